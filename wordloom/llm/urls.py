"""URL filters: pattern rules indexed by their rarest literal token.

A rule is run only on the URLs that hold its index token; a rule without a literal token
is run on all.  Which token of a rule is rarest is counted over all URLs.  Equal URLs are
judged once.  DataFrame operations only; what is broadcast has a row for each rule.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.scratch import stored

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


@dataclass(frozen=True)
class HostRule:
    """Fits a host and its subdomains where the path starts with the rule's path."""

    verdict: str
    rule: str

    @property
    def regex(self) -> str:
        host, _, path = self.rule.partition("/")
        return r"^(?:[^/]*\.)?" + re.escape(host) + "/" + re.escape(path)

    @property
    def tokens(self) -> list[str]:
        # The last token of the path may go on in the URL.
        return re.findall(r"[a-z0-9]+(?![a-z0-9]*$)", self.rule.lower())


@dataclass(frozen=True)
class PatternRule:
    """Fits lower-cased URLs: `*` is any run of characters, `^` a separator or the end."""

    verdict: str
    pattern: str

    @property
    def regex(self) -> str:
        kinds = {"*": ".*", "^": "(?:[^a-z0-9]|$)"}
        return "(?s)" + "".join(kinds.get(c) or re.escape(c) for c in self.pattern)

    @property
    def tokens(self) -> list[str]:
        return re.findall(r"(?<=[^a-z0-9*])[a-z0-9]+(?=[^a-z0-9*])", self.pattern)


HOST_RULES = (
    HostRule("block", "net/"),
    HostRule("allow", "example.net/en/"),
    HostRule("block", "example.com/de/"),
    HostRule("allow", "org/fr/"),
)
PATTERN_RULES = (
    PatternRule("block", "/ads/"),
    PatternRule("block", "/banner/"),
    PatternRule("block", "/cgi-bin/"),
    PatternRule("block", "/wp-login.php^"),
    PatternRule("block", "^phpsessid="),
    PatternRule("block", "^sessionid="),
    PatternRule("block", "/cart/checkout^"),
    PatternRule("block", ".casino."),
    PatternRule("block", ".doubleclick."),
    PatternRule("block", "/tag/*/feed/"),
    PatternRule("block", "--*--*--"),
    PatternRule("allow", "/robots.txt^"),
)


def url_host(url: Column) -> Column:
    """What follows the first `://`, up to `/`, `?`, `#` or the end, A-Z lower-cased."""
    found = F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://([^/?#]*)", 1)
    return F.translate(found, UPPER, LOWER)


def url_path(url: Column) -> Column:
    """What follows the host, up to `?`, `#` or the end."""
    return F.regexp_extract(F.coalesce(url, F.lit("")), r"(?s)^.*?://[^/?#]*([^?#]*)", 1)


def _rule_table(spark, rules) -> DataFrame:
    rows = [
        (n, r.rule if isinstance(r, HostRule) else None, r.verdict, r.regex, sorted(set(r.tokens)))
        for n, r in enumerate(rules)]
    return spark.createDataFrame(
        rows, "number int, rule string, verdict string, regex string, tokens array<string>")


def rule_index(rules: DataFrame, tokens: DataFrame) -> DataFrame:
    """`rules` with the `token` each is indexed by, null for rules without literal tokens.

    `tokens` has a row for each token of each URL.  The rarest is chosen, then the smallest.
    """
    named = rules.select("number", F.explode("tokens").alias("token"))
    seen = (
        tokens.join(F.broadcast(named.select("token").distinct()), "token")
        .groupBy("token").agg(F.count("*").alias("n"))
    )
    rarest = (
        named.join(F.broadcast(seen), "token", "left")
        .groupBy("number")
        .agg(F.min(F.struct(F.coalesce("n", F.lit(0)), "token")).alias("least"))
        .select("number", F.col("least.token").alias("token"))
    )
    return rules.join(rarest, "number", "left")


def judged(
    pages: DataFrame, id_col: str = "page_id", url_col: str = "url",
    host_rules=HOST_RULES, pattern_rules=PATTERN_RULES, default: str = "allow",
) -> DataFrame:
    """`(page_id, host, path, rule, verdict)` for every row of `pages`.

    `rule` is the longest host rule that fits, else null.  The verdict is that rule's, else
    that of the first pattern rule that fits, allowing ones before blocking ones, else
    `default`.  A null URL, or one without `://`, has an empty host and path, fits no rule
    and gets `default`.  Rows that repeat an id or URL are each judged; an empty table gives
    no rows; other columns are not looked at.
    """
    spark = pages.sparkSession
    rules = _rule_table(spark, [*host_rules, *pattern_rules])
    rows = pages.select(
        F.col(id_col), F.col(url_col).alias("url"), url_host(F.col(url_col)).alias("host"),
        url_path(F.col(url_col)).alias("path"))
    urls = stored(
        rows.filter("url is not null").select("url", "host", "path").distinct()
        .withColumn("token", F.array_distinct(F.split(F.lower("url"), "[^a-z0-9]+"))),
        "urls")
    tokens = urls.select("url", "host", "path", F.explode("token").alias("token"))
    index = stored(rule_index(rules, tokens), "rule-index")
    target = F.when(F.col("rule").isNull(), F.lower("url")).otherwise(F.concat("host", "path"))
    indexed = tokens.join(
        F.broadcast(index.filter("token is not null")), "token",
    ).filter(F.regexp_like(target, F.col("regex")))
    run_on_all = [
        F.when(
            F.regexp_like(
                F.concat("host", "path") if isinstance(r, HostRule) else F.lower("url"),
                F.lit(r.regex)),
            F.struct(
                F.lit(r.rule if isinstance(r, HostRule) else None).cast("string").alias("rule"),
                F.lit(r.verdict).alias("verdict"), F.lit(n).alias("number")))
        for n, r in enumerate([*host_rules, *pattern_rules]) if not r.tokens]
    kind = "array<struct<rule:string,verdict:string,number:int>>"
    fitting = F.array_compact(F.array(*run_on_all)) if run_on_all else F.array().cast(kind)
    scanned = urls.select("url", F.inline(fitting))
    best = (
        indexed.select("url", "rule", "verdict", "number")
        .unionByName(scanned.select("url", "rule", "verdict", "number"))
        .groupBy("url").agg(
            F.max(F.when(F.col("rule").isNotNull(), F.struct(
                F.length("rule").alias("size"), "rule", "verdict"))).alias("host_rule"),
            F.min(F.when(F.col("rule").isNull(), F.struct(
                (F.col("verdict") != "allow").alias("blocks"), "number", "verdict"),
            )).alias("pattern_rule"),
        )
        .select(
            "url", F.col("host_rule.rule").alias("rule"),
            F.coalesce("host_rule.verdict", "pattern_rule.verdict").alias("verdict"))
    )
    return rows.join(stored(best, "judged-urls"), "url", "left").select(
        id_col, "host", "path", "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"))
