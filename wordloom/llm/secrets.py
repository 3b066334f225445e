"""Secret scans by a trigram inverted index.

Each rule's regular expression gives a Boolean query over trigrams: AND of clauses, a clause
being an OR of strings, a string the AND of its trigrams.  Postings (trigram, doc_id) are
built for the trigrams that some rule asks for, met by document, and only the documents
whose postings satisfy a rule's query are verified with its expression.  A rule without a
mandatory trigram scans every text.  DataFrame operations only.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import fresh
from wordloom.scratch import stored

_parser = re._parser
# Most strings that a clause may list; a longer one is left out of the query.
MOST_STRINGS = 64
# Elements of an array, and code points of a text, that are worked on at a time.
RUN, BLOCK = 512, 1024


@dataclass(frozen=True)
class Rule:
    """A secret's kind, its regular expression, and how long a group of it must be."""

    kind: str
    regex: str
    group: int = 0
    least: int = 0


# The first three are given; their order is that of equal starts.
RULES = (
    Rule("assign", r"((?i:password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?"
                   r"([A-Za-z0-9+/_.=-]+)", 2, 8),
    Rule("access", r"AKIA[A-Z0-9]{12,}"),
    Rule("hex", r"[0-9a-f]{32,}"),
    Rule("github", r"gh[pousr]_[A-Za-z0-9]{36,}"),
    Rule("slack", r"xox[abprs]-[A-Za-z0-9-]{10,}"),
    Rule("google", r"AIza[0-9A-Za-z_-]{35}"),
    Rule("stripe", r"[rs]k_live_[0-9A-Za-z]{16,}"),
    Rule("jwt", r"eyJ[A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]{10,}[.][A-Za-z0-9_-]+"),
    Rule("key", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH |PGP )?PRIVATE KEY"),
)
BASE = ("assign", "access", "hex")


def _exact(nodes) -> set[str] | None:
    """All strings that `nodes` match, lower-cased, or None if there are too many."""
    found = {""}
    for op, value in nodes:
        name = str(op)
        if name == "LITERAL":
            some = {chr(value).lower()}
        elif name == "IN" and all(str(o) == "LITERAL" for o, _ in value):
            some = {chr(v).lower() for _, v in value}
        elif name == "SUBPATTERN":
            some = _exact(value[3])
        elif name == "BRANCH":
            parts = [_exact(branch) for branch in value[1]]
            some = None if None in parts else set().union(*parts)
        elif name == "MAX_REPEAT" and value[1] <= 2:
            one = _exact(value[2])
            some = None if one is None else {
                s for n in range(value[0], value[1] + 1)
                for s in ({""} if n == 0 else one if n == 1 else {a + b for a in one for b in one})}
        else:
            some = None
        if some is None or len(found) * len(some) > MOST_STRINGS:
            return None
        found = {a + b for a in found for b in some}
    return found


def trigram_query(regex: str) -> list[list[set[str]]]:
    """The clauses that every match satisfies; no clause if no trigram is mandatory."""
    clauses, run = [], {""}

    def close() -> None:
        nonlocal run
        if all(len(s) >= 3 for s in run):
            clauses.append([{s[i:i + 3] for i in range(len(s) - 2)} for s in sorted(run)])
        run = {""}

    def walk(nodes) -> None:
        nonlocal run
        for op, value in nodes:
            optional = str(op) == "MAX_REPEAT" and value[0] == 0
            some = None if optional else _exact([(op, value)])
            if some is not None and len(run) * len(some) <= MOST_STRINGS:
                run = {a + b for a in run for b in some}
            elif str(op) == "SUBPATTERN":
                walk(value[3])
            else:
                close()
                if str(op) == "MAX_REPEAT" and value[0] >= 1:
                    walk(value[2])
                    close()

    walk(_parser.parse(regex))
    close()
    return clauses


def postings(
    docs: DataFrame, trigrams: list[str], id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """`(trigram, doc_id)`: the inverted index of whole lower-cased texts, for `trigrams`."""
    low = F.lower(F.coalesce(F.col(text_col), F.lit("")))
    asked = F.array(*[F.lit(t) for t in trigrams]) if trigrams else F.array().cast("array<string>")
    return docs.select(F.col(id_col), low.alias("__low")).select(
        F.explode(F.filter(asked, lambda t: F.contains(F.col("__low"), t))).alias("trigram"),
        id_col)


def candidates(
    index: DataFrame, trigrams: list[str], rules, id_col: str = "doc_id",
) -> DataFrame:
    """`(doc_id, rules)`: the rules whose query a document's postings satisfy.

    The postings of a document meet as bits, 60 trigrams to a number, combined map-side.
    """
    words = [trigrams[i:i + 60] for i in range(0, len(trigrams), 60)]
    at = {t: (w, b) for w, word in enumerate(words) for b, t in enumerate(word)}
    bits = [
        F.bit_or(sum(
            (F.when(F.col("trigram") == t, F.lit(1 << b).cast("long"))
             .otherwise(F.lit(0).cast("long")) for b, t in enumerate(word)),
            F.lit(0).cast("long"))).alias(f"__bits{w}")
        for w, word in enumerate(words)]
    met = index.groupBy(id_col).agg(*bits)

    def string(grams: set[str]) -> Column:
        held = F.lit(True)
        for w in range(len(words)):
            mask = sum(1 << at[t][1] for t in grams if at[t][0] == w)
            if mask:
                held &= F.col(f"__bits{w}").bitwiseAND(F.lit(mask).cast("long")) == mask
        return held

    found = []
    for rule in rules:
        held = F.lit(True)
        for clause in trigram_query(rule.regex):
            any_string = F.lit(False)
            for grams in clause:
                any_string |= string(grams)
            held &= any_string
        found.append(F.when(held, F.lit(rule.kind)))
    return met.select(id_col, F.array_compact(F.array(*found)).alias("rules")).filter(
        F.size("rules") > 0)


def _bound(value: Column, body) -> Column:
    """`body(value)`, with `value` evaluated once however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def running(values: Column, combine) -> Column:
    """What `combine` makes of an array of longs up to each place, starting from 0.

    Results are gathered in runs and then shifted by those of the runs before, so an array is
    never copied for each of its elements.
    """
    none = F.array().cast("array<bigint>")

    def last(array: Column) -> Column:
        return F.coalesce(F.try_element_at(array, F.lit(-1)), F.lit(0).cast("long"))

    def gathered(run: Column) -> Column:
        return F.aggregate(run, none, lambda done, v: F.concat(done, F.array(
            combine(last(done), v))))

    def shifted(runs: Column) -> Column:
        before = F.aggregate(
            runs, F.array(F.lit(0).cast("long")),
            lambda done, run: F.concat(done, F.array(combine(last(done), last(run)))))
        return F.flatten(F.zip_with(
            runs, F.slice(before, F.lit(1), F.size(runs)),
            lambda run, base: F.transform(run, lambda v: combine(base, v))))

    def whole(array: Column) -> Column:
        starts = F.sequence(F.lit(1), F.greatest(F.size(array), F.lit(1)), F.lit(RUN))
        return _bound(
            F.transform(starts, lambda at: gathered(F.slice(array, at, F.lit(RUN)))), shifted)

    return _bound(values, whole)


def matches(text: Column, rule: Rule) -> Column:
    """Spans `(start, end)` of a rule in code points: leftmost, non-overlapping.

    The texts between matches and the matches alternate, so their running lengths are the
    positions; short groups are dropped after that.
    """
    pattern = F.lit(rule.regex)
    sizes = F.transform(F.regexp_extract_all(text, pattern, F.lit(0)),
                        lambda s: F.char_length(s).cast("long"))
    gaps = F.transform(F.split(text, rule.regex, -1), lambda s: F.char_length(s).cast("long"))
    kind = "array<struct<start:bigint,end:bigint>>"

    def placed(sizes: Column) -> Column:
        steps = F.zip_with(F.slice(gaps, F.lit(1), F.size(sizes)), sizes, lambda gap, size: gap + size)
        return F.zip_with(running(steps, lambda a, b: a + b), sizes, lambda end, size: F.struct(
            (end - size).alias("start"), end.alias("end")))

    spans = _bound(sizes, placed)
    if rule.least:
        long_enough = F.transform(
            F.regexp_extract_all(text, pattern, F.lit(rule.group)),
            lambda s: F.char_length(s) >= rule.least)
        spans = F.transform(
            F.filter(
                F.arrays_zip(spans.alias("span"), long_enough.alias("long_enough")),
                lambda x: x["long_enough"]),
            lambda x: x["span"])
    return F.when(F.regexp_like(text, pattern), spans).otherwise(F.array().cast(kind))


def _named(number: int, kind: str):
    return lambda s: F.struct(
        s["start"].alias("start"), F.lit(number).alias("number"), F.lit(kind).alias("kind"),
        s["end"].alias("end"))


def _of_kind(kind: str):
    return lambda s: s["kind"] == kind


def with_spans(
    docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
    spans_col: str = "spans",
) -> DataFrame:
    """`docs` with a column `spans_col`: all secrets as `(start, number, kind, end)`, by start,
    then in the order of the rules.  A null text has none."""
    queries = {r.kind: trigram_query(r.regex) for r in rules}
    indexed = [r for r in rules if queries[r.kind]]
    trigrams = sorted({t for q in queries.values() for c in q for grams in c for t in grams})
    found = candidates(
        stored(postings(docs, trigrams, id_col, text_col), "postings"), trigrams, indexed, id_col
    )
    found_id, found_rules = fresh(docs, "found_id", "found_rules")
    found = found.select(F.col(id_col).alias(found_id), F.col("rules").alias(found_rules))
    text = F.coalesce(F.col(text_col), F.lit(""))
    kind = "array<struct<start:bigint,number:int,kind:string,end:bigint>>"
    parts = []
    for number, rule in enumerate(rules):
        spans = F.transform(matches(text, rule), _named(number, rule.kind))
        if rule in indexed:
            asked = F.coalesce(F.array_contains(found_rules, rule.kind), F.lit(False))
            spans = F.when(asked, spans).otherwise(F.array().cast(kind))
        parts.append(spans)
    joined = docs.join(
        found.hint("shuffle_hash"), F.col(id_col).eqNullSafe(F.col(found_id)), "left")
    return joined.withColumn(spans_col, F.array_sort(F.concat(*parts))).drop(
        found_id, found_rules)


def _said(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def scanned(docs: DataFrame, rules=RULES, id_col: str = "doc_id",
            text_col: str = "text") -> DataFrame:
    """`(doc_id, n_assign, n_access, n_hex, base_sha256, spans)` for every row of `docs`.

    `spans` is `kind:start:end` of all secrets, comma-joined; `base_sha256` hashes those of
    the three base kinds.  A null or empty text has none: counts 0, an empty string.  Rows
    that repeat an id are each scanned; an empty table gives no rows; other columns are not
    looked at.
    """
    rows = with_spans(docs.select(id_col, text_col), rules, id_col, text_col)
    spans = F.col("spans")
    counts = [
        F.size(F.filter(spans, _of_kind(kind))).cast("long").alias(f"n_{kind}")
        for kind in BASE]
    base = F.filter(spans, lambda s: s["kind"].isin(*BASE))
    return rows.select(
        id_col, *counts, F.sha2(_said(base), 256).alias("base_sha256"),
        _said(spans).alias("spans"))


def redacted(docs: DataFrame, rules=RULES, id_col: str = "doc_id", text_col: str = "text",
             mark: str = "[secret]") -> DataFrame:
    """`docs` with every secret of the texts replaced by `mark`; overlapping ones by one.

    Null texts stay null, rows that repeat an id are each redacted, an empty table gives no
    rows, and other columns stay as they are, whatever their names.
    """
    [spans] = fresh(docs, "secret_spans")
    text = F.coalesce(F.col(text_col), F.lit(""))
    found = with_spans(docs, rules, id_col, text_col, spans)
    return found.withColumn(
        text_col, F.when(F.size(spans) > 0, _without(text, F.col(spans), mark)).otherwise(
            F.col(text_col))
    ).select(*docs.columns)


def _without(text: Column, spans: Column, mark: str) -> Column:
    """A text with its spans, in order of their starts, replaced: each piece that stays is cut from
    the blocks that it lies in, not from the whole text."""
    ends = running(F.transform(spans, lambda s: s["end"]), F.greatest)

    def piece(blocks: Column, start: Column, end: Column) -> Column:
        def block(at: Column) -> Column:
            return F.floor(at / BLOCK).cast("int")

        near = F.slice(blocks, block(start) + 1, block(end) - block(start) + 1)
        return F.substring(
            F.array_join(near, ""), (start - block(start) * BLOCK + 1).cast("int"),
            (end - start).cast("int"))

    def cut(blocks: Column) -> Column:
        def kept(ends: Column) -> Column:
            before = F.concat(F.array(F.lit(0).cast("long")), ends)
            pieces = F.zip_with(
                spans, F.slice(before, F.lit(1), F.size(spans)),
                lambda s, at: F.when(s["start"] >= at, F.concat(
                    piece(blocks, at, s["start"]), F.lit(mark))).otherwise(F.lit("")))
            rest = piece(blocks, F.element_at(ends, -1), F.char_length(text).cast("long"))
            return F.array_join(F.concat(pieces, F.array(rest)), "")

        return _bound(ends, kept)

    return _bound(F.regexp_extract_all(text, F.lit(f"(?s).{{1,{BLOCK}}}"), F.lit(0)), cut)
