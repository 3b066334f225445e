"""The registered queries of this subpackage and the SQL that checks them."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.llm import (
    bpe, exact, hmm, language, licenses, merkle, neighbours, packing, secrets, simhash,
    toxicity, urls, whitening,
)

VOCABULARY = public_tokenizers.path("byte_bpe_50k.json")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    return simhash.near_duplicates(table(spark, sf_dir, "documents"))


def op2_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as files of a tree by source and number; every 50th is a licence file."""
    number = F.col("doc_id")
    name = F.when(number % 50 == 0, F.lit("LICENSE")).otherwise(
        F.concat(number.cast("string"), F.lit(".txt")))
    files = table(spark, sf_dir, "documents").select(
        "doc_id", "text", F.concat_ws(
            "/", "source", F.floor(number / 1000).cast("string"),
            F.floor(number / 50).cast("string"), name).alias("path"))
    return licenses.licensed(files, id_col="doc_id")


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), VOCABULARY)


def op4_hmm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hmm.scored(table(spark, sf_dir, "documents"))


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return neighbours.nearest(table(spark, sf_dir, "embeddings"))


def op6_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judged(table(spark, sf_dir, "pages"))


def op7_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secrets.scanned(table(spark, sf_dir, "documents"))


def op8_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.packed(table(spark, sf_dir, "documents"), VOCABULARY, with_ids=False)


def op9_exact(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact.exact_duplicates(table(spark, sf_dir, "documents"))


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.scored(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op11_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitening.whitened(table(spark, sf_dir, "embeddings"))


def op12_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.predicted(table(spark, sf_dir, "documents"))


def op13_merkle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The manifest of all documents; one in five has its letters lower-cased behind its back."""
    tampered = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0
    return merkle.manifest(table(spark, sf_dir, "documents"), tampered=tampered)


QUERIES = {
    f.__name__: f for f in (
        op1_simhash, op2_licenses, op3_bpe, op4_hmm, op5_neighbours, op6_urls, op7_secrets,
        op8_packing, op9_exact, op10_toxicity, op11_whitening,
        op12_language, op13_merkle)}

_OP6 = r"""
WITH parts AS (
  SELECT page_id, lower(coalesce(url, '')) AS low,
    translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1),
      'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) AS path
  FROM pages),
ruled AS (
  SELECT *, '.' || host AS dotted, CASE
    WHEN dotted LIKE '%.example.net' AND starts_with(path, '/en/') THEN 'example.net/en/'
    WHEN dotted LIKE '%.example.com' AND starts_with(path, '/de/') THEN 'example.com/de/'
    WHEN dotted LIKE '%.org' AND starts_with(path, '/fr/') THEN 'org/fr/'
    WHEN dotted LIKE '%.net' AND starts_with(path, '/') THEN 'net/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule, CASE
    WHEN rule IN ('example.net/en/', 'org/fr/') THEN 'allow'
    WHEN rule IS NOT NULL THEN 'block'
    WHEN regexp_matches(low, '/robots\.txt([^a-z0-9]|$)') THEN 'allow'
    WHEN regexp_matches(low, '(?s)/ads/|/banner/|/cgi-bin/|/wp-login\.php([^a-z0-9]|$)'
      '|([^a-z0-9]|$)phpsessid=|([^a-z0-9]|$)sessionid=|/cart/checkout([^a-z0-9]|$)'
      '|\.casino\.|\.doubleclick\.|/tag/.*/feed/|--.*--.*--') THEN 'block'
    ELSE 'allow' END AS verdict
FROM ruled
"""

_SPANS = r"""
  SELECT doc_id, k, kind, unnest(range(1, len(hits) + 1)) AS i, hits, gaps, least, vals
  FROM (
    SELECT doc_id, 0 AS k, 'assign' AS kind, 8 AS least,
      regexp_extract_all(body, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS hits,
      string_split_regex(body, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)') AS gaps,
      regexp_extract_all(body, '((?i:password|passwd|secret|token|api_?key))["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)', 2) AS vals
    FROM bodies
"""


def _kind_sql(number: int, kind: str, regex: str) -> str:
    quoted = regex.replace("'", "''")
    return (
        f"SELECT doc_id, {number}, '{kind}', 0, regexp_extract_all(body, '{quoted}'), "
        f"string_split_regex(body, '{quoted}'), regexp_extract_all(body, '{quoted}') FROM bodies")


_OP7 = (
    "WITH bodies AS (SELECT doc_id, coalesce(text, '') AS body FROM documents), found AS ("
    + _SPANS + "".join(
        f"    UNION ALL {_kind_sql(n, r.kind, r.regex)}\n"
        for n, r in enumerate(secrets.RULES) if n)
    + r""")),
placed AS (
  SELECT doc_id, k, kind,
    list_sum([length(g) for g in gaps[1:i]]) + coalesce(list_sum([length(h) for h in hits[1:i - 1]]), 0) AS s,
    length(hits[i]) AS n FROM found WHERE length(vals[i]) >= least),
said AS (
  SELECT doc_id,
    count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access,
    count(*) FILTER (k = 2) AS n_hex,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k)
      FILTER (k < 3) AS base,
    string_agg(kind || ':' || CAST(s AS BIGINT) || ':' || CAST(s + n AS BIGINT), ',' ORDER BY s, k) AS spans
  FROM placed GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access,
  coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256,
  coalesce(spans, '') AS spans
FROM documents d LEFT JOIN said s ON d.doc_id = s.doc_id
""")

_OP9 = r"""
WITH bodies AS (
  SELECT doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]', '', 'g') AS body,
    length(coalesce(text, '')) AS points
  FROM documents)
SELECT doc_id, first_value(doc_id) OVER same AS keep_id, count(*) OVER (PARTITION BY body)
    AS group_size, doc_id = first_value(doc_id) OVER same AS kept, sha256(body) AS text_sha256
FROM bodies WINDOW same AS (PARTITION BY body ORDER BY points DESC, doc_id)
"""

# Enough for 16 ** 8 leaves a source and as many sources.
_MERKLE_LEVELS = 8


def _field_sql(column: str) -> str:
    text = f"CAST({column} AS VARCHAR)"
    return f"coalesce(octet_length(encode({text})) || ':' || {text}, '-')"


def _merkle_tree(name: str, key: str, leaves: str) -> str:
    """CTEs `{name}_0` to `{name}_8`: a level's nodes with the hashes beside them, and whether the
    level has a single node."""
    run = f"PARTITION BY {key}, rank // 16 ORDER BY rank"
    sides = f"""
        coalesce(string_agg(hash, '') OVER ({run} ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), '') AS lhs,
        coalesce(string_agg(hash, '') OVER ({run} ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING), '') AS rhs,
        count(*) OVER (PARTITION BY {key}) = 1 AS top"""
    parts = [f"{name}_0 AS (SELECT *, {sides} FROM {leaves})"]
    for level in range(1, _MERKLE_LEVELS + 1):
        parts.append(f"""{name}_{level} AS (SELECT *, {sides} FROM (
            SELECT {key}, rank // 16 AS rank,
                CASE WHEN bool_or(top) THEN min(hash)
                    ELSE sha256(string_agg(hash, '' ORDER BY rank)) END AS hash
            FROM {name}_{level - 1} GROUP BY {key}, rank // 16))""")
    return ",\n".join(parts)


def _merkle_folds(start: str, tree: str, key: str, name: str) -> str:
    """CTEs that fold each row of `start` up the tree: `folded` and the siblings in `said`."""
    parts = []
    for level in range(_MERKLE_LEVELS):
        parts.append(f"""{name}_{level + 1} AS (
            SELECT f.* REPLACE (
                CASE WHEN n.top THEN f.folded ELSE sha256(n.lhs || f.folded || n.rhs) END AS folded,
                CASE WHEN n.top THEN f.said ELSE f.said || n.lhs || n.rhs END AS said)
            FROM {start if level == 0 else f'{name}_{level}'} f JOIN {tree}_{level} n
            ON f.{key} IS NOT DISTINCT FROM n.{key} AND f.{key}_rank // {16 ** level} = n.rank)""")
    return ",\n".join(parts)


_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_FIELDS = ("doc_id", "source", "lang", "n_chars", "text")
# The checksum bit by bit: each bit of each byte, the lowest first.
_CRC32 = """xor(list_reduce(list_prepend(4294967295::BIGINT, flatten(list_transform(
        string_split(CAST(doc_id AS VARCHAR), ''),
        lambda ch: list_transform(range(8), lambda b: (unicode(ch) >> b::INTEGER) & 1)))),
        lambda crc, bit: xor(crc >> 1, CASE WHEN xor(crc, bit) & 1 = 1 THEN 3988292384 ELSE 0 END)),
    4294967295)"""

_OP13 = f"""
WITH hashed AS (
  SELECT doc_id, source, sha256({" || ".join(map(_field_sql, _FIELDS))}) AS hash,
    CASE WHEN {_CRC32} % 5 = 0 THEN
      sha256({" || ".join(_field_sql(_LOWERED if c == "text" else c) for c in _FIELDS)})
    END AS tampered
  FROM documents),
leaves AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, hash) - 1 AS rank
  FROM hashed),
{_merkle_tree("low", "source", "(SELECT source, rank, hash FROM leaves)")},
subroots AS (
  SELECT 0 AS everything, source, hash, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS rank
  FROM low_{_MERKLE_LEVELS}),
{_merkle_tree("high", "everything", "(SELECT everything, rank, hash FROM subroots)")},
begun AS (
  SELECT doc_id, source, hash AS leaf, rank AS source_rank, coalesce(tampered, hash) AS folded,
    '' AS said FROM leaves),
{_merkle_folds("begun", "low", "source", "climbed")},
arrived AS (
  SELECT c.*, 0 AS everything, s.rank AS everything_rank, s.hash AS subroot
  FROM climbed_{_MERKLE_LEVELS} c JOIN subroots s ON c.source IS NOT DISTINCT FROM s.source),
{_merkle_folds("arrived", "high", "everything", "ended")}
SELECT doc_id, leaf, subroot, root.hash AS root, sha256(said) AS proof_sha256,
  folded AS folded_root, folded = root.hash AS verified
FROM ended_{_MERKLE_LEVELS}, (SELECT hash FROM high_{_MERKLE_LEVELS}) root
"""

ORACLE_SQL = {
    "op6_urls": _OP6, "op7_secrets": _OP7, "op9_exact": _OP9, "op13_merkle": _OP13}
