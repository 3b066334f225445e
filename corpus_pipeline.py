"""From raw documents to packed token sequences, stage by stage.

Each stage works on all that the one before kept; `run` writes a stage's documents as Parquet in the
folder that all executors share and reads them again as the input of the next.  Null ids and texts,
repeated rows, empty tables and further columns of any name are handled as each operator states.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from wordloom.llm import exact, packing, secrets, simhash, toxicity
from wordloom.llm.queries import VOCABULARY, table
from wordloom.scratch import stored


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the pattern grammar rejects go; a null or empty text is never rejected
    unless its like were labelled toxic."""
    return toxicity.without_toxic(docs, table(spark, sf_dir, "labels"))


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of texts equal without white space, the longest stays, then the smallest id; null texts
    are empty ones."""
    return exact.without_exact_duplicates(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each component of fingerprints within three bits, the smallest id stays."""
    return simhash.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Secrets are replaced by a mark; every document stays, a null text as it is."""
    return secrets.redacted(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of 2048 or a smaller power of two; a null text is an empty one."""
    return packing.packed(docs, VOCABULARY)


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_exact_copies),
    ("simhash near-dedup", drop_near_copies),
    ("secret scans", redact_secrets),
    ("packing", pack),
]

# Packing is no SQL; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
