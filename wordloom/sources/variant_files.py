"""Rankings of OCR variants and the files of the anagram index."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.files import delimited, line_order, text_lines

# Seven '#'-separated columns; the meaning of two is not documented.
CANDIDATE_SCHEMA = (
    "ocr_variant STRING, corpus_frequency LONG, correction_candidate STRING, `?1` LONG, "
    "ld INT, `?2` STRING, anahash LONG"
)


def read_correction_candidates(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """One file, several files or a whole folder of correction candidates, with `line_order`."""
    return delimited(spark, paths, CANDIDATE_SCHEMA, "#").select("*", line_order())


def read_ranked_variants(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(wordform, frequency, wordform_source, levenshtein_distance): fields 1, 2, 3 and 6.

    A word keeps its first line.  Gzip files cannot be split, but the aggregation that picks
    the first line spreads their rows over the cluster.
    """
    fields = F.split("value", "#")
    rows = text_lines(spark, paths).select(
        fields[0].alias("wordform"),
        F.struct(
            fields[1].cast("long").alias("frequency"),
            fields[2].alias("wordform_source"),
            fields[5].cast("long").alias("levenshtein_distance"),
        ).alias("rest"),
        "line_order",
    )
    first = rows.groupBy("wordform").agg(F.min_by("rest", "line_order").alias("rest"))
    return first.select("wordform", "rest.*")


def read_alphabet(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    return delimited(spark, paths, "char STRING, frequency LONG, char_hash LONG", "\t")


def read_anahash_file(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(anahash, variant_id, wordform) from lines `hash~word#word...`."""
    parts = F.split("value", "~", 2)
    return text_lines(spark, paths).select(
        parts[0].cast("long").alias("anahash"),
        F.posexplode(F.split(parts[1], "#")).alias("variant_id", "wordform"),
    )


def read_confusions(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """`confusion` from lines `value#...` that have exactly two parts."""
    parts = F.split("value", "#")
    return text_lines(spark, paths).filter(F.size(parts) == 2).select(
        parts[0].cast("long").alias("confusion"))


def read_confusion_index(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(confusion, list_index, word_hash) from lines `confusion#h1,h2,...`."""
    parts = F.split("value", "#", 2)
    return text_lines(spark, paths).select(
        parts[0].cast("long").alias("confusion"),
        F.posexplode(F.split(parts[1], ",")).alias("list_index", "_hash"),
    ).select("confusion", "list_index", F.col("_hash").cast("long").alias("word_hash"))
