"""The tab-separated file of morphological paradigms."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.files import delimited

# The nine columns of the file.
PARADIGM_FILE_SCHEMA = (
    "wordform STRING, corpus_freq STRING, component_codes STRING, human_readable_c_code STRING, "
    "first_year STRING, last_year STRING, dict_ids STRING, pos_tags STRING, int_ids STRING"
)


def read_paradigm_file(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """The rows after the first line of each file; that line is noise."""
    return delimited(spark, paths, PARADIGM_FILE_SCHEMA, "\t", header=True)


def external_ids(rows: DataFrame, sources: tuple[str, ...] = ("WNT", "MNW")) -> DataFrame:
    """(wordform, source_name, source_id) of the dictionary ids of a paradigm file."""
    ids = rows.select("wordform", F.explode(F.split("dict_ids", "[#@]")).alias("id"))
    parts = F.split("id", "_")
    return (
        ids.filter(F.col("id") != "")
        .select(
            "wordform", parts[0].alias("source_name"),
            F.get(parts, F.lit(1)).alias("source_id"),
        )
        .filter(F.col("source_name").isin(*sources))
    )
