"""Linguistically annotated XML: tokens with a lemma and a part of speech."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.sources.files import file_name

TOKEN_SCHEMA = (
    "_class STRING, t STRING, pos STRUCT<_head: STRING>, lemma STRUCT<_class: STRING>"
)


def read_tokens(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """(file, wordform, part_of_speech, lemma), one row per token of class WORD.

    A file that is not well-formed stops the job.
    """
    tokens = (
        spark.read.format("xml").schema(TOKEN_SCHEMA).option("rowTag", "w")
        .option("mode", "FAILFAST").load(paths)
        .select("*", F.col("_metadata.file_path").alias("path"))
    )
    return tokens.filter(F.col("_class") == "WORD").select(
        file_name(F.col("path")).alias("file"), F.col("t").alias("wordform"),
        F.col("pos._head").alias("part_of_speech"), F.col("lemma._class").alias("lemma"),
    )


def lemma_tables(tokens: DataFrame) -> dict[str, DataFrame]:
    """Distinct words and lemmata of the tokens, one analysis and attestation per token."""
    return {
        "wordforms": tokens.select("wordform").distinct(),
        "lemmata": tokens.select(
            F.col("lemma").alias("modern_lemma"),
            F.col("part_of_speech").alias("lemma_part_of_speech"),
        ).distinct(),
        "analyses": tokens.select("wordform", "part_of_speech", "lemma"),
        "token_attestations": tokens.select("file", "wordform", "part_of_speech", "lemma"),
    }
