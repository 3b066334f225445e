"""Searching words by pattern and by ending."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.model import Model


def regexp_search(model: Model, pattern: str, limit: int = 500) -> DataFrame:
    """The first matching words in spelling order; the pattern is a Java regular expression."""
    return model.words.filter(F.col("wordform").rlike(pattern)).select(
        "wordform").orderBy("wordform").limit(limit)


def regexp_search_total(model: Model, pattern: str) -> DataFrame:
    return model.words.filter(F.col("wordform").rlike(pattern)).agg(
        F.count(F.lit(1)).alias("total"))


def suffix_pairs(
    model: Model, suffix_1: str, suffix_2: str = "", min_freq: int = 10,
) -> DataFrame:
    """Words ending in `suffix_1` whose form with `suffix_2` exists, both above `min_freq`."""
    frequent = model.word_frequency.filter(F.col("frequency") > min_freq)
    swapped = F.concat(
        F.expr(f"left(wordform, length(wordform) - {len(suffix_1)})"), F.lit(suffix_2))
    first = frequent.filter(F.col("wordform").endswith(suffix_1)).select(
        F.col("wordform").alias("word1"), F.col("frequency").alias("word1_freq"),
        swapped.alias("word2"),
    )
    second = frequent.filter(F.col("wordform").endswith(suffix_2)).select(
        F.col("wordform").alias("word2"), F.col("frequency").alias("word2_freq"))
    return first.join(second, "word2").select("word1", "word1_freq", "word2", "word2_freq")
