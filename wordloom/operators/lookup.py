"""Choosing the words a query is about."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# A list longer than this belongs in a DataFrame, where it is joined.
MAX_LISTED = 1000

Words = str | Sequence[str] | DataFrame | None


def for_words(df: DataFrame, words: Words, column: str = "wordform") -> DataFrame:
    """Rows about one word, a short list of words, a DataFrame of words, or (None) all.

    A literal becomes a filter that reaches the scan; a DataFrame becomes a semi join, which
    Spark broadcasts only when the statistics say it is small.
    """
    if words is None:
        return df
    if isinstance(words, str):
        return df.filter(F.col(column) == words)
    if isinstance(words, DataFrame):
        wanted = words.select(F.col(words.columns[0]).alias(column))
        return df.join(wanted, column, "left_semi")
    words = list(words)
    if len(words) > MAX_LISTED:
        raise ValueError(f"{len(words)} words listed; pass a DataFrame of words instead")
    return df.filter(F.col(column).isin(words))


def is_listed(words: Words) -> bool:
    """True for one word or a list, of which there are at most `MAX_LISTED`."""
    return words is not None and not isinstance(words, DataFrame)
