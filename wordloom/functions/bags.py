"""Bags of words: the term frequencies of one document, counted inside its row."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import tokens


def _shifted(array: str, step: int, filler: Column) -> Column:
    """The array moved one place right (-1) or left (+1), of the same length."""
    rest = F.greatest(F.size(array) - 1, F.lit(0))
    if step < 0:
        return F.concat(F.array(filler), F.slice(array, F.lit(1), rest))
    return F.concat(F.slice(array, F.lit(2), rest), F.array(filler))


def count_in_rows(df: DataFrame, token_array: str, bag: str = "bag") -> DataFrame:
    """Replace an array of tokens by an array of (wordform, frequency).

    A document's tokens all sit in one row, so they are sorted and run-length counted there:
    the (document, word) aggregation needs no shuffle.  The lambdas use only their own
    arguments; an outer column in one would be computed again for every element as soon as
    the optimizer merges the projections.
    """
    df = df.withColumn("_sorted", F.sort_array(token_array)).drop(token_array)
    before = _shifted("_sorted", -1, F.lit(None).cast("string"))
    starts = F.zip_with("_sorted", before, lambda w, b: F.when(~w.eqNullSafe(b), w))
    df = df.withColumn("_starts", F.filter(
        F.transform(starts, lambda w, i: F.when(w.isNotNull(), F.struct(
            w.alias("wordform"), i.alias("at")))),
        lambda run: run.isNotNull(),
    )).withColumn("_size", F.size("_sorted")).drop("_sorted")
    end = F.struct(F.lit(None).cast("string").alias("wordform"), F.col("_size").alias("at"))
    runs = F.zip_with("_starts", _shifted("_starts", 1, end), lambda run, following: F.struct(
        run["wordform"].alias("wordform"),
        (following["at"] - run["at"]).cast("long").alias("frequency"),
    ))
    empty = F.lit([]).cast("array<struct<wordform:string,frequency:bigint>>")
    runs = F.when(F.size("_starts") > 0, runs).otherwise(empty)
    return df.withColumn(bag, runs).drop("_starts", "_size")


def bags_of_texts(
    texts: DataFrame, text: str = "text", max_length: int | None = None,
) -> DataFrame:
    """One row per text: its other columns, `word_count` and `bag`; longer words than
    `max_length`, if given, are left out."""
    df = texts.withColumn("_tokens", tokens(F.col(text), max_length)).drop(text)
    df = df.withColumn("word_count", F.coalesce(F.size("_tokens"), F.lit(0)).cast("long"))
    return count_in_rows(df, "_tokens")


def bags_of_word_lists(lists: DataFrame, words: str = "words") -> DataFrame:
    """One row per word list, case kept: its other columns, `word_count` and `bag`."""
    df = lists.withColumn("word_count", F.coalesce(F.size(words), F.lit(0)).cast("long"))
    return count_in_rows(df, words)


def long_frame(bags: DataFrame, *keys: str) -> DataFrame:
    """(keys, wordform, frequency): the sparse term-document matrix as rows.

    An outer explode, with its NULL row of an empty bag dropped: a plain explode makes the
    optimizer add a size filter that computes the whole bag a second time.
    """
    rows = bags.select(*keys, F.explode_outer("bag").alias("_t"))
    return rows.filter(F.col("_t").isNotNull()).select(*keys, "_t.wordform", "_t.frequency")
