"""Links between words, always stored in both directions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.anahash import anahash

LINK = ["wordform_from", "wordform_to"]


def both_directions(
    pairs: DataFrame, from_column: str, to_column: str, extra: Sequence[str] = (),
    order_by: str | None = None,
) -> DataFrame:
    """(wordform_from, wordform_to, forward, extra columns): two rows per unordered pair.

    Self links are dropped.  A pair that occurs again, in either direction, keeps its first
    occurrence by `order_by`, or without it the smallest; a map-side aggregation finds it, so
    a pair repeated any number of times stays cheap.
    """
    low, high = F.least(from_column, to_column), F.greatest(from_column, to_column)
    content = F.struct(
        F.col(from_column).alias("wordform_from"), F.col(to_column).alias("wordform_to"),
        *[F.col(c) for c in extra],
    )
    first = (
        pairs.filter(F.col(from_column) != F.col(to_column))
        .groupBy(low.alias("_low"), high.alias("_high"))
        .agg(F.min_by(content, F.col(order_by) if order_by else content).alias("p"))
    )

    def direction(start: str, end: str, forward: bool) -> Column:
        return F.struct(
            F.col(f"p.{start}").alias("wordform_from"), F.col(f"p.{end}").alias("wordform_to"),
            F.lit(forward).alias("forward"), *[F.col(f"p.{c}").alias(c) for c in extra],
        )

    return first.select(F.inline(F.array(
        direction("wordform_from", "wordform_to", True),
        direction("wordform_to", "wordform_from", False),
    )))


def new_links(links: DataFrame, directed: DataFrame) -> DataFrame:
    """Links not in the table yet; each direction is checked by itself."""
    return directed.select(*LINK).distinct().join(links, LINK, "left_anti")


def link_sources(
    directed: DataFrame, lexicon_id: int, from_correct: bool, to_correct: bool,
) -> DataFrame:
    """The lexicon's statement about each direction; the flags swap on the way back."""
    forward = F.col("forward")
    given = set(directed.columns)
    return directed.select(
        *LINK, F.lit(lexicon_id).cast("long").alias("lexicon_id"),
        F.when(forward, F.lit(from_correct)).otherwise(F.lit(to_correct))
        .alias("wordform_from_correct"),
        F.when(forward, F.lit(to_correct)).otherwise(F.lit(from_correct))
        .alias("wordform_to_correct"),
        (F.col("ld").cast("int") if "ld" in given else F.lit(None).cast("int")).alias("ld"),
        F.lit(None).cast("long").alias("anahash_difference"),
    )


def unmapped_pairs(
    pairs: DataFrame, words: DataFrame, from_column: str, to_column: str,
) -> DataFrame:
    """Pairs with a side that is no known word; they would be lost in a join."""
    known = words.select("wordform").distinct()
    return pairs.join(
        known.withColumnRenamed("wordform", from_column).withColumn("_f", F.lit(True)),
        from_column, "left",
    ).join(
        known.withColumnRenamed("wordform", to_column).withColumn("_t", F.lit(True)),
        to_column, "left",
    ).filter(F.col("_f").isNull() | F.col("_t").isNull()).select(from_column, to_column)


def add_links(
    links: DataFrame, sources: DataFrame, pairs: DataFrame, lexicon_id: int,
    from_column: str = "wordform_from", to_column: str = "wordform_to",
    from_correct: bool = False, to_correct: bool = True,
) -> tuple[DataFrame, DataFrame]:
    """Link pairs and record the lexicon once per pair: (links to add, sources to add).

    With the default flags a pair is a spelling correction.  Doing it twice adds nothing.
    """
    directed = both_directions(pairs, from_column, to_column)
    stated = link_sources(directed, lexicon_id, from_correct, to_correct)
    return new_links(links, directed), stated.join(
        sources, [*LINK, "lexicon_id"], "left_anti")


def measure_links(sources: DataFrame, alphabet: dict[str, int] | None = None) -> DataFrame:
    """Fill the edit distance and the hash difference where they are missing; no join."""
    difference = anahash(F.col("wordform_to"), alphabet) - anahash(
        F.col("wordform_from"), alphabet)
    return sources.withColumns({
        "ld": F.coalesce("ld", F.levenshtein(*LINK)),
        "anahash_difference": F.coalesce(F.col("anahash_difference"), difference),
    })
