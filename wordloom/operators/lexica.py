"""Adding and removing lexica."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import preprocess
from wordloom.model import Model
from wordloom.operators import links as L
from wordloom.operators.words import cleaned, new_words
from wordloom.schema import MODEL


def plus(model: Model, additions: dict[str, DataFrame]) -> Model:
    """The model with rows added to some of its tables."""
    return replace(model, **{
        name: getattr(model, name).unionByName(rows) for name, rows in additions.items()})


def next_id(table: DataFrame, column: str) -> int:
    return (table.agg(F.max(column)).first()[0] or 0) + 1


def _lexicon_row(model: Model, lexicon_id: int, name: str, vocabulary: bool) -> DataFrame:
    spark = model.lexica.sparkSession
    return spark.createDataFrame([(lexicon_id, name, vocabulary)], MODEL["lexica"])


def add_lexicon(
    model: Model, name: str, vocabulary: bool, wordforms: DataFrame,
    preprocess_words: bool = True, lexicon_id: int | None = None,
) -> dict[str, DataFrame]:
    """Rows to add for a word list: new words, the lexicon and its membership."""
    if lexicon_id is None:
        lexicon_id = next_id(model.lexica, "lexicon_id")
    members = cleaned(wordforms, preprocess_words)
    return {
        "words": new_words(model.words, wordforms, preprocess_words),
        "lexica": _lexicon_row(model, lexicon_id, name, vocabulary),
        "lexicon_words": members.select(
            F.lit(lexicon_id).cast("long").alias("lexicon_id"), "wordform"),
    }


def add_lexicon_with_links(
    model: Model, name: str, vocabulary: bool, pairs: DataFrame, from_column: str,
    to_column: str, from_correct: bool, to_correct: bool, preprocess_words: bool = True,
    extra: Sequence[str] = (), order_by: str | None = None, lexicon_id: int | None = None,
) -> dict[str, DataFrame]:
    """Rows to add for a list of word pairs: a lexicon of both sides, and their links."""
    if lexicon_id is None:
        lexicon_id = next_id(model.lexica, "lexicon_id")
    wordforms = pairs.select(
        F.explode(F.array(from_column, to_column)).alias("wordform"))
    additions = add_lexicon(model, name, vocabulary, wordforms, preprocess_words, lexicon_id)
    if preprocess_words:
        pairs = pairs.withColumns({
            c: preprocess(F.col(c)) for c in (from_column, to_column)})
    pairs = pairs.filter((F.col(from_column) != "") & (F.col(to_column) != ""))
    directed = L.both_directions(pairs, from_column, to_column, extra, order_by)
    return {
        **additions,
        "links": L.new_links(model.links, directed),
        "link_sources": L.link_sources(directed, lexicon_id, from_correct, to_correct),
    }


def add_correction_candidates(
    model: Model, name: str, candidates: DataFrame, order_by: str | None = None,
    lexicon_id: int | None = None,
) -> dict[str, DataFrame]:
    """OCR variants (wrong) linked to their correction candidates (right), with distance."""
    return add_lexicon_with_links(
        model, name, False, candidates, "ocr_variant", "correction_candidate", False, True,
        preprocess_words=False, extra=["ld"], order_by=order_by, lexicon_id=lexicon_id,
    )


def delete_lexicon(model: Model, lexicon_id: int) -> Model:
    """Without the lexicon, its membership and its statements; words and links stay."""
    def others(df: DataFrame) -> DataFrame:
        return df.filter(~F.col("lexicon_id").eqNullSafe(lexicon_id))

    return replace(
        model, lexica=others(model.lexica), lexicon_words=others(model.lexicon_words),
        link_sources=others(model.link_sources),
    )
