"""Attestations that carry what corpus and year queries ask of their document.

A document's corpora are a sparse bit set, `array<struct<block, bits>>`: bit `corpus_id mod 64` of block
`corpus_id div 64`, blocks in order, so equal sets are equal values that rows can be grouped by.  Bags of
words (one row a document) meet the marks before they are exploded into attestations; every
query of all words after that reads one table without a join on documents.  That table may be
the marked bags themselves, exploded as they are read: attestations then never lie on disk.
Sums are formed per word and set first, and only then spread over the corpora of the set.
"""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import effective_year
from wordloom.operators.lookup import Words, for_words, is_listed

BITS = 64
NO_CORPORA = "array<struct<block:bigint,bits:bigint>>"
MARKS = ["title", "word_count", "pub_year", "year", "corpora"]


@dataclass(frozen=True)
class Marked:
    """Marked attestations, and the model of whose tables they were made.

    A function in place of the rows makes them when a query asks for them; `at_hand` tells
    whether it has what it makes them of.
    """

    given: DataFrame | Callable[[], DataFrame]
    model: object
    at_hand: Callable[[], bool] = lambda: True

    @classmethod
    def of(
        cls, rows: DataFrame | Callable[[], DataFrame], model,
        at_hand: Callable[[], bool] = lambda: True,
    ) -> "Marked":
        return cls(rows, model, at_hand)

    @property
    def rows(self) -> DataFrame:
        return self.given if isinstance(self.given, DataFrame) else self.given()

    def holds_for(self, model) -> bool:
        """False once one of the model's tables was replaced."""
        return model is self.model or all(
            getattr(model, name) is getattr(self.model, name)
            for name in ("attestations", "documents", "corpus_documents"))


def corpus_sets(corpus_documents: DataFrame) -> DataFrame:
    """`(document_id, corpora)`; a membership that is stated twice counts once."""
    bit = F.expr(f"shiftleft(1L, cast(pmod(corpus_id, {BITS}) as int))")
    return (
        corpus_documents.filter("corpus_id is not null and document_id is not null")
        .groupBy("document_id", F.floor(F.col("corpus_id") / BITS).alias("block"))
        .agg(F.bit_or(bit).alias("bits"))
        .groupBy("document_id")
        .agg(F.sort_array(F.collect_list(F.struct("block", "bits"))).alias("corpora"))
    )


def document_marks(model) -> DataFrame:
    """`(document_id, title, word_count, pub_year, year, corpora)`, one row a document.

    `year` is the effective one.  Members of corpora that are no documents have a row too.
    """
    documents = model.documents.select(
        "document_id", "title", "word_count", "pub_year", effective_year().alias("year"))
    return documents.join(
        corpus_sets(model.corpus_documents), "document_id", "full").withColumn(
        "corpora", F.coalesce("corpora", F.lit([]).cast(NO_CORPORA)))


def marked(model, words: Words = None, few: bool | None = None) -> DataFrame:
    """Attestations with the marks of their document, of the words asked for.

    The model's own marked table where it has one that still holds; otherwise the attestations
    are joined with the marks, which shuffles them.  For `few` words (by default, those of a
    list) that is cheaper than marking all bags, so a table not at hand is not made for them.
    """
    few = is_listed(words) if few is None else few
    known = getattr(model, "marked", None)
    if known is not None and known.holds_for(model) and (known.at_hand() or not few):
        return for_words(known.rows, words)
    rows = for_words(model.attestations, words).join(
        document_marks(model), "document_id", "left")
    return rows.withColumn("corpora", F.coalesce("corpora", F.lit([]).cast(NO_CORPORA)))


def in_corpus(corpus_id: int) -> Column:
    """1 if the row's document is in the corpus, else 0."""
    block, bit = divmod(corpus_id, BITS)
    bits = F.element_at(F.map_from_entries("corpora"), F.lit(block).cast("long"))
    return F.coalesce(F.getbit(bits, F.lit(bit)).cast("long"), F.lit(0).cast("long"))


def number_of_corpora() -> Column:
    return F.aggregate(
        "corpora", F.lit(0).cast("long"), lambda n, b: n + F.bit_count(b["bits"]))


def each_corpus(rows: DataFrame, outer: bool = False) -> DataFrame:
    """`rows` once for each corpus of their set, as `corpus_id`; with `outer`, a row without any
    has a NULL one."""
    ids = F.flatten(F.transform("corpora", lambda b: F.transform(
        F.filter(F.sequence(F.lit(0), F.lit(BITS - 1)), lambda i: F.getbit(b["bits"], i) == 1),
        lambda i: b["block"] * BITS + i)))
    explode = F.explode_outer if outer else F.explode
    return rows.select(
        *[c for c in rows.columns if c != "corpora"], explode(ids).alias("corpus_id"))


def summed_by_corpus(
    rows: DataFrame, keys: list[str], sums: dict[str, Column], outer: bool = False,
) -> DataFrame:
    """`(keys, corpus_id, sums)`: summed by set of corpora, and once for each corpus of a set."""
    by_set = rows.groupBy(*keys, "corpora").agg(
        *[F.sum(value).alias(name) for name, value in sums.items()])
    return each_corpus(by_set, outer)
