"""Queries on the lemma database: analysed words, lemmata and token attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import is_complete_form
from wordloom.scratch import in_parts

Tables = dict[str, DataFrame]


def analysed_words(db: Tables) -> DataFrame:
    """Words that have an analysis, with it."""
    return db["analyses"].join(db["wordforms"], "wordform")


def words_in_documents(db: Tables, parts: int | None = None) -> DataFrame:
    """Every word with its analyses, attestations and documents, as far as it has them.

    Attestations are sorted in as many `parts` as given, if the session shuffles into fewer.  A
    word has one in a document at most, so no part holds more of a hot word than documents.
    """
    analysed = db["wordforms"].join(db["analyses"], "wordform", "left").select(
        "wordform", "analysis_id", "part_of_speech")
    # The large table is the left side of an inner join, which can be split at a hot word.
    attested = in_parts(
        db["token_attestations"], parts, "analysis_id").join(analysed, "analysis_id")
    without = analysed.join(
        db["token_attestations"].select("analysis_id").distinct(), "analysis_id", "left_anti")
    found = attested.unionByName(without, allowMissingColumns=True)
    return (
        in_parts(found, parts, "document_id")
        .join(db["documents"].drop("word_count"), "document_id", "left")
        .select("wordform", "analysis_id", "part_of_speech", "document_id", "persistent_id")
    )


def tokens_per_document(db: Tables, parts: int | None = None) -> DataFrame:
    """Attested tokens per document, with the number of distinct words among them."""
    per_word = words_in_documents(db, parts).filter(F.col("document_id").isNotNull()).groupBy(
        "document_id", "wordform").agg(F.count(F.lit(1)).alias("n"))
    return per_word.groupBy("document_id").agg(
        F.sum("n").alias("num_tokens"), F.count(F.lit(1)).alias("num_words"))


def count_by_part_of_speech(db: Tables) -> DataFrame:
    return db["analyses"].groupBy("part_of_speech").agg(
        F.count(F.lit(1)).alias("num_analyses")).orderBy("part_of_speech")


def lemma_forms(db: Tables, lemma_id: int | None = None) -> DataFrame:
    """All words with their lemmata, or the forms of one lemma."""
    forms = (
        db["wordforms"].join(db["analyses"], "wordform", "left")
        .join(db["lemmata"], "lemma_id", "left")
        .select("wordform", "analysis_id", "part_of_speech", "lemma_id", "modern_lemma",
                "lemma_part_of_speech")
    )
    return forms if lemma_id is None else forms.filter(F.col("lemma_id") == lemma_id)


def lemmata_per_word(db: Tables) -> DataFrame:
    """Number of lemma rows of every word."""
    return lemma_forms(db).groupBy("wordform").agg(F.count("lemma_id").alias("num_lemmata"))


def complete_lemma_forms(db: Tables) -> DataFrame:
    """Lemma forms that are whole words, not parts or contractions."""
    return lemma_forms(db).filter(is_complete_form(F.col("part_of_speech")))


def rows_with(table: DataFrame, column: str, present: bool = True) -> DataFrame:
    """Rows where a column is, or is not, filled."""
    test = F.col(column).isNotNull() if present else F.col(column).isNull()
    return table.filter(test)


def random_rows(table: DataFrame, key: str, n: int = 10, seed: int = 0) -> DataFrame:
    """A random sample of `n` rows; the same rows however the table is partitioned."""
    drawn = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"|{seed}")))
    return table.orderBy(drawn, key).limit(n)
