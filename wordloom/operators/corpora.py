"""Adding corpora, and the tables derived from attestations."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import component_code, preprocess
from wordloom.model import Model
from wordloom.operators.lexica import next_id
from wordloom.operators.ranks import numbered
from wordloom.operators.words import new_words
from wordloom.schema import DOCUMENT_COLUMNS, MODEL


def attestations_of(
    frequencies: DataFrame, documents: DataFrame, key: str = "file",
) -> DataFrame:
    """(wordform, document_id, frequency) of term frequencies keyed by file."""
    return frequencies.join(documents.select(key, "document_id"), key).select(
        "wordform", "document_id", "frequency")


def add_corpus(
    model: Model, name: str, documents: DataFrame, frequencies: DataFrame, key: str = "file",
    corpus_id: int | None = None, first_document_id: int | None = None,
) -> dict[str, DataFrame]:
    """Rows to add for a corpus of (documents by `key`, term frequencies by `key`).

    A document's word count is the sum of its term frequencies.  Corpus words are stored as
    they are, without the cleaning that lexicon words get.
    """
    if corpus_id is None:
        corpus_id = next_id(model.corpora, "corpus_id")
    if first_document_id is None:
        first_document_id = next_id(model.documents, "document_id")
    counts = frequencies.groupBy(key).agg(F.sum("frequency").alias("word_count"))
    documents = documents.drop("word_count").join(counts, key, "left").withColumn(
        "word_count", F.coalesce("word_count", F.lit(0)))
    documents = numbered(documents, "document_id", [F.col(key)], first_document_id)
    given = set(documents.columns)
    spark = frequencies.sparkSession
    return {
        "words": new_words(
            model.words, frequencies.select("wordform"), preprocess_words=False),
        "documents": documents.select(*[
            (F.col(c).cast(t) if c in given else F.lit(None).cast(t)).alias(c)
            for c, t in DOCUMENT_COLUMNS.items()
        ]),
        "corpora": spark.createDataFrame([(corpus_id, name)], MODEL["corpora"]),
        "corpus_documents": documents.select(
            F.lit(corpus_id).cast("long").alias("corpus_id"), "document_id"),
        "attestations": attestations_of(frequencies, documents, key),
    }


def word_frequencies(model: Model, missing_as_zero: bool = False) -> DataFrame:
    """Total frequency of every word: NULL, or on request 0, for words without attestation.

    Attestations are summed per word before the join, so a frequent word is one row by then.
    """
    totals = model.attestations.groupBy("wordform").agg(F.sum("frequency").alias("frequency"))
    table = model.words.select("wordform").join(totals, "wordform", "left")
    if missing_as_zero:
        table = table.withColumn("frequency", F.coalesce("frequency", F.lit(0).cast("long")))
    return table


def resolve_variant_sources(model: Model) -> DataFrame:
    """Ranked variants with `known_source`: their source if it is a word of the model."""
    known = model.words.select(F.col("wordform").alias("known_source"))
    return model.ranked_variants.join(
        known, F.col("wordform_source") == F.col("known_source"), "left")


def set_document_years(
    model: Model, corpus_name: str, year_from: int | None, year_to: int | None,
) -> DataFrame:
    """The documents table with the year range of one corpus replaced."""
    corpus = model.corpora.filter(F.col("name") == corpus_name)
    members = model.corpus_documents.join(corpus, "corpus_id", "left_semi").select(
        "document_id").distinct().withColumn("_member", F.lit(True))
    documents = model.documents.join(members, "document_id", "left")
    member = F.coalesce("_member", F.lit(False))
    return documents.withColumns({
        "year_from": F.when(member, F.lit(year_from).cast("long")).otherwise(
            F.col("year_from")),
        "year_to": F.when(member, F.lit(year_to).cast("long")).otherwise(F.col("year_to")),
    }).select(*model.documents.columns)


def paradigm_rows(rows: DataFrame) -> DataFrame:
    """(wordform, Z ... V, type code and number) from words with `#`-joined codes.

    Codes that do not parse are dropped.  Words are cleaned as in the word table, so that a
    word the cleaning changes keeps its codes.
    """
    codes = rows.select(
        preprocess(F.col("wordform")).alias("wordform"),
        F.explode(F.split("component_codes", "#")).alias("code"),
    ).filter(F.col("wordform") != "")
    return codes.select("wordform", component_code(F.col("code")).alias("c")).filter(
        F.col("c").isNotNull()).select("wordform", "c.*")


def add_paradigms(
    model: Model, rows: DataFrame, first_paradigm_id: int | None = None,
) -> dict[str, DataFrame]:
    """Rows to add for a paradigm file: its words, and one row per parsed code."""
    if first_paradigm_id is None:
        first_paradigm_id = next_id(model.paradigms, "paradigm_id")
    parsed = paradigm_rows(rows)
    order = [F.col(c) for c in ("wordform", "Z", "Y", "X", "W", "V", "word_type_code",
                                "word_type_number")]
    return {
        "words": new_words(model.words, rows.select("wordform")),
        "paradigms": numbered(
            parsed, "paradigm_id", order, first_paradigm_id
        ).select(*MODEL["paradigms"].names),
    }


def empty(df: DataFrame) -> DataFrame:
    """The table without rows, for replacing its content on ingest."""
    return df.limit(0)
