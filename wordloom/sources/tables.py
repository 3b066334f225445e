"""Model tables on disk: id-keyed TSV files in, parquet and CSV out."""

from __future__ import annotations

import os
from collections.abc import Iterable

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.model import Model
from wordloom.schema import MODEL, RELATIONAL


def read_tsv_table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """`<folder>/<name>.tsv`, with a header line, under its declared schema."""
    return (
        spark.read.schema(RELATIONAL[name]).option("sep", "\t").option("header", True)
        .option("quote", "").csv(os.path.join(folder, f"{name}.tsv"))
    )


def read_relational(
    spark: SparkSession, folder: str, may_lack: Iterable[str] = (),
) -> Model:
    """A folder of id-keyed TSV tables as a model; a table may be a file or a folder of files.

    A missing table is an error, but for those named in `may_lack`, which are then empty.
    """
    lacking = set(may_lack)

    def table(name: str) -> DataFrame:
        try:
            return read_tsv_table(spark, folder, name)
        except AnalysisException as error:
            if name in lacking and error.getCondition() == "PATH_NOT_FOUND":
                return spark.createDataFrame([], RELATIONAL[name])
            raise

    return to_natural_keys({name: table(name) for name in RELATIONAL})


def to_natural_keys(tables: dict[str, DataFrame]) -> Model:
    """Replace word and hash ids by the words and hashes they stand for."""
    words = tables["wordforms"].join(tables["anahashes"], "anahash_id", "left")
    ids = words.select("wordform_id", "wordform")

    def named(df: DataFrame, column: str = "wordform_id", name: str = "wordform") -> DataFrame:
        return df.join(ids.select(
            F.col("wordform_id").alias(column), F.col("wordform").alias(name)), column)

    def linked(df: DataFrame) -> DataFrame:
        df = df.withColumnsRenamed({"wordform_from": "from_id", "wordform_to": "to_id"})
        return named(named(df, "from_id", "wordform_from"), "to_id", "wordform_to")

    frames = {
        "words": words,
        "lexica": tables["lexica"],
        "lexicon_words": named(tables["lexical_source_wordform"]),
        "links": linked(tables["wordform_links"]),
        "link_sources": linked(tables["source_x_wordform_link"]),
        "corpora": tables["corpora"],
        "documents": tables["documents"],
        "corpus_documents": tables["corpusId_x_documentId"],
        "attestations": named(tables["text_attestations"]),
        "paradigms": named(tables["morphological_paradigms"]),
        "external_links": named(tables["external_links"]),
        "word_frequency": tables["wordform_frequency"],
        "ranked_variants": tables["ranked_variants"],
    }
    return Model(**{
        name: df.select(*[F.col(f.name).cast(f.dataType) for f in MODEL[name].fields])
        for name, df in frames.items()
    })


def write_word_list(words: DataFrame, path: str, column: str = "wordform") -> None:
    """Export one column of words as CSV with a header."""
    words.select(column).write.option("header", True).csv(path)


def append(df: DataFrame, path: str) -> None:
    """Add rows to a parquet table."""
    df.write.mode("append").parquet(path)


def write_model(model: Model, path: str) -> None:
    """Write every table; attestations are laid out by word, so a lookup reads few files.

    The range partitioning includes the document, so one word's rows may span many files.
    """
    for name, df in model.tables().items():
        if name == "attestations":
            df = by_word(df)
        df.write.mode("overwrite").parquet(f"{path}/{name}")


def by_word(attestations: DataFrame, parts: int | None = None) -> DataFrame:
    """Laid out by word, in as many parts as given or else as the session shuffles into."""
    numbers = [] if parts is None else [parts]
    return attestations.repartitionByRange(
        *numbers, "wordform", "document_id").sortWithinPartitions("wordform", "document_id")


def read_model(spark: SparkSession, path: str) -> Model:
    return Model(**{
        name: spark.read.schema(schema).parquet(f"{path}/{name}")
        for name, schema in MODEL.items()
    })
