"""Term-frequency files and the corpora that consist of them."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from wordloom.functions.text import MAX_WORD_LENGTH
from wordloom.sources.files import (
    delimited, dot_part, file_name, glob_pattern, stem, text_lines,
)


def read_frequency_files(
    spark: SparkSession, paths: str | list[str], glob: str | None = None,
    max_word_length: int = MAX_WORD_LENGTH,
) -> DataFrame:
    """(file, wordform, frequency) from lines `word<TAB>count`, plain or compressed.

    Over-long words are left out; of a word repeated in one file the last line counts.  A line
    without a tab or with a bad count stops the job, as a broken file should.
    """
    fields = F.split("value", "\t")
    rows = text_lines(spark, paths, glob).select(
        "file", fields[0].alias("wordform"),
        F.trim(fields[1]).cast("long").alias("frequency"), "line_order",
    )
    # Words of a file are nearly all different: sorted once, behind the shuffle, not before it too.
    rows = rows.filter(F.length("wordform") <= max_word_length).repartition("file", "wordform")
    return rows.groupBy("file", "wordform").agg(
        F.max_by("frequency", "line_order").alias("frequency"))


@dataclass(frozen=True)
class CorpusLayout:
    """How the files of one corpus are named and what their names say."""

    corpus: str
    glob: str

    def title(self, name: Column) -> Column:
        return stem(name)

    def years(self, name: Column) -> dict[str, Column]:
        return {"pub_year": dot_part(name, -2).cast("long")}

    def language(self, path: Column) -> Column:
        return F.lit("nl")


class YearInName(CorpusLayout):
    """`<title>.<year>.clean`."""


class FixedRange(CorpusLayout):
    """`<title>.wordfreqlist.clean.tsv.bz2`, all from the same two decades."""

    def title(self, name: Column) -> Column:
        return dot_part(name, 1)

    def years(self, name: Column) -> dict[str, Column]:
        return {"year_from": F.lit(1990).cast("long"), "year_to": F.lit(2010).cast("long")}


class YearSpanInName(CorpusLayout):
    """`<title>.<year>[+<span>][_...].clean`; a zero span is an exact year."""

    def years(self, name: Column) -> dict[str, Column]:
        token = F.split(F.split(dot_part(name, -2), "_")[0], r"\+")
        first = token[0].cast("long")
        last = first + F.coalesce(F.get(token, F.lit(1)).cast("long"), F.lit(0))
        return {
            "pub_year": F.when(first == last, first),
            "year_from": F.when(first != last, first),
            "year_to": F.when(first != last, last),
        }

    def language(self, path: Column) -> Column:
        return F.when(path.contains("LIM"), "lim").otherwise("nl")


# Corpus names and the names of their files.
LAYOUTS = {
    "sonar": FixedRange("SoNaR-500", "*.wordfreqlist.clean.tsv.bz2"),
    "sgd": YearInName("Staten Generaal Digitaal", "*.clean"),
    "edbo": YearInName("Early Dutch Books Online", "*1[0-9][0-9][0-9].clean"),
    "dbnl": YearSpanInName("Databank Nederlandse Literatuur (DBNL)", "*.clean"),
}


def read_corpus(
    spark: SparkSession, paths: str | list[str], layout: CorpusLayout,
) -> tuple[DataFrame, DataFrame]:
    """(documents, frequencies) of a corpus, both keyed by `file`.

    Documents come from the listing of the files, so a file without a usable word is a
    document too; only a file of zero bytes is not, as Spark reads no row from it.
    """
    frequencies = read_frequency_files(spark, paths, layout.glob)
    listing = (
        spark.read.format("binaryFile").load(paths)
        .select(file_name(F.col("path")).alias("file"), "path")
        .filter(F.col("file").rlike(glob_pattern(layout.glob)))
        .groupBy("file").agg(F.min("path").alias("path"))
    )
    name = F.col("file")
    documents = listing.select(
        "file", layout.title(name).alias("title"),
        layout.language(F.col("path")).alias("language"),
        *[
            layout.years(name).get(year, F.lit(None).cast("long")).alias(year)
            for year in ("year_from", "year_to", "pub_year")
        ],
    )
    return documents, frequencies


# Columns of the intermediate lists of a correction run.
LIST_SCHEMAS = {
    "frequency": "wordform STRING, frequency LONG, running_sum LONG, share DOUBLE",
    "clean": "wordform STRING, frequency LONG",
    "punctuation": "wordform STRING, correction STRING",
    "unknown": "wordform STRING, frequency LONG",
}


def read_list(spark: SparkSession, paths: str | list[str], kind: str) -> DataFrame:
    return delimited(spark, paths, LIST_SCHEMAS[kind], "\t")
