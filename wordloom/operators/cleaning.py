"""Cleaning dictionary entries into words and word pairs."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.text import apply_diacritics, clean_disambiguation, clean_entry

# The columns of the 1995 dictionary that hold words.
RELATED = [
    "disambiguation", "plural/past/attrib", "diminu/compara/past plural", "past perfect/superla",
]


def clean_words(entries: DataFrame, column: str = "wordform") -> DataFrame:
    """Distinct cleaned words, abbreviations left out."""
    return entries.select(clean_entry(F.col(column)).alias(column)).filter(
        F.col(column).isNotNull()).distinct()


def _stacked(rows: DataFrame, columns: list[str]) -> DataFrame:
    """One row per filled cell of the columns."""
    cells = F.explode(F.array(*[F.col(f"`{c}`") for c in columns]))
    return rows.select(cells.alias("wordform")).filter(F.col("wordform").isNotNull())


def split_cells(rows: DataFrame, column: str = "wordform") -> DataFrame:
    """One row per part of a comma-separated cell."""
    return rows.withColumn(column, F.explode(F.split(column, ", ")))


def split_multi_word(rows: DataFrame, column: str = "wordform") -> DataFrame:
    """One row per word of an entry with a space inside it."""
    words = F.when(F.col(column).rlike(". ."), F.split(column, " ")).otherwise(F.array(column))
    return rows.withColumn(column, F.explode(words))


def dictionary_words(dictionary: DataFrame) -> DataFrame:
    """Distinct words of the 1995 dictionary, from the entry and its related forms."""
    rows = dictionary.withColumn(
        "disambiguation", clean_disambiguation(F.col("disambiguation")))
    words = clean_words(split_cells(_stacked(rows, ["word", *RELATED])))
    return words.select(apply_diacritics(F.col("wordform")).alias("wordform"))


def dictionary_links(dictionary: DataFrame) -> DataFrame:
    """(wordform_1, wordform_2): every entry with each of its related forms."""
    rows = dictionary.withColumns({
        "see also": F.replace(F.col("see also"), F.lit("zie ook "), F.lit("")),
        "disambiguation": clean_disambiguation(F.col("disambiguation")),
    })
    cells = F.explode(F.array(*[F.col(f"`{c}`") for c in ["see also", *RELATED]]))
    pairs = rows.select(F.col("word").alias("wordform_1"), cells.alias("wordform_2")).dropna()
    pairs = split_cells(split_cells(pairs, "wordform_1"), "wordform_2")
    pairs = pairs.select(*[
        clean_entry(F.col(c)).alias(c) for c in ("wordform_1", "wordform_2")]).dropna()
    return pairs.select(*[
        apply_diacritics(F.col(c)).alias(c) for c in ("wordform_1", "wordform_2")])


def contains_in_any_column(rows: DataFrame, pattern: str) -> DataFrame:
    """Rows with a match in at least one column."""
    tests = [F.coalesce(F.col(f"`{c}`").rlike(pattern), F.lit(False)) for c in rows.columns]
    return rows.filter(reduce(lambda a, b: a | b, tests))


# What the cleanliness report looks for.
CLEANLINESS_RULES = {
    "colons": ":",
    "periods": r"\.",
    "padding": "^ | $",
    "trailing_numbers": "[0-9]$",
    "parentheses": r"\(|\)",
    "abbreviations": r"\.$",
}


def cleanliness(words: DataFrame, column: str = "wordform") -> DataFrame:
    """One row with the number of words that break each rule."""
    return words.agg(*[
        F.count_if(F.col(column).rlike(pattern)).alias(name)
        for name, pattern in CLEANLINESS_RULES.items()
    ])


def unclean_words(words: DataFrame, rule: str, column: str = "wordform") -> DataFrame:
    return words.filter(F.col(column).rlike(CLEANLINESS_RULES[rule]))
