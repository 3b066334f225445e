"""Queries that clean raw dictionary entries made from the driver's tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.text import clean_disambiguation, clean_entry
from wordloom.operators import cleaning as c
from wordloom.plans.registry import query
from wordloom.plans.workload import Workload

# Entries with everything the cleaning looks for, by the length of the word.
ENTRY = """
    SELECT wordform AS word, CASE length(wordform) % 7
        WHEN 0 THEN ' ' || wordform || ':'
        WHEN 1 THEN wordform || '2'
        WHEN 2 THEN '(' || wordform || ')'
        WHEN 3 THEN wordform || '.'
        WHEN 4 THEN wordform || ', ' || reverse(wordform)
        WHEN 5 THEN wordform || '@@s ' || wordform
        ELSE 'e@''' || wordform END AS wordform
    FROM m_vocabulary"""


def entries(w: Workload):
    word = F.col("wordform")
    n = F.length(word) % 7
    raw = (
        F.when(n == 0, F.concat(F.lit(" "), word, F.lit(":")))
        .when(n == 1, F.concat(word, F.lit("2")))
        .when(n == 2, F.concat(F.lit("("), word, F.lit(")")))
        .when(n == 3, F.concat(word, F.lit(".")))
        .when(n == 4, F.concat(word, F.lit(", "), F.reverse(word)))
        .when(n == 5, F.concat(word, F.lit("@@s "), word))
        .otherwise(F.concat(F.lit("e@'"), word))
    )
    return w.words.select(word.alias("word"), raw.alias("wordform"))


def clean_sql(column: str) -> str:
    bare = f"trim(replace({column}, ':', ''))"
    bare = f"regexp_replace({bare}, '[0-9]$', '')"
    bare = f"trim({bare}, '()')"
    return f"CASE WHEN NOT {bare} LIKE '%.' THEN {bare} END"


def marked_sql(column: str) -> str:
    """Only the markers that `ENTRY` has; the others leave no trace there."""
    return f"replace(replace({column}, '@''', chr(769)), '@@', '''')"


@query(f"SELECT DISTINCT {clean_sql('wordform')} AS wordform FROM ({ENTRY}) "
       f"WHERE {clean_sql('wordform')} IS NOT NULL")
def clean_dictionary_words(w: Workload):
    return c.clean_words(entries(w))


@query(f"SELECT word, {clean_sql('wordform')} AS wordform FROM ({ENTRY})")
def clean_dictionary_series(w: Workload):
    return entries(w).select("word", clean_entry(F.col("wordform")).alias("wordform"))


DISAMBIGUATION = """
    SELECT wordform, CASE length(wordform) % 6
        WHEN 0 THEN '(' || wordform || ')'
        WHEN 1 THEN 'andere bet.'
        WHEN 2 THEN wordform || ' ' || wordform
        WHEN 3 THEN wordform || ', two words, ' || reverse(wordform)
        WHEN 4 THEN wordform || ', -' || wordform
        ELSE NULL END AS cell
    FROM m_vocabulary"""


@query(f"""
    SELECT wordform, CASE length(wordform) % 6 WHEN 0 THEN wordform
        WHEN 3 THEN wordform || ', ' || reverse(wordform) END AS cell
    FROM ({DISAMBIGUATION})""")
def clean_disambiguations(w: Workload):
    word = F.col("wordform")
    n = F.length(word) % 6
    cell = (
        F.when(n == 0, F.concat(F.lit("("), word, F.lit(")")))
        .when(n == 1, F.lit("andere bet."))
        .when(n == 2, F.concat(word, F.lit(" "), word))
        .when(n == 3, F.concat(word, F.lit(", two words, "), F.reverse(word)))
        .when(n == 4, F.concat(word, F.lit(", -"), word))
    )
    return w.words.select(word, clean_disambiguation(cell).alias("cell"))


@query(f"SELECT word, {marked_sql('wordform')} AS wordform FROM ({ENTRY})")
def diacritics(w: Workload):
    from wordloom.functions.text import apply_diacritics

    return entries(w).select("word", apply_diacritics(F.col("wordform")).alias("wordform"))


@query(f"SELECT word, unnest(string_split(wordform, ', ')) AS wordform FROM ({ENTRY})")
def split_cells(w: Workload):
    return c.split_cells(entries(w))


@query(f"""
    SELECT word, unnest(CASE WHEN regexp_matches(wordform, '. .')
                        THEN string_split(wordform, ' ') ELSE [wordform] END) AS wordform
    FROM ({ENTRY})""")
def split_multi_word_entries(w: Workload):
    return c.split_multi_word(entries(w))


@query(f"""
    SELECT word, wordform FROM ({ENTRY})
    WHERE regexp_matches(word, 'the.*ing') OR regexp_matches(wordform, 'the.*ing')""")
def contains_in_any_column(w: Workload):
    return c.contains_in_any_column(entries(w), "the.*ing")


@query(f"""
    SELECT count(*) FILTER (regexp_matches(wordform, ':'))::BIGINT AS colons,
           count(*) FILTER (regexp_matches(wordform, '\\.'))::BIGINT AS periods,
           count(*) FILTER (regexp_matches(wordform, '^ | $'))::BIGINT AS padding,
           count(*) FILTER (regexp_matches(wordform, '[0-9]$'))::BIGINT AS trailing_numbers,
           count(*) FILTER (regexp_matches(wordform, '\\(|\\)'))::BIGINT AS parentheses,
           count(*) FILTER (regexp_matches(wordform, '\\.$'))::BIGINT AS abbreviations
    FROM ({ENTRY})""")
def cleanliness(w: Workload):
    return c.cleanliness(entries(w))


@query(f"SELECT word, wordform FROM ({ENTRY}) WHERE regexp_matches(wordform, '[0-9]$')")
def unclean_words(w: Workload):
    return c.unclean_words(entries(w), "trailing_numbers")
