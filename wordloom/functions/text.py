"""Tokens, cleaning rules and code parsing as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_WORD_LENGTH = 255

# The pattern of a word in running text, and the whitespace that is stripped.
WORD_PATTERN = r"[\p{L}]+"
_SPACE = r"[\s\x1c-\x1f]"
_PADDING = rf"(?U)^{_SPACE}+|{_SPACE}+\z"

# Diacritic markers of the 1995 word list, applied in this order.
DIACRITIC_MARKERS = {
    "@`": "̀",     # grave
    "@'": "́",     # acute
    "@\\": "̈",    # diaeresis
    "@+": "̧",     # cedilla
    "@^": "̂",     # circumflex
    "@=": "̃",     # tilde
    "@@": "'",          # apostrophe
    "@2": "₂",     # subscript two
    "@n": "̈n",    # diaeresis, then n
}

# The layout of one paradigm code.
COMPONENT_CODE = r"Z(\d{4})Y(\d{4})X(\d{4})W(\d{8})V(\d{4})_(\w{3})(\d{3})?"

# Fixed value: the amount added to the count of words that come from a lexicon.
ARTIFICIAL_FREQUENCY = 100_000_000


def tokens(text: Column, max_length: int | None = MAX_WORD_LENGTH) -> Column:
    """The lower-cased words of a text, in order; with None, those of any length."""
    words = F.regexp_extract_all(F.lower(text), F.lit(WORD_PATTERN), F.lit(0))
    return words if max_length is None else F.filter(words, lambda w: F.length(w) <= max_length)


def strip(word: Column) -> Column:
    return F.regexp_replace(word, _PADDING, "")


def preprocess(word: Column) -> Column:
    """Strip; `_` becomes `*`, a space becomes `_` (one translate equals the ordered pair)."""
    return F.translate(strip(word), "_ ", "*_")


def effective_year() -> Column:
    """Publication year, else the rounded middle of the year range."""
    middle = F.round((F.col("year_from") + F.col("year_to")) / 2)
    return F.coalesce(F.col("pub_year"), middle.cast("long"))


def paradigm_code() -> Column:
    return F.format_string("Z%04dY%04dX%04dW%08d", "Z", "Y", "X", "W")


def component_code(code: Column) -> Column:
    """Struct of the parts of a paradigm code; NULL where the code does not parse.

    One match finds the code and its parts have fixed places in it.  The match is handed to a
    lambda, so it is made once and not once per part.
    """
    def parts(found: Column) -> Column:
        places = {"Z": (2, 4), "Y": (7, 4), "X": (12, 4), "W": (17, 8), "V": (26, 4)}
        numbers = [
            F.substring(found, *place).cast("long").alias(name)
            for name, place in places.items()
        ]
        return F.struct(
            *numbers, F.substring(found, 31, 3).alias("word_type_code"),
            F.nullif(F.substring(found, 34, 3), F.lit("")).cast("long")
            .alias("word_type_number"),
        )

    found = F.filter(F.array(F.regexp_extract(code, COMPONENT_CODE, 0)), lambda m: m != "")
    return F.get(F.transform(found, parts), F.lit(0))


def clean_entry(entry: Column) -> Column:
    """Dictionary entry to word: no colons, padding, footnote digit or parentheses around it.

    Abbreviations (entries ending in a full stop) become NULL.
    """
    word = strip(F.replace(entry, F.lit(":"), F.lit("")))
    word = F.regexp_replace(word, r"[0-9]\z", "")
    word = F.regexp_replace(word, r"^[()]+|[()]+\z", "")
    return F.when(~word.endswith("."), word)


def clean_disambiguation(cell: Column) -> Column:
    """Keep only single-word disambiguations, as a comma-separated list; else NULL."""
    text = F.regexp_replace(cell, r"^[()]+|[()]+\z", "")
    spaced_list = text.rlike("[^,] ")
    single = F.array_join(F.filter(F.split(text, ", "), lambda p: ~p.contains(" ")), ", ")
    kept = F.when(spaced_list, F.nullif(single, F.lit(""))).otherwise(text)
    dropped = text.isin("andere bett.", "andere bet.") | (text.contains(" ") & ~text.contains(","))
    return F.when(~dropped & ~kept.contains(", -"), kept)


def apply_diacritics(word: Column) -> Column:
    return reduce(
        lambda w, marker: F.replace(w, F.lit(marker[0]), F.lit(marker[1])),
        DIACRITIC_MARKERS.items(), word,
    )


def without_artificial_frequency(count: Column) -> Column:
    return F.when(count >= ARTIFICIAL_FREQUENCY, count - ARTIFICIAL_FREQUENCY).otherwise(count)


def is_complete_form(pos: Column) -> Column:
    """True for tags of whole words: all upper case with a letter, and no contraction."""
    upper = (pos == F.upper(pos)) & (pos != F.lower(pos))
    return F.coalesce(upper & ~pos.endswith("_CONTRACT"), F.lit(False))
