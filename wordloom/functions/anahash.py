"""Anagram hashes: the sum of one number per character, equal for all anagrams of a word."""

from __future__ import annotations

from itertools import chain

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

MAX_ALPHABET = 10_000


def characters(word: Column) -> Column:
    # Splitting at nothing gives the characters, and of an empty word one empty string.
    return F.filter(F.split(word, ""), lambda c: c != "")


def code_base(char: Column) -> Column:
    """A shifted code point, capped so that the fifth powers of 9000 characters fit in a LONG."""
    return F.least(F.ascii(char), F.lit(1000)).cast("long") + F.lit(4)


def anahash(
    word: Column, alphabet: dict[str, int] | None = None, unknown: int = 0,
) -> Column:
    """Hash of the lower-cased word, from an alphabet or, without one, from code points.

    NULL for a word whose sum does not fit in a LONG.
    """
    chars = characters(F.lower(word))
    if alphabet is None:
        # Bases first: a lambda computes what it names twice twice.
        chars = F.transform(chars, code_base)

        def value(base: Column) -> Column:
            return base * base * base * base * base
    else:
        if len(alphabet) > MAX_ALPHABET:
            raise ValueError(f"alphabet has {len(alphabet)} characters, over {MAX_ALPHABET}")
        table = F.create_map(*[F.lit(x) for x in chain.from_iterable(alphabet.items())])
        table = table.cast("map<string,bigint>")

        def value(char: Column) -> Column:
            return F.coalesce(F.try_element_at(table, char), F.lit(unknown).cast("long"))

    zero = F.lit(0).cast("long")
    return F.aggregate(chars, zero, lambda acc, c: F.try_add(acc, value(c)))


def alphabet_dict(alphabet: DataFrame) -> dict[str, int]:
    """An alphabet table (`char`, `char_hash`) as a dict, after a check of its size."""
    rows = alphabet.select("char", "char_hash").limit(MAX_ALPHABET + 1).collect()
    if len(rows) > MAX_ALPHABET:
        raise ValueError(f"alphabet has more than {MAX_ALPHABET} characters")
    return {row["char"]: row["char_hash"] for row in rows}
