"""Building the word table and its anagram hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.anahash import anahash
from wordloom.functions.text import preprocess
from wordloom.model import Model


def cleaned(wordforms: DataFrame, preprocess_words: bool = True) -> DataFrame:
    """Distinct non-empty spellings."""
    word = F.col("wordform")
    word = preprocess(word) if preprocess_words else word
    return wordforms.select(word.alias("wordform")).filter(F.col("wordform") != "").distinct()


def new_words(
    words: DataFrame, wordforms: DataFrame, preprocess_words: bool = True,
) -> DataFrame:
    """The rows to add to `words`: spellings not in it yet, without a hash.

    Their number is the number of words added.
    """
    unseen = cleaned(wordforms, preprocess_words).join(words, "wordform", "left_anti")
    return unseen.select(
        "wordform", F.lower("wordform").alias("wordform_lowercase"),
        F.lit(None).cast("long").alias("anahash"),
    )


def get_or_create_words(words: DataFrame, wordforms: DataFrame) -> DataFrame:
    """One row per asked spelling, existing or new; spellings are taken as they are."""
    asked = cleaned(wordforms, preprocess_words=False)
    known = words.join(asked, "wordform", "left_semi")
    return known.unionByName(new_words(words, wordforms, preprocess_words=False))


def words_without_hash(words: DataFrame) -> DataFrame:
    """Words to be hashed, each with frequency 1."""
    return words.filter(F.col("anahash").isNull()).select(
        "wordform", F.lit(1).cast("long").alias("frequency"))


def lexicon_mapping(
    model: Model, lexicon_id: int | None = None, lexicon_name: str | None = None,
) -> DataFrame:
    """The words of one lexicon, for looking words up in."""
    if lexicon_id is None and lexicon_name is None:
        raise ValueError("give a lexicon id or a lexicon name")
    if lexicon_id is not None:
        return model.lexicon_words.filter(F.col("lexicon_id") == lexicon_id)
    lexicon = model.lexica.filter(F.col("lexicon_name") == lexicon_name).select("lexicon_id")
    return model.lexicon_words.join(lexicon, "lexicon_id", "left_semi")


def new_anahashes(known: DataFrame, hashes: DataFrame) -> DataFrame:
    """Distinct hashes not among the known ones."""
    return hashes.select("anahash").filter(F.col("anahash").isNotNull()).distinct().join(
        known.select("anahash"), "anahash", "left_anti")


def connect_anahashes(words: DataFrame, hashes: DataFrame) -> DataFrame:
    """Give words the hash that `hashes` (wordform, anahash) has for them."""
    new = hashes.select("wordform", F.col("anahash").alias("_new"))
    return words.join(new, "wordform", "left").select(
        "wordform", "wordform_lowercase", F.coalesce("_new", "anahash").alias("anahash"))


def fill_anahashes(
    words: DataFrame, alphabet: dict[str, int] | None = None, unknown: int = 0,
) -> DataFrame:
    """Hash every word that has no hash yet; a projection, no join."""
    return words.withColumn(
        "anahash", F.coalesce("anahash", anahash(F.col("wordform"), alphabet, unknown)))


def reset_anahashes(words: DataFrame) -> DataFrame:
    return words.withColumn("anahash", F.lit(None).cast("long"))


def normalize_words(words: DataFrame) -> DataFrame:
    """Respell words by the cleaning rule, except where the new spelling already exists.

    Returns (wordform, new_wordform, renamed).  When several words would get one new spelling,
    the smallest gets it.
    """
    plan = words.select("wordform", preprocess(F.col("wordform")).alias("target"))
    changing = plan.filter((F.col("wordform") != F.col("target")) & (F.col("target") != ""))
    free = changing.join(
        words.select(F.col("wordform").alias("target")), "target", "left_anti")
    chosen = free.groupBy("target").agg(F.min("wordform").alias("wordform"))
    return words.select("wordform").join(chosen, "wordform", "left").select(
        "wordform", F.coalesce("target", "wordform").alias("new_wordform"),
        F.col("target").isNotNull().alias("renamed"),
    )
