"""Anagram space: words with equal or near hashes."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.model import Model
from wordloom.operators.bloom import Bloom
from wordloom.operators.lexicon_queries import word_links
from wordloom.operators.lookup import Words, for_words
from wordloom.operators.paradigm_queries import morph_links
from wordloom.operators.ranks import ranked
from wordloom.scratch import stored


# Hashes and confusions that travel as one array.
DEALT = 4096


def anahash_of_word(model: Model, words: Words) -> DataFrame:
    return for_words(model.words, words).filter(F.col("anahash").isNotNull()).select(
        "wordform", "anahash")


def words_per_anahash(model: Model) -> DataFrame:
    """Hashes shared by more than one word."""
    return (
        model.words.filter(F.col("anahash").isNotNull())
        .groupBy("anahash").agg(F.count(F.lit(1)).alias("num_wf"))
        .filter(F.col("num_wf") > 1).orderBy(F.desc("num_wf"), "anahash")
    )


def anahash_links(model: Model, words: Words) -> DataFrame:
    """Words with the hash of a word, itself included; one NULL for a word without hash."""
    asked = for_words(model.words, words).select(
        F.col("wordform").alias("lookup_word"), "anahash")
    return asked.join(model.words.select("anahash", "wordform"), "anahash", "left").select(
        "lookup_word", "wordform")


def word_card(model: Model, words: Words) -> DataFrame:
    """Everything linked to a word: by a lexicon, by hash, by paradigm."""
    no_lexicon = F.lit(None).cast("string").alias("lexicon_name")

    def kind(rows: DataFrame, name: str, lexicon=no_lexicon) -> DataFrame:
        return rows.select("lookup_word", F.lit(name).alias("kind"), "wordform", lexicon)

    return (
        kind(word_links(model, words), "lexicon", F.col("lexicon_name"))
        .unionByName(kind(anahash_links(model, words), "anahash"))
        .unionByName(kind(morph_links(model, words), "morph"))
    )


def _dealt(rows: DataFrame, column: str, group: str) -> tuple[DataFrame, int]:
    """Distinct values as arrays of about `DEALT`, numbered from 0, and how many."""
    values = stored(rows.select(F.col(column).cast("long").alias(column)).filter(
        F.col(column).isNotNull()).distinct(), "dealt")
    groups = max(1, -(-values.count() // DEALT))
    return values.groupBy(F.pmod(F.xxhash64(column), F.lit(groups)).alias(group)).agg(
        F.collect_list(column).alias(f"{column}_list")), groups


def shifts_to_known(
    hashes: DataFrame, words: DataFrame, confusions: DataFrame,
) -> DataFrame:
    """(anahash, confusion, target): every hash moved by every confusion, without those whose
    target is no word's hash for sure.

    Hashes and confusions are dealt in arrays, and each pair of arrays is a row of its own; a task
    generates the shifts of its pairs and tests each with a Bloom filter of all words' hashes at
    once, so what leaves it is near the number of true hits, however long the lists.
    """
    known = stored(words.select("anahash").filter("anahash is not null").distinct(), "known")
    passes = Bloom(known, "anahash")
    origins, _ = _dealt(hashes, "anahash", "origin")
    steps, chunks = _dealt(confusions, "confusion", "chunk")
    pairs = origins.withColumn(
        "chunk", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(chunks - 1).cast("long"))))
    return (
        pairs.join(steps, "chunk").repartition("origin", "chunk")
        .select(F.explode("anahash_list").alias("anahash"), "confusion_list")
        .select("anahash", F.explode("confusion_list").alias("confusion"))
        .withColumn("target", F.try_add("anahash", "confusion"))
        .filter(passes.may_have(F.col("target")))
    )


def _shifted_to_words(hashes: DataFrame, words: DataFrame, confusions: DataFrame) -> DataFrame:
    """(anahash, confusion, wordform): every hash moved by every confusion to known words."""
    known = words.select(F.col("anahash").alias("target"), "wordform")
    return shifts_to_known(hashes, words, confusions).join(known, "target").select(
        "anahash", "confusion", "wordform")


def confusion_neighbours(model: Model, confusions: DataFrame) -> DataFrame:
    """(anahash, confusion, wordform): words one listed confusion away from a hash.

    Runs on distinct hashes for the whole vocabulary at once: each hash is shifted by every
    confusion, tested with a Bloom filter, and equi-joined to the words.  `confusions` is a table of any
    length, such as the distinct ones of an index; repeated and NULL ones add nothing.  The words that start from a hash are its anagrams,
    which `anahash_links` lists; pairs of words are not formed, so a large anagram class stays
    linear.
    """
    words = model.words.filter(F.col("anahash").isNotNull())
    return _shifted_to_words(words.select("anahash").distinct(), words, confusions)


def confusion_neighbours_of_word(
    model: Model, words: Words, confusions: DataFrame,
) -> DataFrame:
    """(lookup_word, confusion, wordform): the neighbours of looked-up words."""
    asked = anahash_of_word(model, words).select(
        F.col("wordform").alias("lookup_word"), "anahash")
    near = _shifted_to_words(asked.select("anahash").distinct(), model.words, confusions)
    return asked.join(near, "anahash").select("lookup_word", "confusion", "wordform")


def range_neighbours(model: Model, words: Words, max_distance: int) -> DataFrame:
    """(lookup_word, wordform, difference): words whose hash is at most so far away.

    A range join as an equi-join: hashes fall into buckets as wide as the distance, and a
    looked-up word is compared with its own bucket and the two beside it.
    """
    def bucket(column):
        return F.floor(column / F.lit(max_distance))

    asked = anahash_of_word(model, words).select(
        F.col("wordform").alias("lookup_word"), F.col("anahash").alias("origin"))
    asked = asked.withColumn(
        "bucket", F.explode(F.transform(
            F.array(F.lit(-1), F.lit(0), F.lit(1)),
            lambda step: bucket(F.col("origin")) + step)))
    others = model.words.filter(F.col("anahash").isNotNull()).select(
        "wordform", "anahash", bucket(F.col("anahash")).alias("bucket"))
    difference = F.col("anahash") - F.col("origin")
    return asked.join(others, "bucket").filter(
        F.abs(difference) <= max_distance
    ).select("lookup_word", "wordform", difference.alias("difference"))


def anagram_statistics(model: Model) -> DataFrame:
    """Per hash the number of its words and the length of the smallest."""
    return model.words.filter(F.col("anahash").isNotNull()).groupBy("anahash").agg(
        F.count(F.lit(1)).alias("variant_count"),
        F.length(F.min("wordform")).alias("word_length"))


def mean_variants(model: Model) -> DataFrame:
    return anagram_statistics(model).agg(
        F.avg("variant_count").alias("mean_variants"), F.count(F.lit(1)).alias("num_hashes"))


def variants_by_length(model: Model) -> DataFrame:
    """How many hashes have words of a length and a number of variants."""
    return anagram_statistics(model).groupBy("word_length", "variant_count").agg(
        F.count(F.lit(1)).alias("num_hashes"))


def anagram_variants(model: Model) -> DataFrame:
    """(anahash, variant_id, wordform): the words of each hash numbered from 0 by spelling.

    Numbered over the whole vocabulary and shifted by the first number of the hash.  The first
    numbers are written, so that both sides of the join are freshly shuffled and adaptive
    execution can split a large anagram class.
    """
    words = model.words.filter(F.col("anahash").isNotNull()).select("anahash", "wordform")
    rows = ranked(words, [F.col("anahash"), F.col("wordform")], "position")
    first = stored(rows.groupBy("anahash").agg(F.min("position").alias("first")), "first")
    return rows.join(first, "anahash").select(
        "anahash", (F.col("position") - F.col("first")).alias("variant_id"), "wordform")


def words_per_variant_rank(variants: DataFrame) -> DataFrame:
    """How many hashes have a word number 0, 1, 2, ..."""
    return variants.groupBy("variant_id").agg(F.count(F.lit(1)).alias("num_words"))
