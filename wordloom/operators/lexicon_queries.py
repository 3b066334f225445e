"""What lexica say about words."""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.model import Model
from wordloom.operators.corpus_queries import corpora_named
from wordloom.operators.links import LINK
from wordloom.operators.lookup import Words, for_words, is_listed
from wordloom.operators.marks import in_corpus, marked
from wordloom.scratch import stored


def words_in_min_lexica(
    model: Model, num: int = 2, vocabulary_only: bool = False,
) -> DataFrame:
    """Words with at least `num` lexicon memberships; repeated memberships count."""
    members = model.lexicon_words
    if vocabulary_only:
        members = members.join(
            model.lexica.filter(F.col("vocabulary")), "lexicon_id", "left_semi")
    return (
        members.groupBy("wordform").agg(F.count(F.lit(1)).alias("num_lexicons"))
        .filter(F.col("num_lexicons") >= num).orderBy("num_lexicons", "wordform")
    )


def count_words_in_lexica(model: Model) -> DataFrame:
    """Distinct words per lexicon name."""
    return (
        model.lexicon_words.join(model.lexica, "lexicon_id")
        .select("lexicon_name", "wordform").distinct()
        .groupBy("lexicon_name").agg(F.count(F.lit(1)).alias("num_wordforms"))
    )


def words_of_lexicon(model: Model, lexicon_name: str) -> DataFrame:
    lexicon = model.lexica.filter(F.col("lexicon_name") == lexicon_name)
    return model.lexicon_words.join(lexicon, "lexicon_id", "left_semi").select("wordform")


def words_in_lexicon_and_corpus(
    model: Model, lexicon_name: str, corpus_name: str,
) -> DataFrame:
    """The intersection of a lexicon and the words of a corpus."""
    attested = reduce(or_, (
        in_corpus(i) > 0 for i in corpora_named(model, corpus_name)), F.lit(False))
    # A word leaves a task once, not once a document.
    attested = marked(model).filter(attested).select("wordform").distinct()
    wanted = words_of_lexicon(model, lexicon_name).distinct()
    return wanted.join(attested, "wordform", "left_semi")


def lexicon_size(model: Model) -> DataFrame:
    """Members per lexicon in units of 10^5, under the first 20 characters of its name."""
    counts = model.lexicon_words.groupBy("lexicon_id").agg(F.count("wordform").alias("n"))
    return counts.join(model.lexica, "lexicon_id", "left").select(
        F.substring("lexicon_name", 1, 20).alias("name"),
        (F.col("n") / F.lit(1e5)).alias("word_count"),
    ).orderBy(F.desc("word_count"), "name")


def word_links(model: Model, words: Words) -> DataFrame:
    """Words linked to a word, with the lexica that say so (NULL if none does)."""
    linked = for_words(model.links, words, "wordform_from")
    stated = for_words(model.link_sources, words, "wordform_from").select(*LINK, "lexicon_id")
    return (
        linked.join(stated, LINK, "left").join(model.lexica, "lexicon_id", "left")
        .select(
            F.col("wordform_from").alias("lookup_word"), F.col("wordform_to").alias("wordform"),
            "lexicon_name",
        )
    )


def lexica_of_word(model: Model, words: str | list[str]) -> DataFrame:
    """Per looked-up word and lexicon: does it have the word, and is it right?

    A vocabulary has its members, all right.  Another lexicon has the words it links from, and
    says of each whether it is right; of several statements the one with the smallest linked
    word counts.
    """
    asked = [words] if isinstance(words, str) else list(words)
    per_lexicon = model.lexica.select(
        "*", F.explode(F.array(*[F.lit(w) for w in asked])).alias("lookup_word"))
    members = for_words(model.lexicon_words, asked).select(
        "lexicon_id", F.col("wordform").alias("lookup_word"),
    ).distinct().withColumn("member", F.lit(True))
    statements = (
        for_words(model.link_sources, asked, "wordform_from")
        .groupBy("lexicon_id", F.col("wordform_from").alias("lookup_word"))
        .agg(F.min_by("wordform_from_correct", "wordform_to").alias("stated"),
             F.lit(True).alias("linked"))
    )
    known = for_words(model.words, asked).select(
        F.col("wordform").alias("lookup_word"), F.lit(True).alias("known"))
    keys = ["lexicon_id", "lookup_word"]
    joined = (
        per_lexicon.join(members, keys, "left").join(statements, keys, "left")
        .join(known, "lookup_word", "left")
    )
    has = F.col("known").isNotNull() & F.when(
        F.col("vocabulary"), F.col("member").isNotNull()).otherwise(F.col("linked").isNotNull())
    return joined.withColumn("has_wordform", has).select(
        "lookup_word", "lexicon_name", "has_wordform",
        F.when(F.col("has_wordform"), F.col("vocabulary") | F.coalesce(
            "stated", F.lit(False))).alias("correct"),
    )


def linked_words(model: Model, words: Words, lexicon_id: int) -> DataFrame:
    """Words a lexicon links to a word."""
    stated = for_words(model.link_sources, words, "wordform_from").filter(
        F.col("lexicon_id") == lexicon_id)
    return stated.join(model.links, LINK, "left_semi").select(
        *LINK, "wordform_from_correct", "wordform_to_correct", "ld",
    ).orderBy("ld", "wordform_to")


def linked_words_in_corpus(
    model: Model, words: Words, lexicon_id: int, corpus_id: int,
) -> DataFrame:
    """Words a lexicon links to a word, with their frequency in a corpus.

    Words that the corpus does not have are left out.  `correct` tells of the linked word,
    `word_correct` of the word itself.
    """
    # Written first: its true size is known when the attestations are joined, so a few words
    # are broadcast by Spark's own size check and the attestations are only scanned.
    linked = stored(linked_words(model, words, lexicon_id), "linked")
    frequencies = (
        marked(model, linked.select("wordform_to"), is_listed(words))
        .filter(in_corpus(corpus_id) > 0)
        .groupBy(F.col("wordform").alias("wordform_to"))
        .agg(F.sum("frequency").alias("f"))
    )
    return (
        linked.join(frequencies, "wordform_to")
        .groupBy(
            F.col("wordform_from").alias("lookup_word"), F.col("wordform_to").alias("wordform"),
            F.col("wordform_to_correct").alias("correct"),
            F.col("wordform_from_correct").alias("word_correct"), "ld",
        )
        .agg(F.sum("f").alias("freq_in_corpus"))
        .orderBy(F.desc("freq_in_corpus"), "ld", "wordform")
    )


def corrections(model: Model, words: Words) -> DataFrame:
    """Ranked OCR variants of a word."""
    return for_words(model.ranked_variants, words, "wordform_source").select(
        F.col("wordform_source").alias("lookup_word"), "wordform", "frequency",
        "levenshtein_distance",
    )
