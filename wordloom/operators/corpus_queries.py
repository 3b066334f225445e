"""Where and when words occur."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.functions.text import effective_year
from wordloom.model import Model
from wordloom.operators.lookup import MAX_LISTED, Words
from wordloom.operators.marks import (
    each_corpus, in_corpus, marked, number_of_corpora, summed_by_corpus,
)


def _rows() -> Column:
    return F.count(F.lit(1))


def _one() -> Column:
    return F.lit(1).cast("long")


def _by_name(
    rows: DataFrame, model: Model, keys: list[str], sums: dict[str, Column],
    together: list[str] | None = None,
) -> DataFrame:
    """`(keys, name, sums)` of marked attestations, once per corpus of the document.

    Rows that agree in the columns `together` come out in one task, for a window over them.
    """
    named = summed_by_corpus(rows, keys, sums).join(model.corpora, "corpus_id")
    if together:
        named = named.select(*keys, "name", *sums).repartition(*together)
    return named.groupBy(*keys, "name").agg(*[F.sum(name).alias(name) for name in sums])


def corpora_named(model: Model, corpus_name: str) -> list[int]:
    """The ids of that name, nearly always one; they become literals that are tested row by row."""
    found = model.corpora.filter(F.col("name") == corpus_name).select("corpus_id").limit(
        MAX_LISTED + 1).collect()
    if len(found) > MAX_LISTED:
        raise ValueError(f"over {MAX_LISTED} corpora are named {corpus_name!r}")
    return [row["corpus_id"] for row in found]


def _of_corpus(rows: DataFrame, model: Model, corpus_name: str) -> tuple[DataFrame, Column]:
    """The marked attestations of one corpus, and how often each counts: once for each corpus
    of that name."""
    times = sum((in_corpus(i) for i in corpora_named(model, corpus_name)), F.lit(0).cast("long"))
    return rows.filter(times > 0), times


def word_in_corpora(model: Model, words: Words = None) -> DataFrame:
    """Per word and corpus: rows of documents and occurrences."""
    return _by_name(marked(model, words), model, ["wordform"], {
        "document_frequency": _one(), "term_frequency": F.col("frequency")})


def word_in_corpus_over_time(model: Model, corpus_name: str, words: Words = None) -> DataFrame:
    """Per word and publication year (which may be unknown) within one corpus."""
    members, times = _of_corpus(marked(model, words), model, corpus_name)
    return members.groupBy("wordform", "pub_year").agg(
        F.sum(times).alias("document_frequency"),
        F.sum(F.col("frequency") * times).alias("term_frequency"))


def year_range(model: Model) -> DataFrame:
    """First and last publication year; year ranges do not count."""
    return model.documents.agg(
        F.min("pub_year").alias("min_year"), F.max("pub_year").alias("max_year"))


def year_bound(model: Model, which: str, given: int | None) -> Column:
    """A given year, or the first or last publication year of all documents."""
    if given is not None:
        return F.lit(given).cast("long")
    return year_range(model).select(which).scalar()


def word_in_corpora_over_time(
    model: Model, words: Words = None, start: int | None = None, end: int | None = None,
    few: bool | None = None,
) -> DataFrame:
    """Yearly series per word and corpus.

    `few` is that of `marks.marked`.  `total` is the size of the documents that contain the word; `freq` the share of the word in
    them; `rel_corpus_frequency` the share of the year in the word's corpus total.
    """
    rows = marked(model, words, few).filter(F.col("pub_year").isNotNull())
    if start is not None:
        rows = rows.filter(F.col("pub_year") >= start)
    if end is not None:
        rows = rows.filter(F.col("pub_year") <= end)
    yearly = _by_name(rows, model, ["wordform", "pub_year"], {
        "document_frequency": _one(), "term_frequency": F.col("frequency"),
        "total": F.col("word_count")}, together=["wordform"]
    ).withColumnRenamed("pub_year", "year")
    # Sums by set of corpora are few for one word, so they are shuffled once, by word, which also
    # serves what is asked of a word's whole series; the window holds one row per year.
    corpus_total = F.sum("term_frequency").over(Window.partitionBy("wordform", "name"))
    return yearly.withColumn("total_number_of_words", corpus_total).withColumns({
        "freq": F.try_divide("term_frequency", "total"),
        "rel_corpus_frequency": F.try_divide("term_frequency", "total_number_of_words"),
    })


def series_per_corpus(series: DataFrame) -> DataFrame:
    """The yearly series as one array per word and corpus, oldest year first."""
    point = F.struct(
        "year", "freq", "total", "term_frequency", "rel_corpus_frequency")
    return series.groupBy("wordform", "name").agg(
        F.first("total_number_of_words").alias("total_number_of_words"),
        F.sort_array(F.collect_list(point)).alias("frequencies"),
    )


def series_metadata(
    model: Model, series: DataFrame, start: int | None = None, end: int | None = None,
) -> DataFrame:
    """Per word the ranges of its series; words without a series have no row."""
    return series.groupBy("wordform").agg(
        F.min("year").alias("min_year"), F.max("year").alias("max_year"),
        F.min("freq").alias("min_freq"), F.max("freq").alias("max_freq"),
        F.min("term_frequency").alias("min_term_freq"),
        F.max("term_frequency").alias("max_term_freq"),
        F.min("rel_corpus_frequency").alias("min_corpus_rel_freq"),
        F.max("rel_corpus_frequency").alias("max_corpus_rel_freq"),
    ).withColumns({
        "overall_min_year": year_bound(model, "min_year", start),
        "overall_max_year": year_bound(model, "max_year", end),
    })


def relative_series(model: Model, words: Words = None) -> DataFrame:
    """Occurrences per hundred words, per word, corpus and publication year, known or not."""
    yearly = _by_name(marked(model, words), model, ["wordform", "pub_year"], {
        "document_frequency": _one(), "term_frequency": F.col("frequency"),
        "num_words": F.col("word_count")})
    return yearly.withColumn("normalized_term_frequency", F.try_divide(
        F.col("term_frequency"), F.col("num_words")) * 100)


def dated_documents(model: Model) -> DataFrame:
    return model.documents.select(
        "document_id", "word_count", effective_year().alias("year"))


def word_frequency_per_year(
    model: Model, words: Words = None, corpus_id: int | None = None,
) -> DataFrame:
    """Occurrences per thousand million words, by effective year.

    The denominator is the size of the documents that contain the word.  A document counts
    once for every corpus it is in: that number is multiplied in, not produced as rows.
    """
    rows = marked(model, words).filter(F.col("year").isNotNull())
    if corpus_id is not None:
        rows, copies = rows.filter(in_corpus(corpus_id) > 0), _one()
    else:
        copies = F.greatest(number_of_corpora(), _one())
    sums = rows.groupBy("wordform", "year").agg(
        F.sum(F.col("frequency") * copies).alias("f"),
        F.sum(F.col("word_count") * copies).alias("n"))
    return sums.select(
        "wordform", "year",
        F.try_divide(F.lit(1e9) * F.col("f"), F.col("n")).alias("normalized_frequency"),
    )


def word_frequency_per_corpus(model: Model, words: Words = None) -> DataFrame:
    """Occurrences per thousand million words, by corpus; NULL for documents in none."""
    sums = summed_by_corpus(marked(model, words), ["wordform"], {
        "f": F.col("frequency"), "n": F.col("word_count")}, outer=True)
    return (
        sums.join(model.corpora, "corpus_id", "left")
        .groupBy("wordform", "corpus_id", F.col("name").alias("corpus_name"))
        .agg(F.sum("f").alias("f"), F.sum("n").alias("n"))
        .select(
            "wordform", "corpus_name",
            F.try_divide(F.lit(1e9) * F.col("f"), F.col("n")).alias("relative_frequency"),
        )
    )


def corpora(model: Model) -> DataFrame:
    """Word total and document count of every corpus, also of empty ones."""
    sizes = (
        model.corpus_documents
        .join(model.documents.select("document_id", "word_count"), "document_id")
        .groupBy("corpus_id")
        .agg(F.sum("word_count").alias("word_count"), _rows().alias("document_count"))
    )
    return model.corpora.join(sizes, "corpus_id", "left").withColumn(
        "document_count", F.coalesce("document_count", F.lit(0).cast("long")))


def _sizes_by_corpus(documents: DataFrame, model: Model, *keys: str) -> DataFrame:
    return (
        documents.join(model.corpus_documents, "document_id", "left")
        .groupBy("corpus_id", *keys).agg(F.sum("word_count").alias("sum_word_count"))
        .join(model.corpora, "corpus_id", "left")
        .groupBy("corpus_id", "name", *keys)
        .agg(F.sum("sum_word_count").alias("sum_word_count"))
    )


def corpus_size(model: Model) -> DataFrame:
    """Size of every corpus in units of 10^8 words; documents in no corpus have a NULL name."""
    sizes = _sizes_by_corpus(model.documents.select("document_id", "word_count"), model)
    return sizes.select(
        "name", (F.col("sum_word_count") / F.lit(1e8)).alias("sum_word_count"),
    ).orderBy("name")


def word_count_per_year(model: Model) -> DataFrame:
    """Words per corpus and effective year."""
    return _sizes_by_corpus(dated_documents(model), model, "year").select(
        "name", "year", "sum_word_count").orderBy("year", "name")


def words_in_min_corpora(model: Model, num: int = 2) -> DataFrame:
    """Words that occur in at least `num` corpora."""
    blocks = marked(model).select("wordform", F.inline("corpora"))
    return (
        blocks.groupBy("wordform", "block").agg(F.bit_or("bits").alias("bits"))
        .groupBy("wordform").agg(F.sum(F.bit_count("bits")).alias("num_corpora"))
        .filter(F.col("num_corpora") >= num)
    )


def words_per_document(model: Model, corpus_name: str) -> DataFrame:
    """Distinct words by document title."""
    members, _ = _of_corpus(marked(model), model, corpus_name)
    return members.select("title", "wordform").distinct()


def count_words_per_document(model: Model, corpus_name: str) -> DataFrame:
    return words_per_document(model, corpus_name).groupBy("title").agg(
        _rows().alias("tot_freq"))


def count_words_per_document_and_lexicon(
    model: Model, corpus_name: str, lexicon_name: str,
) -> DataFrame:
    lexicon = model.lexica.filter(F.col("lexicon_name") == lexicon_name)
    members = model.lexicon_words.join(lexicon, "lexicon_id", "left_semi")
    return (
        words_per_document(model, corpus_name)
        .join(members, "wordform", "left_semi")
        .groupBy("title").agg(_rows().alias("lexicon_freq"))
    )


def lexicon_coverage(model: Model, corpus_name: str, lexicon_name: str) -> DataFrame:
    """Percentage of each document's words that the lexicon has, in one pass over the words."""
    lexicon = model.lexica.filter(F.col("lexicon_name") == lexicon_name)
    members = model.lexicon_words.join(lexicon, "lexicon_id", "left_semi").select(
        "wordform").distinct().withColumn("known", F.lit(1).cast("long"))
    counted = (
        words_per_document(model, corpus_name).join(members, "wordform", "left")
        .groupBy("title").agg(_rows().alias("tot_freq"), F.sum("known").alias("lexicon_freq"))
    )
    return counted.withColumn(
        "percentage", F.col("lexicon_freq") / F.col("tot_freq") * 100)


def words_of_corpora(model: Model) -> DataFrame:
    """Distinct (wordform, corpus name)."""
    sets = marked(model).select("wordform", "corpora").distinct()
    return each_corpus(sets).join(model.corpora, "corpus_id").select(
        "wordform", "name").distinct()


def count_unique_words_per_corpus(model: Model, corpus_name: str | None = None) -> DataFrame:
    """Distinct words and total occurrences, of one corpus or of each.

    Summed per word first: the second aggregation counts rows and needs no distinct.
    """
    if corpus_name is None:
        per_word = _by_name(marked(model), model, ["wordform"], {"f": F.col("frequency")})
    else:
        members, times = _of_corpus(marked(model), model, corpus_name)
        per_word = members.groupBy("wordform").agg(
            F.sum(F.col("frequency") * times).alias("f")).withColumn("name", F.lit(corpus_name))
    return per_word.groupBy("name").agg(
        _rows().alias("num_wordforms"), F.sum("f").alias("total_wordforms"))


def total_frequencies(model: Model) -> DataFrame:
    """Total frequency of every attested word."""
    return model.attestations.groupBy("wordform").agg(F.sum("frequency").alias("freq"))


def cardinalities(model: Model) -> DataFrame:
    """Number of rows of every table."""
    counts = [
        df.agg(_rows().alias("num_rows")).select(F.lit(name).alias("table"), "num_rows")
        for name, df in model.tables().items()
    ]
    result = counts[0]
    for count in counts[1:]:
        result = result.unionByName(count)
    return result
