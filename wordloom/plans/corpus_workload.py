"""Queries about corpora, documents and years."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.bags import bags_of_texts, bags_of_word_lists, long_frame
from wordloom.operators import corpora as build
from wordloom.operators import corpus_queries as q
from wordloom.plans.registry import query, rounded
from wordloom.plans.workload import Workload, spread

LOOKUPS = ["the", "and", "of", "in"]
LISTED = "('the', 'and', 'of', 'in')"


@query("""
    SELECT a.wordform, d.year,
           round(1e9 * sum(a.frequency) / sum(d.word_count), 4) AS normalized_frequency
    FROM m_attestations a JOIN m_dated d ON a.document_id = d.document_id
    LEFT JOIN m_corpus_documents cd ON d.document_id = cd.document_id
    WHERE a.wordform IN ('the', 'and', 'of', 'in') AND d.year IS NOT NULL
    GROUP BY a.wordform, d.year""")
def word_frequency_per_year(w: Workload):
    return rounded(q.word_frequency_per_year(w, LOOKUPS), "normalized_frequency", digits=4)


@query("""
    SELECT a.wordform, d.year,
           round(1e9 * sum(a.frequency) / sum(d.word_count), 4) AS normalized_frequency
    FROM m_attestations a JOIN m_dated d ON a.document_id = d.document_id
    LEFT JOIN m_corpus_documents cd ON d.document_id = cd.document_id
    WHERE d.year IS NOT NULL
    GROUP BY a.wordform, d.year""")
def word_frequency_per_year_all_words(w: Workload):
    return rounded(q.word_frequency_per_year(w), "normalized_frequency", digits=4)


@query("""
    SELECT a.wordform, d.year,
           round(1e9 * sum(a.frequency) / sum(d.word_count), 4) AS normalized_frequency
    FROM m_attestations a JOIN m_dated d ON a.document_id = d.document_id
    JOIN m_corpus_documents cd ON d.document_id = cd.document_id
    WHERE a.wordform IN ('the', 'and', 'of', 'in') AND cd.corpus_id = 1000
    GROUP BY a.wordform, d.year""")
def word_frequency_per_year_in_corpus(w: Workload):
    return rounded(
        q.word_frequency_per_year(w, LOOKUPS, corpus_id=1000), "normalized_frequency", digits=4)


@query("""
    SELECT a.wordform, m.name AS corpus_name,
           round(1e9 * sum(a.frequency) / sum(d.word_count), 4) AS relative_frequency
    FROM m_attestations a JOIN m_documents d ON a.document_id = d.document_id
    LEFT JOIN m_members m ON d.document_id = m.document_id
    GROUP BY a.wordform, m.corpus_id, m.name""")
def word_frequency_per_corpus(w: Workload):
    return rounded(q.word_frequency_per_corpus(w), "relative_frequency", digits=4)


@query("""
    SELECT a.wordform, m.name, count(*)::BIGINT AS document_frequency,
           sum(a.frequency)::BIGINT AS term_frequency
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
    GROUP BY a.wordform, m.name""")
def word_in_corpora(w: Workload):
    return q.word_in_corpora(w)


@query("""
    SELECT a.wordform, d.pub_year, count(*)::BIGINT AS document_frequency,
           sum(a.frequency)::BIGINT AS term_frequency
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
    JOIN m_documents d ON a.document_id = d.document_id
    WHERE m.name = 'quality' GROUP BY a.wordform, d.pub_year""")
def word_in_corpus_over_time(w: Workload):
    return q.word_in_corpus_over_time(w, "quality")


SERIES = """
    WITH yearly AS (
        SELECT a.wordform, m.name, d.pub_year AS year, count(*)::BIGINT AS document_frequency,
               sum(a.frequency)::BIGINT AS term_frequency,
               sum(d.word_count)::BIGINT AS total
        FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
        JOIN m_documents d ON a.document_id = d.document_id
        WHERE d.pub_year BETWEEN 1850 AND 1950
        GROUP BY a.wordform, m.name, d.pub_year),
    series AS (
        SELECT *, sum(term_frequency) OVER (PARTITION BY wordform, name)::BIGINT
                   AS total_number_of_words
        FROM yearly)
"""


@query(SERIES + """
    SELECT *, round(term_frequency / total, 6) AS freq,
           round(term_frequency / total_number_of_words, 6) AS rel_corpus_frequency
    FROM series""")
def word_in_corpora_over_time(w: Workload):
    series = q.word_in_corpora_over_time(w, None, 1850, 1950)
    return rounded(series, "freq", "rel_corpus_frequency")


@query(SERIES + """
    SELECT wordform, min(year) AS min_year, max(year) AS max_year,
           round(min(term_frequency / total), 6) AS min_freq,
           round(max(term_frequency / total), 6) AS max_freq,
           min(term_frequency) AS min_term_freq, max(term_frequency) AS max_term_freq,
           round(min(term_frequency / total_number_of_words), 6) AS min_corpus_rel_freq,
           round(max(term_frequency / total_number_of_words), 6) AS max_corpus_rel_freq,
           1850::BIGINT AS overall_min_year, 1950::BIGINT AS overall_max_year
    FROM series GROUP BY wordform""")
def word_over_time_metadata(w: Workload):
    series = q.word_in_corpora_over_time(w, None, 1850, 1950)
    return rounded(
        q.series_metadata(w, series, 1850, 1950),
        "min_freq", "max_freq", "min_corpus_rel_freq", "max_corpus_rel_freq")


@query(SERIES + """
    SELECT wordform, name, total_number_of_words, count(*)::BIGINT AS num_years,
           arg_min(term_frequency, year) AS first_term_frequency
    FROM series GROUP BY ALL""")
def word_series_nested(w: Workload):
    series = q.series_per_corpus(q.word_in_corpora_over_time(w, None, 1850, 1950))
    return series.select(
        "wordform", "name", "total_number_of_words",
        F.size("frequencies").cast("long").alias("num_years"),
        F.col("frequencies")[0]["term_frequency"].alias("first_term_frequency"))


@query(f"""
    SELECT a.wordform, m.name, d.pub_year, count(*)::BIGINT AS document_frequency,
           sum(a.frequency)::BIGINT AS term_frequency, sum(d.word_count)::BIGINT AS num_words,
           round(sum(a.frequency) / sum(d.word_count) * 100, 6) AS normalized_term_frequency
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
    JOIN m_documents d ON a.document_id = d.document_id
    WHERE a.wordform IN {LISTED} GROUP BY a.wordform, m.name, d.pub_year""")
def word_relative_series(w: Workload):
    return rounded(q.relative_series(w, LOOKUPS), "normalized_term_frequency")


@query("""
    SELECT wordform, count(DISTINCT corpus_id)::BIGINT AS num_corpora
    FROM m_attestations a JOIN m_corpus_documents cd ON a.document_id = cd.document_id
    GROUP BY wordform HAVING count(DISTINCT corpus_id) >= 2""")
def words_in_min_corpora(w: Workload):
    return q.words_in_min_corpora(w, 2)


TITLED = """
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
    JOIN m_documents d ON a.document_id = d.document_id WHERE m.name = 'src3'"""


@query(f"SELECT title, count(DISTINCT wordform)::BIGINT AS tot_freq {TITLED} GROUP BY title")
def count_words_per_document(w: Workload):
    return q.count_words_per_document(w, "src3")


@query(f"""
    SELECT title, count(DISTINCT wordform)::BIGINT AS lexicon_freq {TITLED}
    AND wordform IN (SELECT lw.wordform FROM m_lexicon_words lw JOIN m_lexica l
                     ON lw.lexicon_id = l.lexicon_id WHERE l.lexicon_name = 'benchmark')
    GROUP BY title""")
def count_words_per_document_and_lexicon(w: Workload):
    return q.count_words_per_document_and_lexicon(w, "src3", "benchmark")


@query(f"""
    WITH all_words AS (SELECT title, count(DISTINCT wordform)::BIGINT AS tot_freq
                       {TITLED} GROUP BY title),
    known AS (SELECT title, count(DISTINCT wordform)::BIGINT AS lexicon_freq {TITLED}
              AND wordform IN (SELECT wordform FROM m_lexicon_words WHERE lexicon_id = 1)
              GROUP BY title)
    SELECT coalesce(a.title, k.title) AS title, tot_freq, lexicon_freq,
           round(lexicon_freq / tot_freq * 100, 6) AS percentage
    FROM all_words a FULL OUTER JOIN known k ON a.title = k.title""")
def lexicon_coverage(w: Workload):
    return rounded(q.lexicon_coverage(w, "src3", "benchmark"), "percentage")


@query(f"SELECT DISTINCT title, wordform {TITLED}")
def words_per_document(w: Workload):
    return q.words_per_document(w, "src3")


@query("""
    SELECT m.name, count(DISTINCT a.wordform)::BIGINT AS num_wordforms,
           sum(a.frequency)::BIGINT AS total_wordforms
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id GROUP BY m.name""")
def count_unique_words_per_corpus(w: Workload):
    return q.count_unique_words_per_corpus(w)


@query("""
    SELECT m.name, count(DISTINCT a.wordform)::BIGINT AS num_wordforms,
           sum(a.frequency)::BIGINT AS total_wordforms
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
    WHERE m.name = 'quality' GROUP BY m.name""")
def count_unique_words_in_corpus(w: Workload):
    return q.count_unique_words_per_corpus(w, "quality")


@query("""
    SELECT DISTINCT a.wordform, m.name
    FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id""")
def words_of_corpora(w: Workload):
    return q.words_of_corpora(w)


@query("SELECT wordform, sum(frequency)::BIGINT AS freq FROM m_attestations GROUP BY wordform")
def total_frequencies(w: Workload):
    return q.total_frequencies(w)


@query("SELECT min(pub_year) AS min_year, max(pub_year) AS max_year FROM m_documents")
def year_range(w: Workload):
    return q.year_range(w)


@query("""
    SELECT c.corpus_id, c.name, sum(d.word_count)::BIGINT AS word_count,
           count(d.document_id)::BIGINT AS document_count
    FROM m_corpora c LEFT JOIN m_corpus_documents cd ON c.corpus_id = cd.corpus_id
    LEFT JOIN m_documents d ON cd.document_id = d.document_id GROUP BY c.corpus_id, c.name""")
def corpora(w: Workload):
    return q.corpora(w)


@query("""
    SELECT m.name, round(sum(d.word_count) / 1e8, 8) AS sum_word_count
    FROM m_documents d LEFT JOIN m_members m ON d.document_id = m.document_id
    GROUP BY m.corpus_id, m.name""")
def corpus_size(w: Workload):
    return rounded(q.corpus_size(w), "sum_word_count", digits=8)


@query("""
    SELECT m.name, d.year, sum(d.word_count)::BIGINT AS sum_word_count
    FROM m_dated d LEFT JOIN m_members m ON d.document_id = m.document_id
    GROUP BY m.corpus_id, m.name, d.year""")
def word_count_per_year(w: Workload):
    return q.word_count_per_year(w)


@query("""
    SELECT document_id, title, language, word_count, pub_year, year_from, year_to, year
    FROM m_dated""")
def effective_years(w: Workload):
    return q.dated_documents(w).select("document_id", "year").join(w.documents.select(
        "document_id", "title", "language", "word_count", "pub_year", "year_from", "year_to",
    ), "document_id")


# Building a corpus.

@query("SELECT document_id, wordform, frequency FROM m_attestations")
def tokenized_corpus(w: Workload):
    bags = bags_of_texts(spread(w.source("documents").select("doc_id", "text"), "doc_id"),
                         max_length=None)
    return long_frame(bags, "doc_id").withColumnRenamed("doc_id", "document_id")


@query("""
    SELECT conv_id, turn, wordform, count(*)::BIGINT AS frequency
    FROM (SELECT conv_id, turn, unnest(string_split(text, ' ')) AS wordform FROM conversations)
    GROUP BY conv_id, turn, wordform""")
def word_list_corpus(w: Workload):
    lists = w.source("conversations").select("conv_id", "turn", F.split("text", " ").alias("words"))
    return long_frame(bags_of_word_lists(lists), "conv_id", "turn")


def _english_corpus(w: Workload):
    """A corpus to add: the benchmark items, as bags keyed by `file`."""
    bags = bags_of_texts(w.source("benchmark").select(
        F.format_string("item-%06d", "item_id").alias("file"), "text"), max_length=None)
    documents = bags.select(
        "file", F.col("file").alias("title"), F.lit("en").alias("language"),
        F.lit(1990).alias("pub_year"))
    return build.add_corpus(
        w, "items", documents, long_frame(bags, "file"), corpus_id=2000,
        first_document_id=1_000_000_000)


ITEMS = """
    WITH bags AS (
        SELECT item_id, wordform, count(*)::BIGINT AS frequency FROM (
            SELECT item_id, unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS wordform
            FROM benchmark) GROUP BY ALL),
    numbered AS (SELECT item_id, 999999999 + row_number() OVER (
                     ORDER BY printf('item-%06d', item_id)) AS document_id FROM benchmark)
"""


@query(ITEMS + """
    SELECT n.document_id, printf('item-%06d', n.item_id) AS title, 'en' AS language,
           1990::BIGINT AS pub_year,
           coalesce((SELECT sum(b.frequency) FROM bags b WHERE b.item_id = n.item_id), 0)::BIGINT
               AS word_count
    FROM numbered n""")
def added_corpus_documents(w: Workload):
    return _english_corpus(w)["documents"].select(
        "document_id", "title", "language", "pub_year", "word_count")


@query(ITEMS + """
    SELECT n.document_id, b.wordform, b.frequency
    FROM numbered n JOIN bags b ON n.item_id = b.item_id""")
def added_corpus_attestations(w: Workload):
    return _english_corpus(w)["attestations"]


@query(ITEMS + """
    SELECT DISTINCT wordform, wordform AS wordform_lowercase FROM bags
    WHERE wordform NOT IN (SELECT wordform FROM m_vocabulary)""")
def added_corpus_words(w: Workload):
    return _english_corpus(w)["words"].drop("anahash")


@query(ITEMS + "SELECT 2000::BIGINT AS corpus_id, document_id FROM numbered")
def added_corpus_members(w: Workload):
    return _english_corpus(w)["corpus_documents"]


WORD_TABLE = """
    WITH known AS (SELECT wordform FROM m_vocabulary UNION SELECT wordform FROM m_benchmark_words)
    SELECT k.wordform, {frequency} AS frequency
    FROM known k LEFT JOIN m_attestations a ON k.wordform = a.wordform GROUP BY k.wordform"""


def _with_benchmark_words(w: Workload):
    from dataclasses import replace

    from wordloom.operators.words import new_words

    model = w.model()
    return replace(model, words=model.words.unionByName(
        new_words(model.words, w.benchmark_words, preprocess_words=False)))


@query(WORD_TABLE.format(frequency="sum(a.frequency)::BIGINT"))
def word_frequency_table(w: Workload):
    return build.word_frequencies(_with_benchmark_words(w))


@query(WORD_TABLE.format(frequency="coalesce(sum(a.frequency), 0)::BIGINT"))
def word_frequency_table_with_zeros(w: Workload):
    return build.word_frequencies(_with_benchmark_words(w), missing_as_zero=True)


@query("""
    SELECT d.document_id, pub_year,
           CASE WHEN m.document_id IS NULL THEN year_from ELSE 1950 END AS year_from,
           CASE WHEN m.document_id IS NULL THEN year_to ELSE 2010 END AS year_to
    FROM m_documents d LEFT JOIN (
        SELECT DISTINCT document_id FROM m_members WHERE name = 'quality') m
    ON d.document_id = m.document_id""")
def set_document_years(w: Workload):
    return build.set_document_years(w, "quality", 1950, 2010).select(
        "document_id", "pub_year", "year_from", "year_to")


@query("""
    SELECT 'attestations' AS "table", count(*)::BIGINT AS num_rows FROM m_attestations
    UNION ALL SELECT 'words', count(*) FROM m_vocabulary
    UNION ALL SELECT 'word_frequency', count(*) FROM m_vocabulary
    UNION ALL SELECT 'documents', count(*) FROM documents
    UNION ALL SELECT 'corpora', count(*) FROM m_corpora
    UNION ALL SELECT 'corpus_documents', count(*) FROM m_corpus_documents
    UNION ALL SELECT 'lexica', count(*) FROM m_lexica
    UNION ALL SELECT 'lexicon_words', count(*) FROM m_lexicon_words
    UNION ALL SELECT 'links', count(*) FROM m_link_sources
    UNION ALL SELECT 'link_sources', count(*) FROM m_link_sources
    UNION ALL SELECT 'ranked_variants', count(*) FROM m_variant_pairs
    UNION ALL SELECT 'paradigms', count(*) FROM m_paradigms
    UNION ALL SELECT 'external_links', 2 * count(*) FROM m_paradigms
              WHERE word_type_code = 'HCL'""")
def table_cardinalities(w: Workload):
    return q.cardinalities(w.model())
