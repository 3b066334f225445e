"""Queries in anagram space, on frequency distributions and on the lemma database."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.functions.text import is_complete_form, without_artificial_frequency
from wordloom.operators import anagram_queries as a
from wordloom.operators import lemma_queries as g
from wordloom.operators import statistics as s
from wordloom.plans.paradigm_workload import ASKED, LISTED, LOOKUPS
from wordloom.plans.registry import query, rounded
from wordloom.plans.workload import Workload

# A confusion list, as a parameter: letters that print alike, in both directions.
ALIKE = ["ec", "il", "nu", "sf", "hb", "ao", "vu", "tl"]


def _value(letter: str) -> int:
    return (ord(letter) + 4) ** 5


CONFUSIONS = sorted(
    sign * (_value(x) - _value(y)) for x, y in ALIKE for sign in (1, -1))
MAX_CONFUSION = max(CONFUSIONS)


def confusions(w: Workload):
    return w.spark.createDataFrame([(c,) for c in CONFUSIONS], "confusion LONG")


@query("SELECT wordform, anahash FROM m_vocabulary")
def anahash_of_word(w: Workload):
    return a.anahash_of_word(w, None)


@query("""
    SELECT anahash, count(*)::BIGINT AS num_wf FROM m_vocabulary
    GROUP BY anahash HAVING count(*) > 1""")
def words_per_anahash(w: Workload):
    return a.words_per_anahash(w)


@query(f"""
    SELECT x.wordform AS lookup_word, y.wordform FROM m_vocabulary x
    LEFT JOIN m_vocabulary y ON x.anahash = y.anahash WHERE x.wordform IN {LISTED}""")
def anahash_links(w: Workload):
    return a.anahash_links(w, LOOKUPS)


@query(f"""
    WITH {ASKED}
    SELECT s.wordform_from AS lookup_word, 'lexicon' AS kind, s.wordform_to AS wordform,
           l.lexicon_name
    FROM m_link_sources s LEFT JOIN m_lexica l ON s.lexicon_id = l.lexicon_id
    WHERE s.wordform_from IN {LISTED}
    UNION ALL SELECT x.wordform, 'anahash', y.wordform, NULL FROM m_vocabulary x
    LEFT JOIN m_vocabulary y ON x.anahash = y.anahash WHERE x.wordform IN {LISTED}
    UNION ALL SELECT k.lookup_word, 'morph', p.wordform, NULL FROM asked k JOIN m_paradigms p
    ON k.Z = p.Z AND k.Y = p.Y AND k.X = p.X AND k.W = p.W""")
def word_card(w: Workload):
    return a.word_card(w, LOOKUPS)


@query(f"""
    WITH shifts AS (SELECT unnest({CONFUSIONS})::BIGINT AS confusion),
    targets AS (SELECT anahash, confusion, anahash + confusion AS target
                FROM (SELECT DISTINCT anahash FROM m_vocabulary), shifts)
    SELECT t.anahash, t.confusion, v.wordform
    FROM targets t JOIN m_vocabulary v ON t.target = v.anahash""")
def confusion_neighbours(w: Workload):
    return a.confusion_neighbours(w, confusions(w))


@query(f"""
    WITH shifts AS (SELECT unnest({CONFUSIONS})::BIGINT AS confusion)
    SELECT x.wordform AS lookup_word, s.confusion, v.wordform
    FROM m_vocabulary x, shifts s JOIN m_vocabulary v ON x.anahash + s.confusion = v.anahash
    WHERE x.wordform IN {LISTED}""")
def confusion_neighbours_of_word(w: Workload):
    return a.confusion_neighbours_of_word(w, LOOKUPS, confusions(w))


@query(f"""
    SELECT x.wordform AS lookup_word, v.wordform, v.anahash - x.anahash AS difference
    FROM m_vocabulary x JOIN m_vocabulary v
    ON v.anahash BETWEEN x.anahash - {MAX_CONFUSION} AND x.anahash + {MAX_CONFUSION}
    WHERE x.wordform IN {LISTED}""")
def range_neighbours(w: Workload):
    return a.range_neighbours(w, LOOKUPS, MAX_CONFUSION)


CLASSES = """
    WITH classes AS (
        SELECT anahash, count(*)::BIGINT AS variant_count,
               length(min(wordform))::INTEGER AS word_length
        FROM m_vocabulary GROUP BY anahash)"""


@query(CLASSES + "SELECT * FROM classes")
def anagram_statistics(w: Workload):
    return a.anagram_statistics(w)


@query(CLASSES + """
    SELECT round(avg(variant_count), 6) AS mean_variants, count(*)::BIGINT AS num_hashes
    FROM classes""")
def mean_variants_per_anahash(w: Workload):
    return rounded(a.mean_variants(w), "mean_variants")


@query(CLASSES + """
    SELECT word_length, variant_count, count(*)::BIGINT AS num_hashes
    FROM classes GROUP BY word_length, variant_count""")
def variants_by_length(w: Workload):
    return a.variants_by_length(w)


@query("""
    SELECT variant_id, count(*)::BIGINT AS num_words FROM (
        SELECT row_number() OVER (PARTITION BY anahash ORDER BY wordform) - 1 AS variant_id
        FROM m_vocabulary) GROUP BY variant_id""")
def words_per_variant_rank(w: Workload):
    return a.words_per_variant_rank(a.anagram_variants(w))


# Frequency distributions.

RANKED = """
    WITH ranked AS (
        SELECT wordform, frequency, row_number() OVER (ORDER BY frequency DESC, wordform) AS rank,
               sum(frequency) OVER () AS total, count(*) OVER () AS n
        FROM m_vocabulary)"""


@query(RANKED + """
    SELECT wordform, frequency, rank,
           sum(frequency) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING)::BIGINT AS running_sum,
           round(sum(frequency) OVER (ORDER BY rank ROWS UNBOUNDED PRECEDING) / total, 6)
               AS running_share
    FROM ranked""")
def running_shares(w: Workload):
    return rounded(s.running_shares(w.word_frequency), "running_share")


@query("""
    SELECT 'removed' AS change, count(*)::BIGINT AS num_words FROM m_vocabulary
    WHERE wordform NOT IN (SELECT wordform FROM m_lexicon_words)
    UNION ALL
    SELECT 'added', count(DISTINCT wordform) FROM m_lexicon_words
    WHERE wordform NOT IN (SELECT wordform FROM m_vocabulary)""")
def list_differences(w: Workload):
    return s.list_differences(w.words, w.lexicon_words)


ZIPF = RANKED + """,
    norm AS (SELECT sum(1.0 / pow(rank, 1.05)) AS z FROM ranked),
    expected AS (
        SELECT wordform, frequency, rank, total * (1.0 / pow(rank + 1.5, 1.05) / z) AS expected
        FROM ranked, norm)"""


@query(ZIPF + """
    SELECT wordform, frequency, rank, round(expected, 6) AS expected,
           round(1 - frequency / expected, 6) AS residual FROM expected""")
def zipf_mandelbrot(w: Workload):
    return rounded(s.zipf(w.word_frequency, q=1.5, s=1.05), "expected", "residual")


@query(RANKED + """,
    norm AS (SELECT sum(1.0 / rank) AS z FROM ranked)
    SELECT 0.0::DOUBLE AS q, 1.0::DOUBLE AS s,
           round(-sum(frequency / total * log2((1.0 / rank / z) / (frequency / total))), 6) AS kl
    FROM ranked, norm WHERE frequency > 0""")
def kl_divergence(w: Workload):
    return rounded(s.kl_divergence(w.word_frequency), "kl")


@query(RANKED + """
    SELECT round(-sum(frequency / total * log2(frequency / total)), 6) AS entropy
    FROM ranked WHERE frequency > 0""")
def entropy(w: Workload):
    return rounded(s.entropy(w.word_frequency), "entropy")


QS, SS = (0.0, 0.5, 1.0, 2.0, 5.0), (0.9, 0.95, 1.0, 1.05, 1.1, 1.2)
GRID = RANKED + f""",
    grid AS (SELECT q::DOUBLE AS q, s::DOUBLE AS s FROM (SELECT unnest({list(QS)}) AS q),
             (SELECT unnest({list(SS)}) AS s)),
    norms AS (SELECT g.s, sum(1.0 / pow(r.rank, g.s)) AS z
              FROM (SELECT DISTINCT s FROM grid) g, ranked r GROUP BY g.s),
    fits AS (
        SELECT g.q, g.s, round(sum(frequency / total * log2(
                   (frequency / total) / (1.0 / pow(rank + g.q, g.s) / n.z))), 6) AS kl
        FROM ranked, grid g JOIN norms n ON g.s = n.s WHERE frequency > 0 GROUP BY g.q, g.s)"""


@query(GRID + "SELECT * FROM fits")
def kl_grid(w: Workload):
    return rounded(s.kl_grid(w.word_frequency, QS, SS), "kl")


@query(GRID + "SELECT * FROM fits ORDER BY kl, q, s LIMIT 1")
def fit_zipf(w: Workload):
    return rounded(s.fit_zipf(w.word_frequency, QS, SS), "kl")


# Newton's method written out: each step is a sum over all ranks.
STEPS = "".join(f""",
    step{i + 1} AS (
        SELECT s - (any_value(aim) - sum(ln(rank) / pow(rank, s)) / sum(1 / pow(rank, s)))
                   / (sum(ln(rank) * ln(rank) / pow(rank, s)) / sum(1 / pow(rank, s))
                      - pow(sum(ln(rank) / pow(rank, s)) / sum(1 / pow(rank, s)), 2)) AS s
        FROM step{i}, ranked, aims GROUP BY s)""" for i in range(8))


@query(RANKED + f""",
    aims AS (SELECT sum(frequency / total * ln(rank)) AS aim FROM ranked),
    step0 AS (SELECT 1.0::DOUBLE AS s){STEPS},
    norm AS (SELECT s, sum(1 / pow(rank, s)) AS z FROM step8, ranked GROUP BY s)
    SELECT 0.0::DOUBLE AS q, round(any_value(s), 6) AS s,
           round(sum(frequency / total * log2((frequency / total) * pow(rank, s) * z)), 6) AS kl
    FROM ranked, norm WHERE frequency > 0""")
def best_zipf(w: Workload):
    return rounded(s.best_zipf(w.word_frequency), "s", "kl")


@query("""
    SELECT wordform, frequency FROM m_vocabulary""")
def without_artificial_frequency_counts(w: Workload):
    count = F.when(
        F.length("wordform") % 2 == 0, F.col("frequency") + 100_000_000
    ).otherwise(F.col("frequency"))
    return w.word_frequency.select("wordform", count.alias("frequency")).withColumn(
        "frequency", without_artificial_frequency(F.col("frequency")))


# The lemma database.

ANALYSES = """
    WITH analyses AS (
        SELECT p.paradigm_id AS analysis_id, p.wordform,
               CASE p.word_type_code WHEN 'HCL' THEN 'NOU' WHEN 'HCT' THEN 'VRB_CONTRACT'
                    ELSE 'VRB(mainPart)' END AS part_of_speech,
               l.paradigm_id AS lemma_id, l.wordform AS modern_lemma,
               CASE WHEN p.V = 1 THEN 1::BIGINT END AS verified_by
        FROM m_paradigms p JOIN m_paradigms l
        ON p.Z = l.Z AND p.Y = l.Y AND p.X = l.X AND p.W = l.W AND l.word_type_code = 'HCL')"""


@query(ANALYSES + """
    SELECT analysis_id, wordform, part_of_speech, lemma_id, verified_by FROM analyses""")
def analysed_words(w: Workload):
    return g.analysed_words(w.lemma_db).select(
        "analysis_id", "wordform", "part_of_speech", "lemma_id", "verified_by")


@query(ANALYSES + """
    SELECT v.wordform, x.analysis_id, x.part_of_speech, d.document_id,
           d.title AS persistent_id
    FROM m_vocabulary v LEFT JOIN analyses x ON v.wordform = x.wordform
    LEFT JOIN m_attestations t ON x.wordform = t.wordform
    LEFT JOIN m_documents d ON t.document_id = d.document_id""")
def words_in_documents(w: Workload):
    return g.words_in_documents(w.lemma_db, w.attested_parts)


@query("""
    SELECT document_id, count(*)::BIGINT AS num_tokens,
           count(DISTINCT wordform)::BIGINT AS num_words
    FROM m_attestations WHERE wordform IN (SELECT wordform FROM m_paradigms)
    GROUP BY document_id""")
def tokens_per_document(w: Workload):
    return g.tokens_per_document(w.lemma_db, w.attested_parts)


@query(ANALYSES + """
    SELECT part_of_speech, count(*)::BIGINT AS num_analyses FROM analyses
    GROUP BY part_of_speech""")
def count_by_part_of_speech(w: Workload):
    return g.count_by_part_of_speech(w.lemma_db)


@query(ANALYSES + """
    SELECT v.wordform, x.analysis_id, x.part_of_speech, x.lemma_id, x.modern_lemma,
           CASE WHEN x.lemma_id IS NOT NULL THEN 'NOU' END AS lemma_part_of_speech
    FROM m_vocabulary v LEFT JOIN analyses x ON v.wordform = x.wordform""")
def lemma_forms(w: Workload):
    return g.lemma_forms(w.lemma_db)


@query(ANALYSES + """
    SELECT v.wordform, count(x.lemma_id)::BIGINT AS num_lemmata
    FROM m_vocabulary v LEFT JOIN analyses x ON v.wordform = x.wordform GROUP BY v.wordform""")
def lemmata_per_word(w: Workload):
    return g.lemmata_per_word(w.lemma_db)


@query(ANALYSES + """
    SELECT wordform, analysis_id, part_of_speech, lemma_id, modern_lemma,
           'NOU' AS lemma_part_of_speech
    FROM analyses WHERE part_of_speech = 'NOU'""")
def complete_lemma_forms(w: Workload):
    return g.complete_lemma_forms(w.lemma_db)


@query(ANALYSES + """
    SELECT part_of_speech, part_of_speech = 'NOU' AS complete, count(*)::BIGINT AS n
    FROM analyses GROUP BY part_of_speech""")
def complete_part_of_speech(w: Workload):
    return w.lemma_db["analyses"].groupBy(
        "part_of_speech", is_complete_form(F.col("part_of_speech")).alias("complete")
    ).agg(F.count(F.lit(1)).alias("n"))


@query(ANALYSES + "SELECT analysis_id, wordform FROM analyses WHERE verified_by IS NULL")
def unverified_analyses(w: Workload):
    return g.rows_with(w.lemma_db["analyses"], "verified_by", present=False).select(
        "analysis_id", "wordform")


@query("""
    SELECT wordform FROM m_vocabulary ORDER BY md5(wordform || '|7'), wordform LIMIT 10""")
def random_words(w: Workload):
    return g.random_rows(w.words.select("wordform"), "wordform", 10, seed=7)
