"""Queries about morphological paradigms."""

from __future__ import annotations

from pyspark.sql import functions as F

from wordloom.operators import corpora as build
from wordloom.operators import paradigm_queries as q
from wordloom.plans.registry import query, rounded
from wordloom.plans.workload import Workload

LOOKUPS = ["thing", "ertion", "attion", "thble"]
LISTED = "('thing', 'ertion', 'attion', 'thble')"
ASKED = f"""asked AS (
    SELECT DISTINCT wordform AS lookup_word, Z, Y, X, W FROM m_paradigms
    WHERE wordform IN {LISTED})"""


@query("SELECT DISTINCT word_type_code AS code FROM m_paradigms")
def word_type_codes(w: Workload):
    return q.word_type_codes(w)


@query("""
    SELECT paradigm_id, Z, Y, X, W, V::BIGINT AS V, word_type_code,
           word_type_number::BIGINT AS word_type_number, wordform FROM m_paradigms""")
def component_codes(w: Workload):
    return w.paradigms


@query("""
    SELECT wordform, 'Z' || lpad(Z::VARCHAR, 4, '0') || 'Y' || lpad(Y::VARCHAR, 4, '0') || 'X'
           || lpad(X::VARCHAR, 4, '0') || 'W' || lpad(W::VARCHAR, 8, '0') AS code
    FROM m_paradigms""")
def paradigm_codes(w: Workload):
    return w.paradigms.select("wordform", q.paradigm_code().alias("code"))


@query("""
    SELECT wordform, Z, Y, X, W, V::BIGINT AS V, word_type_code,
           word_type_number::BIGINT AS word_type_number
    FROM m_paradigms""")
def paradigm_rows(w: Workload):
    codes = F.concat_ws("#", F.lit("broken"), F.col("code"))
    return build.paradigm_rows(w.coded_words.select("wordform", codes.alias("component_codes")))


@query("""
    SELECT 500 + row_number() OVER (ORDER BY wordform) AS paradigm_id, wordform
    FROM m_paradigms""")
def add_paradigms(w: Workload):
    rows = w.coded_words.select("wordform", F.col("code").alias("component_codes"))
    return build.add_paradigms(w, rows, 501)["paradigms"].select("paradigm_id", "wordform")


@query(f"""
    SELECT wordform, Z, Y, X, W, word_type_code FROM m_paradigms WHERE wordform IN {LISTED}""")
def paradigms_of_word(w: Workload):
    return q.paradigms_of_word(w, LOOKUPS)


@query(f"""
    WITH {ASKED} SELECT a.lookup_word, p.wordform FROM asked a JOIN m_paradigms p
    ON a.Z = p.Z AND a.Y = p.Y AND a.X = p.X AND a.W = p.W""")
def morph_links(w: Workload):
    return q.morph_links(w, LOOKUPS)


@query("""
    SELECT a.wordform AS lookup_word, p.paradigm_id, p.wordform, p.W, p.X, p.Y, p.Z
    FROM m_paradigms a JOIN m_paradigms p ON a.Z = p.Z AND a.Y = p.Y AND a.X = p.X AND a.W = p.W
    WHERE p.word_type_code = 'HCL'""")
def lemmas_for_wordform(w: Workload):
    return q.lemmas_for_wordform(w, None)


FAN_OUT = f"""
    WITH {ASKED},
    forms AS (
        SELECT p.* FROM m_paradigms p WHERE EXISTS (
            SELECT 1 FROM asked a
            WHERE a.Z = p.Z AND a.Y = p.Y AND a.X = p.X AND a.W = p.W)),
    joined AS (
        SELECT f.Z, f.Y, f.X, f.W, f.V, f.word_type_code, f.wordform, m.corpus_id,
               lw.lexicon_id, a.frequency, d.year, p3.W + p3.X + p3.Y + p3.Z AS code
        FROM forms f LEFT JOIN m_attestations a ON f.wordform = a.wordform
        LEFT JOIN m_dated d ON a.document_id = d.document_id
        LEFT JOIN m_members m ON d.document_id = m.document_id
        LEFT JOIN m_lexicon_words lw ON f.wordform = lw.wordform
        LEFT JOIN m_paradigms p3 ON f.wordform = p3.wordform)
    SELECT Z, Y, X, W, V::BIGINT AS V, word_type_code, wordform,
           count(DISTINCT corpus_id)::BIGINT AS num_corpora,
           count(DISTINCT lexicon_id)::BIGINT AS num_lexica,
           coalesce(min(year), 0)::BIGINT AS min_year, coalesce(max(year), 0)::BIGINT AS max_year,
           count(DISTINCT code)::BIGINT AS num_paradigms,
           {{frequency}} AS frequency
    FROM joined GROUP BY Z, Y, X, W, V, word_type_code, wordform"""


def _lemma_ids(w: Workload):
    return q.lemmas_for_wordform(w, LOOKUPS).select("paradigm_id").distinct()


@query(FAN_OUT.format(frequency="coalesce(sum(frequency), 0)::BIGINT"))
def variants_for_lemma(w: Workload):
    return q.variants_for_lemma(w, _lemma_ids(w)).drop("lemma_id")


@query(FAN_OUT.format(frequency="""(
    SELECT v.frequency FROM m_vocabulary v WHERE v.wordform = joined.wordform)"""))
def variants_for_lemma_distinct(w: Workload):
    return q.variants_for_lemma(
        w, _lemma_ids(w), distinct_attestations=True).drop("lemma_id")


FORMS = f"""
    WITH {ASKED},
    forms AS (
        SELECT a.lookup_word, 'Z' || lpad(a.Z::VARCHAR, 4, '0') || 'Y' ||
               lpad(a.Y::VARCHAR, 4, '0') || 'X' || lpad(a.X::VARCHAR, 4, '0') || 'W' ||
               lpad(a.W::VARCHAR, 8, '0') AS paradigm_code,
               p.wordform, p.word_type_code, p.word_type_number::BIGINT AS word_type_number,
               p.V::BIGINT AS V, v.anahash, v.frequency
        FROM asked a JOIN m_paradigms p ON a.Z = p.Z AND a.Y = p.Y AND a.X = p.X AND a.W = p.W
        JOIN m_vocabulary v ON p.wordform = v.wordform)"""
FORM_SERIES = FORMS + """,
    yearly AS (
        SELECT a.wordform, m.name AS corpus_name, d.pub_year AS year,
               sum(a.frequency)::BIGINT AS term_frequency, sum(d.word_count)::BIGINT AS total
        FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
        JOIN m_documents d ON a.document_id = d.document_id
        WHERE d.pub_year BETWEEN 1820 AND 1960
        AND a.wordform IN (SELECT wordform FROM forms) GROUP BY ALL),
    series AS (
        SELECT *, sum(term_frequency) OVER (PARTITION BY wordform, corpus_name)::BIGINT
                   AS total_number_of_words FROM yearly),
    lemmas AS (SELECT lookup_word, paradigm_code, min(wordform) AS lemma FROM forms
               WHERE word_type_code = 'HCL' GROUP BY ALL)"""


@query(FORMS + "SELECT * FROM forms")
def paradigm_variants(w: Workload):
    return q.paradigm_variants(w, q.paradigms_asked(w, LOOKUPS)).select(
        "lookup_word", q.paradigm_code().alias("paradigm_code"), "wordform", "word_type_code",
        "word_type_number", "V", "anahash", "frequency")


@query(FORM_SERIES + """
    SELECT f.*, l.lemma, s.corpus_name, s.year, s.term_frequency, s.total,
           round(s.term_frequency / s.total, 6) AS freq,
           round(s.term_frequency / s.total_number_of_words, 6) AS rel_corpus_frequency,
           s.total_number_of_words
    FROM forms f LEFT JOIN lemmas l USING (lookup_word, paradigm_code)
    LEFT JOIN series s ON f.wordform = s.wordform""")
def variants_of_word(w: Workload):
    return rounded(
        q.variants_of_word(w, LOOKUPS, 1820, 1960), "freq", "rel_corpus_frequency")


@query(FORM_SERIES + """,
    per_form AS (
        SELECT f.lookup_word, f.paradigm_code, f.wordform,
               coalesce(min(s.year), 0) AS min_year, coalesce(max(s.year), 0) AS max_year,
               coalesce(min(s.term_frequency / s.total), 0) AS min_freq,
               coalesce(max(s.term_frequency / s.total), 0) AS max_freq
        FROM forms f LEFT JOIN series s ON f.wordform = s.wordform GROUP BY ALL)
    SELECT lookup_word, paradigm_code, greatest(min(min_year), 1820)::BIGINT AS min_year,
           max(max_year)::BIGINT AS max_year, round(min(min_freq), 6) AS min_freq,
           round(max(max_freq), 6) AS max_freq, 1820::BIGINT AS overall_min_year,
           1960::BIGINT AS overall_max_year
    FROM per_form GROUP BY lookup_word, paradigm_code""")
def variants_metadata(w: Workload):
    return rounded(q.variants_metadata(w, LOOKUPS, 1820, 1960), "min_freq", "max_freq")


@query("SELECT X, Y, Z, count(W)::BIGINT AS num_paradigms FROM m_paradigms GROUP BY X, Y, Z")
def paradigm_count(w: Workload):
    return q.paradigm_count(w)


@query("""
    SELECT X, Y, Z, count(W)::BIGINT AS num_paradigms FROM m_paradigms
    WHERE Y = 5 AND Z = 3 GROUP BY X, Y, Z""")
def paradigm_count_filtered(w: Workload):
    return q.paradigm_count(w, Y=5, Z=3)


@query("SELECT X, count(W)::BIGINT AS num_paradigms FROM m_paradigms GROUP BY X")
def paradigm_size(w: Workload):
    return q.paradigm_size(w, "X")


# The codes of the word 'thing', worked out from its letters.
Z, Y, X, W = ord("t") % 3 + 1, ord("h") % 5 + 1, ord("i") * 31 + ord("n"), 11610403
SAME_Z_Y = f"""lemmas AS (
    SELECT p.X, p.W, p.wordform, v.frequency FROM m_paradigms p
    LEFT JOIN m_vocabulary v ON p.wordform = v.wordform
    WHERE p.Z = {Z} AND p.Y = {Y} AND p.word_type_code = 'HCL')"""


@query(f"""
    SELECT p.wordform, coalesce(v.frequency, 0) AS frequency FROM m_paradigms p
    LEFT JOIN m_vocabulary v ON p.wordform = v.wordform
    WHERE p.Z = {Z} AND p.Y = {Y} AND p.X = {X} AND p.W = {W}
    AND p.word_type_code IN ('HCL', 'HCM')""")
def variants_by_codes(w: Workload):
    return q.variants_by_codes(w, W, X, Y, Z)


@query("SELECT wordform AS lookup_word, paradigm_id, W, X, Y, Z FROM m_paradigms")
def codes_of_word(w: Workload):
    return q.codes_of_word(w, None)


@query(f"""
    WITH {SAME_Z_Y} SELECT X, sum(frequency)::BIGINT AS sum_freq FROM lemmas GROUP BY X
    ORDER BY abs(X - {X}), X LIMIT 50""")
def nearest_x(w: Workload):
    return q.nearest_x(w, X, Y, Z)


@query(f"""
    WITH {SAME_Z_Y} SELECT X, sum(frequency)::BIGINT AS sum_freq FROM lemmas GROUP BY X
    ORDER BY sum_freq DESC, X LIMIT 50""")
def frequent_x(w: Workload):
    return q.frequent_x(w, Y, Z)


@query(f"""
    WITH {SAME_Z_Y} SELECT X, W, wordform, frequency FROM lemmas WHERE X = {X}
    ORDER BY frequency DESC, wordform LIMIT 20""")
def frequent_lemmas(w: Workload):
    return q.frequent_lemmas(w, X, Y, Z, 20)


@query(f"""
    WITH {SAME_Z_Y} SELECT X, wordform, frequency FROM lemmas
    QUALIFY row_number() OVER (PARTITION BY X ORDER BY frequency DESC, wordform) = 1""")
def top_lemma_per_x(w: Workload):
    return q.top_lemma_per_x(w, Y, Z)


NETWORK = f"""
    WITH root AS (
        SELECT wordform AS lookup_word, Z, Y, X AS root_x, W AS root_w FROM m_paradigms
        WHERE wordform IN {LISTED}
        QUALIFY row_number() OVER (PARTITION BY wordform ORDER BY paradigm_id) = 1),
    candidates AS (
        SELECT r.*, p.X, p.W, p.wordform, coalesce(v.frequency, 0) AS frequency
        FROM root r JOIN m_paradigms p ON r.Z = p.Z AND r.Y = p.Y
        LEFT JOIN m_vocabulary v ON p.wordform = v.wordform WHERE p.word_type_code = 'HCL'),
    chosen AS (
        SELECT lookup_word, X FROM (SELECT DISTINCT lookup_word, X, root_x FROM candidates)
        QUALIFY row_number() OVER (
            PARTITION BY lookup_word ORDER BY abs(X - root_x), X) <= 50),
    top AS (
        SELECT c.*, row_number() OVER (
                   PARTITION BY c.lookup_word, c.X ORDER BY c.frequency DESC, c.wordform) AS place
        FROM candidates c JOIN chosen n ON c.lookup_word = n.lookup_word AND c.X = n.X
        QUALIFY place <= 50),
    hubs AS (
        SELECT lookup_word, Z, Y, root_x, root_w, X, sum(frequency)::BIGINT AS frequency,
               count(*) AS members, arg_min(W, place) AS first_w,
               arg_min(wordform, place) AS first_word, printf('Z%dY%dX%d', Z, Y, X) AS id
        FROM top GROUP BY lookup_word, Z, Y, root_x, root_w, X),
    word_nodes AS (
        SELECT t.*, h.id AS hub FROM top t JOIN hubs h
        ON t.lookup_word = h.lookup_word AND t.X = h.X WHERE h.members > 1)"""


@query(NETWORK + """
    SELECT lookup_word, wordform AS id, Z, Y, X, W, 'w' AS type, frequency, wordform
    FROM word_nodes
    UNION ALL
    SELECT lookup_word, id, Z, Y, X, CASE WHEN X = root_x THEN root_w ELSE first_w END, 'x',
           frequency, CASE WHEN X = root_x THEN lookup_word ELSE first_word END
    FROM hubs""")
def paradigm_network_nodes(w: Workload):
    return q.paradigm_network(w, LOOKUPS)[0]


@query(NETWORK + """,
    links AS (
        SELECT lookup_word, wordform AS source, hub AS target, 'XW' AS type FROM word_nodes
        UNION ALL
        SELECT lookup_word, id, printf('Z%dY%dX%d', Z, Y, root_x), 'XX' FROM hubs
        WHERE X <> root_x AND lookup_word IN (SELECT lookup_word FROM hubs WHERE X = root_x))
    SELECT *, source || target AS id FROM links""")
def paradigm_network_links(w: Workload):
    return q.paradigm_network(w, LOOKUPS)[1]


NESTED = FORM_SERIES + """,
    counted AS (
        SELECT f.lookup_word, f.paradigm_code, f.wordform, f.V, s.corpus_name,
               count(s.year)::BIGINT AS years, sum(s.term_frequency)::BIGINT AS total
        FROM forms f LEFT JOIN series s ON f.wordform = s.wordform GROUP BY ALL),
    nested AS (
        SELECT lookup_word, count(DISTINCT paradigm_code)::BIGINT AS num_paradigms,
               count(DISTINCT paradigm_code || wordform || V)::BIGINT AS num_variants,
               count(corpus_name)::BIGINT AS num_series, sum(years)::BIGINT AS num_points,
               coalesce(sum(total), 0)::BIGINT AS term_frequency
        FROM counted GROUP BY lookup_word)"""


def _nested_counts():
    variants = F.flatten(F.transform("paradigms", lambda p: p["variants"]))
    series = F.flatten(F.transform(variants, lambda v: v["corpora"]))
    points = F.flatten(F.transform(series, lambda s: s["frequencies"]))
    frequency = F.aggregate(
        points, F.lit(0).cast("long"), lambda total, point: total + point["term_frequency"])
    return [
        F.size("paradigms").cast("long").alias("num_paradigms"), F.size(variants).cast("long").alias("num_variants"),
        F.size(series).cast("long").alias("num_series"),
        F.size(points).cast("long").alias("num_points"), frequency.alias("term_frequency"),
    ]


@query(NESTED + " SELECT * FROM nested")
def variants_nested(w: Workload):
    return q.variants_document(w, LOOKUPS, 1820, 1960).select("lookup_word", *_nested_counts())


@query(NESTED + """,
    ranked AS (
        SELECT correction_candidate AS lookup_word, count(*)::BIGINT AS num_corrections,
               min(ld)::BIGINT AS nearest
        FROM m_variant_pairs WHERE correction_candidate IN {listed} GROUP BY ALL)
    SELECT lookup_word, num_paradigms, num_variants, num_series, num_points, term_frequency,
           num_corrections, nearest
    FROM nested FULL JOIN ranked USING (lookup_word)""".replace("{listed}", LISTED))
def corrections_nested(w: Workload):
    found = q.corrections_document(w, LOOKUPS, 1820, 1960)
    return found.select(
        "lookup_word", *_nested_counts(),
        F.when(F.col("corrections").isNotNull(), F.size("corrections")).cast("long")
        .alias("num_corrections"),
        F.col("corrections")[0]["levenshtein_distance"].alias("nearest"))
