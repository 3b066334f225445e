"""Queries about words, lexica and links."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from wordloom.operators import corpora as build
from wordloom.operators import lexica, links, search, words
from wordloom.operators import lexicon_queries as q
from wordloom.operators.word_index import WordIndex
from wordloom.plans.corpus_workload import LOOKUPS
from wordloom.plans.ingest import empty_model
from wordloom.plans.oracle import edit_distance, hash_of
from wordloom.plans.registry import query
from wordloom.plans.workload import VARIANT_LEXICON, Workload
from wordloom.scratch import new_path
from wordloom.sources.stored_model import StoredModel
from wordloom.sources.tables import append

# Raw entries to clean: the names in `part` and the titles in `customer`, padded and joined.
ENTRIES = """
    SELECT '  ' || replace(p_name, ' ', CASE WHEN p_partkey % 2 = 0 THEN ' ' ELSE '_' END)
           || ' ' AS wordform FROM part
    UNION ALL SELECT c_name || ' ' || lower(c_mktsegment) FROM customer
    UNION ALL SELECT ' ' FROM region"""


def raw_entries(w: Workload):
    gap = F.when(F.col("p_partkey") % 2 == 0, " ").otherwise("_")
    parts = w.source("part").select(
        F.concat(F.lit("  "), F.replace("p_name", F.lit(" "), gap), F.lit(" ")).alias("wordform"))
    customers = w.source("customer").select(
        F.concat_ws(" ", "c_name", F.lower("c_mktsegment")).alias("wordform"))
    blanks = w.source("region").select(F.lit(" ").alias("wordform"))
    return parts.unionByName(customers).unionByName(blanks)


PREPROCESSED = f"""
    WITH cleaned AS (
        SELECT DISTINCT translate(trim(wordform), '_ ', '*_') AS wordform FROM ({ENTRIES})
        WHERE trim(wordform) <> '')"""


@query(f"""
    SELECT wordform AS raw, translate(trim(wordform), '_ ', '*_') AS wordform
    FROM ({ENTRIES})""")
def preprocessed_words(w: Workload):
    from wordloom.functions.text import preprocess

    return raw_entries(w).select(
        F.col("wordform").alias("raw"), preprocess(F.col("wordform")).alias("wordform"))


@query(PREPROCESSED + "SELECT wordform FROM cleaned")
def cleaned_words(w: Workload):
    return words.cleaned(raw_entries(w))


@query("""
    SELECT wordform, wordform AS wordform_lowercase FROM m_vocabulary
    WHERE wordform NOT IN (SELECT wordform FROM m_benchmark_words)""")
def new_words(w: Workload):
    known = words.new_words(w.words.limit(0), w.benchmark_words)
    return words.new_words(known, w.words, preprocess_words=False).drop("anahash")


@query("""
    SELECT coalesce(v.wordform, b.wordform) AS wordform, v.anahash
    FROM m_benchmark_words b LEFT JOIN m_vocabulary v ON v.wordform = b.wordform""")
def get_or_create_words(w: Workload):
    return words.get_or_create_words(w.words, w.benchmark_words).select("wordform", "anahash")


@query(PREPROCESSED + """
    SELECT 'lexica' AS tbl, 'parts' AS value FROM (SELECT 1)
    UNION ALL SELECT 'lexicon_words', wordform FROM cleaned
    UNION ALL SELECT 'words', wordform FROM cleaned
        WHERE wordform NOT IN (SELECT wordform FROM m_vocabulary)""")
def add_lexicon(w: Workload):
    added = lexica.add_lexicon(w, "parts", True, raw_entries(w), lexicon_id=77)
    rows = added["lexica"].select(F.lit("lexica").alias("tbl"), F.col("lexicon_name").alias("value"))
    for name in ("lexicon_words", "words"):
        rows = rows.unionByName(added[name].select(
            F.lit(name).alias("tbl"), F.col("wordform").alias("value")))
    return rows


UNHASHED = "wordform NOT IN (SELECT wordform FROM m_benchmark_words)"


def _partly_hashed(w: Workload):
    """The words, where only those of the benchmark vocabulary have their hash."""
    known = w.benchmark_words.withColumn("known", F.lit(True))
    return w.words.join(known, "wordform", "left").select(
        "wordform", "wordform_lowercase", F.when(F.col("known"), F.col("anahash")).alias("anahash"))


@query(f"SELECT wordform, 1::BIGINT AS frequency FROM m_vocabulary WHERE {UNHASHED}")
def words_without_hash(w: Workload):
    return words.words_without_hash(_partly_hashed(w))


@query("SELECT lexicon_id, wordform FROM m_lexicon_words WHERE lexicon_id = 1")
def lexicon_mapping(w: Workload):
    return words.lexicon_mapping(w, lexicon_name="benchmark").select("lexicon_id", "wordform")


@query("""
    SELECT DISTINCT anahash FROM m_vocabulary WHERE anahash NOT IN (
        SELECT anahash FROM m_vocabulary
        WHERE wordform IN (SELECT wordform FROM m_benchmark_words))""")
def new_anahashes(w: Workload):
    known = _partly_hashed(w).filter(F.col("anahash").isNotNull()).select("anahash").distinct()
    return words.new_anahashes(known, w.words)


@query("SELECT wordform, wordform AS wordform_lowercase, anahash FROM m_vocabulary")
def connected_anahashes(w: Workload):
    hashes = words.fill_anahashes(words.reset_anahashes(w.words)).select("wordform", "anahash")
    return words.connect_anahashes(_partly_hashed(w), hashes)


@query(f"""
    SELECT wordform, {hash_of('wordform')} AS anahash FROM m_vocabulary
    UNION ALL SELECT wordform, {hash_of('wordform')} FROM m_benchmark_words
    WHERE wordform NOT IN (SELECT wordform FROM m_vocabulary)""")
def filled_anahashes(w: Workload):
    table = _partly_hashed(w).unionByName(
        words.new_words(w.words, w.benchmark_words, preprocess_words=False))
    return words.fill_anahashes(table).select("wordform", "anahash")


@query(f"""
    SELECT wordform, list_sum(list_transform(string_split(wordform, ''), lambda ch:
        CASE ch WHEN 'a' THEN 13382255776 WHEN 'b' THEN 22877577568 WHEN 'c' THEN 23863536599
                WHEN 'f' THEN 27027081632 WHEN 'w' THEN 28153056843 ELSE 7 END::BIGINT))::BIGINT
        AS anahash FROM m_vocabulary""")
def alphabet_anahashes(w: Workload):
    from wordloom.functions.anahash import anahash

    # Five letters of an alphabet file; all other characters count 7.
    alphabet = {
        "a": 13382255776, "b": 22877577568, "c": 23863536599, "f": 27027081632,
        "w": 28153056843,
    }
    return w.words.select("wordform", anahash(F.col("wordform"), alphabet, 7).alias("anahash"))


@query("SELECT wordform, NULL::BIGINT AS anahash FROM m_vocabulary")
def reset_anahashes(w: Workload):
    return words.reset_anahashes(w.words).select("wordform", "anahash")


@query(f"""
    WITH w AS (SELECT DISTINCT wordform FROM ({ENTRIES})),
    plan AS (SELECT wordform, translate(trim(wordform), '_ ', '*_') AS target FROM w),
    chosen AS (SELECT target, min(wordform) AS wordform FROM plan
               WHERE wordform <> target AND target <> ''
               AND target NOT IN (SELECT wordform FROM w) GROUP BY target)
    SELECT w.wordform, coalesce(c.target, w.wordform) AS new_wordform,
           c.target IS NOT NULL AS renamed
    FROM w LEFT JOIN chosen c ON w.wordform = c.wordform""")
def normalized_words(w: Workload):
    return words.normalize_words(raw_entries(w).distinct())


# Lexicon queries.

@query("""
    SELECT wordform, count(*)::BIGINT AS num_lexicons FROM m_lexicon_words
    GROUP BY wordform HAVING count(*) >= 2""")
def words_in_min_lexica(w: Workload):
    return q.words_in_min_lexica(w, 2)


@query("""
    SELECT wordform, count(*)::BIGINT AS num_lexicons FROM m_lexicon_words lw
    JOIN m_lexica l ON lw.lexicon_id = l.lexicon_id WHERE l.vocabulary
    GROUP BY wordform HAVING count(*) >= 2""")
def words_in_min_vocabularies(w: Workload):
    return q.words_in_min_lexica(w, 2, vocabulary_only=True)


@query("""
    SELECT lexicon_name, count(DISTINCT wordform)::BIGINT AS num_wordforms
    FROM m_lexicon_words lw JOIN m_lexica l ON lw.lexicon_id = l.lexicon_id
    GROUP BY lexicon_name""")
def count_words_in_lexica(w: Workload):
    return q.count_words_in_lexica(w)


@query("""
    SELECT wordform FROM m_lexicon_words lw JOIN m_lexica l ON lw.lexicon_id = l.lexicon_id
    WHERE l.lexicon_name = 'lang_en'""")
def words_of_lexicon(w: Workload):
    return q.words_of_lexicon(w, "lang_en")


@query("""
    SELECT wordform FROM m_lexicon_words lw JOIN m_lexica l ON lw.lexicon_id = l.lexicon_id
    WHERE l.lexicon_name = 'lang_en'
    INTERSECT
    SELECT wordform FROM m_attestations a JOIN m_members m ON a.document_id = m.document_id
    WHERE m.name = 'quality'""")
def words_in_lexicon_and_corpus(w: Workload):
    return q.words_in_lexicon_and_corpus(w, "lang_en", "quality")


@query("""
    SELECT l.lexicon_name[1:20] AS name, count(lw.wordform) / 1e5 AS word_count
    FROM m_lexicon_words lw LEFT JOIN m_lexica l ON lw.lexicon_id = l.lexicon_id
    GROUP BY lw.lexicon_id, l.lexicon_name""")
def lexicon_size(w: Workload):
    return q.lexicon_size(w)


@query("""
    SELECT s.wordform_from AS lookup_word, s.wordform_to AS wordform, l.lexicon_name
    FROM m_link_sources s LEFT JOIN m_lexica l ON s.lexicon_id = l.lexicon_id""")
def word_links(w: Workload):
    return q.word_links(w, None)


@query(f"""
    WITH asked AS (SELECT unnest(['the', 'and', 'of', 'in', 'eht', 'zzzzz']) AS lookup_word),
    facts AS (
        SELECT a.lookup_word, l.lexicon_id, l.lexicon_name, l.vocabulary,
               a.lookup_word IN (SELECT wordform FROM m_vocabulary) AS known,
               exists (SELECT 1 FROM m_lexicon_words m WHERE m.lexicon_id = l.lexicon_id
                       AND m.wordform = a.lookup_word) AS member,
               (SELECT arg_min(s.wordform_from_correct, s.wordform_to) FROM m_link_sources s
                WHERE s.lexicon_id = l.lexicon_id AND s.wordform_from = a.lookup_word) AS stated
        FROM asked a, m_lexica l),
    having_it AS (
        SELECT *, known AND CASE WHEN vocabulary THEN member ELSE stated IS NOT NULL END AS has
        FROM facts)
    SELECT lookup_word, lexicon_name, has AS has_wordform,
           CASE WHEN has THEN vocabulary OR coalesce(stated, false) END AS correct
    FROM having_it""")
def lexica_of_word(w: Workload):
    return q.lexica_of_word(w, [*LOOKUPS, "eht", "zzzzz"])


@query("""
    SELECT wordform_from, wordform_to, wordform_from_correct, wordform_to_correct, ld
    FROM m_link_sources WHERE lexicon_id = 9""")
def linked_words(w: Workload):
    return q.linked_words(w, None, VARIANT_LEXICON)


@query("""
    SELECT s.wordform_from AS lookup_word, s.wordform_to AS wordform,
           s.wordform_to_correct AS correct, s.wordform_from_correct AS word_correct, s.ld,
           sum(a.frequency)::BIGINT AS freq_in_corpus
    FROM m_link_sources s JOIN m_attestations a ON s.wordform_to = a.wordform
    JOIN m_corpus_documents cd ON a.document_id = cd.document_id
    WHERE s.lexicon_id = 9 AND cd.corpus_id = 1000 GROUP BY ALL""")
def linked_words_in_corpus(w: Workload):
    return q.linked_words_in_corpus(w, None, VARIANT_LEXICON, 1000)


@query("""
    SELECT correction_candidate AS lookup_word, ocr_variant AS wordform,
           corpus_frequency AS frequency, ld::BIGINT AS levenshtein_distance
    FROM m_variant_pairs""")
def corrections(w: Workload):
    return q.corrections(w, None)


@query("""
    SELECT correction_candidate AS lookup_word, ocr_variant AS wordform,
           corpus_frequency AS frequency, ld::BIGINT AS levenshtein_distance
    FROM m_variant_pairs WHERE correction_candidate IN ('thing', 'ertion', 'attion', 'nicht')""")
def corrections_of_word(w: Workload):
    return q.corrections(w, ["thing", "ertion", "attion", "nicht"])


# Links.

def _pairs(w: Workload):
    """Variant pairs at 2, some repeated backwards before or after, and self links."""
    pairs = w.variant_pairs.select(
        F.col("ocr_variant").alias("a"), F.col("correction_candidate").alias("b"), "ld",
        F.lit(2).alias("at"))
    back = pairs.filter(F.col("ld") > 2).select(
        F.col("b").alias("a"), F.col("a").alias("b"), F.lit(99).alias("ld"),
        F.when(F.col("ld") % 2 == 0, 1).otherwise(3).alias("at"))
    self_links = pairs.select(F.col("b").alias("a"), "b", F.lit(0).alias("ld"), "at")
    return pairs.unionByName(back).unionByName(self_links)


@query("""
    WITH given AS (
        SELECT ocr_variant AS a, correction_candidate AS b, ld, 2 AS place FROM m_variant_pairs
        UNION ALL SELECT correction_candidate, ocr_variant, 99, CASE ld % 2 WHEN 0 THEN 1 ELSE 3 END
        FROM m_variant_pairs WHERE ld > 2),
    first AS (SELECT * FROM given QUALIFY row_number() OVER (
        PARTITION BY least(a, b), greatest(a, b) ORDER BY place) = 1)
    SELECT a AS wordform_from, b AS wordform_to, 5::BIGINT AS lexicon_id,
           true AS wordform_from_correct, false AS wordform_to_correct, ld FROM first
    UNION ALL SELECT b, a, 5, false, true, ld FROM first""")
def link_sources(w: Workload):
    directed = links.both_directions(_pairs(w), "a", "b", ["ld"], order_by="at")
    return links.link_sources(directed, 5, True, False).drop("anahash_difference")


@query("""
    SELECT wordform_from, wordform_to FROM m_link_sources
    WHERE NOT (wordform_from_correct AND ld > 2)""")
def new_links(w: Workload):
    known = w.link_sources.filter(F.col("wordform_from_correct") & (F.col("ld") > 2))
    directed = links.both_directions(_pairs(w), "a", "b", ["ld"], order_by="at")
    return links.new_links(known.select(*links.LINK), directed)


@query("""
    SELECT ocr_variant AS a, correction_candidate AS b FROM m_variant_pairs
    WHERE NOT (ocr_variant IN (SELECT wordform FROM m_benchmark_words)
               AND correction_candidate IN (SELECT wordform FROM m_benchmark_words))""")
def unmapped_pairs(w: Workload):
    pairs = w.variant_pairs.select(
        F.col("ocr_variant").alias("a"), F.col("correction_candidate").alias("b"))
    return links.unmapped_pairs(pairs, w.benchmark_words, "a", "b")


@query("""
    WITH sources AS (
        SELECT ocr_variant AS wordform_from, correction_candidate AS wordform_to,
               false AS wordform_from_correct, true AS wordform_to_correct, ld
        FROM m_variant_pairs
        UNION ALL SELECT correction_candidate, ocr_variant, true, false, ld
        FROM m_variant_pairs)
    SELECT * FROM sources""")
def add_correction_candidates(w: Workload):
    added = lexica.add_correction_candidates(w, "again", w.variant_pairs, lexicon_id=78)
    return added["link_sources"].drop("lexicon_id", "anahash_difference")


@query("""
    SELECT DISTINCT wordform_from AS wordform FROM m_link_sources""")
def added_linked_lexicon(w: Workload):
    pairs = w.variant_pairs.select("ocr_variant", "correction_candidate")
    added = lexica.add_lexicon_with_links(
        w, "pairs", True, pairs, "ocr_variant", "correction_candidate", True, True,
        lexicon_id=79)
    return added["lexicon_words"].select("wordform")


@query("""
    SELECT 'links' AS tbl, wordform_from, wordform_to, NULL::BOOLEAN AS wordform_to_correct
    FROM m_link_sources WHERE ld > 2
    UNION ALL SELECT 'sources', wordform_from, wordform_to, wordform_to_correct
    FROM m_link_sources WHERE ld > 2""")
def spelling_corrections(w: Workload):
    few = w.link_sources.filter(F.col("ld") <= 2)
    pairs = w.variant_pairs.select(
        F.col("ocr_variant").alias("wordform_from"),
        F.col("correction_candidate").alias("wordform_to"))
    new, stated = links.add_links(few.select(*links.LINK), few, pairs, VARIANT_LEXICON)
    return new.select(
        F.lit("links").alias("tbl"), *links.LINK,
        F.lit(None).cast("boolean").alias("wordform_to_correct"),
    ).unionByName(stated.select(
        F.lit("sources").alias("tbl"), *links.LINK, "wordform_to_correct"))


@query(f"""
    SELECT wordform_from, wordform_to,
           {edit_distance('wordform_from', 'wordform_to')}::INTEGER AS ld,
           {hash_of('wordform_to')} - {hash_of('wordform_from')} AS anahash_difference
    FROM (SELECT wordform AS wordform_from,
                 lead(wordform) OVER (ORDER BY wordform) AS wordform_to
          FROM m_benchmark_words) WHERE wordform_to IS NOT NULL""")
def measured_links(w: Workload):
    from wordloom.operators.ranks import numbered

    listed = numbered(w.benchmark_words, "n", [F.col("wordform")])
    following = listed.select(
        (F.col("n") - 1).alias("n"), F.col("wordform").alias("wordform_to"))
    pairs = listed.withColumnRenamed("wordform", "wordform_from").join(following, "n").select(
        *links.LINK, F.lit(None).cast("int").alias("ld"),
        F.lit(None).cast("long").alias("anahash_difference"))
    return links.measure_links(pairs)


@query("""
    SELECT ocr_variant AS wordform, correction_candidate AS wordform_source,
           CASE WHEN correction_candidate IN (SELECT wordform FROM m_benchmark_words)
                THEN correction_candidate END AS known_source
    FROM m_variant_pairs""")
def resolved_variant_sources(w: Workload):
    known = words.new_words(w.words.limit(0), w.benchmark_words)
    return build.resolve_variant_sources(replace(w.model(), words=known)).select(
        "wordform", "wordform_source", "known_source")


@query("""
    SELECT 'lexica' AS "table", count(*)::BIGINT AS num_rows FROM m_lexica WHERE lexicon_id <> 9
    UNION ALL SELECT 'lexicon_words', count(*) FROM m_lexicon_words WHERE lexicon_id <> 9
    UNION ALL SELECT 'link_sources', 0
    UNION ALL SELECT 'links', count(*) FROM m_link_sources
    UNION ALL SELECT 'words', count(*) FROM m_vocabulary""")
def deleted_lexicon(w: Workload):
    from wordloom.operators.corpus_queries import cardinalities

    left = lexica.delete_lexicon(w.model(), VARIANT_LEXICON)
    return cardinalities(left).filter(F.col("table").isin(
        "lexica", "lexicon_words", "link_sources", "links", "words"))


# Changes to a model on disk.

@query(f"""
    WITH w AS (SELECT DISTINCT wordform FROM ({ENTRIES})),
    plan AS (SELECT wordform, translate(trim(wordform), '_ ', '*_') AS target FROM w),
    chosen AS (SELECT target, min(wordform) AS wordform FROM plan
               WHERE wordform <> target AND target <> ''
               AND target NOT IN (SELECT wordform FROM w) GROUP BY target)
    SELECT coalesce(c.target, w.wordform) AS wordform,
           lower(coalesce(c.target, w.wordform)) AS wordform_lowercase, 7::BIGINT AS lexicon_id
    FROM w LEFT JOIN chosen c ON w.wordform = c.wordform""")
def stored_words_normalized(w: Workload):
    """Words and a lexicon of them on disk, respelled in place, and once more by the same name."""
    entries = raw_entries(w).distinct().select(
        "wordform", F.lower("wordform").alias("wordform_lowercase"),
        F.lit(None).cast("long").alias("anahash"))
    model = replace(
        empty_model(w.spark), words=entries, lexicon_words=entries.select(
            F.lit(7).cast("long").alias("lexicon_id"), "wordform"))
    store = StoredModel.create(
        w.spark, new_path(w.spark, "stored-model"), model, parts=4)
    store.normalize_words("clean")
    store.normalize_words("clean")
    return store.rows("words").select("wordform", "wordform_lowercase").join(
        store.rows("lexicon_words"), "wordform")


@query("""
    SELECT l.lexicon_id, l.lexicon_name, count(lw.wordform)::BIGINT AS num_words
    FROM (SELECT * FROM m_lexica UNION ALL SELECT 77, 'added', true) l
    LEFT JOIN (SELECT * FROM m_lexicon_words
               UNION ALL SELECT 77, wordform FROM m_benchmark_words) lw
    ON l.lexicon_id = lw.lexicon_id
    WHERE l.lexicon_id <> 9 GROUP BY l.lexicon_id, l.lexicon_name""")
def stored_lexica_changed(w: Workload):
    """Lexica on disk: one added and one deleted in place, each change tried twice."""
    model = replace(
        empty_model(w.spark), words=w.words, lexica=w.lexica, lexicon_words=w.lexicon_words)
    store = StoredModel.create(
        w.spark, new_path(w.spark, "stored-model"), model, parts=4)
    for _ in range(2):
        store.add_lexicon("add", "added", True, w.benchmark_words, lexicon_id=77)
        store.delete_lexicon("delete", VARIANT_LEXICON)
    counts = store.rows("lexicon_words").groupBy("lexicon_id").agg(
        F.count(F.lit(1)).alias("num_words"))
    return store.rows("lexica").join(counts, "lexicon_id", "left").select(
        "lexicon_id", "lexicon_name",
        F.coalesce("num_words", F.lit(0).cast("long")).alias("num_words"))


# Search.

@query("""
    SELECT wordform FROM m_vocabulary WHERE regexp_matches(wordform, '^th.*(ing|ed)$')
    ORDER BY wordform LIMIT 500""")
def regexp_search(w: Workload):
    return search.regexp_search(w, "^th.*(ing|ed)$")


@query("""
    SELECT count(*)::BIGINT AS total FROM m_vocabulary
    WHERE regexp_matches(wordform, '^th.*(ing|ed)$')""")
def regexp_search_total(w: Workload):
    return search.regexp_search_total(w, "^th.*(ing|ed)$")


@query("""
    SELECT wordform, count(*) OVER ()::BIGINT AS total FROM m_vocabulary
    WHERE regexp_matches(wordform, '^th.*(ing|ed)$') ORDER BY wordform LIMIT 500""")
def regexp_search_indexed(w: Workload):
    index = WordIndex.build(w, new_path(w.spark, "word-index"))
    return index.first_matches("^th.*(ing|ed)$")


SUFFIX_PAIRS = """
    WITH f AS (SELECT wordform, frequency FROM m_vocabulary WHERE frequency > 2)
    SELECT a.wordform AS word1, a.frequency AS word1_freq, b.wordform AS word2,
           b.frequency AS word2_freq
    FROM f a JOIN f b ON left(a.wordform, length(a.wordform) - 3) || 'ed' = b.wordform
    WHERE a.wordform LIKE '%ing'"""


@query(SUFFIX_PAIRS)
def suffix_pairs(w: Workload):
    return search.suffix_pairs(w, "ing", "ed", 2)


@query(SUFFIX_PAIRS)
def suffix_pairs_indexed(w: Workload):
    index = WordIndex.build(w, new_path(w.spark, "word-index"))
    return index.suffix_pairs("ing", "ed", 2)


# Sinks.

@query("""
    SELECT wordform, frequency FROM m_vocabulary
    UNION ALL SELECT wordform, 0 FROM m_benchmark_words""")
def appended_tables(w: Workload):
    path = new_path(w.spark, "appended")
    append(w.word_frequency, path)
    append(w.benchmark_words.select(
        "wordform", F.lit(0).cast("long").alias("frequency")), path)
    return w.spark.read.schema(w.word_frequency.schema).parquet(path)
