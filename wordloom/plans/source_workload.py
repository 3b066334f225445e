"""Queries that read every file format, from files that Spark writes from the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.functions.anahash import anahash
from wordloom.functions.bags import long_frame
from wordloom.operators import cleaning
from wordloom.operators.anagram_queries import confusion_neighbours
from wordloom.operators.corpora import add_corpus
from wordloom.operators.corpus_queries import cardinalities
from wordloom.operators.ranks import numbered, ranked
from wordloom.plans import ingest
from wordloom.plans.cleaning_workload import clean_sql
from wordloom.plans.oracle import hash_of
from wordloom.plans.registry import query, rounded
from wordloom.plans.workload import Workload, source_number
from wordloom.scratch import new_path
from wordloom.sources import frequency_files as ff
from wordloom.sources import paradigm_files, tables, variant_files, word_lists, xml_tokens


def files(w: Workload, name: str, write) -> str:
    """The folder of a set of files, written once per session."""
    folders = w.__dict__.setdefault("_folders", {})
    if name not in folders:
        path = new_path(w.spark, name)
        write(path)
        folders[name] = path
    return folders[name]


def lines(df: DataFrame, *columns, sep: str) -> DataFrame:
    return df.select(F.concat_ws(sep, *columns).alias("value"))


def _bag_files(w: Workload, name: str, file, compression: str) -> str:
    """Term-frequency files, one per source and language, each with one over-long word.

    A file is a folder of parts; its rows are salted over several tasks.
    """
    counts = long_frame(w.bags, "source", "lang").groupBy("source", "lang", "wordform").agg(
        F.sum("frequency").alias("frequency"))
    long_word = w.bags.select("source", "lang").distinct().select(
        "source", "lang", F.lit("x" * 300).alias("wordform"),
        F.lit(1).cast("long").alias("frequency"))
    rows = counts.unionByName(long_word).select(
        file.alias("file"), F.concat_ws("\t", "wordform", "frequency").alias("value"))
    spread = rows.repartition(F.col("file"), F.pmod(F.xxhash64("value"), F.lit(4)))
    return files(w, name, lambda path: spread.write.partitionBy("file").option(
        "compression", compression).text(path))


def sonar_files(w: Workload) -> str:
    return _bag_files(
        w, "sonar", F.concat("source", F.lit("-"), "lang", F.lit(".wordfreqlist.clean.tsv.bz2")),
        "bzip2")


def clean_files(w: Workload) -> str:
    """Files named with an exact year, a span (`1803+2_01`) or an unusable year (`18XX`)."""
    n = source_number()
    name = F.concat("source", F.lit("-"), "lang", F.lit("."))
    year = (F.lit(1800) + n).cast("string")
    file = (
        F.when(F.col("lang") == "en", F.concat(
            name, year, F.lit("+"), (n % 3).cast("string"), F.lit("_01.clean")))
        .when(F.col("lang") == "fr", F.concat(name, F.lit("18XX.clean")))
        .when(F.col("lang") == "es", F.concat(F.lit("LIM-"), name, year, F.lit(".clean")))
        .otherwise(F.concat(name, year, F.lit(".clean")))
    )
    return _bag_files(w, "clean", file, "none")


def year_files(w: Workload) -> str:
    """Files of all languages, each named with its year."""
    return _bag_files(w, "years", F.concat(
        "source", F.lit("-"), "lang", F.lit("."), F.lit(1800) + source_number(),
        F.lit(".clean")), "none")


def span_files(w: Workload) -> str:
    """Files of all languages: the English ones with a span of years, the Spanish ones marked."""
    n = source_number()
    english = F.col("lang") == "en"
    return _bag_files(w, "spans", F.concat(
        F.when(F.col("lang") == "es", F.lit("LIM-")).otherwise(F.lit("")),
        "source", F.lit("-"), "lang", F.lit("."), F.lit(1800) + n,
        F.when(english, F.concat(F.lit("+"), n % 3, F.lit("_01"))).otherwise(F.lit("")),
        F.lit(".clean")), "none")


GROUPS = """
    WITH counts AS (
        SELECT source, lang, wordform, count(*)::BIGINT AS frequency,
               regexp_extract(source, '([0-9]+)$', 1)::BIGINT AS n
        FROM m_tokens GROUP BY source, lang, wordform),
    named AS (
        SELECT *, CASE lang
            WHEN 'en' THEN source || '-en.' || (1800 + n) || '+' || (n % 3) || '_01.clean'
            WHEN 'fr' THEN source || '-fr.18XX.clean'
            WHEN 'es' THEN 'LIM-' || source || '-es.' || (1800 + n) || '.clean'
            ELSE source || '-' || lang || '.' || (1800 + n) || '.clean' END AS file
        FROM counts),
    per_file AS (
        SELECT file, left(file, length(file) - 6) AS title, lang, n,
               sum(frequency)::BIGINT AS word_count
        FROM named GROUP BY file, lang, n)"""


@query(GROUPS + """
    SELECT source || '-' || lang || '.wordfreqlist.clean.tsv.bz2' AS file, wordform, frequency
    FROM counts""")
def frequency_files(w: Workload):
    return ff.read_frequency_files(w.spark, sonar_files(w))


@query(GROUPS + """
    SELECT source || '-' || lang AS title, 'nl' AS language, 1990::BIGINT AS year_from,
           2010::BIGINT AS year_to, NULL::BIGINT AS pub_year,
           sum(frequency)::BIGINT AS word_count
    FROM counts GROUP BY source, lang""")
def sonar_corpus(w: Workload):
    return _corpus(w, "sonar", sonar_files(w))


def _corpus(w: Workload, layout: str, paths: str) -> DataFrame:
    chosen = ff.LAYOUTS[layout]
    documents, frequencies = ff.read_corpus(w.spark, paths, chosen)
    added = add_corpus(
        w, chosen.corpus, documents, frequencies, corpus_id=1, first_document_id=1)
    return added["documents"].select(
        "title", "language", "year_from", "year_to", "pub_year", "word_count")


@query(GROUPS + """
    SELECT source || '-' || lang || '.' || (1800 + n) AS title, 'nl' AS language,
           NULL::BIGINT AS year_from, NULL::BIGINT AS year_to, 1800 + n AS pub_year,
           sum(frequency)::BIGINT AS word_count
    FROM counts GROUP BY source, lang, n""")
def sgd_corpus(w: Workload):
    return _corpus(w, "sgd", year_files(w))


@query(GROUPS + """
    SELECT title, 'nl' AS language, NULL::BIGINT AS year_from, NULL::BIGINT AS year_to,
           1800 + n AS pub_year, word_count
    FROM per_file WHERE lang IN ('de', 'es')""")
def edbo_corpus(w: Workload):
    """The layout leaves out names without an exact year."""
    return _corpus(w, "edbo", clean_files(w))


@query(GROUPS + """
    SELECT CASE lang WHEN 'es' THEN 'LIM-' ELSE '' END || source || '-' || lang || '.' || (1800 + n)
               || CASE lang WHEN 'en' THEN '+' || (n % 3) || '_01' ELSE '' END AS title,
           CASE lang WHEN 'es' THEN 'lim' ELSE 'nl' END AS language,
           CASE WHEN lang = 'en' AND n % 3 > 0 THEN 1800 + n END AS year_from,
           CASE WHEN lang = 'en' AND n % 3 > 0 THEN 1800 + n + n % 3 END AS year_to,
           CASE WHEN lang <> 'en' OR n % 3 = 0 THEN 1800 + n END AS pub_year,
           sum(frequency)::BIGINT AS word_count
    FROM counts GROUP BY source, lang, n""")
def dbnl_corpus(w: Workload):
    return _corpus(w, "dbnl", span_files(w))


# Word lists and linked lexica.

def word_file(w: Workload) -> str:
    """All words, and three that look like missing values."""
    odd = w.spark.range(1).select(F.explode(F.array(*map(F.lit, ["null", "nan", "NA"]))).alias(
        "value"))
    rows = w.words.select(F.col("wordform").alias("value")).unionByName(odd)
    return files(w, "words", lambda path: rows.write.text(path))


WORD_LIST = """
    SELECT wordform FROM m_vocabulary UNION ALL SELECT unnest(['null', 'nan', 'NA'])"""


@query(WORD_LIST)
def word_list_files(w: Workload):
    return word_lists.read_word_list(w.spark, word_file(w))


@query(WORD_LIST)
def word_csv_files(w: Workload):
    rows = word_lists.read_word_list(w.spark, word_file(w))
    path = files(w, "words-csv", lambda path: tables.write_word_list(rows, path))
    return word_lists.read_word_csv(w.spark, path)


@query("SELECT correction_candidate AS lemma, ocr_variant AS variant FROM m_variant_pairs")
def pair_files(w: Workload):
    rows = lines(w.variant_pairs, "correction_candidate", "ocr_variant", sep="\t")
    return word_lists.read_pairs(w.spark, files(w, "pairs", rows.write.text)).drop("line_order")


def correction_file(w: Workload) -> str:
    """Lines with two corrections, an example, a rule or an over-long correction."""
    v, c, n = F.col("ocr_variant"), F.col("correction_candidate"), F.col("ld") % 3
    rest = (
        F.when(n == 0, F.concat(F.lit("#"), c, F.lit(" # "), F.reverse(c)))
        .when(n == 1, F.concat(F.lit("\t#"), c, F.lit("~ as in this #example")))
        .otherwise(F.concat(F.lit(" \t[EXAMPL: a#b] #"), c, F.lit("#" + "y" * 120)))
    )
    rows = w.variant_pairs.select(F.concat(F.lit("*"), v, rest).alias("value"))
    return files(w, "corrections", rows.write.text)


@query("""
    SELECT ocr_variant AS wf, correction_candidate AS corr FROM m_variant_pairs
    UNION ALL SELECT ocr_variant, reverse(correction_candidate) FROM m_variant_pairs
    WHERE ld % 3 = 0""")
def correction_lists(w: Workload):
    return word_lists.read_correction_list(w.spark, correction_file(w)).drop("line_order")


def dictionary_file(w: Workload) -> str:
    """Twelve-column entries from variant pairs; related forms in every clean-up situation."""
    v, c, n = F.col("ocr_variant"), F.col("correction_candidate"), F.col("corpus_frequency") % 3
    empty = F.lit("")
    rows = lines(
        w.variant_pairs,
        F.concat(c, F.lit(":")), F.lit("syl"), F.concat(F.lit("zie ook "), v),
        F.when(n == 0, F.concat(F.lit("("), v, F.lit(")"))).otherwise(F.lit("andere bet.")),
        F.lit("zn"), F.lit("de"),
        F.when(n == 1, F.concat(v, F.lit("s, "), v, F.lit("en"))).otherwise(F.lit("Ili/as")),
        F.lit("syl"), F.when(n == 2, F.concat(v, F.lit("tje2"))).otherwise(empty), empty,
        F.concat(v, F.lit(".")), empty, sep=";")
    return files(w, "dictionary", rows.write.text)


DICTIONARY = """
    WITH dictionary AS (
        SELECT correction_candidate || ':' AS word, 'zie ook ' || ocr_variant AS "see also",
               CASE WHEN corpus_frequency % 3 = 0 THEN '(' || ocr_variant || ')'
                    ELSE 'andere bet.' END AS disambiguation,
               CASE WHEN corpus_frequency % 3 = 1
                    THEN ocr_variant || 's, ' || ocr_variant || 'en' END AS plural,
               CASE WHEN corpus_frequency % 3 = 2 THEN ocr_variant || 'tje2' END AS diminutive,
               ocr_variant || '.' AS perfect
        FROM m_variant_pairs),
    related AS (
        SELECT word, replace("see also", 'zie ook ', '') AS other, false AS listed FROM dictionary
        UNION ALL SELECT word, trim(disambiguation, '()'), true FROM dictionary
            WHERE disambiguation <> 'andere bet.'
        UNION ALL SELECT word, unnest(string_split(plural, ', ')), true FROM dictionary
        UNION ALL SELECT word, diminutive, true FROM dictionary
        UNION ALL SELECT word, perfect, true FROM dictionary)"""


@query(DICTIONARY + """
    SELECT word, "see also", disambiguation, plural AS "plural/past/attrib",
           diminutive AS "diminu/compara/past plural", perfect AS "past perfect/superla"
    FROM dictionary""")
def dictionary_files_1995(w: Workload):
    return word_lists.read_dictionary_1995(w.spark, dictionary_file(w)).select(
        "word", "see also", "disambiguation", "plural/past/attrib",
        "diminu/compara/past plural", "past perfect/superla")


@query(DICTIONARY + f"""
    SELECT DISTINCT w AS wordform FROM (
        SELECT {clean_sql('word')} AS w FROM dictionary
        UNION ALL SELECT {clean_sql('other')} FROM related WHERE listed) WHERE w IS NOT NULL""")
def dictionary_words(w: Workload):
    return cleaning.dictionary_words(
        word_lists.read_dictionary_1995(w.spark, dictionary_file(w)))


@query(DICTIONARY + f"""
    SELECT {clean_sql('word')} AS wordform_1, {clean_sql('other')} AS wordform_2
    FROM related WHERE other IS NOT NULL AND {clean_sql('other')} IS NOT NULL""")
def dictionary_links(w: Workload):
    return cleaning.dictionary_links(
        word_lists.read_dictionary_1995(w.spark, dictionary_file(w)))


@query("""
    SELECT paradigm_id::VARCHAR AS "index", wordform AS "word 95",
           CASE WHEN V = 1 THEN wordform END AS "word 05",
           X::VARCHAR AS "2nd/3rd person present singular syllables"
    FROM m_paradigms""")
def dictionary_files_2005(w: Workload):
    cells = {
        "index": F.col("paradigm_id"), "word 95": F.col("wordform"),
        "word 05": F.when(F.col("V") == 1, F.col("wordform")).otherwise(F.lit("Ili/as")),
        "2nd/3rd person present singular syllables": F.col("X"),
    }
    rows = lines(
        w.paradigms, *[cells.get(c, F.lit("")) for c in word_lists.COLUMNS_2005], sep=";")
    path = files(w, "dictionary-2005", rows.write.text)
    return word_lists.read_dictionary_2005(w.spark, path).select(*cells)


# Paradigm files.

def paradigm_file(w: Workload) -> str:
    """Nine columns under a noise line; lemmas have two dictionary ids."""
    ids = F.when(F.col("code").contains("_HCL"), F.concat(
        F.lit("WNT_M"), F.length("wordform"), F.lit("_s#@MNW_"), F.length("wordform"))
    ).otherwise(F.lit("XYZ_1"))
    rows = w.coded_words.select(
        "wordform", F.lit("").alias("corpus_freq"),
        F.concat_ws("#", "code", F.lit("noise")).alias("component_codes"),
        F.lit("").alias("human_readable_c_code"), F.lit("1808").alias("first_year"),
        F.lit("1808").alias("last_year"), ids.alias("dict_ids"),
        F.lit("NOU-C").alias("pos_tags"), F.lit("INT_1").alias("int_ids"))
    return files(w, "paradigms", lambda path: rows.write.option("sep", "\t").option(
        "header", True).option("quote", "").csv(path))


@query("""
    SELECT wordform, Z, Y, X, W, V::BIGINT AS V, word_type_code,
           word_type_number::BIGINT AS word_type_number FROM m_paradigms""")
def paradigm_files_rows(w: Workload):
    from wordloom.operators.corpora import paradigm_rows

    return paradigm_rows(paradigm_files.read_paradigm_file(w.spark, paradigm_file(w)))


@query("""
    SELECT wordform, 'WNT' AS source_name, 'M' || length(wordform) AS source_id
    FROM m_paradigms WHERE word_type_code = 'HCL'
    UNION ALL SELECT wordform, 'MNW', length(wordform)::VARCHAR
    FROM m_paradigms WHERE word_type_code = 'HCL'""")
def external_ids(w: Workload):
    return paradigm_files.external_ids(
        paradigm_files.read_paradigm_file(w.spark, paradigm_file(w)))


# Variant rankings and the anagram index.

@query("""
    SELECT ocr_variant, corpus_frequency, correction_candidate, 7::BIGINT AS "?1", ld,
           'R' AS "?2", anahash FROM m_variant_pairs""")
def correction_candidate_files(w: Workload):
    rows = lines(
        w.variant_pairs, "ocr_variant", "corpus_frequency", "correction_candidate", F.lit("7"),
        "ld", F.lit("R"), "anahash", sep="#")
    return variant_files.read_correction_candidates(
        w.spark, files(w, "candidates", rows.write.text)).drop("line_order")


def variant_file(w: Workload) -> str:
    rows = lines(
        w.variant_pairs, "ocr_variant", "corpus_frequency", "correction_candidate", F.lit("a"),
        F.lit("b"), "ld", sep="#")
    return files(w, "variants", lambda path: rows.write.option(
        "compression", "gzip").text(path))


@query("""
    SELECT ocr_variant AS wordform, corpus_frequency AS frequency,
           correction_candidate AS wordform_source, ld::BIGINT AS levenshtein_distance
    FROM m_variant_pairs""")
def ranked_variant_files(w: Workload):
    return variant_files.read_ranked_variants(w.spark, variant_file(w))


@query("""
    SELECT anahash, unnest([0, 1])::INTEGER AS variant_id,
           unnest([ocr_variant, correction_candidate]) AS wordform FROM m_variant_pairs""")
def anahash_files(w: Workload):
    rows = w.variant_pairs.select(F.concat(
        "anahash", F.lit("~"), "ocr_variant", F.lit("#"), "correction_candidate").alias("value"))
    return variant_files.read_anahash_file(w.spark, files(w, "anahashes", rows.write.text))


def confusion_file(w: Workload) -> str:
    """Two-part lines, and for words of even length three-part lines that do not count."""
    extra = F.when(F.length("wordform") % 2 == 0, F.lit("#x")).otherwise(F.lit(""))
    rows = w.vocabulary.select(
        F.concat("anahash", F.lit("#"), "wordform", extra).alias("value"))
    return files(w, "confusions", rows.write.text)


@query("SELECT anahash AS confusion FROM m_vocabulary WHERE length(wordform) % 2 = 1")
def confusion_files(w: Workload):
    return variant_files.read_confusions(w.spark, confusion_file(w))


@query("SELECT max(anahash) AS max_confusion FROM m_vocabulary WHERE length(wordform) % 2 = 1")
def max_confusion(w: Workload):
    return variant_files.read_confusions(w.spark, confusion_file(w)).agg(
        F.max("confusion").alias("max_confusion"))


@query("""
    SELECT anahash AS confusion, unnest([0, 1, 2])::INTEGER AS list_index,
           unnest([corpus_frequency, ld::BIGINT, anahash]) AS word_hash FROM m_variant_pairs""")
def confusion_index_files(w: Workload):
    hashes = F.concat_ws(",", "corpus_frequency", "ld", "anahash")
    rows = w.variant_pairs.select(F.concat("anahash", F.lit("#"), hashes).alias("value"))
    return variant_files.read_confusion_index(
        w.spark, files(w, "confusion-index", rows.write.text))


@query(f"""
    WITH b AS (SELECT DISTINCT {hash_of('wordform')} AS anahash FROM m_benchmark_words
               WHERE length(wordform) <= 2),
    gaps AS (SELECT DISTINCT lead(anahash) OVER (ORDER BY anahash) - anahash AS confusion FROM b)
    SELECT g.confusion, count(*)::BIGINT AS num_neighbours
    FROM gaps g, (SELECT DISTINCT anahash FROM m_vocabulary) h
    JOIN m_vocabulary v ON h.anahash + g.confusion = v.anahash GROUP BY g.confusion""")
def confusion_index_neighbours(w: Workload):
    """All words one confusion of an index file away from a hash: the index holds the gaps between
    the hashes of the benchmark's words of one or two letters."""
    hashes = ranked(w.benchmark_words.filter(F.length("wordform") <= 2).select(
        anahash(F.col("wordform")).alias("anahash")).distinct(), [F.col("anahash")])
    following = hashes.select((F.col("rank") - 1).alias("rank"), F.col("anahash").alias("next"))
    lines = hashes.join(following, "rank").groupBy(
        (F.col("next") - F.col("anahash")).alias("confusion")).agg(F.concat(
            F.col("confusion"), F.lit("#"),
            F.array_join(F.collect_list(F.col("anahash").cast("string")), ",")).alias("value"))
    index = variant_files.read_confusion_index(
        w.spark, files(w, "gap-index", lines.select("value").write.text))
    return confusion_neighbours(w, index).groupBy("confusion").agg(
        F.count(F.lit(1)).alias("num_neighbours"))


@query("""
    SELECT wordform, frequency, 2 * frequency AS running_sum,
           round(frequency / 8, 6) AS share FROM m_vocabulary""")
def frequency_lists(w: Workload):
    rows = lines(
        w.word_frequency, "wordform", "frequency", F.col("frequency") * 2,
        F.col("frequency") / 8, sep="\t")
    return rounded(
        ff.read_list(w.spark, files(w, "list-frequency", rows.write.text), "frequency"), "share")


@query("SELECT wordform, frequency + 100000000 AS frequency FROM m_vocabulary")
def clean_lists(w: Workload):
    rows = lines(
        w.word_frequency, "wordform", F.col("frequency") + 100_000_000, sep="\t")
    return ff.read_list(w.spark, files(w, "list-clean", rows.write.text), "clean")


@query("SELECT ocr_variant AS wordform, correction_candidate AS correction FROM m_variant_pairs")
def punctuation_lists(w: Workload):
    rows = lines(w.variant_pairs, "ocr_variant", "correction_candidate", sep="\t")
    return ff.read_list(w.spark, files(w, "list-punct", rows.write.text), "punctuation")


@query("SELECT ocr_variant AS wordform, corpus_frequency AS frequency FROM m_variant_pairs")
def unknown_lists(w: Workload):
    rows = lines(w.variant_pairs, "ocr_variant", "corpus_frequency", sep="\t")
    return ff.read_list(w.spark, files(w, "list-unknown", rows.write.text), "unknown")


# Annotated XML.

def xml_files(w: Workload) -> str:
    """A token per paradigm row; every third one is punctuation."""
    kind = F.when(F.length("wordform") % 3 == 0, "PUNCTUATION").otherwise("WORD")
    rows = w.paradigms.select(
        kind.alias("_class"), F.col("wordform").alias("t"),
        F.struct(F.col("word_type_code").alias("_head")).alias("pos"),
        F.struct(F.substring("wordform", 1, 4).alias("_class")).alias("lemma"))
    return files(w, "xml", lambda path: rows.write.format("xml").option("rowTag", "w").option(
        "rootTag", "text").save(path))


@query("""
    SELECT wordform, word_type_code AS part_of_speech, wordform[1:4] AS lemma
    FROM m_paradigms WHERE length(wordform) % 3 <> 0""")
def xml_token_files(w: Workload):
    return xml_tokens.read_tokens(w.spark, xml_files(w)).drop("file")


@query("""
    SELECT DISTINCT wordform[1:4] AS modern_lemma, word_type_code AS lemma_part_of_speech
    FROM m_paradigms WHERE length(wordform) % 3 <> 0""")
def xml_lemmata(w: Workload):
    return xml_tokens.lemma_tables(
        xml_tokens.read_tokens(w.spark, xml_files(w)))["lemmata"]


# Tables and whole loads.

@query("""
    SELECT row_number() OVER (ORDER BY wordform) AS wordform_id, wordform, frequency
    FROM m_vocabulary""")
def tsv_tables(w: Workload):
    rows = numbered(w.word_frequency, "wordform_id", [F.col("wordform")]).select(
        "wordform_id", "wordform", "frequency")
    folder = files(w, "tables", lambda path: rows.write.option("sep", "\t").option(
        "header", True).csv(f"{path}/wordform_frequency.tsv"))
    return tables.read_tsv_table(w.spark, folder, "wordform_frequency")


@query(GROUPS + """,
    corpus AS (SELECT wordform, file AS title, frequency FROM named WHERE lang IN ('de', 'es')),
    known AS (SELECT wordform FROM m_vocabulary UNION SELECT unnest(['null', 'nan', 'NA'])),
    pairs AS (SELECT ocr_variant AS wf, correction_candidate AS corr FROM m_variant_pairs
              UNION SELECT ocr_variant, reverse(correction_candidate) FROM m_variant_pairs
              WHERE ld % 3 = 0),
    unordered AS (SELECT DISTINCT least(wf, corr) AS a, greatest(wf, corr) AS b FROM pairs
                  WHERE wf <> corr),
    all_words AS (SELECT wordform FROM known UNION SELECT corr FROM pairs)
    SELECT 'words' AS "table", count(*)::BIGINT AS num_rows FROM all_words
    UNION ALL SELECT 'lexica', 2
    UNION ALL SELECT 'lexicon_words', (SELECT count(*) FROM known) + (
        SELECT count(*) FROM (SELECT wf FROM pairs UNION SELECT corr FROM pairs))
    UNION ALL SELECT 'links', 2 * count(*) FROM unordered
    UNION ALL SELECT 'link_sources', 2 * count(*) FROM unordered
    UNION ALL SELECT 'corpora', 1
    UNION ALL SELECT 'documents', count(DISTINCT title) FROM corpus
    UNION ALL SELECT 'corpus_documents', count(DISTINCT title) FROM corpus
    UNION ALL SELECT 'attestations', count(*) FROM corpus
    UNION ALL SELECT 'paradigms', count(*) FROM m_paradigms
    UNION ALL SELECT 'external_links', 0
    UNION ALL SELECT 'word_frequency', count(*) FROM all_words
    UNION ALL SELECT 'ranked_variants', count(*) FROM m_variant_pairs""")
def ingested_sources(w: Workload):
    """Six sources of different kinds, loaded into an empty model."""
    where = {
        "twente": [correction_file(w)], "opentaal": [word_file(w)], "edbo": [clean_files(w)],
        "paradigms": [paradigm_file(w)], "variants": [variant_file(w)],
    }
    model = ingest.ingest(
        w.spark, "/", include=[*where, "frequencies"], paths=where)
    return cardinalities(model)
