"""The same derivations as SQL common table expressions, to check results against."""

from __future__ import annotations

import re

# Accented letters as single bytes, for an edit distance that counts bytes.
_PLAIN = "translate({0}, 'çíéèßñöóüêä', 'ABCDEFGHIJK')"


def edit_distance(a: str, b: str) -> str:
    return f"levenshtein({_PLAIN.format(a)}, {_PLAIN.format(b)})"


def hash_of(word: str) -> str:
    base = "(least(unicode(ch), 1000) + 4)::BIGINT"
    power = " * ".join([base] * 5)
    return f"list_sum(list_transform(string_split({word}, ''), lambda ch: {power}))::BIGINT"


CTES = {
    "m_tokens": """
        SELECT doc_id, lang, source, wordform FROM (
            SELECT doc_id, lang, source,
                   unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS wordform
            FROM documents)""",
    "m_attestations": """
        SELECT doc_id AS document_id, wordform, count(*)::BIGINT AS frequency
        FROM m_tokens GROUP BY doc_id, wordform""",
    "m_documents": """
        SELECT d.doc_id AS document_id, 'doc_' || d.doc_id AS title, d.lang AS language,
               coalesce(c.n, 0)::BIGINT AS word_count,
               CASE WHEN d.doc_id % 5 <> 0 THEN 1800 + d.doc_id % 200 END AS pub_year,
               CASE WHEN d.doc_id % 5 = 0 THEN 1800 + d.doc_id % 100 END AS year_from,
               CASE WHEN d.doc_id % 5 = 0 THEN 1800 + d.doc_id % 100 + d.doc_id % 11 END
                   AS year_to
        FROM documents d LEFT JOIN (
            SELECT document_id, sum(frequency) AS n FROM m_attestations GROUP BY 1) c
        ON d.doc_id = c.document_id""",
    "m_dated": """
        SELECT *, coalesce(pub_year, round((year_from + year_to) / 2)::BIGINT) AS year
        FROM m_documents""",
    "m_corpora": """
        SELECT DISTINCT regexp_extract(source, '([0-9]+)$', 1)::BIGINT + 1 AS corpus_id,
               source AS name FROM documents
        UNION ALL SELECT 1000, 'quality'""",
    "m_corpus_documents": """
        SELECT regexp_extract(source, '([0-9]+)$', 1)::BIGINT + 1 AS corpus_id,
               doc_id AS document_id FROM documents
        UNION ALL SELECT 1000, doc_id FROM labels WHERE quality = 1""",
    "m_vocabulary": f"""
        SELECT wordform, sum(frequency)::BIGINT AS frequency, {hash_of('wordform')} AS anahash
        FROM m_attestations GROUP BY wordform""",
    "m_lexica": """
        SELECT DISTINCT (unicode(lang[1]) * 1000 + unicode(lang[2]))::BIGINT AS lexicon_id,
               'lang_' || lang AS lexicon_name, true AS vocabulary FROM documents
        UNION ALL SELECT 1, 'benchmark', true
        UNION ALL SELECT 9, 'variants', false""",
    "m_benchmark_words": """
        SELECT DISTINCT wordform FROM (
            SELECT unnest(regexp_extract_all(lower(text), '[\\p{L}]+')) AS wordform
            FROM benchmark)""",
    "m_lexicon_words": """
        SELECT 1::BIGINT AS lexicon_id, wordform FROM m_benchmark_words
        UNION ALL SELECT (unicode(lang[1]) * 1000 + unicode(lang[2]))::BIGINT, wordform
            FROM m_tokens GROUP BY lang, wordform
        UNION ALL SELECT DISTINCT 9, wordform_from FROM m_link_sources""",
    "m_variant_pairs": f"""
        SELECT v.wordform AS ocr_variant, l.wordform AS correction_candidate, v.anahash,
               v.frequency AS corpus_frequency,
               {edit_distance('v.wordform', 'l.wordform')}::INTEGER AS ld
        FROM m_vocabulary v JOIN (
            SELECT anahash, wordform FROM m_vocabulary
            QUALIFY row_number() OVER (
                PARTITION BY anahash ORDER BY frequency DESC, wordform) = 1) l
        ON v.anahash = l.anahash AND v.wordform <> l.wordform""",
    "m_link_sources": """
        SELECT ocr_variant AS wordform_from, correction_candidate AS wordform_to,
               9::BIGINT AS lexicon_id, false AS wordform_from_correct,
               true AS wordform_to_correct, ld FROM m_variant_pairs
        UNION ALL SELECT correction_candidate, ocr_variant, 9, true, false, ld
        FROM m_variant_pairs""",
    "m_coded": """
        SELECT wordform, frequency, length(wordform) AS n,
               (greatest(unicode(wordform[1]), 0) % 3 + 1)::BIGINT AS Z,
               (greatest(unicode(wordform[2]), 0) % 5 + 1)::BIGINT AS Y,
               ((greatest(unicode(wordform[3]), 0) * 31 + greatest(unicode(wordform[4]), 0)) % 10000)::BIGINT AS X,
               ((greatest(unicode(wordform[1]), 0) % 1000) * 100000 + (greatest(unicode(wordform[2]), 0) % 1000) * 100
                   + greatest(unicode(wordform[5]), 0) % 100)::BIGINT AS W
        FROM m_vocabulary""",
    "m_paradigms": """
        SELECT row_number() OVER (ORDER BY wordform) AS paradigm_id, Z, Y, X, W,
               CASE WHEN place = 1 THEN 1 ELSE 2 + n % 97 END AS V,
               CASE WHEN place = 1 THEN 'HCL' WHEN n % 2 = 0 THEN 'HCT' ELSE 'HCM' END
                   AS word_type_code,
               CASE WHEN n % 3 = 0 THEN n END AS word_type_number, wordform
        FROM (SELECT *, row_number() OVER (
                  PARTITION BY Z, Y, X, W ORDER BY frequency DESC, wordform) AS place
              FROM m_coded)""",
    "m_members": """
        SELECT cd.document_id, cd.corpus_id, c.name
        FROM m_corpus_documents cd JOIN m_corpora c ON cd.corpus_id = c.corpus_id""",
}


def with_tables(select: str) -> str:
    """The query with the definitions of the tables it uses, and of those they use."""
    needed: list[str] = []

    def need(text: str) -> None:
        for name in CTES:
            if re.search(rf"\b{name}\b", text) and name not in needed:
                need(CTES[name])
                if name not in needed:
                    needed.append(name)

    need(select)
    definitions = ",\n".join(f"{name} AS ({CTES[name]})" for name in needed)
    select = select.strip()
    if not definitions:
        return select
    if select.upper().startswith("WITH "):
        return f"WITH {definitions},\n{select[5:]}"
    return f"WITH {definitions}\n{select}"
