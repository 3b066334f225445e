"""The id-keyed tables that the expected results were made for."""

from __future__ import annotations

from pathlib import Path

from wordloom.schema import RELATIONAL

WORDS = [
    "aandacht", "banaan", "dromedaris", "drmoedaris", "etter", "foxtrot", "golfbreker",
    "heipaal", "iedereen", "iederene",
]
HASH_IDS = [1, 2, 3, 3, 4, 5, 6, 7, 8, 8]
HASHES = [
    10000000000, 10510100501, 11592740743, 12166529024, 12762815625, 13382255776, 14025517307,
    14693280768, 15386239549, 16105100000,
]
# document: words in it, first and last year, publication year
DOCUMENTS = [
    (28853, 1950, 2010, None), (2637889, None, None, 1510), (177750159, None, None, 1580),
    (1606, None, None, 1620), (570601, None, None, 1620), (47627379, None, None, 1640),
    (290564, None, None, 1642), (18682640, None, None, 1799), (7918133, None, None, 1900),
    (24496083, None, None, 1930),
]
# frequency, word, document
ATTESTATIONS = [
    (1, 1, 1), (2, 2, 1), (2, 3, 2), (4, 4, 2), (1, 5, 3), (1, 6, 3), (1, 7, 2), (1, 8, 4),
    (1, 9, 4), (1, 10, 5), (4, 1, 2),
]
# Z, Y, X, W, V, type code, for words 1 to 10
PARADIGMS = [
    (1, 1, 1, 1, 1, "HCL"), (1, 1, 2, 1, 1, "HCL"), (1, 1, 1, 2, 1, "HCL"),
    (1, 1, 1, 2, 2, "HCT"), (1, 1, 1, 3, 1, "HCL"), (1, 1, 1, 4, 1, "HCL"),
    (1, 2, 1, 1, 1, "HCL"), (1, 2, 1, 2, 1, "HCL"), (1, 2, 1, 3, 1, "HCL"),
    (1, 2, 1, 3, 2, "HCT"),
]
FREQUENCIES = [3, 231, 7, 3, 1, 4, 5, 1, 4, None]
# variant, distance, frequency; all of `wanneer`
VARIANTS = [
    ("-A-nee:r", 3, 1), ("-Janneef", 3, 1), ("-S.Vanneer", 4, 1), ("-Wanfeen", 3, 1),
    ("-Wanneer", 1, 85), ("-Wanneet", 2, 1), ("-Wan„eer", 2, 1), ("-anneer", 1, 3),
    ("-annexh", 3, 1), ("-ar.neei", 4, 1),
]


def tables() -> dict[str, list[dict]]:
    n = range(1, 11)
    return {
        "anahashes": [{"anahash_id": i, "anahash": h} for i, h in enumerate(HASHES, 1)],
        "corpora": [{"corpus_id": i, "name": f"Dummy corpus {i}"} for i in (1, 2)],
        "corpusId_x_documentId": [
            {"corpus_id": 2 - i % 2, "document_id": i} for i in n],
        "documents": [
            {"document_id": i, "word_count": count, "title": f"Dummy_Doc_{i}",
             "year_from": first, "year_to": last, "pub_year": year, "language": "nl"}
            for i, (count, first, last, year) in enumerate(DOCUMENTS, 1)],
        "lexica": [
            {"lexicon_id": 1, "lexicon_name": "DUMMY.LEXICON.1", "vocabulary": 0},
            {"lexicon_id": 2, "lexicon_name": "DUMMY.LEXICON.2", "vocabulary": 1}],
        "lexical_source_wordform": [
            {"wordform_source_id": i, "lexicon_id": lexicon, "wordform_id": word}
            for i, (lexicon, word) in enumerate(
                [(1, w) for w in (2, 3, 4, 5)] + [(2, w) for w in (6, 7, 8, 9, 10, 2, 3)], 1)],
        "morphological_paradigms": [
            dict(zip(["Z", "Y", "X", "W", "V", "word_type_code"], codes), paradigm_id=i,
                 wordform_id=i) for i, codes in enumerate(PARADIGMS, 1)],
        "source_x_wordform_link": [
            {"source_x_wordform_link_id": i, "wordform_from": a, "wordform_to": b,
             "lexicon_id": lexicon, "wordform_from_correct": right,
             "wordform_to_correct": 1 - right}
            for i, (a, b, lexicon, right) in enumerate(
                [(3, 4, 1, 1), (9, 10, 2, 1), (4, 3, 1, 0), (10, 9, 2, 0)], 1)],
        "text_attestations": [
            {"attestation_id": i, "frequency": f, "wordform_id": w, "document_id": d}
            for i, (f, w, d) in enumerate(ATTESTATIONS, 1)],
        "ranked_variants": [
            {"variant_id": i, "wordform": v, "wordform_source": "wanneer",
             "wordform_source_id": 20471, "levenshtein_distance": d, "frequency": f}
            for i, (v, d, f) in enumerate(VARIANTS, 1)],
        "wordform_frequency": [
            {"wordform_id": i, "wordform": w, "frequency": f}
            for i, w, f in zip(n, WORDS, FREQUENCIES)],
        "wordform_links": [
            {"wordform_from": 3, "wordform_to": 4}, {"wordform_from": 9, "wordform_to": 10}],
        "wordforms": [
            {"wordform_id": i, "wordform": w, "anahash_id": h, "wordform_lowercase": w}
            for i, w, h in zip(n, WORDS, HASH_IDS)],
    }


def write(folder: Path) -> None:
    for name, rows in tables().items():
        columns = RELATIONAL[name].names
        lines = ["\t".join(columns)] + [
            "\t".join("" if r.get(c) is None else str(r[c]) for c in columns) for r in rows]
        (Path(folder) / f"{name}.tsv").write_text("\n".join(lines) + "\n", encoding="utf-8")
