"""Expected results of the lookups on the small model."""

import pytest

from tests.conftest import rows_of
from wordloom.operators import anagram_queries as anagrams
from wordloom.operators import corpus_queries as corpora
from wordloom.operators import lexicon_queries as lexica
from wordloom.operators import paradigm_queries as paradigms
from wordloom.operators import search


def test_tables_are_complete(golden):
    counts = dict(rows_of(corpora.cardinalities(golden), "table", "num_rows"))
    assert counts == {
        "words": 10, "lexica": 2, "lexicon_words": 11, "links": 2, "link_sources": 4,
        "corpora": 2, "documents": 10, "corpus_documents": 10, "attestations": 11,
        "paradigms": 10, "external_links": 0, "word_frequency": 10, "ranked_variants": 10,
    }


def test_corpora(golden):
    rows = rows_of(corpora.corpora(golden), "name", "word_count", "document_count")
    assert rows == [
        ("Dummy corpus 1", 28853 + 177750159 + 570601 + 290564 + 7918133, 5),
        ("Dummy corpus 2", 2637889 + 1606 + 47627379 + 18682640 + 24496083, 5),
    ]


@pytest.mark.parametrize("word, expected", [
    ("aandacht", [("aandacht", 1, 1, 1, 1, 1)]),
    ("drmoedaris", [("dromedaris", 3, 2, 1, 1, 1)]),
    ("iederene", [("iedereen", 9, 3, 1, 2, 1)]),
    ("blaa123", []),
])
def test_lemmas(golden, word, expected):
    lemmas = paradigms.lemmas_for_wordform(golden, word)
    assert rows_of(lemmas, "wordform", "paradigm_id", "W", "X", "Y", "Z") == expected


def test_lexica_of_word(golden):
    asked = ["idonotexist", "aandacht", "foxtrot", "dromedaris", "drmoedaris"]
    found = {
        word: [(has, correct) for w, _, has, correct in rows_of(
            lexica.lexica_of_word(golden, asked),
            "lookup_word", "lexicon_name", "has_wordform", "correct") if w == word]
        for word in asked
    }
    absent = (False, None)
    assert found == {
        "idonotexist": [absent, absent], "aandacht": [absent, absent],
        "foxtrot": [absent, (True, True)], "dromedaris": [(True, True), (True, True)],
        "drmoedaris": [(True, False), absent],
    }


def test_variants_for_lemma(golden):
    columns = ("wordform", "frequency", "min_year", "max_year", "num_corpora", "num_lexica",
               "num_paradigms", "V")
    assert rows_of(paradigms.variants_for_lemma(golden, 1), *columns) == [
        ("aandacht", 5, 1510, 1980, 2, 0, 1, 1)]
    assert rows_of(paradigms.variants_for_lemma(golden, 3), *columns) == [
        ("drmoedaris", 4, 1510, 1510, 1, 1, 1, 2),
        ("dromedaris", 4, 1510, 1510, 1, 2, 1, 1)]
    once = paradigms.variants_for_lemma(golden, 3, distinct_attestations=True)
    assert rows_of(once, "wordform", "frequency") == [("drmoedaris", 4), ("dromedaris", 2)]


def test_network(golden):
    nodes, links = paradigms.paradigm_network(golden, "dromedaris")
    assert nodes.count() == 6 and links.count() == 5
    hubs = rows_of(nodes.filter("type = 'x'"), "id", "wordform", "W", "frequency")
    assert hubs == [("Z1Y1X1", "dromedaris", 2, 15), ("Z1Y1X2", "banaan", 1, 231)]
    assert rows_of(links.filter("type = 'XX'"), "source", "target") == [("Z1Y1X2", "Z1Y1X1")]


def test_paradigm_count(golden):
    rows = [tuple(r) for r in paradigms.paradigm_count(golden).collect()]
    assert rows == [(1, 1, 1, 5), (1, 2, 1, 4), (2, 1, 1, 1)]


def test_variants_of_word(golden):
    rows = paradigms.variants_of_word(golden, "aandacht", 0, 2000)
    assert rows_of(
        rows, "paradigm_code", "lemma", "wordform", "V", "word_type_code", "word_type_number",
        "anahash", "frequency", "corpus_name", "year", "term_frequency", "total",
        "rel_corpus_frequency", "freq", "total_number_of_words",
    ) == [("Z0001Y0001X0001W00000001", "aandacht", "aandacht", 1, "HCL", None, 10000000000, 3,
           "Dummy corpus 2", 1510, 4, 2637889, 1.0, 1.5163640319967973e-06, 4)]
    metadata = paradigms.variants_metadata(golden, "aandacht", None, 2000)
    assert rows_of(
        metadata, "min_year", "max_year", "min_freq", "max_freq", "overall_min_year",
        "overall_max_year",
    ) == [(1510, 1510, 1.5163640319967973e-06, 1.5163640319967973e-06, 1510, 2000)]
    assert paradigms.variants_of_word(golden, "asdasdasd").count() == 0
    nested = paradigms.variants_document(golden, "aandacht", None, 2000).collect()
    (paradigm,) = nested[0]["paradigms"]
    assert (paradigm["lemma"], paradigm["metadata"]["max_year"]) == ("aandacht", 1510)
    (form,) = paradigm["variants"]
    assert form["corpora"][0]["corpus_name"] == "Dummy corpus 2"
    assert [p["term_frequency"] for p in form["corpora"][0]["frequencies"]] == [4]
    ranked = paradigms.corrections_document(golden, "wanneer").first()
    assert ranked["paradigms"] is None and len(ranked["corrections"]) == lexica.corrections(
        golden, "wanneer").count()


def test_variants_by_codes(golden):
    assert rows_of(paradigms.variants_by_codes(golden, 1, 1, 1, 1)) == [("aandacht", 3)]
    assert rows_of(paradigms.variants_by_codes(golden, W=3, X=1, Y=2, Z=1)) == [("iedereen", 4)]


def test_word_card(golden):
    card = anagrams.word_card(golden, ["aandacht", "drmoedaris", "idonotexist"])
    assert rows_of(card, "lookup_word", "kind", "wordform") == [
        ("aandacht", "anahash", "aandacht"), ("aandacht", "morph", "aandacht"),
        ("drmoedaris", "anahash", "drmoedaris"), ("drmoedaris", "anahash", "dromedaris"),
        ("drmoedaris", "morph", "drmoedaris"), ("drmoedaris", "morph", "dromedaris"),
    ]
    assert rows_of(lexica.word_links(golden, "dromedaris"), "wordform", "lexicon_name") == [
        ("drmoedaris", "DUMMY.LEXICON.1")]


def test_frequency_per_corpus(golden):
    found = corpora.word_frequency_per_corpus(golden, ["aandacht", "drmoedaris", "none"])
    assert rows_of(found, "wordform", "corpus_name", "relative_frequency") == [
        ("aandacht", "Dummy corpus 1", 34658.44106332097),
        ("aandacht", "Dummy corpus 2", 1516.3640319967974),
        ("drmoedaris", "Dummy corpus 2", 1516.3640319967974)]


def test_frequency_per_year(golden):
    found = corpora.word_frequency_per_year(golden, ["aandacht", "drmoedaris", "none"])
    assert rows_of(found, "wordform", "year", "normalized_frequency") == [
        ("aandacht", 1510, 1516.3640319967974), ("aandacht", 1980, 34658.44106332097),
        ("drmoedaris", 1510, 1516.3640319967974)]
    one = corpora.word_frequency_per_year(golden, "aandacht", corpus_id=1)
    assert rows_of(one, "year", "normalized_frequency") == [(1980, 34658.44106332097)]


def test_word_type_codes(golden):
    assert rows_of(paradigms.word_type_codes(golden)) == [("HCL",), ("HCT",)]


def test_corrections(golden):
    found = rows_of(
        lexica.corrections(golden, "wanneer"), "wordform", "levenshtein_distance", "frequency")
    from tests.golden_tables import VARIANTS

    assert found == sorted(VARIANTS)
    assert paradigms.variants_of_word(golden, "wanneer").count() == 0
    assert rows_of(corpora.year_range(golden)) == [(1510, 1930)]


def test_linked_words_need_the_corpus(golden, frame):
    """A linked word that the corpus does not have is left out."""
    from dataclasses import replace

    sources = golden.link_sources
    links = sources.select("wordform_from", "wordform_to")
    model = replace(golden, links=links)
    found = lexica.linked_words_in_corpus(model, "dromedaris", 1, 2)
    assert rows_of(found, "wordform", "correct", "word_correct", "ld", "freq_in_corpus") == [
        ("drmoedaris", False, True, None, 4)]
    assert lexica.linked_words_in_corpus(model, "dromedaris", 1, 1).count() == 0


def test_null_hash_gives_one_null(golden, frame):
    from dataclasses import replace

    words = golden.words.unionByName(frame(
        [("nohash", "nohash", None)], golden.words.schema))
    found = anagrams.anahash_links(replace(golden, words=words), "nohash")
    assert rows_of(found) == [("nohash", None)]


def test_frequencies_keep_null_or_zero(golden):
    from wordloom.operators.corpora import word_frequencies

    rows = dict(rows_of(word_frequencies(golden)))
    assert rows["aandacht"] == 5 and rows["drmoedaris"] == 4 and len(rows) == 10


def test_search(golden):
    assert rows_of(search.regexp_search(golden, "^d.*s$")) == [("drmoedaris",), ("dromedaris",)]
    assert rows_of(search.regexp_search_total(golden, "aa")) == [(3,)]


def test_series_metadata_and_nesting(golden):
    series = corpora.word_in_corpora_over_time(golden, "aandacht")
    nested = corpora.series_per_corpus(series).collect()
    assert [(r["name"], len(r["frequencies"])) for r in nested] == [("Dummy corpus 2", 1)]
    row = corpora.series_metadata(golden, series).first()
    assert (row["overall_min_year"], row["overall_max_year"]) == (1510, 1930)
    assert (row["min_year"], row["max_corpus_rel_freq"]) == (1510, 1.0)


def test_paradigm_size_checks_its_argument(golden):
    with pytest.raises(ValueError):
        paradigms.paradigm_size(golden, "W")


def test_lookups_as_a_frame(golden, frame):
    """A DataFrame of words gives the same rows as a list."""
    asked = frame([("aandacht",), ("dromedaris",), ("none",)], "anything STRING")
    listed = ["aandacht", "dromedaris", "none"]
    for query in (
        corpora.word_frequency_per_year, corpora.word_in_corpora, paradigms.lemmas_for_wordform,
        paradigms.variants_of_word, anagrams.word_card,
        lambda m, w: paradigms.paradigm_network(m, w)[0],
        lambda m, w: paradigms.paradigm_network(m, w)[1],
    ):
        found = rows_of(query(golden, asked))
        assert found and found == rows_of(query(golden, listed))
