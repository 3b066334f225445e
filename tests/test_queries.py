"""Registered queries against their SQL at the smallest scale.

A selection by default; all of them with WORDLOOM_ALL_QUERIES=1.
"""

import os

import pytest

import __spark_entry__ as entry
from tests.compare import difference, duck

FOLDER = "/root/testdata/sf0.001"
SELECTED = [
    "word_frequency_per_year", "word_frequency_per_corpus", "word_in_corpora_over_time",
    "lexicon_coverage", "tokenized_corpus", "lexica_of_word", "link_sources", "suffix_pairs",
    "variants_for_lemma", "variants_of_word", "paradigm_network_nodes", "confusion_neighbours",
    "range_neighbours", "running_shares", "kl_grid", "frequency_files", "dbnl_corpus",
    "correction_lists", "dictionary_links", "words_in_documents",
]
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
NAMES = list(QUERIES) if os.environ.get("WORDLOOM_ALL_QUERIES") else SELECTED


@pytest.fixture(scope="module")
def con():
    return duck(FOLDER)


@pytest.mark.parametrize("name", NAMES)
def test_query(spark, con, name):
    result = QUERIES[name](spark, FOLDER)
    if name in ORACLES:
        assert difference(result, con, ORACLES[name]) is None
    else:
        assert result.columns and result.count() >= 0


def test_entry(spark):
    assert entry.entry(spark).count() > 0


def test_every_oracle_has_a_query():
    assert set(ORACLES) <= set(QUERIES)
