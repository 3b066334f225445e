"""Attestations that carry the marks of their documents: equal rows, no join on documents."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_skew import SKEWED, settings
from wordloom.operators import corpus_queries as q
from wordloom.operators import lexicon_queries, marks, paradigm_queries
from wordloom.plans import ingest
from wordloom.plans.workload import Workload
from wordloom.schema import MODEL

FOLDER = "/root/testdata/sf0.001"
ALL_WORDS = {
    "word_in_corpora": q.word_in_corpora,
    "word_in_corpus_over_time": lambda m: q.word_in_corpus_over_time(m, "quality"),
    "word_in_corpora_over_time": q.word_in_corpora_over_time,
    "relative_series": q.relative_series,
    "word_frequency_per_year": q.word_frequency_per_year,
    "word_frequency_per_year_of_one": lambda m: q.word_frequency_per_year(m, None, 1000),
    "word_frequency_per_corpus": q.word_frequency_per_corpus,
    "words_in_min_corpora": q.words_in_min_corpora,
    "words_per_document": lambda m: q.words_per_document(m, "src3"),
    "count_words_per_document": lambda m: q.count_words_per_document(m, "src3"),
    "lexicon_coverage": lambda m: q.lexicon_coverage(m, "src3", "benchmark"),
    "words_of_corpora": q.words_of_corpora,
    "count_unique_words_per_corpus": q.count_unique_words_per_corpus,
    "count_unique_words_in_corpus": lambda m: q.count_unique_words_per_corpus(m, "quality"),
    "words_in_lexicon_and_corpus": lambda m: lexicon_queries.words_in_lexicon_and_corpus(
        m, "lang_en", "quality"),
}


@pytest.mark.parametrize("name", list(ALL_WORDS))
def test_no_exchange_on_documents(spark, name):
    workload = Workload.of(spark, FOLDER)
    plan = ALL_WORDS[name](workload)._jdf.queryExecution().executedPlan().toString()
    exchanges = [line for line in plan.splitlines() if "Exchange" in line]
    assert exchanges and not any("document_id" in line for line in exchanges)
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert not any("document_id" in line.split("ReadSchema")[-1] for line in scans)


def test_rows_equal_those_joined_with_documents(spark):
    workload = Workload.of(spark, FOLDER)
    model = workload.model()
    assert model.marked.holds_for(model)
    joined = replace(model, marked=None)
    for run in ALL_WORDS.values():
        assert rows_of(run(model)) == rows_of(run(joined))
    lemma = model.paradigms.filter("word_type_code = 'HCL'").first()["paradigm_id"]
    assert rows_of(paradigm_queries.variants_for_lemma(model, lemma)) == rows_of(
        paradigm_queries.variants_for_lemma(joined, lemma))


def test_marks_of_replaced_tables_no_longer_hold(spark):
    model = Workload.of(spark, FOLDER).model()
    fewer = replace(model, corpus_documents=model.corpus_documents.filter("corpus_id = 1000"))
    assert not fewer.marked.holds_for(fewer)
    assert {name for _, name in rows_of(q.words_of_corpora(fewer))} == {"quality"}


def small_model(spark, members, documents=4):
    frame = spark.createDataFrame
    return replace(
        ingest.empty_model(spark),
        documents=spark.range(documents).select(*[
            {"document_id": F.col("id"), "word_count": F.lit(10).cast("long"),
             "pub_year": F.when(F.col("id") != 3, F.col("id") + 1900),
             "title": F.lit("same")}.get(f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in MODEL["documents"].fields]),
        corpora=frame([(c, f"c{c % 1000}") for c in (1, 63, 64, 5000, -3, 1001)], MODEL["corpora"]),
        corpus_documents=frame(members, MODEL["corpus_documents"]),
        attestations=frame([("a", d, 2) for d in range(documents)] + [("b", 0, 1)],
                           MODEL["attestations"]))


def test_sets_of_any_ids(spark):
    members = [(1, 0), (63, 0), (64, 0), (5000, 0), (-3, 0), (5000, 1), (1, 1), (1, 1),
               (None, 1), (1001, 2), (1, 2), (77, 2)]
    model = small_model(spark, members)
    sets = {r["document_id"]: r["corpora"] for r in marks.corpus_sets(
        model.corpus_documents).collect()}
    assert [b["block"] for b in sets[0]] == [-1, 0, 1, 78]
    expanded = marks.each_corpus(marks.document_marks(model), outer=True)
    assert rows_of(expanded, "document_id", "corpus_id") == rows_of(
        spark.createDataFrame(sorted({m for m in members if m[0]}) + [(None, 3)],
                              "corpus_id long, document_id long"), "document_id", "corpus_id")
    # Two corpora of one name count once each; one without a name is left out.
    assert rows_of(q.word_in_corpora(model, "a")) == [
        ("a", "c0", 2, 4), ("a", "c1", 4, 8), ("a", "c63", 1, 2), ("a", "c64", 1, 2),
        ("a", "c997", 1, 2)]
    assert rows_of(q.word_in_corpus_over_time(model, "c1", "a")) == [
        ("a", 1900, 1, 2), ("a", 1901, 1, 2), ("a", 1902, 2, 4)]
    assert rows_of(q.word_in_corpus_over_time(model, "absent", "a")) == []
    assert rows_of(q.words_in_min_corpora(model, 3)) == [("a", 7), ("b", 5)]
    assert rows_of(q.words_per_document(model, "c64")) == [("same", "a"), ("same", "b")]
    names = {name for _, name, _ in rows_of(q.word_frequency_per_corpus(model))}
    assert names == {None, "c0", "c1", "c63", "c64", "c997"}


def test_hot_word_and_hot_corpus(spark):
    """A word in every document and a corpus of every document leave each task as a few rows."""
    n = 6000
    model = small_model(
        spark, [(1, i) for i in range(n)] + [(63, i) for i in range(0, n, 7)], n)
    rows = marks.marked(model).repartition(6)
    model = replace(model, marked=marks.Marked.of(rows, model))
    with settings(spark, **SKEWED):
        found = q.word_in_corpora(model)
        assert rows_of(found) == [
            ("a", "c1", n, 2 * n), ("a", "c63", len(range(0, n, 7)), 2 * len(range(0, n, 7))),
            ("b", "c1", 1, 1), ("b", "c63", 1, 1)]
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert "partial_sum" in plan
