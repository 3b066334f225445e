"""What keeps the cost of queries in proportion to their tables."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_skew import settings
from wordloom import scratch
from wordloom.functions.bags import long_frame
from wordloom.operators import corpus_queries, lemma_queries, lexicon_queries, paradigm_queries
from wordloom.operators.marks import MARKS, marked
from wordloom.operators.word_index import WordIndex
from wordloom.plans.catalog import QUERIES
from wordloom.plans.ingest import empty_model
from wordloom.plans.workload import Workload
from wordloom.scratch import new_path
from wordloom.sources import frequency_files
from wordloom.sources.files import file_name

FOLDER = "/root/testdata/sf0.001"
COLUMNS = ["wordform", "document_id", "frequency", *MARKS]


def plan_of(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name", [
    "morph_links", "words_of_lexicon", "best_zipf", "suffix_pairs_indexed", "word_list_files",
    "sonar_corpus", "tokens_per_document"])
def test_queries_of_words_lay_out_no_attestations(spark, name):
    workload = Workload(spark, FOLDER)
    assert QUERIES[name].run(workload).count() > 0
    assert "bags" in workload.__dict__ and "marked_rows" not in workload.__dict__


def test_vocabulary_is_that_of_the_attestations(spark):
    workload = Workload.of(spark, FOLDER)
    totals = workload.attestations.groupBy("wordform").agg(F.sum("frequency"))
    assert rows_of(workload.vocabulary, "wordform", "frequency") == rows_of(totals)


def test_parts_of_a_sorted_table_grow_with_its_rows(spark, monkeypatch):
    workload = Workload(spark, FOLDER)
    rows = long_frame(workload.bags).count()
    monkeypatch.setattr(scratch, "ROWS_A_PART", rows // 40)
    assert 40 <= workload.attested_parts <= 42
    assert 35 <= len(workload.marked_rows.inputFiles()) <= 42
    index = WordIndex.build(workload, new_path(spark, "word-index"))
    trigrams = index.trigrams.count()
    assert len(index.trigrams.inputFiles()) >= trigrams / (rows // 40) * 0.7


def test_attested_tokens_in_many_parts(spark, monkeypatch):
    usual = lemma_queries.tokens_per_document(Workload.of(spark, FOLDER).lemma_db)
    workload = Workload(spark, FOLDER)
    monkeypatch.setattr(scratch, "ROWS_A_PART", 500)
    parts = workload.attested_parts
    assert parts > int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = lemma_queries.tokens_per_document(workload.lemma_db, parts)
    for key in ("wordform", "analysis_id", "document_id"):
        assert any(f"hashpartitioning({key}" in line and f", {parts})" in line
                   for line in plan_of(found).splitlines())
    assert rows_of(found) == rows_of(usual)


def test_paradigms_are_scanned_for_listed_words(spark):
    found = paradigm_queries.morph_links(Workload.of(spark, FOLDER), ["thing", "ertion"])
    plan = plan_of(found)
    assert "BroadcastHashJoin" in plan and "Exchange hashpartitioning" not in plan
    scans = [line for line in plan.splitlines() if "FileScan" in line]
    assert sum("looked-up" in line for line in scans) == 1


def test_series_are_shuffled_once_after_their_sums(spark):
    series = corpus_queries.word_in_corpora_over_time(Workload.of(spark, FOLDER), None, 1850, 1950)
    exchanges = [line for line in plan_of(series).splitlines()
                 if "Exchange hashpartitioning" in line]
    assert len(exchanges) == 2


def test_file_names_of_any_path(spark):
    paths = [
        ("/a/b=c/part-1-x.txt", "c"), ("part-0", "part-0"), ("a", "a"), ("/a/", ""), ("", ""),
        ("a/part-1/part-2", "part-1"), ("file:///x/y%20z/1803+2_01.clean", "1803+2_01.clean"),
        ("/q/a%2Bb.tsv", "a+b.tsv"), ("/x/k=v=w/part-", "v=w"),
        (None, None)]
    df = spark.createDataFrame(paths, "path string, name string")
    for row in df.select("path", "name", file_name(F.col("path")).alias("found")).collect():
        assert row["found"] == row["name"], row
    # No expression runs over a whole path, as deep as folders may be.
    assert "substring_index(path" in df.select(file_name(F.col("path")))._jdf.queryExecution(
        ).analyzed().toString()


def test_lines_are_sorted_behind_the_shuffle_only(spark, tmp_path):
    (tmp_path / "a.clean").write_text("x\t1\ny\t2\nx\t3\n")
    found = frequency_files.read_frequency_files(spark, str(tmp_path))
    below = plan_of(found).split("Exchange hashpartitioning(file")
    assert len(below) == 2 and "Sort" not in below[1]
    assert rows_of(found) == [("a.clean", "x", 3), ("a.clean", "y", 2)]


@pytest.mark.parametrize("name", [
    "table_cardinalities", "corrections_nested", "word_frequency_per_year", "lexica_of_word"])
def test_counts_and_few_words_mark_no_bags(spark, name):
    """One table of bags is enough; neither it nor the attestations are written a second time."""
    workload = Workload(spark, FOLDER)
    assert QUERIES[name].run(workload).count() > 0
    assert not {"marked_rows", "marked_bags"} & set(workload.__dict__)


@pytest.mark.parametrize("name", [
    "words_in_lexicon_and_corpus", "word_frequency_per_year_all_words", "word_over_time_metadata",
    "word_in_corpora"])
def test_all_words_are_read_from_one_table_of_marked_bags(spark, name):
    workload = Workload(spark, FOLDER)
    assert QUERIES[name].run(workload).count() > 0
    assert "marked_bags" in workload.__dict__ and "marked_rows" not in workload.__dict__
    assert all("/marked-bags-" in file for file in workload.bags.inputFiles())


def odd_folder(spark, path):
    """Documents without id, text, source or language, unlabelled ones and labels of no document."""
    spark.createDataFrame([
        (1, "b a b", "en", "src1"), (2, "a", "en", "src1"), (3, None, "nl", "src2"),
        (4, "", "nl", "src2"), (5, "c a", None, None), (None, "d a", "en", "src3"),
        (None, "d", "en", "src3"), (10, "a c", "en", "plain")],
        "doc_id long, text string, lang string, source string",
    ).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, 1, 0), (2, 0, 0), (4, 1, 0), (5, 1, 0), (77, 1, 0), (None, 1, 0)],
                          "doc_id long, quality int, toxic int",
                          ).write.parquet(f"{path}/labels.parquet")
    return str(path)


def test_marked_bags_of_texts_and_of_bags_are_those_joined_with_documents(spark, tmp_path):
    folder = odd_folder(spark, tmp_path)
    of_texts, of_bags, joined = (Workload(spark, folder) for _ in range(3))
    assert joined.bags.count() == 8
    expected = rows_of(marked(replace(empty_model(spark), **{
        name: getattr(joined, name) for name in (
            "attestations", "documents", "corpus_documents")})).select(*COLUMNS))
    assert len(expected) == 7
    assert rows_of(marked(of_texts).select(*COLUMNS)) == expected
    assert "bags" not in of_texts.__dict__
    assert rows_of(of_texts.bags) == rows_of(joined.bags)
    assert rows_of(of_texts.documents) == rows_of(joined.documents)
    assert of_bags.bags.count() == 8
    assert rows_of(marked(of_bags).select(*COLUMNS)) == expected
    assert rows_of(of_bags.marked_rows.select(*COLUMNS)) == expected
    # Few words meet the marks by themselves, and equal those of the marked bags.
    assert rows_of(marked(joined, ["a"]).select(*COLUMNS)) == [
        row for row in expected if row[0] == "a"]
    assert "marked_bags" not in joined.__dict__


def test_marked_bags_are_in_more_parts_where_texts_are_long(spark, monkeypatch):
    monkeypatch.setattr(scratch, "ROWS_A_PART", 500)
    workload = Workload(spark, FOLDER)
    assert len(workload.marked_bags.inputFiles()) > int(
        spark.conf.get("spark.sql.shuffle.partitions"))


def test_words_of_a_corpus_leave_a_task_once(spark):
    with settings(spark, **{"spark.sql.autoBroadcastJoinThreshold": "-1"}):
        lines = plan_of(lexicon_queries.words_in_lexicon_and_corpus(
            Workload.of(spark, FOLDER), "lang_en", "quality")).splitlines()
    shuffled = [below for line, below in zip(lines, lines[1:])
                if "Exchange hashpartitioning(wordform" in line]
    assert len(shuffled) == 2 and all("HashAggregate" in line for line in shuffled)


def test_ranges_of_series_take_no_shuffle_of_their_own(spark):
    plan = plan_of(QUERIES["word_over_time_metadata"].run(Workload.of(spark, FOLDER)))
    assert plan.count("Exchange hashpartitioning") == 2
