"""A stored model changed in place: each change once, other parts untouched, readers undisturbed."""

from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wordloom.operators import corpus_queries, lexica
from wordloom.plans import ingest
from wordloom.schema import MODEL
from wordloom.sources.stored_model import StoredModel

WORDS = ["two words", "two_words", "a b", "plain", " padded", "tail ", "x y"]


def model(spark):
    frame = spark.createDataFrame
    return replace(
        ingest.empty_model(spark),
        words=frame([(w, w.lower(), n or None) for n, w in enumerate(WORDS)], MODEL["words"]),
        lexica=frame([(1, "one", True), (2, "two", False)], MODEL["lexica"]),
        lexicon_words=frame([(1, "a b"), (1, "plain"), (2, "x y")], MODEL["lexicon_words"]),
        links=frame([("a b", "plain"), ("plain", "a b")], MODEL["links"]),
        link_sources=frame([
            ("a b", "plain", 2, False, True, 3, None), ("plain", "a b", 2, True, False, 3, None)],
            MODEL["link_sources"]),
        corpora=frame([(1, "old")], MODEL["corpora"]),
        documents=spark.range(3).select(*[
            {"document_id": F.col("id"), "word_count": F.lit(4).cast("long"),
             "title": F.concat(F.lit("d"), "id"), "pub_year": F.lit(1900).cast("long")}.get(
                f.name, F.lit(None).cast(f.dataType)).alias(f.name)
            for f in MODEL["documents"].fields]),
        corpus_documents=frame([(1, 0), (1, 1)], MODEL["corpus_documents"]),
        attestations=frame([("a b", 0, 1), ("a b", 1, 2), ("plain", 2, 4), ("tail ", 0, 3)],
                           MODEL["attestations"]),
    )


@pytest.fixture
def store(spark, tmp_path):
    return StoredModel.create(spark, str(tmp_path / "model"), model(spark), parts=4)


def files(store):
    return {t: {p: tuple(v) for p, v in e.items()} for t, e in store.manifest.tables.items()}


def test_written_and_read_again(spark, store):
    again = StoredModel(spark, store.path)
    assert again.manifest == store.manifest and again.has_marks()
    for name, df in model(spark).tables().items():
        assert rows_of(again.rows(name)) == rows_of(df)
    read = again.model()
    assert rows_of(corpus_queries.word_in_corpora(read)) == rows_of(
        corpus_queries.word_in_corpora(model(spark)))
    plan = corpus_queries.word_in_corpora(read)._jdf.queryExecution().executedPlan().toString()
    assert "document_id" not in plan
    with pytest.raises(FileExistsError):
        StoredModel.create(spark, store.path, read)
    with pytest.raises(FileNotFoundError):
        StoredModel(spark, store.path + "-none")


def test_additions_write_only_what_is_new(spark, store):
    before, read = files(store), store.model()
    new = spark.createDataFrame([("plain",), ("fresh word",)], "wordform string")
    assert store.add_lexicon("load three", "three", True, new, lexicon_id=3)
    after = files(store)
    for table in set(before) - {"words", "lexica", "lexicon_words"}:
        assert after.get(table) == before[table]
    for part, versions in before["words"].items():
        assert after["words"][part][:len(versions)] == versions
    assert rows_of(store.rows("words").filter("wordform like 'fresh%'")) == [
        ("fresh_word", "fresh_word", None)]
    assert store.rows("words").count() == len(WORDS) + 1
    # Who opened the model before still reads it as it was.
    assert read.words.count() == len(WORDS) and read.lexica.count() == 2
    # The same change again, also of a job started anew, adds nothing.
    assert not store.add_lexicon("load three", "three", True, new, lexicon_id=3)
    again = StoredModel(spark, store.path)
    assert not again.add_lexicon("load three", "three", True, new, lexicon_id=3)
    assert again.manifest == store.manifest


def test_a_failed_change_leaves_no_trace(spark, store):
    before = {t: rows_of(store.rows(t)) for t in ("words", "lexica", "lexicon_words")}

    def failing(found):
        rows = lexica.add_lexicon(found, "bad", True, spark.createDataFrame(
            [("half",)], "wordform string"), lexicon_id=4)
        rows["lexicon_words"] = rows["lexicon_words"].withColumn(
            "wordform", F.raise_error(F.lit("lost")).cast("string"))
        return rows

    with pytest.raises(Exception, match="lost"):
        store.add("load four", failing)
    again = StoredModel(spark, store.path)
    for table, rows in before.items():
        assert rows_of(store.rows(table)) == rows_of(again.rows(table)) == rows
    good = spark.createDataFrame([("whole",)], "wordform string")
    assert again.add_lexicon("load four", "four", True, good, lexicon_id=4)
    assert rows_of(again.rows("lexicon_words").filter("lexicon_id = 4")) == [(4, "whole")]
    assert rows_of(again.rows("words").filter("wordform in ('half', 'whole')"), "wordform") == [
        ("whole",)]


def test_deleting_touches_the_lexicon_alone(spark, store):
    before = files(store)
    assert store.delete_lexicon("drop two", 2) and not store.delete_lexicon("drop two", 2)
    after = files(store)
    for table in set(before) - {"lexica", "lexicon_words", "link_sources"}:
        assert after[table] == before[table]
    kept = {p for p, v in after["lexicon_words"].items() if v == before["lexicon_words"].get(p)}
    mine = store.parts_with("lexicon_words", spark.createDataFrame([(2,)], "id long"))
    assert set(before["lexicon_words"]) - {str(p) for p in mine} <= kept
    assert rows_of(store.rows("lexicon_words")) == [(1, "a b"), (1, "plain")]
    assert store.rows("link_sources").isEmpty() and store.rows("links").count() == 2
    assert store.rows("words").count() == len(WORDS) and store.has_marks()


def test_normalizing_respells_every_table(spark, store):
    before = files(store)
    assert store.normalize_words("clean") and not store.normalize_words("clean")
    assert rows_of(store.rows("words"), "wordform") == sorted(
        (w,) for w in ["two words", "two*words", "a_b", "plain", "padded", "tail", "x_y"])
    assert rows_of(store.rows("words").filter("anahash = 2"), "wordform", "wordform_lowercase") == [
        ("a_b", "a_b")]
    assert rows_of(store.rows("lexicon_words")) == [(1, "a_b"), (1, "plain"), (2, "x_y")]
    assert rows_of(store.rows("links")) == [("a_b", "plain"), ("plain", "a_b")]
    assert rows_of(store.rows("attestations")) == [
        ("a_b", 0, 1), ("a_b", 1, 2), ("plain", 2, 4), ("tail", 0, 3)]
    assert store.has_marks()
    assert rows_of(corpus_queries.word_in_corpora(store.model())) == [
        ("a_b", "old", 2, 3), ("tail", "old", 1, 3)]
    after = files(store)
    assert all(after[t] == before[t] for t in ("documents", "corpora", "corpus_documents", "lexica"))
    # Cleaning twice would respell a_b once more; a job that starts anew does not.
    again = StoredModel(spark, store.path)
    assert not again.normalize_words("clean") and files(again) == after


def test_years_hashes_frequencies_and_marks(spark, store):
    assert store.set_document_years("years", "old", 1800, 1820)
    assert rows_of(store.rows("documents"), "document_id", "year_from") == [
        (0, 1800), (1, 1800), (2, None)]
    assert not store.has_marks() and store.model().marked is None
    assert store.refresh_marks("marks") and store.has_marks()
    before = files(store)["words"]
    assert store.fill_anahashes("hash") and store.rows("words").filter("anahash is null").isEmpty()
    assert rows_of(store.rows("words").filter("wordform = 'plain'"), "anahash") == [(3,)]
    touched = store.parts_with("words", spark.createDataFrame([(WORDS[0],)], "w string"))
    assert {p for p, v in files(store)["words"].items() if before[p] != v} == {
        str(p) for p in touched}
    assert store.refresh_frequencies("totals", missing_as_zero=True)
    assert dict(rows_of(store.rows("word_frequency")))["a b"] == 3
    assert store.empty("none", "word_frequency") and store.rows("word_frequency").isEmpty()


def test_a_corpus_brings_its_marks(spark, store):
    documents = spark.createDataFrame([("f1", 1950), ("f2", None)], "file string, pub_year long")
    frequencies = spark.createDataFrame(
        [("f1", "plain", 5), ("f1", "nieuw", 1), ("f2", "plain", 2)],
        "file string, wordform string, frequency long")
    before = files(store)
    assert store.add_corpus("load new", "new", documents, frequencies, corpus_id=70)
    assert store.has_marks()
    assert all(files(store)["marked"][p][:len(v)] == v for p, v in before["marked"].items())
    assert rows_of(corpus_queries.word_in_corpora(store.model(), "plain")) == [
        ("plain", "new", 2, 7)]
    assert rows_of(corpus_queries.word_in_corpora(store.model())) == rows_of(
        corpus_queries.word_in_corpora(replace(store.model(), marked=None)))
    # A membership of a known document changes its marks: they no longer hold.
    assert store.append("member", "corpus_documents", spark.createDataFrame(
        [(70, 2)], MODEL["corpus_documents"]))
    assert not store.has_marks()
    assert rows_of(corpus_queries.word_in_corpora(store.model(), "plain")) == [
        ("plain", "new", 3, 11)]
    assert store.compact("compact", "words")
    assert all(len(v) == 1 for v in files(store)["words"].values())


def test_loading_goes_on_where_it_stopped(spark, tmp_path):
    (tmp_path / "opentaal").write_text("een\ntwee woorden\n")
    (tmp_path / "elex").write_text("een\tene\n")
    store = StoredModel.create(
        spark, str(tmp_path / "model"), ingest.empty_model(spark), parts=2)
    ingest.ingest_into(store, str(tmp_path), include=["opentaal"], hash_words=False)
    again = StoredModel(spark, store.path)
    loaded = ingest.ingest_into(again, str(tmp_path), include=["opentaal", "elex"])
    expected = ingest.ingest(spark, str(tmp_path), include=["elex", "opentaal"])
    assert rows_of(loaded.words) == rows_of(expected.words)
    assert rows_of(loaded.links) == rows_of(expected.links)
    assert loaded.lexica.count() == 2 and again.manifest.version == 4
