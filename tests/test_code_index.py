"""The layout of paradigms by codes against the plain table; networks of all words at once."""

import random
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wordloom.operators import paradigm_queries as q
from wordloom.operators.code_index import CodeIndex
from wordloom.operators.paradigm_networks import paradigm_networks
from wordloom.plans import ingest
from wordloom.schema import MODEL

FILES = 24


def paradigm_rows():
    rng = random.Random(4)
    rows = []
    for n in range(3000):
        # One Z and Y holds a third of all rows.
        z, y = (1, 1) if n % 3 == 0 else (rng.randrange(6), rng.randrange(40))
        x, w = rng.randrange(120) * 3, rng.randrange(400)
        rows.append({
            "paradigm_id": n + 1, "Z": z, "Y": y, "X": x, "W": w, "V": rng.randrange(5),
            "word_type_code": rng.choice(["HCL", "HCM", "HCX"]), "word_type_number": n % 7,
            "wordform": f"w{rng.randrange(1500)}"})
    return rows


@pytest.fixture(scope="module")
def model(spark):
    names = MODEL["paradigms"].fieldNames()
    rows = paradigm_rows()
    paradigms = spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows], MODEL["paradigms"])
    frequency = spark.createDataFrame(
        [(f"w{n}", (n * 7919) % 211) for n in range(0, 1500, 2)], "wordform string, frequency long")
    words = spark.createDataFrame(
        [(f"w{n}",) for n in range(1500)], "wordform string").select(*[
            F.col("wordform") if f.name == "wordform" else F.lit(None).cast(f.dataType).alias(f.name)
            for f in MODEL["words"].fields])
    return replace(
        ingest.empty_model(spark), paradigms=paradigms, words=words, word_frequency=frequency)


@pytest.fixture(scope="module")
def index(spark, model, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("index") / "codes")
    CodeIndex.build(model, path, FILES)
    return CodeIndex.open(spark, path)


def test_lookups_by_codes_are_equal(model, index):
    row = next(r for r in paradigm_rows() if r["word_type_code"] == "HCL" and r["Z"] != 1)
    z, y, x, w = (row[c] for c in q.CODES)
    for part, ask in (
        (index.at(model, Z=z, Y=y, X=x, W=w), lambda m: q.variants_by_codes(m, w, x, y, z)),
        (index.at(model, Z=z, Y=y), lambda m: q.nearest_x(m, x, y, z)),
        (index.at(model, Z=z, Y=y), lambda m: q.frequent_x(m, y, z)),
        (index.at(model, Z=z, Y=y, X=x), lambda m: q.frequent_lemmas(m, x, y, z, 20)),
        (index.at(model, Z=z, Y=y), lambda m: q.top_lemma_per_x(m, y, z)),
        (index.at(model, X=x), lambda m: q.paradigm_count(m, X=x)),
        (index.at(model), lambda m: q.paradigm_size(m, "X")),
    ):
        assert rows_of(ask(part)) == rows_of(ask(model))
    assert rows_of(index.at(model, Z=99).paradigms) == []
    with pytest.raises(ValueError):
        index.at(model, V=1)


@pytest.mark.parametrize("words", ["w7", ["w7", "w300", "w1499", "none"], []])
def test_lookups_by_words_are_equal(model, index, words):
    part = index.of_words(model, words)
    for ask in (q.morph_links, q.lemmas_for_wordform, q.paradigms_of_word, q.codes_of_word):
        assert rows_of(ask(part, words)) == rows_of(ask(model, words))
    wide = index.of_words(model, words, ("Z", "Y"))
    for mine, plain in zip(q.paradigm_network(wide, words), q.paradigm_network(model, words)):
        assert rows_of(mine) == rows_of(plain)


def test_files_are_skipped_and_filters_pushed(model, index):
    def opened(part):
        return len(part.paradigms.inputFiles())

    assert opened(index.at(model)) == FILES
    assert opened(index.at(model, Z=4)) <= FILES * 3 // 4
    assert opened(index.at(model, X=30)) <= FILES * 3 // 4
    assert opened(index.at(model, W=30)) < FILES
    row = paradigm_rows()[1]
    exact = index.at(model, **{c: row[c] for c in q.CODES})
    assert 1 <= opened(exact) <= FILES // 4
    spark = exact.paradigms.sparkSession
    formatted = spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString("formatted")
    plan = exact.paradigms._jdf.queryExecution().explainString(formatted)
    assert all(f"EqualTo({c},{row[c]})" in plan for c in q.CODES)
    assert opened(index.of_words(model, "w7")) < FILES


def test_words_without_codes_and_empty_tables(spark, model, tmp_path):
    odd = [(1, None, 1, 2, 3), (2, 1, None, 2, 3), (3, 1, 1, 2, 3), (4, 1, 1, 2, 3)]
    names = MODEL["paradigms"].fieldNames()
    rows = [{"paradigm_id": i, "Z": z, "Y": y, "X": x, "W": w, "word_type_code": "HCL",
             "wordform": "a" if i < 4 else None} for i, z, y, x, w in odd]
    given = replace(model, paradigms=spark.createDataFrame(
        [tuple(r.get(n) for n in names) for r in rows], MODEL["paradigms"]))
    index = CodeIndex.build(given, str(tmp_path / "odd"), 2)
    for ask in (q.codes_of_word, q.morph_links, q.paradigms_of_word):
        assert rows_of(ask(index.of_words(given, "a"), "a")) == rows_of(ask(given, "a"))
    empty = replace(model, paradigms=model.paradigms.limit(0))
    index = CodeIndex.build(empty, str(tmp_path / "empty"))
    assert rows_of(index.at(empty, Z=1).paradigms) == []
    assert rows_of(index.of_words(empty, "a").paradigms) == []


@pytest.mark.parametrize("groups,lemmas", [(50, 50), (4, 2), (1, 1)])
def test_networks_of_all_words(spark, model, groups, lemmas):
    words = ["w1", "w7", "w300", "w501", "w1499", "w12", "w900"]
    mine = paradigm_networks(model, groups, lemmas)
    plain = q.paradigm_network(model, words, groups, lemmas)
    for found, want in zip(mine, plain):
        some = found.filter(F.col("lookup_word").isin(words))
        assert found.columns == want.columns
        assert rows_of(some) == rows_of(want)


def test_networks_cut_hubs_before_the_shuffle(spark, model):
    from wordloom.operators.paradigm_networks import hub_members

    plan = hub_members(model, 5)._jdf.queryExecution().executedPlan().toString()
    assert "WindowGroupLimit" in plan and "Partial" in plan
