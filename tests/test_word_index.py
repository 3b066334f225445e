"""The word index against plain scans."""

import re
from dataclasses import replace
from functools import reduce

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_queries import FOLDER
from wordloom.model import Model
from wordloom.operators import search, word_index
from wordloom.operators.word_index import WordIndex, required_strings
from wordloom.plans import ingest
from wordloom.plans.workload import Workload
from wordloom.schema import MODEL

WORDS = [
    "", "a", "ab", "abc", "abcabc", "thing", "something", "nothings", "talking", "talked",
    "walking", "walked", "walk", "ing", "ed", "théâtre", "Thing", "th\nng", "a.c", "a]c", "[abc]",
    "😀😀😀s", "x😀😀😀y", "%ing", "_ed", "naïve", "naïef", "colour", "color", "colouur", "ab\n", "ab\r\n", "ab\u2028", "ab\n\n", "\x02th", "ed\x03s",
]


@pytest.fixture(scope="module")
def indexed(spark, tmp_path_factory) -> tuple[Model, WordIndex]:
    model = replace(
        ingest.empty_model(spark),
        words=spark.createDataFrame(
            [(w,) for w in [*WORDS, "thing", None]], "wordform string").select(*[
                F.col("wordform") if f.name == "wordform" else F.lit(None).cast(f.dataType).alias(
                    f.name) for f in MODEL["words"].fields]),
        word_frequency=spark.createDataFrame(
            [(w, i) for i, w in enumerate(WORDS)] + [(None, 99), ("unknown", None)],
            MODEL["word_frequency"]))
    path = str(tmp_path_factory.mktemp("index") / "words")
    WordIndex.build(model, path)
    return model, WordIndex.open(spark, path)


PATTERNS = [
    "thing", "^th.*ing$", "(thing|talk)", "(thing|a)", "th(in|at)g?", "ab+c", "(abc)+", "(abc){2}",
    "(abc)*", "(abc)?x", "colou?r", "colou*r", "[tw]alk(ing|ed)", "[^t]alking", "alk[a-z]ng",
    "(?i)thing", "(?i:thing)", "(?x)th ing", r"\Qa.c\E", r"a\.c", "a]c", r"\[abc\]",
    "[abc[def]]hing", "[a-z&&[t]]hing", r"\p{L}hing", "[th]+ing(s|)", "(?=thing)t", "t(?!hing)alk",
    "😀{3}s", "😀😀😀y", "na[ïi]ve|naïef", "walk(ed|ing)?", "", ".", "zzz", "talk(?:ing|ed)",
    "(alk|th).*(ing|ed)$", "th(?:.*ing|.*at)", "(some|no)thing(s?)", "abc|", "(?:abc|def)++",
    "^th", "ed$", "^^th", "ed$$", "^$", "^a$", "^ab", "ab$\\n", "ab$", "(^|s)th", "(ed|ing)$",
    "ab\\Z", r"\Ath", "b$(\n|\r)", "a^b",
]


def test_same_as_a_scan(spark, indexed):
    model, index = indexed
    words = [w for (w,) in rows_of(model.words.select("wordform").distinct())]
    scanned = spark.createDataFrame(
        [(p, w) for p in PATTERNS for w in words], "pattern string, wordform string").filter(
        "wordform rlike pattern")
    found = reduce(DataFrame.union, [
        index.matching(p).select(F.lit(p).alias("pattern"), "wordform") for p in PATTERNS])
    assert rows_of(found) == rows_of(scanned)


def test_required_strings():
    assert required_strings("thing") == [["thing"]]
    assert required_strings("^th.*(ing|ed)$") == [["\x02th"], ["ed\x03", "ing\x03"]]
    assert required_strings("some.*(thing|talking)") == [["some"], ["talking", "thing"]]
    assert required_strings("col(ou|o)r") == [["color", "colour"]]
    assert required_strings("(abc.*|def.*)") == [["abc", "def"]]
    assert required_strings("(abc.*|d.*)") == []
    assert required_strings("(abc)?d") == []
    assert required_strings("(abc){2,}") == [["abc"]]
    for unlike in ("(?i)thing", "[a&&[b]]thing", r"\Qthing", r"\p{L}thing", "(thing", "[[]thing]"):
        assert required_strings(unlike) == []


@settings(max_examples=300, deadline=None)
@given(st.recursive(
    st.sampled_from(["a", "b", "abc", ".", "[ab]", "[^a]", "^", "$"]),
    lambda part: st.one_of(
        st.lists(part, min_size=1, max_size=4).map("".join),
        st.lists(part, min_size=1, max_size=3).map(lambda p: f"({'|'.join(p)})"),
        part.map(lambda p: f"(?:{p})?"), part.map(lambda p: f"(?:{p})+"),
        part.map(lambda p: f"(?:{p}){{2,3}}")), max_leaves=12),
    st.text("abc", max_size=12))
def test_every_match_has_the_required_trigrams(pattern, word):
    if re.search(pattern, word):
        held = word_index._trigrams_of(f"\x02{word}\x03")
        assert all(any(word_index._trigrams_of(s) <= held for s in clause)
                   for clause in required_strings(pattern))


def test_first_matches_with_total(indexed):
    _, index = indexed
    assert [tuple(r) for r in index.first_matches("alk", 2).collect()] == [
        ("talked", 5), ("talking", 5)]
    assert index.first_matches("zzz").count() == 0


@pytest.mark.parametrize("suffixes", [
    ("ing", "ed"), ("ing", ""), ("", "s"), ("", ""), ("😀😀s", ""), ("%ing", ""), ("hing", "_ed")])
def test_suffix_pairs_like_a_scan(indexed, suffixes):
    model, index = indexed
    for least in (-1, 9):
        expected = search.suffix_pairs(model, *suffixes, least)
        assert rows_of(index.suffix_pairs(*suffixes, least)) == rows_of(expected)


def test_plans(spark, tmp_path):
    """An expression reads only its trigrams' rows, and an ending is a pushed range."""
    model = Workload.of(spark, FOLDER).model()
    index = WordIndex.build(model, str(tmp_path / "index"))

    def plan(df):
        return df._jdf.queryExecution().executedPlan().toString()

    found = plan(index.matching("thing"))
    assert "In(trigram, [hin,ing,thi])" in found
    # Words are tested after their postings met.
    assert found.index("RLIKE") < found.index("HashAggregate") and found.count("RLIKE") == 1
    assert "StringStartsWith(reversed,gni)" in plan(index.suffix_pairs("ing", "ed", 2))
    few, all_words = index.candidates("q.*uali").count(), index.words.count()
    assert few < all_words / 10


def test_empty_model(spark, tmp_path):
    index = WordIndex.build(ingest.empty_model(spark), str(tmp_path / "index"))
    assert index.matching("thing").count() == 0
    assert index.matching("").count() == 0
    assert index.suffix_pairs("ing", "ed").count() == 0
