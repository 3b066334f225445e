"""Cleaning rules and expressions, checked value by value."""

import random
import string
from collections import Counter

import pytest

from tests.conftest import rows_of
from pyspark.sql import functions as F
from wordloom.functions import text as T
from wordloom.functions.anahash import anahash
from wordloom.functions.bags import bags_of_texts, bags_of_word_lists, long_frame
from wordloom.operators import cleaning


def apply(frame, function, values):
    rows = frame([(i, v) for i, v in enumerate(values)], "i INT, v STRING")
    found = {r["i"]: r["o"] for r in rows.select("i", function(F.col("v")).alias("o")).collect()}
    return [found[i] for i in range(len(values))]


def test_preprocess(frame):
    raw = ["wf1 ", "  wf2", " ", "\twf3\t", "wf 1", "wf_1", "a_b c", " x ", "\x1cy"]
    assert apply(frame, T.preprocess, raw) == [
        "wf1", "wf2", "", "wf3", "wf_1", "wf*1", "a*b_c", "x", "y"]


def test_component_code(frame):
    found = apply(frame, T.component_code, [
        "Z0001Y0003X2578W00054662V0001_HDU001", "Z0001Y0003X2578W00054662V0012_HCL", "Z1Y3", None])
    assert [tuple(r) if r else None for r in found] == [
        (1, 3, 2578, 54662, 1, "HDU", 1), (1, 3, 2578, 54662, 12, "HCL", None), None, None]


def test_clean_entry(frame):
    assert apply(frame, T.clean_entry, [
        "a:b", " c ", "d2", "(e)", "f.", "((g", "h12", "(i.)", None]) == [
        "ab", "c", "d", "e", None, "g", "h1", None, None]


def test_clean_disambiguation(frame):
    assert apply(frame, T.clean_disambiguation, [
        "(x)", "andere bett.", "andere bet.", "two words", "a, b c, d", "a b, c d", "a, -b",
        "a, b", None]) == ["x", None, None, None, "a, d", None, None, "a, b", None]


def test_diacritics_in_order(frame):
    assert apply(frame, T.apply_diacritics, [
        "cafe@'", "coo@\\rd", "gar@+con", "zo@@n", "CO@2", "ee@n", "e@^e@`e@="]) == [
        "café", "coörd", "gaŗcon", "zo'n", "CO₂", "eën",
        "êèẽ"]


def test_effective_year(frame):
    rows = frame([(1, 1700, None, None), (2, None, 1950, 2010), (3, None, 1951, 1952),
                  (4, None, 1900, None)],
                 "i INT, pub_year LONG, year_from LONG, year_to LONG")
    assert rows_of(rows.select("i", T.effective_year())) == [
        (1, 1700), (2, 1980), (3, 1952), (4, None)]


def test_complete_forms(frame):
    tags = ["NOU", "VRB_CONTRACT", "VRB(mainPart)", None, "123", "NOU-C"]
    assert apply(frame, T.is_complete_form, tags) == [True, False, False, False, False, True]


def test_artificial_frequency(frame):
    rows = frame([(100_000_005,), (99_999_999,), (100_000_000,)], "c LONG")
    found = rows.select(T.without_artificial_frequency(F.col("c"))).collect()
    assert sorted(r[0] for r in found) == [0, 5, 99_999_999]


def test_anahash(frame):
    alphabet = {"a": 13382255776, "b": 22877577568, "w": 28153056843}
    found = apply(frame, lambda c: anahash(c, alphabet), ["ab", "BA", "wab", "x", "\U0001d4d0a"])
    a, b, w = alphabet.values()
    assert found == [a + b, a + b, a + b + w, 0, a]
    assert apply(frame, lambda c: anahash(c, alphabet, 5), ["x\U0001d4d0"]) == [10]
    assert apply(frame, anahash, ["a", "ba"]) == [101 ** 5, 101 ** 5 + 102 ** 5]
    with pytest.raises(ValueError):
        anahash(F.col("v"), {str(i): i for i in range(10_001)})


def test_bags_against_counter(frame):
    random.seed(3)
    texts = ["", "...", "One one, TWO", "x" * 256 + " y", "Été été-là"]
    texts += [" ".join(random.choices(["a", "b", "cc", "Cc", "d"], k=random.randint(0, 300)))
              for _ in range(30)]
    rows = frame(list(enumerate(texts)), "doc INT, text STRING")
    import regex

    # By default words of any length count; a limit is asked for.
    for longest, bags in ((10**9, bags_of_texts(rows)), (255, bags_of_texts(rows, max_length=255))):
        words = [[t for t in regex.findall(r"\p{L}+", text.lower()) if len(t) <= longest]
                 for text in texts]
        expected = sorted((i, t, n) for i, ws in enumerate(words) for t, n in Counter(ws).items())
        assert rows_of(long_frame(bags, "doc")) == expected
        assert rows_of(bags, "doc", "word_count") == [(i, len(ws)) for i, ws in enumerate(words)]


def test_word_lists_keep_case(frame):
    rows = frame([(1, ["A", "a", "A"]), (2, []), (3, None)], "doc INT, words ARRAY<STRING>")
    bags = bags_of_word_lists(rows)
    assert rows_of(long_frame(bags, "doc")) == [(1, "A", 2), (1, "a", 1)]
    assert rows_of(bags, "doc", "word_count") == [(1, 3), (2, 0), (3, 0)]


def test_dictionary(frame):
    from wordloom.sources.word_lists import COLUMNS_1995

    def entry(**cells):
        return tuple(cells.get(c.replace(" ", "_").replace("/", "_")) for c in COLUMNS_1995)

    rows = frame([
        entry(word="abc:", see_also="zie ook def", disambiguation="(ghi)",
              plural_past_attrib="abcs, abcen", past_perfect_superla="afk."),
        entry(word="x, y", disambiguation="andere bet."),
        entry(word="caf@'2", diminu_compara_past_plural="z"),
    ], ", ".join(f"`{c}` STRING" for c in COLUMNS_1995))
    assert rows_of(cleaning.dictionary_words(rows)) == [
        ("abc",), ("abcen",), ("abcs",), ("caf́",), ("ghi",), ("x",), ("y",), ("z",)]
    assert rows_of(cleaning.dictionary_links(rows)) == [
        ("abc", "abcen"), ("abc", "abcs"), ("abc", "def"), ("abc", "ghi"), ("caf́", "z")]


def test_reports(frame):
    rows = frame([("a:",), ("b.",), (" c",), ("d1",), ("(e)",), ("f",)], "wordform STRING")
    assert tuple(cleaning.cleanliness(rows).first()) == (1, 1, 1, 1, 1, 1)
    assert rows_of(cleaning.unclean_words(rows, "parentheses")) == [("(e)",)]
    assert rows_of(cleaning.contains_in_any_column(rows, "^[bf]")) == [("b.",), ("f",)]
    multi = frame([("a b",), (" c",), ("d",)], "wordform STRING")
    assert rows_of(cleaning.split_multi_word(multi)) == [(" c",), ("a",), ("b",), ("d",)]


def test_random_anagrams_share_a_hash(frame):
    random.seed(5)
    words = ["".join(random.choices(string.ascii_lowercase, k=8)) for _ in range(50)]
    shuffled = ["".join(random.sample(w, len(w))) for w in words]
    assert apply(frame, anahash, words) == apply(frame, anahash, shuffled)


def test_words_of_any_length_count(frame):
    from wordloom.functions.anahash import anahash
    from wordloom.functions.bags import bags_of_texts

    long, longer = "a" * 300, "é" * 20_000
    row = bags_of_texts(frame([(f"b {long} {longer} {long}",)], "text string"), max_length=None).first()
    assert row["word_count"] == 4
    assert {(t["wordform"], t["frequency"]) for t in row["bag"]} == {("b", 1), (long, 2), (longer, 1)}
    words = frame([(long,), ("一" * 20_000,)], "word string")
    hashes = [r[0] for r in words.select(anahash(words["word"])).collect()]
    assert hashes == [300 * 101**5, None]
