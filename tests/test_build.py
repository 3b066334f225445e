"""Building tables: words, lexica, links, corpora, paradigms, loads and ranks."""

import math
import random

import pytest
from pyspark.sql import functions as F

from tests.conftest import rows_of
from wordloom.functions.bags import bags_of_word_lists, long_frame
from wordloom.operators import anagram_queries as anagrams
from wordloom.operators import corpora, lexica, links, ranks, statistics, words
from wordloom.plans import ingest
from wordloom.schema import MODEL


def listed(frame, *items):
    return frame([(w,) for w in items], "wordform STRING")


@pytest.fixture
def empty(spark):
    return ingest.empty_model(spark)


def test_new_words(frame, empty):
    first = words.new_words(empty.words, listed(frame, "wf1 ", "  wf2", " ", "wf3", "wf3"))
    assert rows_of(first, "wordform") == [("wf1",), ("wf2",), ("wf3",)]
    more = words.new_words(first, listed(frame, "wf3", "Wf4", "wf 5"))
    assert rows_of(more, "wordform", "wordform_lowercase") == [
        ("Wf4", "wf4"), ("wf_5", "wf_5")]
    asked = words.get_or_create_words(first, listed(frame, "wf1", "x y"))
    assert rows_of(asked, "wordform") == [("wf1",), ("x y",)]


def test_lexicon_mapping(frame, empty):
    model = lexica.plus(empty, lexica.add_lexicon(empty, "one", True, listed(frame, "a", "b")))
    assert rows_of(words.lexicon_mapping(model, lexicon_name="one"), "wordform") == [
        ("a",), ("b",)]
    assert words.lexicon_mapping(model, lexicon_id=1).count() == 2
    with pytest.raises(ValueError):
        words.lexicon_mapping(model)


def test_hash_steps(frame, empty):
    table = words.new_words(empty.words, listed(frame, "ab", "ba", "c"))
    assert rows_of(words.words_without_hash(table)) == [("ab", 1), ("ba", 1), ("c", 1)]
    hashed = words.fill_anahashes(table, {"a": 1, "b": 2, "c": 4})
    assert rows_of(hashed, "wordform", "anahash") == [("ab", 3), ("ba", 3), ("c", 4)]
    assert words.fill_anahashes(hashed, {"a": 9}).exceptAll(hashed).count() == 0
    known = frame([(3,)], "anahash LONG")
    assert rows_of(words.new_anahashes(known, hashed)) == [(4,)]
    again = words.connect_anahashes(words.reset_anahashes(hashed), hashed)
    assert again.exceptAll(hashed).count() == 0


def test_normalize_words(frame):
    found = words.normalize_words(listed(frame, "a b", "a_b", "x*y", "x_y", "ok"))
    assert rows_of(found) == [
        ("a b", "a b", False), ("a_b", "a*b", True), ("ok", "ok", False), ("x*y", "x*y", False),
        ("x_y", "x_y", False)]


PAIRS = [("wf1", "wf1s", 1), ("wf2", "wf2s", 2), ("wf1s", "wf1", 9), ("wf3", "wf3", 0)]


def test_links(frame, empty):
    pairs = frame([(a, b, n, i) for i, (a, b, n) in enumerate(PAIRS)],
                  "a STRING, b STRING, ld INT, at INT")
    directed = links.both_directions(pairs, "a", "b", ["ld"], order_by="at")
    assert rows_of(links.new_links(empty.links, directed)) == [
        ("wf1", "wf1s"), ("wf1s", "wf1"), ("wf2", "wf2s"), ("wf2s", "wf2")]
    stated = links.link_sources(directed, 7, False, True)
    columns = [*links.LINK, "wordform_from_correct", "wordform_to_correct", "ld"]
    assert rows_of(stated, *columns) == [
        ("wf1", "wf1s", False, True, 1), ("wf1s", "wf1", True, False, 1),
        ("wf2", "wf2s", False, True, 2), ("wf2s", "wf2", True, False, 2)]
    # Doing it again adds nothing; one existing direction leaves the other to add.
    new, sources = links.add_links(
        links.new_links(empty.links, directed), stated, pairs, 7, "a", "b")
    assert new.count() == 0 and sources.count() == 0
    half = links.new_links(empty.links, directed).filter("wordform_from = 'wf1'")
    assert links.new_links(half, directed).count() == 3
    unmapped = links.unmapped_pairs(pairs, listed(frame, "wf1", "wf1s", "wf2", "wf3"), "a", "b")
    assert rows_of(unmapped) == [("wf2", "wf2s")]


def test_linked_lexicon_and_deletion(frame, empty):
    pairs = frame([(a, b) for a, b, _ in PAIRS], "lemma STRING, variant STRING")
    added = lexica.add_lexicon_with_links(
        empty, "pairs", True, pairs, "lemma", "variant", True, True)
    model = lexica.plus(empty, added)
    assert model.words.count() == 5 and model.lexicon_words.count() == 5
    assert model.links.count() == 4 and model.link_sources.count() == 4
    model = lexica.plus(model, lexica.add_lexicon(model, "other", True, listed(frame, "wf1")))
    left = lexica.delete_lexicon(model, 1)
    assert left.words.count() == 5 and left.links.count() == 4
    assert left.link_sources.count() == 0 and left.lexicon_words.count() == 1
    assert rows_of(left.lexica, "lexicon_name") == [("other",)]


def test_correction_candidates(frame, empty):
    rows = frame([("ws1", "wf1", 1), ("wf2", "wf1", 1)],
                 "ocr_variant STRING, correction_candidate STRING, ld INT")
    added = lexica.add_correction_candidates(empty, "ocr", rows)
    assert added["words"].count() == 3
    assert rows_of(added["link_sources"].filter("wordform_from = 'wf1'"), "wordform_to",
                   "wordform_from_correct", "wordform_to_correct", "ld") == [
        ("wf2", True, False, 1), ("ws1", True, False, 1)]


def test_measured_links(frame):
    rows = frame([("abc", "abd", None, None), ("a", "a", 5, 6)],
                 "wordform_from STRING, wordform_to STRING, ld INT, anahash_difference LONG")
    assert rows_of(links.measure_links(rows, {"c": 3, "d": 10}), "ld", "anahash_difference") == [
        (1, 7), (5, 6)]


def test_corpus(frame, empty):
    lists = frame([("1", "wf1 wf2 wf3".split()), ("2", "wf2 wf3 wf4".split()),
                   ("3", "wf1 wf5 wf1".split())], "file STRING, words ARRAY<STRING>")
    bags = bags_of_word_lists(lists)
    added = corpora.add_corpus(
        empty, "c", bags.select("file", F.col("file").alias("title")), long_frame(bags, "file"))
    model = lexica.plus(empty, added)
    assert model.words.count() == 5
    assert rows_of(model.documents, "document_id", "title", "word_count") == [
        (1, "1", 3), (2, "2", 3), (3, "3", 3)]
    counts = model.attestations.groupBy("document_id").count()
    assert rows_of(counts) == [(1, 3), (2, 3), (3, 2)]
    assert rows_of(model.attestations.filter("document_id = 3")) == [
        ("wf1", 3, 2), ("wf5", 3, 1)]
    assert rows_of(corpora.word_frequencies(model)) == [
        ("wf1", 3), ("wf2", 2), ("wf3", 2), ("wf4", 1), ("wf5", 1)]


def test_paradigms(frame, empty):
    rows = frame([("aa", "Z0001Y0007X2124W00006579V0001_HDU002#bad")],
                 "wordform STRING, component_codes STRING")
    added = corpora.add_paradigms(empty, rows)["paradigms"]
    assert rows_of(added) == [(1, 1, 7, 2124, 6579, 1, "HDU", 2, "aa")]


def test_sources_are_chosen():
    assert list(ingest.chosen_sources(include=["elex", "inl"])) == ["elex", "inl"]
    assert "elex" not in ingest.chosen_sources(exclude=["elex"])
    with pytest.raises(ValueError):
        ingest.chosen_sources(include=["elex"], exclude=["inl"])


def test_ingest_replaces_and_hashes(spark, tmp_path):
    for name, text in {"opentaal": "aap\nnoot\n", "elex": "aap\tapen\n"}.items():
        (tmp_path / name).write_text(text, encoding="utf-8")
    code = "Z0001Y0007X2124W00006579V0001_HDU002"
    (tmp_path / "paradigms").write_text(
        "\t".join(["noise"] * 9) + "\n" + "\t".join(["aap", "", code] + ["x"] * 6) + "\n")
    model = ingest.ingest(spark, str(tmp_path), include=["opentaal", "elex", "paradigms"])
    model = ingest.ingest(spark, str(tmp_path), model, include=["paradigms"])
    assert model.paradigms.count() == 1 and model.words.count() == 3
    assert model.words.filter("anahash IS NULL").count() == 0
    assert rows_of(model.lexica, "lexicon_id", "lexicon_name") == [
        (1, "Open Taal modern Dutch word list"), (2, "e-Lex")]


def test_ranks_against_sorting(frame):
    random.seed(11)
    # Two thirds of the words share one frequency.
    rows = [(f"w{i:05d}", 1 if i % 3 else random.randint(2, 50)) for i in range(3000)]
    found = ranks.ranked(
        frame(rows, "wordform STRING, frequency LONG"),
        [F.desc("frequency"), F.col("wordform")], running={"total": "frequency"}, parts=7)
    expected, total = [], 0
    for i, (word, n) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        total += n
        expected.append((i, word, n, total))
    assert rows_of(found, "rank", "wordform", "frequency", "total") == expected


def test_zipf_and_divergence(frame):
    import numpy as np

    counts = np.array([50, 20, 20, 7, 2, 1])
    rows = frame([(f"w{i}", int(c)) for i, c in enumerate(counts)],
                 "wordform STRING, frequency LONG")
    p, r = counts / counts.sum(), np.arange(1, 7)
    model = 1 / (r + 0.5) ** 1.2 / (1 / r ** 1.2).sum()
    row = statistics.kl_divergence(rows, 0.5, 1.2).first()
    assert row["kl"] == pytest.approx(-(p * np.log2(model / p)).sum())
    assert statistics.entropy(rows).first()["entropy"] == pytest.approx(-(p * np.log2(p)).sum())
    found = [x["expected"] for x in statistics.zipf(rows, 0.5, 1.2).orderBy("rank").collect()]
    assert found == pytest.approx(list(model * counts.sum()))
    best = statistics.fit_zipf(rows, (0.0, 1.0), (1.0, 1.5, 2.0)).first()
    grid = {(x["q"], x["s"]): x["kl"]
            for x in statistics.kl_grid(rows, (0.0, 1.0), (1.0, 1.5, 2.0)).collect()}
    assert grid[(best["q"], best["s"])] == min(grid.values())


def test_range_and_confusion_neighbours_against_brute_force(frame, empty):
    from dataclasses import replace

    random.seed(2)
    table = [(f"w{i}", f"w{i}", random.randint(-500, 500)) for i in range(300)]
    table.append(("none", "none", None))
    model = replace(empty, words=frame(table, MODEL["words"]))
    hashed = [(w, h) for w, _, h in table if h is not None]
    asked = ["w1", "w2", "w3"]
    expected = sorted((a, b, h - g) for a, g in hashed if a in asked
                      for b, h in hashed if abs(h - g) <= 37)
    assert rows_of(anagrams.range_neighbours(model, asked, 37)) == expected
    steps = [3, -8, 20]
    confusions = frame([(s,) for s in steps + [3]], "confusion LONG")
    expected = sorted((g, s, b) for g in {h for _, h in hashed} for s in steps
                      for b, h in hashed if h == g + s)
    assert rows_of(anagrams.confusion_neighbours(model, confusions)) == expected


def test_anagram_variants(frame, empty):
    from dataclasses import replace

    table = [("ab", "ab", 1), ("ba", "ba", 1), ("c", "c", 2), ("cb", "cb", 1)]
    model = replace(empty, words=frame(table, MODEL["words"]))
    variants = anagrams.anagram_variants(model)
    assert rows_of(variants) == [(1, 0, "ab"), (1, 1, "ba"), (1, 2, "cb"), (2, 0, "c")]
    assert rows_of(anagrams.words_per_variant_rank(variants)) == [(0, 2), (1, 1), (2, 1)]


def test_shared_folder_is_the_clusters(spark, tmp_path):
    from wordloom import scratch

    assert scratch.shared_root(spark).endswith(spark.sparkContext.applicationId)


def test_long_lists_are_refused(golden):
    from wordloom.operators.lookup import for_words

    with pytest.raises(ValueError):
        for_words(golden.words, ["x"] * 1001)


def _divergence(counts, s):
    counts = sorted(counts, reverse=True)
    z, total = sum((r + 1) ** -s for r in range(len(counts))), sum(counts)
    return sum(c / total * math.log2(c / total * (r + 1) ** s * z)
               for r, c in enumerate(counts) if c)


def test_best_zipf_against_a_fine_grid(frame):
    """The optimum of plain sums, on steep, flat and gapped counts with ranks beyond own bins."""
    for counts in (
            [int(1e6 / (r + 1) ** 1.1) for r in range(3000)],
            [int(1e5 / (r + 3) ** 0.6) for r in range(900)] + [0] * 50,
            [1000, 30, 2, 1, 1], [10 ** 6] + [1] * 400):
        rows = frame([(f"w{i}", c) for i, c in enumerate(counts)], "wordform string, frequency long")
        [(q, s, kl)] = map(tuple, statistics.best_zipf(rows).collect())
        low, high = 0.0, 30.0
        for _ in range(6):
            grid = [low + (high - low) * i / 40 for i in range(41)]
            at = min(range(41), key=lambda i: _divergence(counts, grid[i]))
            low, high = grid[max(at - 1, 0)], grid[min(at + 1, 40)]
        assert q == 0 and abs(s - grid[at]) < 1e-6
        assert abs(kl - _divergence(counts, s)) < 1e-8
        assert statistics.rank_histogram(rows).count() < 250


def test_best_zipf_of_extremes(frame):
    def best(counts):
        rows = frame([(f"w{i}", c) for i, c in enumerate(counts)], "wordform string, frequency long")
        return [tuple(r) for r in statistics.best_zipf(rows).collect()]

    assert best([]) == [] and best([0, 0]) == []
    assert best([5]) == [(0.0, 0.0, 0.0)]
    assert best([5, 5, 5])[0][:2] == (0.0, 0.0)
    assert best([5, 0])[0][1] == 60.0
