"""The language network: exact gradients, labels by a plain reading, accuracy on held-out texts."""

from __future__ import annotations

import random
import zlib

import numpy as np
import pytest

from tests.llm.fixtures import DOCS, documents, frames, rows_of
from wordloom.llm import language

LETTERS = {"xx": "aeiost", "yy": "bkmruw", "zz": "çeñortuß"}


def prose(pick, lang, words):
    return " ".join(
        "".join(pick.choice(LETTERS[lang]) for _ in range(pick.randint(2, 7)))
        for _ in range(words))


def texts(count=160):
    pick = random.Random(11)
    return [(n, prose(pick, lang, pick.choice([1, 5, 60, 400])), lang, "s", 0)
            for n in range(count) for lang in [list(LETTERS)[n % 3]]]


@pytest.mark.parametrize("hidden", [3, 5])
def test_gradients_equal_differences(hidden):
    network = language.Network.first(["a", "b"], hidden)
    pick = np.random.default_rng(1)
    codes, labels = pick.integers(0, 9, (6, 4)), np.array([0, 1, 1, 0])
    _, slopes = network.learn_from(codes, labels)
    for array, slope in zip(network.arrays(), slopes):
        for _ in range(12):
            at = tuple(pick.integers(0, n) for n in array.shape)
            if array.shape[-1] == 256:
                at = (at[0], int(pick.integers(0, 9)))
            kept, losses = array[at], []
            for step in (1e-6, -1e-6):
                array[at] = kept + step
                losses.append(network.learn_from(codes, labels)[0])
            array[at] = kept
            assert abs((losses[0] - losses[1]) / 2e-6 - slope[at]) < 1e-5


def read(reader, codes):
    """States of one direction, unit by unit."""
    h = len(reader.bias)
    state, out = np.zeros(h), []
    for code in codes:
        fed, inner = reader.table[:, code], reader.inner @ state
        update, reset = np.clip(fed[:2 * h] + inner[:2 * h], 0, 1).reshape(2, h)
        raw = fed[2 * h:] + reset * (inner[2 * h:] + reader.bias[:, 0])
        state = update * state + (1 - update) * raw / (1 + abs(raw))
        out.append(reader.out @ state)
    return out


def label_sums(network, body):
    """By brute force: the summed log probabilities of all bytes' labels."""
    total = np.zeros(len(network.languages))
    for start in range(0, len(body), language.WINDOW):
        codes = list(body[start:start + language.WINDOW])
        for there, back in zip(read(network.forwards, codes),
                               read(network.backwards, codes[::-1])[::-1]):
            logits = there + back + network.bias[:, 0]
            total += logits - np.log(np.exp(logits).sum())
    return total


def test_labels_against_brute_force(monkeypatch):
    network = language.Network.first(["a", "b", "c"])
    pick = random.Random(2)
    bodies = [b"", b"x", b"y" * 64, b"z" * 65, prose(pick, "zz", 90).encode(),
              bytes(pick.randrange(256) for _ in range(1000))]
    expected = np.array([label_sums(network, b) for b in bodies])
    assert np.allclose(language._pooled(network, bodies), expected, rtol=1e-4, atol=1e-3)
    monkeypatch.setattr(language, "LANES", 4)
    assert np.allclose(language._pooled(network, bodies), expected, rtol=1e-4, atol=1e-3)


def test_held_out_texts_are_told_apart(spark):
    rows = texts()
    odd = [(900, None, "xx", None, None), (901, "", "yy", None, None), (902, "12 34 -", "xx", None, None),
           (None, "aeio", "xx", None, None), (903, "bkmruw bkm", None, None, None)]
    docs = spark.createDataFrame(rows + odd, DOCS)
    got = {r["doc_id"]: r for r in language.predicted(docs).collect()}
    assert len(got) == len(rows) + len(odd)
    for i, r in got.items():
        assert r["held_out"] == (i is not None and zlib.crc32(str(i).encode()) % 4 == 2)
        assert 0 <= r["score"] <= 1
    held = [row for row in rows if got[row[0]]["held_out"]]
    assert len(held) > 20
    right = [got[i]["lang_pred"] == lang for i, _, lang, _, _ in held]
    assert sum(right) >= 0.95 * len(right)
    assert {got[i]["lang_pred"] for i in (900, 901, 902)} == {"und"}
    assert got[903]["lang_pred"] == "yy" and got[None]["lang_pred"] == "xx"


def test_lang_source_and_id_are_no_inputs(spark):
    rows = texts(60)
    docs = spark.createDataFrame(rows, DOCS)
    network = language.learned(docs, steps=5)
    again = language.learned(docs.repartition(7), steps=5)
    assert all((a == b).all() for a, b in zip(network.arrays(), again.arrays()))
    # Held-out labels change nothing.
    held = {n for n, *_ in rows if zlib.crc32(str(n).encode()) % 4 == 2}
    other = [(n, t, "xx" if n in held else lang, "q", 1) for n, t, lang, _, _ in rows]
    kept = language.learned(spark.createDataFrame(other, DOCS), steps=5)
    assert all((a == b).all() for a, b in zip(network.arrays(), kept.arrays()))


def test_odd_tables(spark):
    docs, odd = frames(spark)
    odd = odd.selectExpr("*", "1 as body", "2 as lang_pred", "3 as window").drop("body")
    plain = rows_of(language.predicted(docs, steps=5))
    assert plain == rows_of(language.predicted(odd, steps=5))
    assert len(plain) == len(documents())
    assert language.predicted(docs.limit(0), steps=5).collect() == []
    nameless = docs.selectExpr("doc_id", "text", "cast(null as string) lang")
    assert {r["lang_pred"] for r in language.predicted(nameless).collect()} == {"und"}
