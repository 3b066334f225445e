"""Confusion search through a Bloom filter: whole results, and few rows that leave the generator."""

import random

from pyspark.sql import functions as F

from tests.conftest import rows_of
from tests.test_skew import model_of
from wordloom.operators import anagram_queries as a
from wordloom.operators.bloom import Bloom


def test_a_filter_loses_nothing_and_lets_little_pass(spark, monkeypatch):
    pick = random.Random(3)
    known = [pick.randrange(-2**62, 2**62) for _ in range(5000)] + [0, -1, 2**63 - 1, -2**63]
    rows = spark.createDataFrame([(v,) for v in known] + [(None,), (known[0],)], "v long")
    bloom = Bloom(rows, "v")
    assert rows.filter("v is not null").filter(bloom.may_have(F.col("v"))).count() == len(known) + 1
    others = spark.range(20_000).select((F.col("id") * 1_000_003 + 17).alias("v"))
    assert others.filter(bloom.may_have(F.col("v"))).count() < 20_000 * 0.02
    # A filter that is far too small lets all pass, and still loses nothing.
    monkeypatch.setattr("wordloom.operators.bloom.MOST", 10)
    small = Bloom(rows, "v")
    assert rows.filter(small.may_have(F.col("v"))).count() == len(known) + 1
    empty = Bloom(rows.limit(0), "v")
    assert rows.filter(empty.may_have(F.col("v"))).count() == 0


def test_long_lists_of_confusions(spark, monkeypatch):
    monkeypatch.setattr(a, "DEALT", 100)
    pick = random.Random(5)
    hashes = sorted({pick.randrange(10**9) for _ in range(1000)})
    words = [(f"w{n}-{i}", h) for n, h in enumerate(hashes) for i in range(1 + n % 2)]
    model = model_of(spark, words)
    steps = sorted({pick.randrange(-10**9, 10**9) for _ in range(900)} | {
        hashes[i + 7] - hashes[i] for i in range(0, 900, 50)})
    confusions = spark.createDataFrame([(s,) for s in steps] * 2 + [(None,)], "confusion long")
    by_hash = {}
    for w, h in words:
        by_hash.setdefault(h, []).append(w)
    expected = sorted(
        (h, s, w) for h in by_hash for s in steps for w in by_hash.get(h + s, []))
    assert len(expected) > 18
    assert rows_of(a.confusion_neighbours(model, confusions)) == expected
    moved = a.shifts_to_known(model.words.select("anahash").distinct(), model.words, confusions)
    hits = len({(h, s) for h, s, _ in expected})
    assert hits <= moved.count() < hits + 0.02 * len(hashes) * len(steps)
    plan = a.confusion_neighbours(model, confusions)._jdf.queryExecution().executedPlan().toString()
    generated = plan.index("Generate explode(confusion_list")
    assert "getbit" in plan[:generated] and "Nested" not in plan and "Cartesian" not in plan
