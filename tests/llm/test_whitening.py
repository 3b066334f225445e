"""Whitening against numpy's symmetric eigenvalues and exact integers."""

from __future__ import annotations

import math

import numpy as np
import pytest

from wordloom.llm import whitening

ROWS = "vec_id long, embedding array<float>"


@pytest.mark.parametrize("size, rank", [(1, 1), (7, 7), (24, 24), (20, 5)])
def test_factor_and_rotations(size, rank):
    pick = np.random.default_rng(size)
    base = pick.normal(size=(size, rank)) * 10.0 ** pick.uniform(-3, 2, size=rank)
    a = base @ base.T
    factor = whitening.pivoted_cholesky(a)
    assert factor.shape[1] == rank or np.allclose(factor[:, rank:], 0, atol=1e-6)
    assert np.allclose(factor @ factor.T, a, rtol=1e-12, atol=1e-12 * np.abs(a).max())
    values, vectors = whitening.one_sided_jacobi(factor[:, :rank])
    expected = np.linalg.svd(base, compute_uv=False) ** 2
    assert np.allclose(values, expected, rtol=1e-7)
    assert np.allclose(vectors.T @ vectors, np.eye(rank), atol=1e-12)
    assert np.allclose(a @ vectors, vectors * values, atol=1e-11 * values[0])


def brute_force(rows, components=16):
    """{(id, component): (n, deviation, |whitened|, explained)} of vectors of one length."""
    x = {i: [math.floor(64 * c) + 1_000_000 for c in v] for i, v in rows}
    fit = np.array(sorted(set(map(tuple, x.values()))))
    n, sums = len(fit), fit.sum(axis=0)
    centred = fit - sums / n
    values, vectors = np.linalg.eigh(centred.T @ centred / n)
    falling = np.argsort(-values)[:components]
    found = {}
    for i, v in x.items():
        deviation = sum((n * a - int(s)) ** 2 for a, s in zip(v, sums))
        for k, at in enumerate(falling, 1):
            y = (np.array(v) - sums / n) @ vectors[:, at] / np.sqrt(values[at])
            found[i, k] = (n, deviation, abs(y), values[at] / values.sum())
    return found


def test_whitening_against_brute_force(spark):
    pick = np.random.default_rng(5)
    base = pick.normal(size=(300, 20)) @ np.diag(np.linspace(0.2, 3, 20)) @ pick.normal(size=(20, 20))
    vectors = [list(map(float, v.astype(np.float32))) for v in base]
    rows = list(enumerate(vectors)) + [(1000, vectors[3])]
    odd = [(500, None), (501, []), (502, [None] * 20), (503, [float("nan")] * 20),
           (504, [float("inf")] * 20), (505, [1e30] * 20), (506, [1.0])]
    docs = spark.createDataFrame(rows + odd, ROWS).selectExpr(
        "*", "1 as x", "2 as id", "3 as n", "4 as component")
    expected = brute_force(rows)
    got = whitening.whitened(docs).collect()
    assert len(got) == len(expected) and len({r["identity_error"] for r in got}) == 1
    for r in got:
        n, deviation, size, explained = expected[r["vec_id"], r["component"]]
        assert (r["n"], r["deviation"]) == (n, deviation)
        assert math.isclose(abs(r["whitened"]), size, rel_tol=1e-9, abs_tol=1e-9)
        assert math.isclose(r["explained"], explained, rel_tol=1e-9)
        assert r["identity_error"] < 1e-10


def test_small_and_repeated_tables(spark):
    empty = spark.createDataFrame([], ROWS)
    assert whitening.whitened(empty).collect() == []
    one = spark.createDataFrame([(1, [0.5, 2.0]), (2, [0.5, 2.0]), (None, None)], ROWS)
    assert whitening.whitened(one).collect() == []
    # Two distinct vectors, one dimension that varies, repeated and null ids; two lengths.
    rows = [(1, [0.0, 1.0]), (1, [0.0, 1.0]), (None, [1.0, 1.0]), (7, [3.0]), (8, [4.0])]
    got = whitening.whitened(spark.createDataFrame(rows, ROWS)).collect()
    seen = sorted((r["vec_id"] or -1, r["component"], r["n"], r["deviation"],
                   round(abs(r["whitened"]), 9), round(r["explained"], 9)) for r in got)
    assert seen == [
        (-1, 1, 2, 64**2, 1.0, 1.0), (1, 1, 2, 64**2, 1.0, 1.0), (1, 1, 2, 64**2, 1.0, 1.0),
        (7, 1, 2, 64**2, 1.0, 1.0), (8, 1, 2, 64**2, 1.0, 1.0)]


def test_deviations_of_any_size():
    big = whitening.Whitening(3, [2**41, -5], None, None, None)
    x = np.array([[2**40, 7], [0, 0]], np.int64)
    exact = [sum((3 * int(v) - s) ** 2 for v, s in zip(row, big.sums)) for row in x]
    assert big.deviations(x) == [v if v < 2**63 else None for v in exact]
    small = whitening.Whitening(3, [10, -5], None, None, None)
    x = np.array([[4, 7], [0, 0]], np.int64)
    assert small.deviations(x) == [(12 - 10) ** 2 + (21 + 5) ** 2, 125]
