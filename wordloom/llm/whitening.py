"""Whitening of embeddings by a pivoted Cholesky factor and one-sided Jacobi rotations.

Entries become whole numbers on a grid, and each distinct vector counts once.  Spark finds the distinct
vectors, their exact sums and the centred scatter matrix in mergeable steps; what reaches the driver is
one sum a dimension and a matrix of dimension x dimension, whatever the number of rows.  The scatter A
is factored with pivoting as L L', and columns of L are rotated in pairs until they are orthogonal:
then their squared norms are the eigenvalues of A and the normalised columns its eigenvectors, without
ever squaring the condition of L.  Disjoint pairs are rotated together, in the order of a round robin.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.scratch import stored

GRID, OFFSET, COMPONENTS = 64, 1_000_000, 16
#: Entries of larger magnitude have no whole number that sums are sure to hold.
LARGEST = 2.0**40
SWEEPS = 60


def pivoted_cholesky(a: np.ndarray) -> np.ndarray:
    """`L`, of as many columns as the rank of the symmetric positive `a`: `a = L L'`.

    The largest remaining diagonal entry is the pivot; rows keep their places.
    """
    n = len(a)
    left = np.diag(a).astype(np.float64).copy()
    floor = n * np.finfo(np.float64).eps * max(left.max(initial=0.0), 0.0)
    factor = np.zeros((n, n))
    for k in range(n):
        pivot = int(np.argmax(left))
        if left[pivot] <= floor:
            return factor[:, :k]
        column = a[:, pivot] - factor[:, :k] @ factor[pivot, :k]
        done = left == -np.inf
        column[done] = 0
        factor[:, k] = column / np.sqrt(left[pivot])
        factor[pivot, k] = np.sqrt(left[pivot])
        left -= factor[:, k] ** 2
        left[done] = -np.inf
        left[pivot] = -np.inf
    return factor


def _rounds(n: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Every pair of n columns once, as rounds of disjoint pairs."""
    seats = list(range(n + n % 2))
    for _ in range(len(seats) - 1):
        half = len(seats) // 2
        pairs = [
            (min(a, b), max(a, b)) for a, b in zip(seats[:half], seats[:half - 1:-1])
            if max(a, b) < n]
        yield np.array([a for a, _ in pairs], int), np.array([b for _, b in pairs], int)
        seats = [seats[0], seats[-1], *seats[1:-1]]


def one_sided_jacobi(factor: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(squared norms, unit columns) of `factor` rotated until its columns are orthogonal, the
    longest column first."""
    u = np.array(factor, np.float64, order="F")
    n = u.shape[1]
    order = list(_rounds(n)) if n > 1 else []
    for _ in range(SWEEPS):
        worst = 0.0
        for a, b in order:
            x, y = u[:, a], u[:, b]
            alpha, beta = (x * x).sum(axis=0), (y * y).sum(axis=0)
            gamma = (x * y).sum(axis=0)
            size = np.sqrt(alpha * beta)
            slant = np.divide(np.abs(gamma), size, out=np.zeros_like(gamma), where=size > 0)
            worst = max(worst, slant.max(initial=0.0))
            turn = slant > 1e-16
            zeta = np.divide(beta - alpha, 2 * gamma, out=np.zeros_like(gamma), where=turn)
            sign = np.where(zeta < 0, -1.0, 1.0)
            tangent = np.where(turn, sign / (np.abs(zeta) + np.hypot(1.0, zeta)), 0.0)
            c = 1 / np.sqrt(1 + tangent * tangent)
            s = c * tangent
            u[:, a], u[:, b] = c * x - s * y, s * x + c * y
        if worst <= n * np.finfo(np.float64).eps:
            break
    values = (u * u).sum(axis=0)
    falling = np.argsort(-values, kind="stable")
    values, u = values[falling], u[:, falling]
    u = u / np.sqrt(values)
    lead = np.argmax(np.abs(u), axis=0)
    return values, u * np.where(u[lead, np.arange(n)] < 0, -1.0, 1.0)


@dataclass(frozen=True)
class Whitening:
    """What maps vectors of one length: the sums are of entries less `OFFSET`, and exact."""

    n: int
    sums: list[int]
    values: np.ndarray
    components: np.ndarray
    explained: np.ndarray
    identity_error: float = 0.0

    def split(self) -> tuple[np.ndarray, np.ndarray]:
        """The mean as whole numbers and what is left of it, times n."""
        parts = [divmod(s, self.n) for s in self.sums]
        return (np.array([q for q, _ in parts], np.int64),
                np.array([r for _, r in parts], np.int64))

    def centred(self, x: np.ndarray) -> np.ndarray:
        whole, rest = self.split()
        return (x - whole).astype(np.float64) - rest / self.n

    def whitened(self, x: np.ndarray) -> np.ndarray:
        return self.centred(x) @ (self.components / np.sqrt(self.values))

    def deviations(self, x: np.ndarray) -> list[int | None]:
        """Sum over dimensions of (n x - S) ** 2, exact; None beyond a long."""
        whole, rest = self.split()
        off = x - whole
        most = self.n * (int(np.abs(off).max(initial=0)) + 1)
        if most * most * max(1, x.shape[1]) < 2**63:
            return ((self.n * off - rest) ** 2).sum(axis=1).tolist()
        rows = (sum((self.n * v - r) ** 2 for v, r in zip(row, rest.tolist()))
                for row in off.tolist())
        return [v if v < 2**63 else None for v in rows]


def on_grid(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`(id, x)`, x less `OFFSET`: rows with a vector whose entries are all finite numbers."""
    rows = table.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    # NaN is larger than any number, so it is left out too.
    return rows.filter(
        (F.size("vector") > 0)
        & F.forall("vector", lambda v: F.coalesce(F.abs(v) <= F.lit(LARGEST), F.lit(False)))
    ).select("id", F.transform("vector", lambda v: F.floor(v * GRID)).alias("x"))


def _by_size(batch: pa.RecordBatch, column: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(places, matrix) of the vectors of each length."""
    lists = batch.column(column)
    sizes = np.diff(np.asarray(lists.offsets))
    flat = lists.flatten().to_numpy(zero_copy_only=False)
    starts = np.concatenate([[0], np.cumsum(sizes)])
    for size in np.unique(sizes):
        at = np.flatnonzero(sizes == size)
        yield at, flat[starts[at][:, None] + np.arange(size)]


def _summed(fit: DataFrame) -> dict[int, tuple[int, list[int]]]:
    """{length: (distinct vectors, sums)}."""
    def run(batches):
        for batch in batches:
            for at, x in _by_size(batch, 0):
                size = x.shape[1]
                values = np.concatenate([x.sum(axis=0), [len(at)]])
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.full(size + 1, size, np.int32)),
                     pa.array(np.arange(size + 1, dtype=np.int32)), pa.array(values)],
                    names=["size", "at", "value"])

    rows = fit.mapInArrow(run, "size int, at int, value long").groupBy("size", "at").agg(
        F.sum(F.col("value").cast("decimal(38,0)")).alias("value")).collect()
    found: dict[int, list[int]] = {}
    for row in sorted(rows):
        found.setdefault(row["size"], []).append(int(row["value"]))
    return {size: (values[-1], values[:-1]) for size, values in found.items()}


def _products(fit: DataFrame, of) -> dict[int, np.ndarray]:
    """{length: sum of the outer products of `of(length, x)`}, merged across tasks."""
    def run(batches):
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for _, x in _by_size(batch, 0):
                y = of(x.shape[1], x)
                totals[x.shape[1]] = totals.get(x.shape[1], 0) + y.T @ y
        for size, total in totals.items():
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.full(total.size, size, np.int32)),
                 pa.array(np.arange(total.size, dtype=np.int32)), pa.array(total.ravel())],
                names=["size", "at", "value"])

    rows = fit.mapInArrow(run, "size int, at int, value double").groupBy("size", "at").agg(
        F.sum("value").alias("value")).toPandas().sort_values(["size", "at"])
    return {
        int(size): part["value"].to_numpy().reshape(int(np.sqrt(len(part))), -1)
        for size, part in rows.groupby("size")}


def fitted(fit: DataFrame, components: int = COMPONENTS) -> dict[int, Whitening]:
    """A whitening for each length of the distinct vectors `x` of `fit`."""
    context = fit.sparkSession.sparkContext
    empty = np.empty((0, 0))
    told = {
        size: Whitening(n, sums, empty, empty, empty)
        for size, (n, sums) in _summed(fit).items()}
    sent = context.broadcast(told)
    scatters = _products(fit, lambda size, x: sent.value[size].centred(x))
    for size, scatter in scatters.items():
        n = told[size].n
        values, vectors = one_sided_jacobi(pivoted_cholesky((scatter + scatter.T) / 2))
        values = values[:components] / n
        told[size] = Whitening(
            n, told[size].sums, values, vectors[:, :components],
            values / (np.trace(scatter) / n or 1.0))
    ready = context.broadcast(told)
    # Centred vectors sum to zero exactly, so their projections need no centring.
    checks = _products(fit, lambda size, x: ready.value[size].whitened(x))
    for size, product in checks.items():
        w = told[size]
        error = np.abs(product / w.n - np.eye(len(product))).max(initial=0.0)
        told[size] = Whitening(
            w.n, w.sums, w.values, w.components, w.explained, float(error))
    return told


def whitened(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding",
    components: int = COMPONENTS,
) -> DataFrame:
    """`(vec_id, component, n, deviation, whitened, explained, identity_error)`: a row for each
    vector and component.

    The fit takes each distinct vector of whole numbers floor(64 c) + 1,000,000 once; repeated
    rows are fitted once and returned each for itself, null ids included.  Vectors that are null,
    empty or hold null or non-finite entries, or one beyond 2**40, take no part.  Vectors of each length have a fit
    of their own.  Components without variance are left out, so a single vector gives no rows.
    A deviation beyond a long is null.  An empty table gives no rows; other columns are not looked at.
    """
    rows = on_grid(table, id_col, vector_col)
    fit = stored(rows.select("x").distinct(), "whitening-fit")
    sent = table.sparkSession.sparkContext.broadcast(fitted(fit, components))

    def run(batches):
        for batch in batches:
            for at, x in _by_size(batch, 1):
                model = sent.value[x.shape[1]]
                k = len(model.values)
                if not k:
                    continue
                yield pa.RecordBatch.from_arrays([
                    batch.column(0).take(pa.array(np.repeat(at, k))),
                    pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), len(at))),
                    pa.array(np.full(len(at) * k, model.n, np.int64)),
                    pa.array(model.deviations(x), pa.int64()).take(
                        pa.array(np.repeat(np.arange(len(at)), k))),
                    pa.array(model.whitened(x).ravel()),
                    pa.array(np.tile(model.explained, len(at))),
                    pa.array(np.full(len(at) * k, model.identity_error)),
                ], names=["id", "component", "n", "deviation", "whitened", "explained",
                          "identity_error"])

    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(
        run, f"id {kind}, component int, n long, deviation long, whitened double, "
             "explained double, identity_error double").withColumnRenamed("id", id_col)
