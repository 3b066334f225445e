"""Nearest neighbours by inner product with collision-counting hashing.

Vectors are dealt into blocks by classes of length, `STEP` times from one to the next, and within a
class by a hash.  In a block they get one more component so that all have the length of its longest,
and queries are scaled to it; then the largest inner product is the smallest distance.  A block's
index has, for each of `PROJECTIONS` random directions, its vectors sorted by their projection.
A query opens a window around its own projection in every array, whose ends are found by bisection.
A vector's collisions are the windows that it is in; only the entries of the shorter side, inside or
outside of a window, are fetched and counted.  A vector with `COLLIDE` of all possible collisions is a
candidate and verified with the original vectors in double precision.  Windows widen (virtual rehashing:
the arrays stay as they are) until they are `SURE` times as wide as the distance of the last of the
`wanted` best candidates: a vector as near as that is then a candidate in 95 of 100 cases, a nearer one
more often.  A query starts near the width that the one before it ended with.

Every query meets every block, in groups of one block and at most about `QUERIES` queries,
so a task holds some ten megabytes; of each such group only the best `wanted` go on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.scratch import stored

PROJECTIONS, SEED = 96, 42
#: Vector entries of a block, and queries of a group.
BLOCK, QUERIES = 1 << 20, 2048
#: Width of the first windows, in lengths of a block's longest vector, and how they grow.
FIRST, WIDER = 2.5, 1.1
#: A projection's normal deviate is within SURE / 2 in 84 % of the directions.
COLLIDE, SURE, STEP = 0.79, 2.8, 1.25


def directions(size: int, count: int = PROJECTIONS) -> np.ndarray:
    return np.random.default_rng(SEED + size).standard_normal((count, size))


def valid_vectors(table: DataFrame, id_col: str, vector_col: str) -> DataFrame:
    """`(id, vector, size, class)`: vectors with an id whose components are all finite, not all
    zero; vectors of a class differ in length by a factor of `STEP` at most."""
    rows = table.select(
        F.col(id_col).alias("id"), F.col(vector_col).cast("array<double>").alias("vector"))
    return rows.filter(
        F.col("id").isNotNull()
        & F.forall("vector", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
        & F.exists("vector", lambda x: x != 0)
    ).withColumn("most", F.array_max(F.transform("vector", F.abs))).select(
        "id", "vector", F.size("vector").alias("size"),
        # Scaled by the largest component, no square is infinite and the largest is one.
        F.round(
            (2 * F.log("most") + F.log(F.aggregate(
                F.zip_with("vector", F.array_repeat("most", F.size("vector")), lambda x, m: x / m),
                F.lit(0.0), lambda a, x: a + x * x)))
            / F.lit(2 * np.log(STEP).item())).cast("long").alias("class"))


def _matrix(column: pa.ChunkedArray, size: int) -> np.ndarray:
    return np.asarray(column.combine_chunks().flatten(), np.float64).reshape(-1, size)


def _rank_type(n: int) -> type:
    return np.uint16 if n < 1 << 16 else np.uint32


def index_block(ids: np.ndarray, vectors: np.ndarray, longest: float) -> dict[str, bytes]:
    """The sorted projections of a block and each vector's rank in them."""
    rest = np.sqrt(np.maximum(0, longest**2 - (vectors**2).sum(axis=1)))
    whole = np.hstack([vectors, rest[:, None]])
    projected = (directions(whole.shape[1]) @ whole.T).astype(np.float32)
    order = np.argsort(projected, axis=1, kind="stable")
    return {
        "ids": ids.astype(np.int64).tobytes(), "vectors": vectors.tobytes(),
        "sorted": np.take_along_axis(projected, order, 1).tobytes(),
        "order": order.astype(_rank_type(len(ids))).tobytes(),
    }


def collisions(order: np.ndarray, low: list[int], high: list[int]) -> np.ndarray:
    """How many of the windows `order[p, low[p]:high[p]]` each vector is in."""
    size = order.shape[1]
    fetched, left_out, most = [], [], 0
    for row, a, b in zip(order, low, high):
        if b - a <= size // 2:
            fetched.append(row[a:b])
        else:
            left_out += [row[:a], row[b:]]
            most += 1
    hits = np.full(size, most)
    if fetched:
        hits += np.bincount(np.concatenate(fetched), minlength=size)
    if left_out:
        hits -= np.bincount(np.concatenate(left_out), minlength=size)
    return hits


def one_array(arrays: np.ndarray, longest: float) -> tuple[np.ndarray, np.ndarray]:
    """The sorted arrays one behind the other, each moved past the one before, and by how much."""
    moved = np.arange(len(arrays)) * (4 * float(np.abs(arrays).max(initial=longest)))
    return (arrays + moved[:, None]).ravel(), moved


def _ends(flat: np.ndarray, moved: np.ndarray, at: np.ndarray, side: str) -> np.ndarray:
    """Where in each array the values `at` are, all found at once."""
    size, far = len(flat) // len(moved), moved[1] / 2 if len(moved) > 1 else np.inf
    found = np.searchsorted(flat, moved + np.clip(at, -far, far), side)
    return np.clip(found - np.arange(len(moved)) * size, 0, size)


def search_block(
    query: np.ndarray, vectors: np.ndarray, arrays: tuple[np.ndarray, np.ndarray], order: np.ndarray,
    longest: float, wanted: int, directed: np.ndarray, start: float = FIRST,
    quota: int | None = None,
) -> tuple[np.ndarray, np.ndarray, float]:
    """(positions, scores) of the candidates of one query in a block, which may have the query
    itself, and the width of the last windows in lengths of the longest vector.

    `quota` of the `wanted` are expected in this block at most; the others' distance bounds no window.
    """
    quota = min(wanted, quota or wanted)
    length = np.sqrt(query @ query)
    if len(vectors) <= wanted or not 0 < longest < np.inf or not 0 < length < np.inf:
        return np.arange(len(vectors)), np.einsum("ij,j->i", vectors, query), start
    at = directed @ (query * (longest / length))
    need, width = int(np.ceil(COLLIDE * len(order))), start * longest
    scores = np.full(len(vectors), -np.inf)
    verified = np.zeros(len(vectors), bool)
    low = high = hits = None
    while True:
        begun = _ends(*arrays, at - width / 2, "left").tolist()
        ended = _ends(*arrays, at + width / 2, "right").tolist()
        if hits is None:
            hits = collisions(order, begun, ended)
        else:
            # Only what the wider windows add is fetched.
            hits += np.bincount(np.concatenate([
                part for p in range(len(order))
                for part in (order[p, begun[p]:low[p]], order[p, high[p]:ended[p]])]),
                minlength=len(hits))
        low, high = begun, ended
        new = np.flatnonzero((hits >= need) & ~verified)
        verified[new] = True
        scores[new] = np.einsum("ij,j->i", vectors[new], query)
        found = np.flatnonzero(verified)
        sure = np.inf
        if len(found) > quota:
            worst = np.partition(scores[found], -quota - 1)[-quota - 1]
            sure = SURE * np.sqrt(max(0.0, 2 * longest * (longest - worst / length)))
        if width >= sure or len(found) == len(vectors):
            return found, scores[found], min(width, sure) / longest
        # More candidates only bring the last one nearer, so these windows are the last.
        width = sure if sure < np.inf else width * WIDER


def quota_of(wanted: int, share: float) -> int:
    """How many of the `wanted` a block with this share of all vectors has, but for one in a
    thousand such blocks: vectors are dealt by a hash."""
    mean = wanted * share
    return int(np.ceil(mean + 3.1 * np.sqrt(mean * (1 - share)) + 1))


def nearest(
    table: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", wanted: int = 20,
    every: int = 20,
) -> DataFrame:
    """`(query_id, rank, vec_id, score)`: the `wanted` nearest found of each query.

    Queries are the rows whose id is divisible by `every`, candidates all rows with another
    id.  Ranks start at 1, ties go to the smaller id; a table with fewer candidates gives all
    of them.  Vectors that are null, empty, zero or hold null or non-finite components, and
    null ids, take no part; vectors of different lengths never meet.  Rows that repeat an id
    and a vector count once.  An empty table gives no rows; other columns are not looked at.
    """
    valid = stored(valid_vectors(table, id_col, vector_col), "vectors")
    totals = stored(
        valid.groupBy("size", "class").agg(
            F.ceil(F.count("*") * F.col("size") / BLOCK).alias("blocks")),
        "classes")
    asked = stored(
        valid.groupBy("size").agg(F.greatest(F.lit(1), F.ceil(
            F.count_if(F.col("id") % every == 0) / QUERIES)).alias("groups")), "groups")
    dealt = valid.join(totals, ["size", "class"]).join(asked, "size").withColumn(
        "block", F.pmod(F.xxhash64("id", "vector"), F.col("blocks")))

    def build(rows: pa.Table) -> pa.Table:
        size = rows.column("size")[0].as_py()
        ids, vectors = rows.column("id").to_numpy(), _matrix(rows.column("vector"), size)
        order = np.lexsort((*vectors.T, ids))
        ids, vectors = ids[order], vectors[order]
        again = (ids[1:] == ids[:-1]) & (vectors[1:] == vectors[:-1]).all(axis=1)
        once = np.append(True, ~again)
        vectors = vectors[once]
        longest = float(np.sqrt((vectors**2).sum(axis=1).max()))
        made = index_block(ids[once], vectors, longest)
        return pa.table({
            "size": pa.array([size], pa.int32()),
            "class": rows.column("class").slice(0, 1),
            "block": rows.column("block").slice(0, 1),
            "longest": pa.array([longest]),
            "groups": rows.column("groups").slice(0, 1),
            "blocks": rows.column("blocks").slice(0, 1),
            **{name: pa.array([value], pa.binary()) for name, value in made.items()},
        })

    index = stored(
        dealt.groupBy("size", "class", "block").applyInArrow(
            build, "size int, class long, block long, longest double, groups long, "
                   "blocks long, ids binary, "
                   "vectors binary, sorted binary, order binary"), "ann-index")
    blocks = index.withColumn("group", F.explode(F.sequence(F.lit(0), F.col("groups") - 1)))
    queries = (
        valid.filter(F.col("id") % every == 0).drop("class").join(asked, "size")
        .join(totals, "size").select(
            "size", "id", "vector", "class",
            F.pmod(F.xxhash64("id"), F.col("groups")).alias("group"),
            F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("block"))
    )

    def search(asked: pa.Table, block: pa.Table) -> pa.Table:
        empty = np.array([], np.int64)
        answer = [(empty, empty, np.array([], np.float64))]
        if asked.num_rows and block.num_rows:
            size, longest = asked.column("size")[0].as_py(), block.column("longest")[0].as_py()
            ids = np.frombuffer(block.column("ids")[0].as_py(), np.int64)
            vectors = np.frombuffer(block.column("vectors")[0].as_py()).reshape(-1, size)
            arrays = np.frombuffer(
                block.column("sorted")[0].as_py(), np.float32).reshape(-1, len(ids))
            order = np.frombuffer(
                block.column("order")[0].as_py(), _rank_type(len(ids))).reshape(-1, len(ids))
            directed = directions(size + 1)[:, :size]
            arrays = one_array(arrays.astype(np.float64), longest)
            width = FIRST
            quota = quota_of(wanted, 1 / block.column("blocks")[0].as_py())
            for own, query in zip(
                    asked.column("id").to_numpy(), _matrix(asked.column("vector"), size)):
                found, score, width = search_block(
                    query, vectors, arrays, order, longest, wanted, directed,
                    1.02 * width, quota)
                others = ids[found] != own
                found, score = found[others], score[others]
                best = np.lexsort((ids[found], -score))[:wanted]
                answer.append((
                    np.full(len(best), own), ids[found[best]], score[best]))
        columns = [np.concatenate(c) for c in zip(*answer)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), map(pa.array, columns))))

    found = queries.groupBy("size", "class", "block", "group").cogroup(
        blocks.groupBy("size", "class", "block", "group")).applyInArrow(
        search, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return (
        found.distinct().withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= wanted).select("query_id", "rank", "vec_id", "score")
    )
