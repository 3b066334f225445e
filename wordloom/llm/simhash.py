"""Near duplicates by SimHash and the general pigeonhole principle.

Fingerprints of 64 bits link at `radius` or fewer differing bits.  The bits are grouped
into four blocks of 16 so that correlated bits share a block.  A fingerprint gives each
part (a block, or two) a threshold t, with the sum of t + 1 over the parts equal to radius + 1;
whatever is within the radius then agrees with it in some part to within that part's t.  The
thresholds are chosen per fingerprint by dynamic programming on the candidate counts
estimated from the blocks' histograms: a block value that many share gets -1, no probe.

What is gathered on the driver has a fixed size: a 64 x 64 matrix and 4 x 65,536 counts.
A bucket above `CELL` rows is dealt as pairs of chunks, so no task gets it whole; links
leave a task as a spanning forest, never as all pairs.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat
from math import comb

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import fresh
from wordloom.llm.components import connected_components
from wordloom.scratch import stored

BITS, BLOCK, SEED = 64, 16, 42
BLOCKS, VALUES = BITS // BLOCK, 1 << BLOCK
CELL = 2048
# Shingles hashed at a time: bounds the memory that a very long text takes.
RUN = 1 << 16


def fingerprint(body: bytes | None, words_in_shingle: int = 3) -> int:
    """SimHash of the word shingles of a text in UTF-8; A-Z count as a-z.

    A text with fewer words than a shingle is one shingle; a text without words gives zero.
    A bit is set if it is set in over half the shingles' hashes, repeats included.
    """
    words = (body or b"").lower().split()
    if not words:
        return 0
    k = min(words_in_shingle, len(words))
    total = len(words) - k + 1
    counts = np.zeros(BITS, np.int64)
    for start in range(0, total, RUN):
        part = words[start:start + RUN + k - 1]
        shingles = map(b" ".join, zip(*(part[i:] for i in range(k))))
        n = min(RUN, total - start)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, shingles, repeat(SEED)), "<u8", n)
        bits = np.unpackbits(hashes.view(np.uint8).reshape(n, 8), axis=1, bitorder="little")
        counts += np.add.reduce(bits, axis=0, dtype=np.uint32)
    return int(np.packbits(counts * 2 > total, bitorder="little").view("<u8")[0])


def fingerprints(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words_in_shingle: int = 3,
    key: Column | None = None,
) -> DataFrame:
    """`(doc_id, fp)`, and the string `key` if given; `fp` is the fingerprint as a signed long."""
    names = [id_col, "fp"] if key is None else [id_col, "fp", "key"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = np.fromiter(
                (fingerprint(body.as_py(), words_in_shingle) for body in batch.column(1)),
                np.uint64, batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array(found.view(np.int64)), *batch.columns[2:]],
                names=names)

    kind = docs.schema[id_col].dataType.simpleString()
    more = [] if key is None else [key.alias("key")]
    return docs.select(
        id_col, F.col(text_col).cast("binary").alias("body"), *more,
    ).mapInArrow(run, f"`{id_col}` {kind}, fp long{', key string' * len(more)}")


def _bits(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(
        np.ascontiguousarray(fps).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def _fps(batch: pa.RecordBatch) -> np.ndarray:
    return batch.column(0).to_numpy(zero_copy_only=False).astype(np.int64, copy=False)


def bit_groups(distinct: DataFrame) -> np.ndarray:
    """The 64 bits as four rows of 16, correlated bits together."""
    def run(batches):
        together = np.zeros((BITS, BITS))
        n = 0
        for batch in batches:
            bits = _bits(_fps(batch)).astype(np.float32)
            together += bits.T @ bits
            n += batch.num_rows
        if n:
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.arange(BITS * BITS + 1, dtype=np.int32)),
                 pa.array(np.append(together.ravel(), n).astype(np.int64))], names=["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(
        F.sum("n").alias("n")).toPandas().sort_values("at")
    if rows.empty:
        return np.arange(BITS).reshape(BLOCKS, BLOCK)
    counts = rows["n"].to_numpy(np.float64)
    n, together = counts[-1], counts[:-1].reshape(BITS, BITS) / counts[-1]
    p = np.diag(together)
    spread = np.sqrt(np.maximum(p * (1 - p), 1 / (4 * n)))
    alike = np.abs(together - np.outer(p, p)) / np.outer(spread, spread)
    np.fill_diagonal(alike, 0)
    left, groups = list(range(BITS)), []
    for _ in range(BLOCKS):
        group = [max(left, key=lambda b: alike[b, left].sum())]
        left.remove(group[0])
        while len(group) < BLOCK:
            group.append(max(left, key=lambda b: alike[b, group].sum()))
            left.remove(group[-1])
        groups.append(group)
    return np.array(groups)


def block_values(fps: np.ndarray, groups: np.ndarray) -> np.ndarray:
    """One row for each block: the 16 bits that each fingerprint has there."""
    bits = _bits(fps)
    weights = (1 << np.arange(BLOCK)).astype(np.int64)
    return np.stack([bits[:, group].astype(np.int64) @ weights for group in groups])


def histograms(distinct: DataFrame, groups: np.ndarray) -> np.ndarray:
    """How many fingerprints have each value in each block; four rows of 65,536."""
    def run(batches):
        counts = np.zeros((BLOCKS, VALUES), np.int64)
        for batch in batches:
            for block, values in enumerate(block_values(_fps(batch), groups)):
                counts[block] += np.bincount(values, minlength=VALUES)
        at = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [pa.array(at.astype(np.int32)), pa.array(counts.ravel()[at])], names=["at", "n"])

    rows = distinct.select("fp").mapInArrow(run, "at int, n long").groupBy("at").agg(
        F.sum("n").alias("n")).toPandas()
    counts = np.zeros(BLOCKS * VALUES, np.int64)
    counts[rows["at"].to_numpy()] = rows["n"].to_numpy()
    return counts.reshape(BLOCKS, VALUES)


def _shells(counts: np.ndarray, radius: int) -> np.ndarray:
    """For each value and r up to `radius`: how many fingerprints differ from it in r bits."""
    at = np.arange(VALUES)
    shells = np.zeros((radius + 1, VALUES))
    shells[0] = counts
    for bit in range(BLOCK):
        flipped = shells[:, at ^ (1 << bit)]
        shells[1:] += flipped[:-1]
    return shells


def choose_parts(counts: np.ndarray, radius: int = 3) -> list[tuple[int, ...]]:
    """Four parts of one block or two parts of two, whichever probes and verifies less.

    Few probes of 16 bits cost the pairs that share a block value, which grow with the square
    of the corpus; probes of 32 bits are many more (at radius 3, 66 against 4) but share more.
    """
    n = max(1.0, float(counts[0].sum()))
    squares = (counts.astype(np.float64) ** 2).sum(axis=1)
    four, two = [(0,), (1,), (2,), (3,)], [(0, 1), (2, 3)]

    def cost(parts: list[tuple[int, ...]]) -> float:
        each, more = divmod(radius + 1, len(parts))
        total = 0.0
        for number, part in enumerate(parts):
            keys = probes(BLOCK * len(part), each + (number < more))
            pairs = np.prod(squares[list(part)]) / n ** (len(part) - 1)
            total += keys * (n + pairs)
        return total

    return four if radius < 2 or cost(four) <= cost(two) else two


def probes(width: int, steps: int) -> int:
    """How many values differ from one of `width` bits in fewer than `steps` bits."""
    return sum(comb(width, r) for r in range(steps))


def _masks(width: int, flips: int) -> np.ndarray:
    """Every way to flip 1 to `flips` of `width` bits."""
    return np.array(
        [sum(1 << b for b in chosen)
         for r in range(1, flips + 1) for chosen in combinations(range(width), r)], np.int64)


def allocate(
    values: np.ndarray, shells: np.ndarray, parts: list[tuple[int, ...]], radius: int, n: float,
) -> np.ndarray:
    """For each fingerprint, threshold + 1 of each part; a column adds up to radius + 1.

    Dynamic programming over the parts on the cost of probes and estimated candidates.
    """
    steps, size = radius + 1, values.shape[1]
    best = np.full((steps + 1, size), np.inf)
    best[0] = 0
    choices = []
    for part in parts:
        near = shells[part[0]][:, values[part[0]]]
        for block in part[1:]:
            other = shells[block][:, values[block]]
            near = np.stack([
                sum(near[i] * other[r - i] for i in range(r + 1)) / n for r in range(steps)])
        keys = np.array([probes(BLOCK * len(part), a) for a in range(1, steps + 1)], float)
        cost = np.concatenate([np.zeros((1, size)), np.cumsum(near, axis=0) + keys[:, None]])
        options = np.stack([
            np.stack([best[s - a] + cost[a] if a <= s else np.full(size, np.inf)
                      for a in range(steps + 1)]) for s in range(steps + 1)])
        choices.append(options.argmin(axis=1))
        best = options.min(axis=1)
    chosen, rest, at = [], np.full(size, steps), np.arange(size)
    for choice in reversed(choices):
        a = choice[rest, at]
        chosen.append(a)
        rest = rest - a
    return np.stack(chosen[::-1])


def _under(part: int, keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array(np.full(len(fps), part, np.int32)), pa.array(keys), pa.array(fps)],
        names=["part", "key", "fp"])


def signatures(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """`(part, key, fp)`: each fingerprint under its value in every part, and under each
    value that it probes.  Fingerprints within the radius meet under some key."""
    groups = bit_groups(distinct)
    counts = histograms(distinct, groups)
    parts = choose_parts(counts, radius)
    sent = distinct.sparkSession.sparkContext.broadcast(counts)

    def run(batches):
        shells = np.stack([_shells(c, radius) for c in sent.value])
        n = max(1.0, float(sent.value[0].sum()))
        masks = {}
        for batch in batches:
            fps = _fps(batch)
            values = block_values(fps, groups)
            chosen = allocate(values, shells, parts, radius, n)
            for number, part in enumerate(parts):
                own = np.zeros(len(fps), np.int64)
                for i, block in enumerate(part):
                    own |= values[block] << (BLOCK * i)
                yield _under(number, own, fps)
                for a in range(2, radius + 2):
                    at = np.flatnonzero(chosen[number] == a)
                    if len(at) and (len(part), a) not in masks:
                        masks[len(part), a] = _masks(BLOCK * len(part), a - 1)
                    rows = max(1, RUN // probes(BLOCK * len(part), a))
                    for start in range(0, len(at), rows):
                        some, flips = at[start:start + rows], masks[len(part), a]
                        yield _under(
                            number, (own[some, None] ^ flips[None, :]).ravel(),
                            np.repeat(fps[some], len(flips)))

    return distinct.select("fp").mapInArrow(run, "part int, key long, fp long")


def _cells(rows: DataFrame) -> DataFrame:
    """`(cell, fp)`: a bucket is a cell; one above CELL rows is a cell for each two chunks."""
    hot = stored(
        rows.groupBy("part", "key").agg(F.count("*").alias("n")).filter(F.col("n") > CELL)
        .select("part", "key", F.ceil(F.col("n") / (CELL // 2)).alias("chunks")),
        "hot-buckets",
    )
    mine = F.pmod(F.xxhash64("fp"), F.coalesce("chunks", F.lit(1)))
    return (
        rows.join(hot, ["part", "key"], "left")
        .withColumn("mine", mine)
        .withColumn("other", F.explode(
            F.sequence(F.lit(0).cast("long"), F.coalesce("chunks", F.lit(1)) - 1)))
        .select(
            F.xxhash64("part", "key", F.least("mine", "other"),
                       F.greatest("mine", "other")).alias("cell"), "fp")
    )


def forest(left: np.ndarray, right: np.ndarray, size: int) -> np.ndarray:
    """The smallest reachable position of each position, by repeated minima."""
    label = np.arange(size)
    while True:
        low = np.minimum(label[left], label[right])
        before = label.copy()
        np.minimum.at(label, left, low)
        np.minimum.at(label, right, low)
        label = label[label]
        if (label == before).all():
            return label


def _linked(cells: np.ndarray, fps: np.ndarray, radius: int) -> pa.RecordBatch:
    """Star edges of the links inside runs of equal cells."""
    at, step, left, right = np.arange(len(fps)), 1, [], []
    while True:
        at = at[at + step < len(fps)]
        at = at[cells[at] == cells[at + step]]
        if not len(at):
            break
        near = np.bitwise_count(fps[at] ^ fps[at + step]) <= radius
        left.append(at[near])
        right.append(at[near] + step)
        step += 1
    a, b = np.array([], np.int64), np.array([], np.int64)
    if left and sum(map(len, left)):
        values, place = np.unique(fps, return_inverse=True)
        label = forest(place[np.concatenate(left)], place[np.concatenate(right)], len(values))
        member = np.flatnonzero(label != np.arange(len(values)))
        a, b = values[label[member]].view(np.int64), values[member].view(np.int64)
    return pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], names=["a", "b"])


def links(distinct: DataFrame, radius: int = 3) -> DataFrame:
    """`(a, b)`: edges between fingerprints that join exactly what the links join."""
    def run(batches):
        cells, fps = np.array([], np.int64), np.array([], np.uint64)
        for batch in batches:
            cells = np.concatenate([cells, batch.column(0).to_numpy()])
            fps = np.concatenate([fps, batch.column(1).to_numpy().view(np.uint64)])
            whole = int(np.searchsorted(cells, cells[-1])) if len(cells) else 0
            if whole:
                yield _linked(cells[:whole], fps[:whole], radius)
                cells, fps = cells[whole:], fps[whole:]
        if len(cells):
            yield _linked(cells, fps, radius)

    rows = stored(signatures(distinct, radius), "signatures")
    return (
        _cells(rows).repartition("cell").sortWithinPartitions("cell")
        .mapInArrow(run, "a long, b long")
    )


def _component_ids(rows: DataFrame, id_col: str, radius: int) -> DataFrame:
    """`(fp, component_id)`, one row for each different fingerprint of `rows`."""
    distinct = stored(
        rows.groupBy("fp").agg(F.min(id_col).alias("low")).repartition("fp"), "distinct-fps")
    roots = connected_components(stored(links(distinct, radius), "links"))
    named = distinct.join(
        roots.select(F.col("node").alias("fp"), "component"), "fp", "left",
    ).select("fp", "low", F.coalesce("component", "fp").alias("root"))
    named = stored(named, "roots")
    lowest = stored(
        named.groupBy("root").agg(F.min("low").alias("component_id")), "component-ids")
    return stored(named.join(lowest, "root").select("fp", "component_id"), "known")


def near_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3,
    words_in_shingle: int = 3,
) -> DataFrame:
    """`(doc_id, fingerprint, component_id)` for every row of `docs`.

    `fingerprint` is 16 hexadecimal digits, `component_id` the smallest id reachable over
    links.  A null or blank text has fingerprint zero and links like any other.  Equal
    fingerprints are one node, so copies are never compared.  A null id is never the smallest
    unless its component has no other.  An empty table gives no rows; other columns are not
    looked at.
    """
    rows = stored(fingerprints(docs, id_col, text_col, words_in_shingle), "fingerprints")
    known = _component_ids(rows, id_col, radius)
    return rows.join(known, "fp").select(
        id_col, F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def one_of_each(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", radius: int = 3,
    words_in_shingle: int = 3,
) -> DataFrame:
    """`docs`, with all columns, less the rows that are not the first of their component.

    Components are those of `near_duplicates`; the row with the smallest id stays, and rows
    that repeat that id and its text stay with it.  A row with a null id stays only if no row
    of its component has one.  Null and blank texts are near copies of each other.  An empty
    table gives no rows; other columns are not looked at, whatever their names.
    """
    told = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text"))
    rows = stored(
        fingerprints(told, "id", "text", words_in_shingle, F.md5(F.coalesce("text", F.lit("")))),
        "fingerprints")
    known = _component_ids(rows, "id", radius)
    gone_id, gone_text = fresh(docs, "gone_id", "gone_text")
    gone = stored(
        rows.join(known, "fp").filter(~F.col("id").eqNullSafe(F.col("component_id")))
        .select(F.col("id").alias(gone_id), F.col("key").alias(gone_text)).distinct(), "gone")
    return docs.join(
        gone,
        docs[id_col].eqNullSafe(F.col(gone_id))
        & (F.md5(F.coalesce(docs[text_col], F.lit(""))) == F.col(gone_text)), "left_anti")
