"""The Merkle manifest against trees built in plain Python."""

from __future__ import annotations

import hashlib
import zlib

import pytest
from pyspark.sql import functions as F

from tests.llm.fixtures import DOCS, documents, frames, rows_of
from wordloom.llm import merkle


def digest(*parts):
    return hashlib.sha256("".join(parts).encode()).hexdigest()


def field(value):
    return "-" if value is None else f"{len(str(value).encode())}:{value}"


def lowered(text):
    return text and "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def tree(nodes):
    levels = [nodes]
    while len(levels[-1]) > 1:
        nodes = levels[-1]
        levels.append([digest(*nodes[i:i + 16]) for i in range(0, len(nodes), 16)])
    return levels


def path(levels, place):
    steps = []
    for level in levels[:-1]:
        start = place // 16 * 16
        steps.append(("".join(level[start:place]), "".join(level[place + 1:start + 16])))
        place //= 16
    return steps


def brute_force(rows):
    groups = {}
    for i, text, lang, source, chars in rows:
        leaves = [digest(*map(field, (i, source, lang, chars, t))) for t in (text, lowered(text))]
        groups.setdefault(source, []).append((i is not None, i or 0, leaves[0], leaves[1], i))
    order = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {}
    for source in order:
        groups[source].sort(key=lambda leaf: leaf[:3])
        trees[source] = tree([leaf[2] for leaf in groups[source]])
    top = tree([trees[source][-1][0] for source in order])
    found = []
    for number, source in enumerate(order):
        for place, (_, _, leaf, other, i) in enumerate(groups[source]):
            steps = path(trees[source], place) + path(top, number)
            tampered = i is not None and zlib.crc32(str(i).encode()) % 5 == 0
            folded = other if tampered else leaf
            for left, right in steps:
                folded = digest(left, folded, right)
            found.append((
                i, leaf, trees[source][-1][0], top[-1][0],
                digest(*[left + right for left, right in steps]), folded, folded == top[-1][0]))
    return sorted(found, key=repr)


def manifest(docs, **more):
    return merkle.manifest(
        docs, tampered=F.crc32(F.col("doc_id").cast("string").cast("binary")) % 5 == 0, **more)


@pytest.mark.parametrize("levels", [3, 1])
def test_trees_of_every_shape(spark, levels):
    sizes = {None: 1, "a": 16, "b": 17, "c": 1, "é": 33, "Z": 257, "": 2}
    sizes |= {f"s{n}": 1 + n % 3 for n in range(12)}
    rows = [
        (number * 1000 + n, f"Text {n}", "de", source, n)
        for number, (source, size) in enumerate(sizes.items()) for n in range(size)]
    rows += documents()
    assert rows_of(manifest(spark.createDataFrame(rows, DOCS), levels=levels)) == brute_force(rows)


def test_odd_tables(spark):
    docs, odd = frames(spark)
    odd = odd.selectExpr("*", "1 as root", "2 as path", "3 as block", "4 as item", "5 as part")
    assert rows_of(manifest(odd)) == rows_of(manifest(docs)) == brute_force(documents())
    assert manifest(docs.limit(0)).collect() == []


def test_tampering_is_found(spark):
    rows = [(n, f"{'T' if n % 2 else 't'}ext", "de", "s", n) for n in range(40)]
    docs = spark.createDataFrame(rows, DOCS)
    assert merkle.manifest(docs).filter("not verified").count() == 0
    told = merkle.manifest(docs, tampered=F.col("doc_id") < 10)
    bad = {r["doc_id"] for r in told.filter("not verified").collect()}
    assert bad == {1, 3, 5, 7, 9}
