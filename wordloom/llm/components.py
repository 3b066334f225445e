"""Connected components of an edge list, by alternating large and small stars.

Every step is a grouped minimum and a join; each half round is written to the shared
folder, so a lost executor costs a re-read.  A hub's edges are split by adaptive
execution: the minima are read from a table, so both sides of the join are freshly
shuffled.  Nothing is gathered on the driver but one checksum a round.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.scratch import stored


def _large_star(edges: DataFrame) -> DataFrame:
    both = edges.unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
    least = stored(
        both.groupBy("u").agg(F.min("v").alias("low"))
        .select("u", F.least("u", "low").alias("low")),
        "large-star",
    )
    return (
        both.filter("v > u").join(least, "u")
        .select(F.col("v").alias("u"), F.col("low").alias("v")).distinct()
    )


def _small_star(edges: DataFrame) -> DataFrame:
    least = stored(edges.groupBy("u").agg(F.min("v").alias("low")), "small-star")
    moved = (
        edges.join(least, "u").filter("v <> low")
        .select(F.col("v").alias("u"), F.col("low").alias("v"))
    )
    return moved.unionByName(least.withColumnRenamed("low", "v")).distinct()


def connected_components(edges: DataFrame, a: str = "a", b: str = "b") -> DataFrame:
    """`(node, component)` for every node of an edge between two different nodes.

    A component is named after its smallest node.  Loops, repeated edges and edges with a
    null end are allowed and add nothing; an empty edge list gives no rows.
    """
    current = stored(
        edges.filter(F.col(a) != F.col(b))
        .select(F.greatest(a, b).alias("u"), F.least(a, b).alias("v")).distinct(),
        "edges",
    )
    seen = None
    while True:
        state = current.agg(
            F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")),
        ).first()
        if state == seen or state[0] == 0:
            return current.select(F.col("u").alias("node"), F.col("v").alias("component")).union(
                current.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct()
            )
        seen = state
        current = stored(_small_star(stored(_large_star(current), "edges")), "edges")
