"""Networks around the paradigms of all words at once.

Hubs and their members do not depend on the word that is looked up, nor do the hubs nearest to a
root: the most frequent lemmas of each (Z, Y, X) are found once, each task cutting its own rows to
them before they are shuffled; hubs are numbered along (Z, Y, X), and a root meets the numbers
around its own place.  Words meet the result last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from wordloom.model import Model
from wordloom.operators.paradigm_queries import (
    LEMMA, drawn_network, members_of_hub, network_roots, with_frequency,
)
from wordloom.operators.ranks import ranked
from wordloom.scratch import stored

PLACE = ["Z", "Y"]


def hub_members(model: Model, lemmas: int = 50) -> DataFrame:
    """(Z, Y, X, W, wordform, frequency, place): the most frequent lemmas of each hub."""
    rows = with_frequency(model.paradigms.filter(
        (F.col("word_type_code") == LEMMA) & F.col("Z").isNotNull() & F.col("Y").isNotNull()
        & F.col("X").isNotNull()), model).select(
        *PLACE, "X", "W", "wordform",
        F.coalesce("frequency", F.lit(0).cast("long")).alias("frequency"))
    frequent = Window.partitionBy(*PLACE, "X").orderBy(F.desc("frequency"), "wordform")
    return rows.withColumn("place", F.row_number().over(frequent)).filter(
        F.col("place") <= lemmas)


def nearest_hubs(hubs: DataFrame, roots: DataFrame, groups: int = 50) -> DataFrame:
    """(Z, Y, root_x, X, rooted): of each different root the `groups` nearest X of `hubs`.

    `upto` counts the hubs up to a place; the nearest are among `groups` numbers on either side,
    which lie in four blocks of `groups` numbers at most.
    """
    points = (
        hubs.select(*PLACE, "X", F.lit(1).alias("is_hub"), F.lit(0).alias("is_root"))
        .unionByName(roots.select(
            *PLACE, F.col("root_x").alias("X"), F.lit(0).alias("is_hub"),
            F.lit(1).alias("is_root")).filter("Z is not null and Y is not null and X is not null"))
        .groupBy(*PLACE, "X").agg(F.max("is_hub").alias("is_hub"), F.max("is_root").alias("is_root"))
    )
    placed = stored(ranked(
        points, [F.col(c) for c in (*PLACE, "X")], "position", running={"upto": "is_hub"}),
        "hub-places")
    asking = placed.filter("is_root = 1").select(
        *PLACE, F.col("X").alias("root_x"), "upto", F.explode(F.sequence(
            F.expr(f"greatest(0, upto - {groups - 1}) div {groups}"),
            F.expr(f"(upto + {groups}) div {groups}"))).alias("block"))
    asked = placed.filter("is_hub = 1").select(
        *PLACE, "X", F.col("upto").alias("number"), F.expr(f"upto div {groups}").alias("block"))
    near = asking.join(asked, [*PLACE, "block"]).filter(
        F.col("number").between(F.col("upto") - (groups - 1), F.col("upto") + groups))
    # Twice `groups` entries a root at most.
    each = F.struct(F.abs(F.col("X") - F.col("root_x")).alias("distance"), "X")
    return near.groupBy(*PLACE, "root_x").agg(
        F.slice(F.sort_array(F.collect_list(each)), 1, groups).alias("nearest"),
    ).select(
        *PLACE, "root_x", F.exists("nearest", lambda n: n["distance"] == 0).alias("rooted"),
        F.explode("nearest.X").alias("X"))


def paradigm_networks(model: Model, groups: int = 50, lemmas: int = 50) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of `paradigm_network` for every word of the paradigms."""
    hubs = stored(
        hub_members(model, lemmas).groupBy(*PLACE, "X").agg(*members_of_hub()), "hubs")
    roots = stored(network_roots(model.paradigms), "network-roots")
    chosen = nearest_hubs(hubs, roots, groups)
    # Written, so that the join with the words is of known size and hot roots can be split.
    met = stored(chosen.join(hubs, [*PLACE, "X"]), "chosen-hubs")
    return drawn_network(met.join(roots, [*PLACE, "root_x"]))
