"""A Merkle manifest of a dataset: leaves, roots and proofs by nested roll-up.

Every row is a leaf.  The leaves of a group, in order of id, and then the groups' subroots form
trees of `WIDTH` children a node.  A leaf's rank within its group is cut into digits of base `WIDTH`,
and the digits are grouped away one after the other, the lowest first: each step nests the children
of a node, with their hashes, into one struct.  `LEVELS` digits make a block, a nested row of at most
`WIDTH ** LEVELS` leaves, so no group grows with the data; the blocks' own hashes are rolled up as the
leaves were, until each group has one block left.  Coming down again, a block's row is
transformed and exploded level by level, and each child takes the hashes of its siblings along: within
a block proofs need no join.  Between two tiers of blocks, one row for each block meets its path.

All blocks of one group are dealt over the tasks, so a group with a third of all rows is no hot
key, and ranks come from a range partitioning with one shift for each part.  Each tier is a table
in the shared folder; the driver learns nothing but whether another tier is needed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.operators.ranks import ranked
from wordloom.scratch import stored

#: Children of a node, and digits of a rank that a block nests: 4,096 leaves at most.
WIDTH, LEVELS = 16, 3
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def digest(*parts: Column) -> Column:
    return F.sha2(F.concat(*parts), 256)


def field(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value."""
    text = value.cast("string")
    return F.coalesce(
        F.concat(F.octet_length(text).cast("string"), F.lit(":"), text), F.lit("-"))


def positions(leaves: DataFrame, parts: int | None = None) -> DataFrame:
    """`leaves` with `rank`, counted from 0 within `source` in order of (`id`, `hash`).

    The rows are range-partitioned, so only the first source of a part can have begun in an
    earlier one: the shifts are one row for each part at most.
    """
    parts = parts or int(leaves.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    split = stored(
        leaves.repartitionByRange(parts, "source", "id", "hash")
        .withColumn("part", F.spark_partition_id()), "leaves")
    earlier = Window.partitionBy("source").orderBy("part").rowsBetween(
        Window.unboundedPreceding, -1)
    shifts = (
        split.groupBy("source", "part").agg(F.count("*").alias("n"))
        .withColumn("shift", F.sum("n").over(earlier)).filter("shift > 0")
        .select(F.col("source").alias("begun"), F.col("part").alias("of"), "shift")
    )
    within = Window.partitionBy("part", "source").orderBy("id", "hash")
    return (
        split.withColumn("rank", F.row_number().over(within) - F.lit(1).cast("long"))
        .join(F.broadcast(shifts), (F.col("part") == F.col("of"))
              & F.col("source").eqNullSafe(F.col("begun")), "left")
        .select("source", "hash", "item", (
            F.col("rank") + F.coalesce("shift", F.lit(0).cast("long"))).alias("rank"))
    )


def _hash_of_children(first: Column) -> Column:
    """The hash of `children`; the first node of a level, with one child, is that child."""
    hashes = F.transform("children", lambda c: c["hash"])
    alone = first & (F.size("children") == 1)
    return F.when(alone, F.col("children")[0]["hash"]).otherwise(
        F.sha2(F.array_join(hashes, ""), 256))


def rolled_up(nodes: DataFrame, key: str = "source", levels: int = LEVELS) -> DataFrame:
    """`(key, block, hash, children)` of `(key, rank, hash, item)`: one nested row a block.

    While a key has several nodes on a level, each run of `WIDTH` becomes its hash, also a
    run of one; a level of a single node ends the key's tree, which only its first run can be.
    """
    digits = [f"d{n}" for n in range(levels)]
    rank = F.col("rank")
    rows = nodes.select(
        key, F.floor(rank / WIDTH**levels).cast("long").alias("block"),
        *[(F.shiftright(rank, 4 * n) % WIDTH).cast("int").alias(d)
          for n, d in enumerate(digits)],
        "hash", F.col("item").alias("children"),
    ).repartition(key, "block")
    for n, digit in enumerate(digits):
        above = digits[n + 1:]
        # The keys hold those of the partitioning, so no step shuffles again.
        rows = rows.groupBy(key, "block", *above).agg(F.sort_array(F.collect_list(
            F.struct(F.col(digit).alias("digit"), "hash", "children"))).alias("children"))
        first = F.col("block") == 0
        for d in above:
            first &= F.col(d) == 0
        rows = rows.select(
            key, "block", *above, "children", _hash_of_children(first).alias("hash"),
            first.alias("first"))
    return rows


def _siblings(first: Column) -> Column:
    """The children, each with the hashes left and right of it; null where there is no hash."""
    def told(child: Column, at: Column) -> Column:
        def joined(part: Column) -> Column:
            return F.array_join(F.transform(part, lambda c: c["hash"]), "")
        alone = first & (F.size("children") == 1)
        return F.struct(
            child.alias("child"),
            F.when(~alone, F.struct(
                joined(F.slice("children", F.lit(1), at)).alias("left"),
                joined(F.slice("children", at + 2, F.lit(WIDTH))).alias("right"))).alias("step"))
    return F.transform("children", told)


def paths_down(blocks: DataFrame, key: str = "source", levels: int = LEVELS) -> DataFrame:
    """`(key, rank, hash, item, path)` of the nodes that `rolled_up` nested in `blocks`.

    `blocks` have their own `path`, from the block to the top; other columns go along.  A path
    is an array of (`left`, `right`), the hashes of the siblings on either side.
    """
    more = [c for c in blocks.columns if c not in (
        key, "block", "hash", "children", "first", "path")]
    rows = blocks.select(
        key, *more, F.col("block").alias("rank"), (F.col("block") == 0).alias("low"),
        "children", "path")
    for _ in range(levels):
        rows = rows.select(
            key, *more, "rank", "low", "path", F.explode(_siblings(F.col("low"))).alias("node"))
        rows = rows.select(
            key, *more,
            (F.col("rank") * WIDTH + F.col("node.child.digit")).alias("rank"),
            (F.col("low") & (F.col("node.child.digit") == 0)).alias("low"),
            F.col("node.child.hash").alias("hash"),
            F.col("node.child.children").alias("children"),
            F.when(F.col("node.step").isNull(), F.col("path")).otherwise(
                F.concat(F.array("node.step"), "path")).alias("path"))
    return rows.select(key, *more, "rank", "hash", F.col("children").alias("item"), "path")


def _tiers(nodes: DataFrame, key: str, levels: int) -> list[DataFrame]:
    """Blocks of the nodes, blocks of those blocks, and so on, until each key has one."""
    tiers = []
    while True:
        blocks = stored(rolled_up(nodes, key, levels), "merkle-blocks")
        tiers.append(blocks)
        if not blocks.filter("block > 0").limit(1).count():
            return tiers
        nodes = blocks.select(
            key, F.col("block").alias("rank"), "hash", F.lit(0).alias("item"))


def _down(tiers: list[DataFrame], above: DataFrame, key: str, levels: int) -> DataFrame:
    """The nodes below `tiers`, given `above` each key's columns and its `path` to the top."""
    for tier, blocks in enumerate(reversed(tiers)):
        path = above.withColumnRenamed(key, "above_key")
        same = F.col(key).eqNullSafe(F.col("above_key"))
        if tier:
            path = path.select(*[c for c in path.columns if c not in ("hash", "item")])
            path = path.withColumnRenamed("rank", "above_rank")
            same &= F.col("block") == F.col("above_rank")
        above = paths_down(
            blocks.join(path, same).drop("above_key", "above_rank"), key, levels)
    return above


def manifest(
    docs: DataFrame, id_col: str = "doc_id", group_col: str = "source", text_col: str = "text",
    fields: tuple[str, ...] = ("doc_id", "source", "lang", "n_chars", "text"),
    tampered: Column | None = None, levels: int = LEVELS,
) -> DataFrame:
    """`(doc_id, leaf, subroot, root, proof_sha256, folded_root, verified)` for every row.

    A leaf hashes `fields` of a row, each as `field` writes it.  Where `tampered` is true, the text's
    A-Z are lower-cased before the row's root is computed again from its siblings; `verified`
    says if that is the root.  A group's leaves are taken by id, null first, then by hash, so rows that repeat an
    id have an order and equal rows are interchangeable; a null group is the first.  Null and empty
    values have different leaves.  An empty table gives no rows; other columns are not looked at.
    """
    false = F.lit(False)
    changed = F.coalesce(tampered, false) if tampered is not None else false

    def leaf(text: Column) -> Column:
        return digest(*[field(text if c == text_col else F.col(c)) for c in fields])

    leaves = docs.select(
        F.col(group_col).alias("source"), F.col(id_col).alias("id"),
        leaf(F.col(text_col)).alias("hash"), F.struct(
            F.col(id_col).alias("id"),
            F.when(changed, leaf(F.translate(text_col, UPPER, LOWER))).alias("tampered"),
        ).alias("item"))
    below = _tiers(positions(leaves), "source", levels)
    subroots = below[-1].select("source", "hash")
    order = [F.col("source").asc_nulls_first()]
    tops = ranked(subroots, order).select(
        F.lit(0).alias("all"), (F.col("rank") - 1).alias("rank"), "hash",
        F.struct("source").alias("item"))
    upper = _tiers(tops, "all", levels)
    root = upper[-1].select(
        "all", F.col("hash").alias("root"), F.lit([]).cast(
            "array<struct<left:string,right:string>>").alias("path"))
    groups = _down(upper, root, "all", levels).select(
        F.col("item.source").alias("source"), F.col("hash").alias("subroot"), "root", "path")
    rows = _down(below, stored(groups, "merkle-groups"), "source", levels)
    proof = F.array_join(F.transform(
        "path", lambda step: F.concat(step["left"], step["right"])), "")
    folded = F.aggregate(
        "path", F.coalesce("item.tampered", "hash"),
        lambda below, step: F.sha2(F.concat(step["left"], below, step["right"]), 256))
    return rows.select(
        F.col("item.id").alias(id_col), F.col("hash").alias("leaf"), "subroot", "root",
        F.sha2(proof, 256).alias("proof_sha256"), folded.alias("folded_root"),
    ).withColumn("verified", F.col("folded_root") == F.col("root"))
