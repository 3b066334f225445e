"""Exact duplicates: group by a 128-bit content hash, compare bytes inside the groups."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wordloom.llm.columns import fresh
from wordloom.scratch import stored

SPACES = " \t\n\x0b\x0c\r"


def content(text: Column) -> Column:
    """The text without ASCII white space; a null text is an empty one."""
    return F.translate(F.coalesce(text, F.lit("")), SPACES, "")


def _rank(text: Column, row_id: Column) -> Column:
    """Orders the rows of a group: more code points first, then the smaller id, null last.

    One number, so that the grouped maximum stays a hash aggregation.
    """
    wide = "decimal(38,0)"
    points = F.char_length(F.coalesce(text, F.lit(""))).cast("decimal(12,0)")
    low = F.lit(str(2**63)).cast(wide) - row_id.cast("decimal(20,0)")
    return (points * F.lit(str(2**65)).cast("decimal(20,0)")).cast(wide) + F.coalesce(
        low.cast(wide), F.lit(0).cast(wide))


def _ranked_id(rank: Column) -> Column:
    low = rank % F.lit(str(2**65)).cast("decimal(20,0)")
    return F.when(low > 0, (F.lit(str(2**63)).cast("decimal(20,0)") - low).cast("long"))


def _grouped(docs: DataFrame, id_col: str, text_col: str, digest) -> DataFrame:
    return (
        docs.select(
            digest(content(F.col(text_col))).alias("hash"),
            content(F.col(text_col)).alias("body"),
            _rank(F.col(text_col), F.col(id_col)).alias("rank"),
        )
        .groupBy("hash", "body")
        .agg(F.max("rank").alias("rank"), F.count("*").alias("group_size"))
        .select("hash", "body", _ranked_id(F.col("rank")).alias("keep_id"), "group_size")
    )


def duplicate_groups(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """`(hash, keep_id, group_size)`, one row for each different content.

    Rows meet by the 128-bit hash of their content, and the bytes are compared by grouping
    on the content itself.  The map side groups first, so a hot text leaves each task once.
    Where two contents share a hash, a column `body` tells them apart; it is null elsewhere,
    and missing when no hash is shared.
    """
    groups = stored(_grouped(docs, id_col, text_col, digest).drop("body"), "contents")
    shared = stored(
        groups.groupBy("hash").agg(F.count("*").alias("n")).filter("n > 1").select("hash"),
        "shared-hashes",
    )
    if shared.isEmpty():
        return groups
    hashed = docs.select(id_col, text_col).withColumn(
        "__hash", digest(content(F.col(text_col))))
    colliding = hashed.join(
        shared.withColumnRenamed("hash", "__hash"), "__hash", "left_semi")
    told_apart = _grouped(colliding, id_col, text_col, digest)
    return stored(
        groups.join(shared, "hash", "left_anti").withColumn("body", F.lit(None).cast("string"))
        .unionByName(told_apart),
        "contents",
    )


def _joined(
    docs: DataFrame, groups: DataFrame, text_col: str, digest,
) -> tuple[DataFrame, dict[str, str]]:
    """`docs` with the columns of each row's group, and their names; hot groups may be split."""
    names = dict(zip(groups.columns, fresh(docs, *[f"group_{c}" for c in groups.columns])))
    [own] = fresh(docs, "own_hash")
    found = groups.withColumnsRenamed(names)
    hashed = docs.withColumn(own, digest(content(F.col(text_col))))
    same = F.col(own) == F.col(names["hash"])
    if "body" in names:
        same &= F.col(names["body"]).isNull() | (
            F.col(names["body"]) == content(F.col(text_col)))
    return hashed.join(found, same), names


def exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
    digest: Callable[[Column], Column] = F.md5,
) -> DataFrame:
    """`(doc_id, keep_id, group_size, kept, text_sha256)` for every row of `docs`.

    Texts are equal when they are identical without ASCII white space; a null text is empty.
    The row with the most code points stays, then the one with the smallest id; a null id
    comes last.  Ids are whole numbers.  Rows that repeat an id and its text stay or go together.  An empty table
    gives no rows; other columns of `docs` are not looked at.
    """
    groups = duplicate_groups(docs, id_col, text_col, digest)
    rows = docs.select(F.col(id_col).alias("__id"), F.col(text_col).alias("__text"))
    rows = rows.select(
        "__id", "__text", F.sha2(content(F.col("__text")), 256).alias("text_sha256"))
    if "body" not in groups.columns:
        rows = rows.withColumn("__hash", digest(content(F.col("__text")))).drop("__text")
        found = groups.withColumnRenamed("hash", "__hash")
        joined = rows.join(found, "__hash")
    else:
        joined, names = _joined(rows, groups, "__text", digest)
        joined = joined.withColumnsRenamed(
            {names["keep_id"]: "keep_id", names["group_size"]: "group_size"})
    return joined.select(
        F.col("__id").alias(id_col), "keep_id", "group_size",
        F.col("__id").eqNullSafe(F.col("keep_id")).alias("kept"), "text_sha256")


def without_exact_duplicates(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text",
) -> DataFrame:
    """The rows of `docs` that stay, with all their columns."""
    groups = duplicate_groups(docs, id_col, text_col)
    joined, names = _joined(docs, groups, text_col, F.md5)
    return joined.filter(
        F.col(id_col).eqNullSafe(F.col(names["keep_id"]))).select(*docs.columns)
