"""Global ranks, row numbers and running sums without a single-task window.

The rows are range-partitioned in order and stored with their part number.  Each part is then
numbered on its own and shifted by the totals of the parts before it; only one row per part
passes through a single task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from wordloom.scratch import stored


def ranked(
    df: DataFrame, order: list[Column], rank: str = "rank", running: dict[str, str] | None = None,
    parts: int | None = None,
) -> DataFrame:
    """Add the 1-based position in `order` and running sums (`{new column: summed column}`).

    `order` must be total: rows that tie would not have one position.
    """
    running = running or {}
    spark = df.sparkSession
    parts = parts or int(spark.conf.get("spark.sql.shuffle.partitions"))
    split = stored(
        df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()),
        "ranked",
    )
    totals = split.groupBy("_part").agg(
        F.count(F.lit(1)).alias("_rows"),
        *[F.sum(column).alias(f"_sum_{new}") for new, column in running.items()],
    )
    # `totals` has `parts` rows at most, whatever the size of `df`.
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    names = ["_rows", *[f"_sum_{new}" for new in running]]
    offsets = totals.select("_part", *[
        F.coalesce(F.sum(name).over(before), F.lit(0)).alias(f"_before{name}") for name in names])
    within = Window.partitionBy("_part").orderBy(*order)
    upto = within.rowsBetween(Window.unboundedPreceding, 0)
    rows = split.select(
        "*", F.row_number().over(within).cast("long").alias("_row"),
        *[F.sum(column).over(upto).alias(f"_upto_{new}") for new, column in running.items()],
    )
    return rows.join(F.broadcast(offsets), "_part").select(
        *df.columns,
        (F.col("_row") + F.col("_before_rows")).cast("long").alias(rank),
        *[
            (F.col(f"_upto_{new}") + F.col(f"_before_sum_{new}")).alias(new)
            for new in running
        ],
    )


def numbered(df: DataFrame, column: str, order: list[Column], start: int = 1) -> DataFrame:
    """Surrogate ids `start, start+1, ...` in `order`, for tables that leave the engine."""
    return ranked(df, order, column).withColumn(
        column, F.col(column) + F.lit(start - 1).cast("long"))
