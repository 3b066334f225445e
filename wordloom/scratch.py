"""Tables written between jobs.

A result that several jobs read, or that must not change between two reads, is written
once as parquet in the folder all executors share.  Losing an executor then costs a
re-read, never a recomputation of the whole lineage.
"""

from __future__ import annotations

import atexit
import math
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_local_roots: dict[str, str] = {}

#: Rows of a part of a sorted table: a task sorts no more of a large table than of a small one.
ROWS_A_PART = 1_000_000
#: A smaller table is dealt over the cores, in parts of so many rows or more.
FEWEST_ROWS = 100_000


def parts_for(spark: SparkSession, rows: int | None) -> int:
    """The number of parts in which a table of so many rows is sorted."""
    rows = rows or 0
    cores = min(spark.sparkContext.defaultParallelism, math.ceil(rows / FEWEST_ROWS))
    return max(1, cores, math.ceil(rows / ROWS_A_PART))


def in_parts(df: DataFrame, parts: int | None, *columns: str) -> DataFrame:
    """`df` shuffled by columns for a join or grouping by them, if that takes more parts than the
    session shuffles into; fewer are left to adaptive execution."""
    usual = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return df.repartition(parts, *columns) if parts and parts > usual else df


def shared_root(spark: SparkSession) -> str:
    """The cluster's `spark.checkpoint.dir`; on a local master without one, a folder that
    is removed when the process ends."""
    app = spark.sparkContext.applicationId
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        root = _local_roots.setdefault(app, "")
        if not root:
            root = _local_roots[app] = tempfile.mkdtemp(prefix="wordloom-")
            atexit.register(shutil.rmtree, root, ignore_errors=True)
    return f"{root.rstrip('/')}/{app}"


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_root(spark)}/{name}-{uuid.uuid4().hex[:10]}"


def stored(df: DataFrame, name: str) -> DataFrame:
    """Write `df` once and return a DataFrame that reads the written table."""
    spark = df.sparkSession
    path = new_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
