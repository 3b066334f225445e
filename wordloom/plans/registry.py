"""Named queries over the driver's tables, each with the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from wordloom.plans.oracle import with_tables
from wordloom.plans.workload import Workload


@dataclass(frozen=True)
class Query:
    name: str
    run: Callable[[Workload], DataFrame]
    sql: str | None


QUERIES: dict[str, Query] = {}


def query(sql: str | None = None, name: str | None = None):
    """Register a function of a workload under its own name."""
    def register(run: Callable[[Workload], DataFrame]):
        key = name or run.__name__
        if key in QUERIES:
            raise ValueError(f"two queries named {key}")
        QUERIES[key] = Query(key, run, with_tables(sql) if sql else None)
        return run

    return register


def rounded(df: DataFrame, *columns: str, digits: int = 6) -> DataFrame:
    return df.withColumns({c: F.round(c, digits) for c in columns})
