"""Run registered queries on Spark and their SQL on DuckDB, and compare the rows.

    python tests/compare.py [--sf 0.01] [name ...]
"""

from __future__ import annotations

import argparse
import math
import os
import sys
import time

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations").split()


def spark_session(cpus: int = 8):
    from pyspark.sql import SparkSession

    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("compare")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "8g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def duck(folder: str):
    import duckdb

    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{folder}/{table}.parquet'")
    return con


def _kind(name: str) -> str:
    name = name.lower()
    if name in ("bigint", "long", "hugeint"):
        return "long" if name != "hugeint" else "hugeint"
    return {"integer": "int", "varchar": "string", "text": "string", "bool": "boolean"}.get(
        name, name)


def _value(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    return str(v)


def difference(spark_df, con, sql: str) -> str | None:
    """None if the rows are the same, else what is different."""
    columns = sorted(spark_df.columns)
    mine = [tuple(_value(r[c]) for c in columns) for r in spark_df.collect()]
    cursor = con.execute(sql)
    names = [d[0] for d in cursor.description]
    if sorted(names) != columns:
        return f"columns {columns} against {sorted(names)}"
    theirs_types = {d[0]: _kind(str(d[1])) for d in cursor.description}
    at = [names.index(c) for c in columns]
    theirs = [tuple(_value(r[i]) for i in at) for r in cursor.fetchall()]
    mine.sort()
    theirs.sort()
    if mine != theirs:
        only_mine = sorted(set(mine) - set(theirs))[:3]
        only_theirs = sorted(set(theirs) - set(mine))[:3]
        return f"{len(mine)} against {len(theirs)} rows; {columns}: {only_mine} / {only_theirs}"
    types = {f.name: _kind(f.dataType.simpleString()) for f in spark_df.schema.fields}
    off = {c: (types[c], theirs_types[c]) for c in columns if types[c] != theirs_types[c]}
    if off:
        return f"types {off}"
    return None


def main() -> int:
    parser = argparse.ArgumentParser()
    parser.add_argument("--sf", default="0.01")
    parser.add_argument("names", nargs="*")
    args = parser.parse_args()
    import __spark_entry__ as entry

    folder = f"/root/testdata/sf{args.sf}"
    queries, oracles = entry.queries(), entry.oracle_sql()
    spark, con = spark_session(), duck(folder)
    bad = 0
    for name in args.names or queries:
        start = time.time()
        try:
            df = queries[name](spark, folder)
            if name in oracles:
                problem = difference(df, con, oracles[name])
                rows = con.execute(f"SELECT count(*) FROM ({oracles[name]})").fetchone()[0] \
                    if not problem else "?"
            else:
                rows, problem = len(df.collect()), None
        except Exception as error:  # noqa: BLE001
            rows, problem = "?", f"{type(error).__name__}: {str(error)[:1200]}"
        bad += problem is not None
        state = "BAD " if problem else ("ok  " if name in oracles else "rows")
        print(f"{state} {name} {rows} rows {time.time() - start:.1f}s {problem or ''}", flush=True)
    print(f"{bad} bad")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main())
