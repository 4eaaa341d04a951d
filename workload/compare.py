"""Runs each query in Spark and its SQL in DuckDB, and compares the rows value by value."""

from __future__ import annotations

import math
import sys
import time
from typing import Any

import duckdb
from pyspark.sql import DataFrame, SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect(config={"memory_limit": "8GB"})
    for table in TABLES:
        connection.execute(f"create view {table} as select * from '{sf_dir}/{table}.parquet'")
    return connection


def _text(value: Any) -> str:
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value)
    return f"{type(value).__name__}:{value}"


def _rows(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted(tuple(_text(row[i]) for i in order) for row in rows)


def differences(frame: DataFrame, connection: duckdb.DuckDBPyConnection, sql: str) -> list[str]:
    """What differs between a Spark result and a DuckDB result; empty if nothing does."""
    cursor = connection.execute(sql)
    expected_names = [d[0] for d in cursor.description]
    expected = _rows(expected_names, cursor.fetchall())
    actual = _rows(frame.columns, [tuple(row) for row in frame.collect()])
    found = []
    if sorted(frame.columns) != sorted(expected_names):
        found.append(f"columns {sorted(frame.columns)} != {sorted(expected_names)}")
    if len(actual) != len(expected):
        found.append(f"{len(actual)} rows != {len(expected)}")
    if actual != expected:
        mine, theirs = set(actual) - set(expected), set(expected) - set(actual)
        found.append(f"only Spark ({len(mine)}): {sorted(mine)[:2]}; only SQL ({len(theirs)}): {sorted(theirs)[:2]}")
    return found


def main() -> None:
    """``python -m workload.compare [sf_dir] [query ..]``"""
    from workload.oracle import oracle_sql
    from workload.queries import queries

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    spark = (
        SparkSession.builder.master("local[8]").config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "12g").config("spark.ui.enabled", "false")
        .config("spark.sql.session.timeZone", "UTC").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    chosen = sys.argv[2:] or list(queries())
    failed = []
    for name in chosen:
        start = time.time()
        try:
            frame = queries()[name](spark, sf_dir)
            sql = oracle_sql().get(name)
            if sql is None:
                print(f"rows {name}: {frame.count()} ({time.time() - start:.1f}s)", flush=True)
                continue
            found = differences(frame, connection, sql)
            rows = frame.count() if not found else -1
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            found, rows = [f"{type(error).__name__}: {str(error)[:1500]}"], -1
        print(f"{'FAIL' if found else 'ok'} {name}: {rows} rows ({time.time() - start:.1f}s)", flush=True)
        for line in found:
            print("    " + line)
            failed.append(name)
    print(f"{len(set(failed))} of {len(chosen)} differ: {sorted(set(failed))}")


if __name__ == "__main__":
    main()
