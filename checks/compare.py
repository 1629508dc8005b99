"""Runs registered queries beside their oracles: ``python -m checks.compare DIR [names...]``."""

from __future__ import annotations

import sys
import time

import duckdb
from pyspark.sql import SparkSession

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for table in TABLES:
        connection.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return connection


def _key(value: object) -> str:
    return repr(float(value)) if isinstance(value, float) else repr(value)


def normal(columns: list[str], rows: list[tuple]) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    picked = [tuple(row[i] for i in order) for row in rows]
    return [columns[i] for i in order], sorted(picked, key=lambda r: [_key(v) for v in r])


def difference(spark_side: tuple, duck_side: tuple) -> str:
    (columns, rows), (duck_columns, duck_rows) = spark_side, duck_side
    if columns != duck_columns:
        return f"columns {columns} / {duck_columns}"
    if len(rows) != len(duck_rows):
        return f"rows {len(rows)} / {len(duck_rows)}"
    wrong = [(a, b) for a, b in zip(rows, duck_rows) if [_key(v) for v in a] != [_key(v) for v in b]]
    return f"{len(wrong)} of {len(rows)} rows differ, first {wrong[0]}" if wrong else ""


def main(sf_dir: str, names: list[str]) -> int:
    from checks.oracles import ORACLES
    from checks.queries import REGISTRY

    spark = (
        SparkSession.builder.master("local[8]")
        .config("spark.sql.shuffle.partitions", "8")
        .config("spark.driver.memory", "10g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection = connect(sf_dir)
    failures = 0
    for name in names or list(REGISTRY):
        started = time.time()
        try:
            frame = REGISTRY[name](spark, sf_dir)
            mine = normal(frame.columns, [tuple(r) for r in frame.collect()])
            took = time.time() - started
            verdict = "no oracle"
            duck = 0.0
            if name in ORACLES:
                started = time.time()
                cursor = connection.execute(ORACLES[name])
                theirs = normal([d[0] for d in cursor.description], cursor.fetchall())
                duck = time.time() - started
                verdict = difference(mine, theirs) or "same"
        except Exception as error:  # report every query
            took, duck, verdict, mine = time.time() - started, 0.0, f"FAIL {str(error)[:600]}", ([], [])
        failures += verdict not in ("same", "no oracle")
        print(f"{name:27s} {len(mine[1]):7d} {took:6.2f}s {duck:6.2f}s {verdict[:700]}", flush=True)
    return failures


if __name__ == "__main__":
    sys.exit(main(sys.argv[1], sys.argv[2:]) > 0)
