"""Run queries and their SQL side by side: ``python tests/compare.py [folder] [name ...]``."""

from __future__ import annotations

import math
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return connection


def cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    return value


def ordered(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    plain = [tuple(cell(row[i]) for i in order) for row in rows]
    return [columns[i] for i in order], sorted(plain, key=repr)


def difference(spark_df, result) -> str | None:
    """What differs between a DataFrame and a DuckDB result, None when nothing does."""
    mine = ordered(spark_df.columns, spark_df.collect())
    theirs = ordered([d[0] for d in result.description], result.fetchall())
    if mine[0] != theirs[0]:
        return f"columns {mine[0]} against {theirs[0]}"
    if len(mine[1]) != len(theirs[1]):
        return f"{len(mine[1])} rows against {len(theirs[1])}"
    for a, b in zip(mine[1], theirs[1]):
        if a != b or [type(x) for x in a] != [type(x) for x in b]:
            return f"{a} against {b}"
    return None


def main(folder: str, names: list[str]) -> int:
    import __spark_entry__ as entry
    from custvalue.session import build_session

    spark = build_session(
        "compare", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "12g"}
    )
    spark.sparkContext.setLogLevel("ERROR")
    connection, failures = connect(folder), 0
    for name, function in entry.queries().items():
        if names and name not in names:
            continue
        started = time.time()
        try:
            sql = entry.oracle_sql().get(name)
            df = function(spark, folder)
            if sql is None:
                problem = None if df.count() else "no rows"
            else:
                problem = difference(df, connection.execute(sql))
        except Exception as error:  # noqa: BLE001 - report and go on with the next query
            problem = f"{type(error).__name__}: {str(error)[:1500]}"
        failures += problem is not None
        print(f"{name:32} {time.time() - started:6.2f}s {problem or 'ok'}", flush=True)
    print(f"{failures} of the queries failed")
    return 1 if failures else 0


if __name__ == "__main__":
    given = sys.argv[1:]
    sys.exit(main(given[0] if given else "/root/testdata/sf0.01", given[1:]))
