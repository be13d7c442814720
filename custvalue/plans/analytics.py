"""Web analytics answers, one field per request, put side by side."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Observation, SparkSession
from pyspark.sql import functions as F

from custvalue.functions.nulls import named
from custvalue.operators.aggregates import widened
from custvalue.operators.filters import in_range
from custvalue.sources.csv import write_csv
from custvalue.sources.json import header_rows_long

# The id column, and the value column of dimension requests.
TRANSACTION_ID = "ga:transactionId"
TOTAL_VALUE = "ga:totalValue"

_MANIFEST = "_finished"  # readers of the exports pass over names that begin so


def periods(starts: Sequence[str], end: str) -> list[tuple[str, str]]:
    """Half-open (start, end) days, each period ending where the next one starts, the last one at
    ``end``, the day after all."""
    return list(zip(starts, [*starts[1:], end]))


def period_of(time: Column, ranges: Sequence[tuple[str, str]]) -> Column:
    """Start day of the period a time falls into, null outside all of them."""
    found = F.lit(None).cast("string")
    for start, end in reversed(ranges):
        inside = in_range(time, F.lit(start).cast("date"), F.lit(end).cast("date"))
        found = F.when(inside, F.lit(start)).otherwise(found)
    return found


def real_transactions(df: DataFrame, column: str = TRANSACTION_ID) -> DataFrame:
    """Rows with a transaction id other than 0."""
    return df.where(named(column) != "0")


def metrics_by_period(
    answers: DataFrame, metrics: Sequence[str], ranges: Sequence[str], range_column: str = "range_end"
) -> DataFrame:
    """Metric answers (one metric each) as one row per period and transaction."""
    long = header_rows_long(answers, [TRANSACTION_ID], keep=[range_column])
    return widened(
        real_transactions(long), [TRANSACTION_ID], "field", "value", metrics, range_column, ranges
    )


def dimensions_by_period(
    answers: DataFrame,
    dimensions: Sequence[str],
    ranges: Sequence[str],
    range_column: str = "range_end",
) -> DataFrame:
    """Dimension answers as one row per period, transaction and total value."""
    keys = [TRANSACTION_ID, TOTAL_VALUE]
    long = header_rows_long(answers, keys, keep=[range_column])
    return widened(
        real_transactions(long), keys, "field", "value", dimensions, range_column, ranges
    )


def _record(spark: SparkSession, path: str, counts: Mapping[str, int | None]) -> None:
    """Note periods in the manifest: their rows, or null while an export is under way."""
    rows = [(period, n) for period, n in counts.items()]
    spark.createDataFrame(rows, "period string, rows long").coalesce(1).write.mode(
        "overwrite"
    ).option("partitionOverwriteMode", "dynamic").partitionBy("period").json(f"{path}/{_MANIFEST}")


def finished_periods(spark: SparkSession, path: str) -> dict[str, int]:
    """Rows of each period whose export ended; one entry per period."""
    there = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{_MANIFEST}")
    if not there.getFileSystem(spark._jsc.hadoopConfiguration()).exists(there):
        return {}
    noted = spark.read.schema("rows long, period string").json(f"{path}/{_MANIFEST}")
    return {r["period"]: r["rows"] for r in noted.where("rows IS NOT NULL").collect()}


def export_by_period(
    wide: DataFrame,
    path: str,
    range_column: str = "range_end",
    ranges: Sequence[str] | None = None,
) -> None:
    """One CSV export per period; those of other periods stay as they are.

    ``ranges`` are the periods to export (days, as ``periods`` takes them), all that occur unless
    given. A listed period without rows loses its old export. A manifest notes each period's rows
    once its export has ended, so a job that was stopped is run again for the periods that
    ``finished_periods`` lacks; running it for others too changes nothing.
    """
    spark, period = wide.sparkSession, named(range_column).cast("string")
    if ranges is None:
        found = wide.where(period.isNotNull()).select(period.alias("period")).distinct()
        ranges = [r["period"] for r in found.collect()]
    if not ranges:
        return
    _record(spark, path, dict.fromkeys(ranges))
    seen = Observation()
    counts = [F.count(F.when(period == day, 1)).alias(f"{i}") for i, day in enumerate(ranges)]
    chosen = wide.where(period.isin(list(ranges))).observe(seen, *counts)
    write_csv(chosen, path, partition_by=[range_column], keep_others=True)
    rows = {day: seen.get[f"{i}"] for i, day in enumerate(ranges)}
    for day in (day for day, n in rows.items() if not n):
        old = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/{range_column}={day}")
        old.getFileSystem(spark._jsc.hadoopConfiguration()).delete(old, True)
    _record(spark, path, rows)
