"""Exact order statistics without sorting a group in one task."""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.nulls import named


# Rows, about, in a bucket that one task looks into.
_ROWS_PER_BUCKET = 250_000


def exact_percentiles(
    df: DataFrame,
    value: str,
    probabilities: Sequence[float],
    by: Sequence[str] = (),
    few_groups: bool = False,
    buckets: int | None = None,
) -> DataFrame:
    """Per group: row count ``n`` and ``percentiles``, interpolated between neighbours.

    The built-in ``percentile`` keeps all distinct values of a group in one task. Here an
    approximate pass gives cut points, a second pass counts rows per cut-point bucket, and
    only the buckets that hold a wanted rank are looked into. Each step pre-aggregates, so
    what one task holds is about ``rows / buckets`` distinct values, and one heavy value is
    one row. The buckets grow in number with the rows, so they do not grow in size. Null and NaN values and null groups are left out.

    ``few_groups`` says that the caller has checked the number of groups; the wanted buckets
    (a few per group) are then broadcast, and the rows themselves are never shuffled.
    """
    keys = list(by)
    wanted = [float(p) for p in probabilities]
    number = named(value).cast("double")
    rows = df.select(*map(named, keys), number.alias("__v")).where(
        F.col("__v").isNotNull() & ~F.isnan("__v")
    )
    for key in keys:
        rows = rows.where(named(key).isNotNull())
    if buckets is None:
        buckets = max(8, math.ceil(rows.count() / _ROWS_PER_BUCKET))
    steps = [i / buckets for i in range(1, buckets)]
    cuts = {c for c in rows.approxQuantile("__v", steps, 0.25 / buckets) if math.isfinite(c)}
    splits = [float("-inf"), *sorted(cuts or {0.0}), float("inf")]
    rows = Bucketizer(splits=splits, inputCol="__v", outputCol="__bucket").transform(rows)

    group = [named(k) for k in keys] or [F.lit(0).alias("__all")]
    names = keys or ["__all"]
    rows = rows.select(*group, "__v", F.col("__bucket").cast("int").alias("__bucket"))
    in_order = Window.partitionBy(*map(named, names)).orderBy("__bucket")
    before = F.sum("__n").over(in_order) - F.col("__n")
    whole = Window.partitionBy(*map(named, names))

    def ranks(total):
        return F.array_distinct(
            F.flatten(
                F.array(
                    *[
                        F.array(
                            F.floor((total - 1) * p).cast("bigint"),
                            F.ceil((total - 1) * p).cast("bigint"),
                        )
                        for p in wanted
                    ]
                )
            )
        )

    def inside(start, count):
        return lambda rank: (rank >= start) & (rank < start + count)

    held = (
        rows.groupBy(*map(named, names), "__bucket")
        .agg(F.count("*").alias("__n"))
        .withColumn("__before", before)
        .withColumn("__total", F.sum("__n").over(whole))
        .withColumn(
            "__ranks",
            F.filter(ranks(F.col("__total")), inside(F.col("__before"), F.col("__n"))),
        )
        .where(F.size("__ranks") > 0)
        .drop("__n")
    )
    if few_groups or not keys:
        held, weighed = F.broadcast(held), rows.withColumn("__w", F.lit(1).cast("bigint"))
    else:
        # Rows have to move: equal values of a group become one row first.
        weighed = rows.groupBy(*map(named, names), "__bucket", "__v").agg(F.count("*").alias("__w"))
    in_bucket = Window.partitionBy(*map(named, names), "__bucket").orderBy("__v")
    start = F.col("__before") + F.sum("__n").over(in_bucket) - F.col("__n")
    found = (
        weighed.join(held, [*names, "__bucket"])
        .groupBy(*map(named, names), "__bucket", "__before", "__total", "__ranks", "__v")
        .agg(F.sum("__w").alias("__n"))
        .withColumn("__start", start)
        .withColumn("__here", F.filter("__ranks", inside(F.col("__start"), F.col("__n"))))
        .select(*map(named, names), "__total", "__v", F.explode("__here").alias("__rank"))
        .groupBy(*map(named, names), "__total")
        .agg(F.map_from_entries(F.collect_list(F.struct("__rank", "__v"))).alias("__at"))
    )

    def interpolated(p):
        position = (F.col("__total") - 1) * p
        low = F.col("__at")[F.floor(position).cast("bigint")]
        high = F.col("__at")[F.ceil(position).cast("bigint")]
        return low + (high - low) * (position - F.floor(position))

    return found.select(
        *map(named, keys),
        F.col("__total").alias("n"),
        F.array(*[interpolated(p) for p in wanted]).alias("percentiles"),
    )
