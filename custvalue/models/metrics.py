"""Class-weighted scores of predictions."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.nulls import named


def _ratio(part, whole):
    return F.when(whole > 0, part / whole).otherwise(0.0)


def weighted_metrics(
    df: DataFrame,
    label: str = "label",
    prediction: str = "prediction",
    by: Sequence[str] = (),
    count: str | None = None,
) -> DataFrame:
    """F1, precision and recall as means over classes weighted by their rows, and accuracy.

    One row, or one per group of ``by``. A score without a base counts as 0. ``count`` names
    a column that says how many rows a row stands for. The rows shrink to one count per label
    and prediction before anything moves.
    """
    keys = list(by)
    rows = F.count("*") if count is None else F.sum(named(count))
    counts = df.groupBy(
        *map(named, keys),
        named(label).cast("double").alias("label"),
        named(prediction).cast("double").alias("prediction"),
    ).agg(rows.alias("n"))
    hit = F.when(F.col("label") == F.col("prediction"), F.col("n")).otherwise(0)
    nothing = F.lit(0).cast("bigint")
    actual = F.struct(
        F.col("label").alias("class"),
        F.col("n").alias("actual"),
        nothing.alias("predicted"),
        hit.cast("bigint").alias("hits"),
    )
    predicted = F.struct(
        F.col("prediction").alias("class"),
        nothing.alias("actual"),
        F.col("n").alias("predicted"),
        nothing.alias("hits"),
    )
    sides = counts.select(*map(named, keys), F.explode(F.array(actual, predicted)).alias("side"))
    classes = sides.select(*map(named, keys), "side.*").groupBy(*map(named, keys), "class").agg(
        F.sum("actual").alias("actual"),
        F.sum("predicted").alias("predicted"),
        F.sum("hits").alias("hits"),
    )
    precision = _ratio(F.col("hits"), F.col("predicted"))
    recall = _ratio(F.col("hits"), F.col("actual"))
    scored = classes.select(
        *map(named, keys), "actual", "hits", precision.alias("precision"), recall.alias("recall")
    ).withColumn(
        "f1",
        _ratio(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")),
    )

    def weighted(score):
        return (F.sum(F.col(score) * F.col("actual")) / F.sum("actual")).alias(score)

    return scored.groupBy(*map(named, keys)).agg(
        weighted("f1"),
        weighted("precision"),
        weighted("recall"),
        (F.sum("hits") / F.sum("actual")).alias("accuracy"),
    )
