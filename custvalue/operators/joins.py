"""Joins. Sides are handed to the optimizer without size hints: adaptive execution measures
them at run time, broadcasts what is small and splits skewed partitions of what is not."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.nulls import named


def _splittable(key: Column) -> Column:
    """The key as a value of its own for a join in which it may be hot.

    Adaptive execution splits a skewed partition only when both sides are shuffled for the
    join. A right side that was grouped by the same key would be taken as it lies; wrapped,
    the key makes it shuffle its few grouped rows again. Null equals null when wrapped, so
    one side must hold no null keys.
    """
    return F.struct(key)


def left_join(
    left: DataFrame,
    right: DataFrame,
    left_on: str | Sequence[str],
    right_on: str | Sequence[str] | None = None,
    null_safe: bool = False,
    skip_blank: bool = False,
    hot_keys: bool = False,
) -> DataFrame:
    """Left equi-join that keeps both key columns when their names differ.

    ``null_safe`` lets null keys meet. ``skip_blank`` takes the empty text out of the right
    side: a blank domain belongs to no company, and as a key it would be hot. ``hot_keys``
    says that one key may hold many left rows: see ``_splittable``.
    """
    left_on = [left_on] if isinstance(left_on, str) else list(left_on)
    right_on = left_on if right_on is None else right_on
    right_on = [right_on] if isinstance(right_on, str) else list(right_on)
    if skip_blank:
        for key in right_on:
            right = right.where(named(key) != "")
    if left_on == right_on and not null_safe and not hot_keys:
        return left.join(right, left_on, "left")
    if hot_keys and not null_safe:
        for key in right_on:
            right = right.where(named(key).isNotNull())
    inner_names = [f"__key_{i}" for i in range(len(right_on))]
    shared = [name for name in right_on if name in left.columns]
    keyed = right.withColumns(dict(zip(inner_names, map(named, right_on)))).drop(*shared)
    condition = F.lit(True)
    for mine, theirs in zip(left_on, inner_names):
        a, b = named(mine), F.col(theirs)
        if hot_keys:
            a, b = _splittable(a), _splittable(b)
        condition = condition & (a.eqNullSafe(b) if null_safe else a == b)
    return left.join(keyed, condition, "left").drop(*inner_names)


def left_join_hot_right(
    left: DataFrame, right: DataFrame, left_on: str, right_on: str
) -> DataFrame:
    """Left equi-join for a right side in which one key may hold many rows.

    A left join can only be split along its left side. As an inner join, which can be split
    along both, and the left rows without a match, found by the distinct right keys, no task
    meets all rows of a hot key.
    """
    keys = right.select(named(right_on).alias("__key")).distinct()
    same = _splittable(named(left_on)) == _splittable(F.col("__key"))
    known = right.where(named(right_on).isNotNull()).withColumn("__key", named(right_on))
    matched = left.join(known, same).drop("__key")
    alone = left.join(keys.where("__key IS NOT NULL"), same, "left_anti")
    return matched.unionByName(alone, allowMissingColumns=True)


def outer_join(left: DataFrame, right: DataFrame, on: str | Sequence[str]) -> DataFrame:
    """Full outer join with one key column holding whichever side's key is there."""
    return left.join(right, [on] if isinstance(on, str) else list(on), "full")


def suffixed_join(
    left: DataFrame,
    right: DataFrame,
    on: str | Sequence[str],
    how: str = "left",
    suffixes: tuple[str, str] = ("_x", "_y"),
) -> DataFrame:
    """Join on shared keys; other columns that both sides have get a suffix."""
    keys = [on] if isinstance(on, str) else list(on)
    clash = [c for c in left.columns if c in right.columns and c not in keys]
    return left.withColumnsRenamed({c: c + suffixes[0] for c in clash}).join(
        right.withColumnsRenamed({c: c + suffixes[1] for c in clash}), keys, how
    )


def with_group_values(df: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """Each row with aggregates of its key group.

    Aggregate and join back, not a window: the aggregate shrinks on the map side, and the
    join can split a hot key over many tasks, where a window would put it into one.
    """
    totals = df.where(named(key).isNotNull()).groupBy(named(key).alias("__key")).agg(
        *[value.alias(name) for name, value in values.items()]
    )
    same = _splittable(named(key)) == _splittable(F.col("__key"))
    return df.join(totals, same, "left").drop("__key")
