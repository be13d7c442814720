"""Keyed aggregates and indicator columns.

Each aggregate here is one shuffle with map-side pre-aggregation. Null keys are left out.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.lists import indicator
from custvalue.functions.nulls import first_known, latest_known, named

# Beyond this many values a column is not a category any more; callers may raise it.
MAX_VALUES = 1000


def _keyed(df: DataFrame, key: str):
    return df.where(named(key).isNotNull()).groupBy(named(key))


def _order(order_by: Sequence[str]) -> Column:
    return F.struct(*[named(c) for c in order_by])


def _order_nulls_last(order_by: Sequence[str]) -> Column:
    """Ascending order in which a missing value comes after all others."""
    cells = [cell for c in order_by for cell in (named(c).isNull(), named(c))]
    return F.struct(*[cell.alias(f"o{i}") for i, cell in enumerate(cells)])


def first_known_per_key(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key with the first known value of every column by ``order_by``.

    ``order_by`` is required, and should end in a unique column: a cluster has no file order.
    Rows with a missing order value come last.
    """
    order = _order_nulls_last(order_by)
    return _keyed(df, key).agg(
        *[first_known(named(c), order).alias(c) for c in df.columns if c != key]
    )


def latest_known_per_key(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key with the latest known value of every column. Null dates rank last."""
    order = _order(order_by)
    return _keyed(df, key).agg(
        *[latest_known(named(c), order).alias(c) for c in df.columns if c != key]
    )


def latest_row_per_key(df: DataFrame, key: str, order_by: Sequence[str]) -> DataFrame:
    """One row per key: its latest whole row, nulls included."""
    row = F.struct(*[named(c) for c in df.columns])
    picked = _keyed(df, key).agg(F.max_by(row, _order(order_by)).alias("__row"))
    return picked.select("__row.*")


def count_per_key(df: DataFrame, key: str, name: str) -> DataFrame:
    return _keyed(df, key).agg(F.count("*").alias(name))


def distinct_values(df: DataFrame, column: Column, limit: int = MAX_VALUES) -> list:
    """Sorted known values of a category, refused beyond ``limit`` and never cut short.

    Brings at most ``limit + 1`` values to the driver.
    """
    values = df.select(column.alias("v")).where("v IS NOT NULL").distinct().limit(limit + 1)
    found = sorted(row.v for row in values.collect())
    if len(found) > limit:
        raise ValueError(f"more than {limit} values: not a category")
    return found


def indicators(
    df: DataFrame, items: str, values: Sequence[str], prefix: str = ""
) -> DataFrame:
    """One column per value: 1 where the list column holds it, null elsewhere.

    A projection: exploding the list, pivoting and joining back would cost two shuffles.
    """
    return df.withColumns({prefix + v: indicator(named(items), v) for v in values})


def item_values(df: DataFrame, items: str, limit: int = MAX_VALUES) -> list[str]:
    """Sorted distinct items of a list column."""
    return distinct_values(df.select(F.explode(named(items)).alias("i")), F.col("i"), limit)


def key_indicators(
    df: DataFrame, key: str, value: str, values: Sequence[str], prefix: str = ""
) -> DataFrame:
    """One row per key and one column per value: 1 if any row of the key has it, else null."""
    flags = [F.max(F.when(named(value) == v, 1)).alias(prefix + v) for v in values]
    return _keyed(df, key).agg(*flags)


def any_flag(condition: Column) -> Column:
    """Aggregate: 1 if the condition holds in any row, else 0."""
    return F.max(F.when(condition, 1).otherwise(0))


def one_hot_columns(
    column: str,
    values: Sequence,
    drop_first: bool = False,
    null_column: bool = False,
    prefix: str | None = None,
) -> dict[str, Column]:
    """0/1 expressions named ``column_value`` for each category, sorted.

    ``drop_first`` leaves out the first category; ``null_column`` adds one for null.
    """
    prefix = column if prefix is None else prefix
    kept = sorted(values)[1 if drop_first else 0 :]
    flags = {f"{prefix}_{v}": F.when(named(column) == v, 1).otherwise(0) for v in kept}
    if null_column:
        flags[f"{prefix}_nan"] = F.when(named(column).isNull(), 1).otherwise(0)
    return flags


def one_hot(
    df: DataFrame,
    column: str,
    values: Sequence | None = None,
    drop_first: bool = False,
    null_column: bool = False,
    prefix: str | None = None,
) -> DataFrame:
    """Replace a category by its 0/1 columns; values are looked up when not given."""
    values = distinct_values(df, named(column)) if values is None else values
    flags = one_hot_columns(column, values, drop_first, null_column, prefix)
    return df.withColumns(flags).drop(column)


def widened(
    long: DataFrame,
    keys: Sequence[str],
    field: str,
    value: str,
    fields: Sequence[str],
    range_column: str | None = None,
    ranges: Sequence[str] | None = None,
) -> DataFrame:
    """Long (keys, field, value) rows side by side, as a chain of left joins would put them.

    The chain starts with the first field that has any row, so its keys stay, and a key that has
    several rows of a field multiplies. With a ``range_column`` that holds within each range, of
    which ``ranges`` may list those asked for.

    Keys with at most one row per field, nearly all, take one grouping in place of one join per
    field; only keys with several rows of a field go through the joins.
    """
    by = ([range_column] if range_column else []) + list(keys)
    asked = long.where(named(field).isin(list(fields)))
    if range_column and ranges is not None:
        asked = asked.where(named(range_column).isin(list(ranges)))
    place = F.array_position(F.array(*map(F.lit, fields)), named(field))
    counts = [F.count_if(named(field) == f) for f in fields]
    wide = asked.groupBy(*map(named, by)).agg(
        F.min(place).alias("__place"),
        F.greatest(*counts, F.lit(0)).alias("__most"),
        *[F.min(F.when(named(field) == f, named(value))).alias(f) for f in fields],
    )
    group = named(range_column) if range_column else F.lit(0)
    anchors = asked.groupBy(group.alias("__group")).agg(F.min(place).alias("__anchor"))
    if not range_column or ranges is not None:
        anchors = F.broadcast(anchors)  # one row in all, or one per listed range
    match = group.eqNullSafe(F.col("__group")) & (F.col("__place") == F.col("__anchor"))
    kept = wide.join(anchors, match, "left_semi")
    single = kept.where("__most <= 1").drop("__place", "__most")
    several = kept.where("__most > 1").select(*map(named, by)).withColumnsRenamed(
        {c: f"__{i}" for i, c in enumerate(by)}
    )

    def same(other: Sequence[str]) -> Column:
        condition = F.lit(True)
        for mine, theirs in zip(by, other):
            condition = condition & named(mine).eqNullSafe(F.col(theirs))
        return condition

    inner = [f"__{i}" for i in range(len(by))]
    rows = asked.join(several, same(inner), "left_semi")
    multiplied = several.toDF(*by)
    for f in fields:
        side = rows.where(named(field) == f).select(
            *[named(c).alias(n) for c, n in zip(by, inner)], named(value).alias(f)
        )
        multiplied = multiplied.join(side, same(inner), "left").drop(*inner)
    return single.unionByName(multiplied)


def label_rates(df: DataFrame, columns: Sequence[str], label: str) -> DataFrame:
    """Per category value of each column: rows and share of positive labels."""
    from custvalue.operators.profile import long_values

    return (
        long_values(df, columns, keep=[label])
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"), F.avg(named(label).cast("double")).alias("label_rate"))
    )


def group_values(df: DataFrame, key: str, values: Mapping[str, Column]) -> DataFrame:
    """One row per key with the given aggregates."""
    return _keyed(df, key).agg(*[v.alias(n) for n, v in values.items()])
