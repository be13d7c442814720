"""Row filters."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.nulls import named, negated
from custvalue.functions.text import is_digits

# Fixed value: the key of the meta rows that mark a payment as a renewal.
RENEWAL_KEY = "_edd_sl_is_renewal"


def renewal_ids(meta: DataFrame, key: str = RENEWAL_KEY) -> DataFrame:
    """Payment ids marked as renewals; meta rows without a numeric id are broken and left out."""
    return (
        meta.where(is_digits(named("meta_id").cast("string")))
        .where(named("meta_key") == key)
        .select(named("post_id").try_cast("bigint").alias("payment_id"))
    )


def without_ids(df: DataFrame, column: str, ids: DataFrame) -> DataFrame:
    """Rows whose id is not in the single column of ``ids``; rows with a null id stay."""
    listed = ids.select(named(ids.columns[0]).cast(df.schema[column].dataType).alias("__id"))
    return df.join(listed, named(column) == F.col("__id"), "left_anti")


def without_listed(df: DataFrame, column: str, values: Sequence[str]) -> DataFrame:
    """Rows whose value is not in a short list handed in by the caller; null rows stay."""
    return df.where(negated(named(column).isin(list(values))))


def without_free_manual(df: DataFrame, revenue: str, manual: str) -> DataFrame:
    """Leave out manual purchases of no revenue; unknown values do not count as such."""
    return df.where(negated((named(revenue) == 0) & (named(manual) == 1)))


def known_points(df: DataFrame, latitude: str) -> DataFrame:
    """Rows with a known latitude other than zero."""
    column = named(latitude).cast("double")
    return df.where(column.isNotNull() & ~F.isnan(column) & (column != 0))


def in_range(column: Column, start: Column, end: Column) -> Column:
    """Half-open range, so that ranges laid side by side share no row and miss none."""
    return (column >= start) & (column < end)


def null_rows(df: DataFrame, column: str) -> tuple[DataFrame, DataFrame]:
    """(rows with a known value, rows without one)."""
    return df.where(named(column).isNotNull()), df.where(named(column).isNull())
