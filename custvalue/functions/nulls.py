"""Null rules of data-frame code, stated as Spark expressions.

Numeric columns hold null, never NaN, past the reading step (see ``nan_to_null``).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The texts a CSV reader of that time takes for a missing cell.
DEFAULT_NULL_TOKENS = (
    "", "#N/A", "#N/A N/A", "#NA", "-1.#IND", "-1.#QNAN", "-NaN", "-nan", "1.#IND",
    "1.#QNAN", "N/A", "NA", "NULL", "NaN", "n/a", "nan", "null",
)


def named(column: str) -> Column:
    """A column by its exact name; names here hold dots, colons, blanks and dollar signs."""
    return F.col("`" + column.replace("`", "``") + "`")


def null_tokens(column: Column, extra: Sequence[str] = (), defaults: bool = True) -> Column:
    """Null where the text is a null token. ``extra`` adds to the default tokens."""
    tokens = [*(DEFAULT_NULL_TOKENS if defaults else ()), *extra]
    return F.when(~column.isin(tokens), column)


def nan_to_null(df: DataFrame) -> DataFrame:
    """NaN becomes null in every float column: Spark ranks NaN above every number."""
    floats = [f.name for f in df.schema if isinstance(f.dataType, (T.DoubleType, T.FloatType))]
    return df.withColumns({n: F.when(~F.isnan(named(n)), named(n)) for n in floats})


def differs(column: Column, value) -> Column:
    """``!=`` that keeps null rows: null differs from every value."""
    return ~column.eqNullSafe(F.lit(value))


def negated(condition: Column) -> Column:
    """Not ``condition``, where an unknown condition counts as false."""
    return ~F.coalesce(condition, F.lit(False))


def sum_or_zero(column: Column) -> Column:
    """Sum that is 0, not null, for a group without known values."""
    return F.coalesce(F.sum(column), F.lit(0))


def at_least_zero(column: Column) -> Column:
    """Clamp below at 0; null counts as 0, since it is not greater than 0."""
    return F.when(column > 0, column).otherwise(F.lit(0.0))


def first_known(column: Column, order: Column) -> Column:
    """Aggregate: the known value that comes first by ``order``.

    Pre-aggregates on the map side, so a key with a third of all rows costs one row per task.
    """
    return F.min_by(column, F.when(column.isNotNull(), order))


def latest_known(column: Column, order: Column) -> Column:
    """Aggregate: the known value that comes last by ``order``."""
    return F.max_by(column, F.when(column.isNotNull(), order))
