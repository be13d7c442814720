"""Table profile: nulls, identifiers, constants, column kinds, counts, distributions.

The profile looks at all columns in a fixed number of passes, not in one pass per column.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.nulls import named
from custvalue.operators.quantiles import exact_percentiles

# The limits and names the profile goes by.
IDENTIFIER_PARTS = ("id", "email", "name")
SAMPLE_SIZE = 20
MAX_CATEGORICAL_DISTINCT = 3
FEW_DISTINCT = 10
MAX_PLOTTED_DISTINCT = 100
QUARTILES = (0.25, 0.5, 0.75)

_GLANCE_ROWS = 1000

_NUMERIC = (T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.ShortType, T.ByteType)


def numeric_columns(df: DataFrame) -> list[str]:
    return [f.name for f in df.schema if isinstance(f.dataType, _NUMERIC)]


def text_of(column: str):
    return named(column).cast("string")


def long_values(df: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """(keep…, column, value) rows, values as text."""
    pairs = [F.struct(F.lit(c).alias("column"), text_of(c).alias("value")) for c in columns]
    exploded = df.select(*map(named, keep), F.explode(F.array(*pairs)).alias("pair"))
    return exploded.select(*map(named, keep), "pair.column", "pair.value")


def long_numbers(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    pairs = [
        F.struct(F.lit(c).alias("column"), named(c).cast("double").alias("value")) for c in columns
    ]
    return df.select(F.explode(F.array(*pairs)).alias("pair")).select("pair.column", "pair.value")


def _melted(one_row: DataFrame, columns: Sequence[str], fields: Sequence[str]) -> DataFrame:
    """A single row of ``i_field`` cells as one row per column."""
    records = [
        F.struct(
            F.lit(c).alias("column"),
            *[F.col(f"{i}_{field}").alias(field) for field in fields],
        )
        for i, c in enumerate(columns)
    ]
    return one_row.select(F.explode(F.array(*records)).alias("r")).select("r.*")


def null_share(df: DataFrame) -> DataFrame:
    """Share of null cells per column, one pass."""
    cells = [
        F.avg(named(c).isNull().cast("double")).alias(f"{i}_null_share")
        for i, c in enumerate(df.columns)
    ]
    return _melted(df.agg(*cells), df.columns, ["null_share"])


def seen_distinct(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    """Distinct known values among some rows: a lower bound for the whole table.

    A column that already shows too many values there needs no pass over all rows, so the
    passes that follow read only the columns still in question.
    """
    if not columns:
        return {}
    some = df.select(*map(named, columns)).limit(_GLANCE_ROWS)
    cells = [F.size(F.collect_set(named(c))).alias(str(i)) for i, c in enumerate(columns)]
    return dict(zip(columns, some.agg(*cells).first()))


def constant_columns(df: DataFrame) -> DataFrame:
    """Columns with one value, or with one value and null.

    Least equals greatest over all rows, asked only of columns that show a single value at a
    glance: one pass over few columns and no distinct count.
    """
    seen = seen_distinct(df, df.columns)
    columns = [c for c in df.columns if seen[c] <= 1]
    if not columns:
        return df.sparkSession.createDataFrame(
            [], "column string, value string, has_null boolean"
        )
    cells = []
    for i, c in enumerate(columns):
        cells += [
            F.min(named(c)).cast("string").alias(f"{i}_least"),
            F.max(named(c)).eqNullSafe(F.min(named(c))).alias(f"{i}_constant"),
            F.max(named(c).isNull()).alias(f"{i}_has_null"),
        ]
    fields = ["least", "constant", "has_null"]
    found = _melted(df.agg(*cells), columns, fields)
    return found.where(F.col("constant") & F.col("has_null").isNotNull()).select(
        "column", F.col("least").alias("value"), "has_null"
    )


def identifier_columns(df: DataFrame) -> list[str]:
    return [c for c in df.columns if any(part in c for part in IDENTIFIER_PARTS)]


def identifier_profile(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Exact distinct count, null being a value, and the 20 least values per identifier column.

    The distinct values are counted where they lie; the window keeps 20 rows per task and
    column before it shuffles, so no task sees a whole column.
    """
    columns = identifier_columns(df) if columns is None else columns
    values = long_values(df, columns).groupBy("column", "value").agg(F.lit(1).alias("one"))
    counts = values.groupBy("column").agg(F.sum("one").alias("n_distinct"))
    least = Window.partitionBy("column").orderBy(F.asc_nulls_last("value"))
    sample = (
        values.select("column", "value", F.row_number().over(least).alias("place"))
        .where(F.col("place") <= SAMPLE_SIZE)
        .groupBy("column")
        .agg(F.sort_array(F.collect_list("value")).alias("sample"))
    )
    return counts.join(sample, "column")


def distinct_up_to(df: DataFrame, columns: Sequence[str], limit: int) -> dict[str, int]:
    """Exact distinct counts, null being a value, of the columns with at most ``limit``.

    Columns that show more at a glance are ruled out; the others are counted together, their
    distinct values where they lie.
    """
    seen = seen_distinct(df, columns)
    close = [c for c in columns if seen[c] <= limit]
    if not close:
        return {}
    values = long_values(df, close).groupBy("column", "value").agg(F.lit(1).alias("one"))
    found = dict.fromkeys(close, 0)
    found |= {row.column: row["count"] for row in values.groupBy("column").count().collect()}
    return {c: n for c, n in found.items() if n <= limit}


def split_kinds(df: DataFrame) -> tuple[list[str], list[str]]:
    """(numeric, categorical) columns: a number with at most three values is a category."""
    numbers = numeric_columns(df)
    few = distinct_up_to(df, numbers, MAX_CATEGORICAL_DISTINCT)
    numeric = [c for c in numbers if c not in few]
    return numeric, [c for c in df.columns if c not in numeric]


def column_kinds(df: DataFrame) -> DataFrame:
    """Kind of each column, and whether a numeric one looks like a category after all."""
    numbers = numeric_columns(df)
    few = distinct_up_to(df, numbers, FEW_DISTINCT - 1)
    rows = []
    for c in df.columns:
        numeric = c in numbers and few.get(c, FEW_DISTINCT) > MAX_CATEGORICAL_DISTINCT
        looks = numeric and (c in few or "id" in c)
        rows.append((c, "numeric" if numeric else "categorical", int(looks)))
    return df.sparkSession.createDataFrame(
        rows, "column string, kind string, looks_categorical int"
    )


def quartiles(df: DataFrame, columns: Sequence[str] | None = None) -> DataFrame:
    """Quartiles of numeric columns after nulls are filled with the column mean."""
    from custvalue.operators.features import mean_filled

    columns = numeric_columns(df) if columns is None else list(columns)
    numbers = long_numbers(mean_filled(df.select(*map(named, columns)), columns), columns)
    found = exact_percentiles(numbers, "value", QUARTILES, ["column"], few_groups=True)
    return found.select(
        "column",
        *[F.col("percentiles")[i].alias(n) for i, n in enumerate(("p25", "p50", "p75"))],
    )


def plottable_columns(df: DataFrame, columns: Sequence[str]) -> list[str]:
    """Columns with at most 100 distinct values, null being one."""
    few = distinct_up_to(df, columns, MAX_PLOTTED_DISTINCT)
    return [c for c in columns if c in few]


def category_counts(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per known value of each column with at most 100 distinct values."""
    columns = plottable_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame([], "column string, value string, n bigint")
    return (
        long_values(df, columns)
        .where("value IS NOT NULL")
        .groupBy("column", "value")
        .agg(F.count("*").alias("n"))
    )


def target_by_category(df: DataFrame, columns: Sequence[str], target: str) -> DataFrame:
    """Distribution of a target per known value of each column with at most 100 values.

    At most 100 groups per column, so their wanted buckets are few. The table is read several
    times: hand in a snapshot when it takes joins to make it.
    """
    columns = plottable_columns(df, columns)
    if not columns:
        return df.sparkSession.createDataFrame(
            [],
            "column string, value string, n bigint, least double, p25 double, p50 double, "
            "p75 double, greatest double",
        )
    values = (
        long_values(df, columns, keep=[target])
        .withColumn("target", named(target).cast("double"))
        .where(F.col("value").isNotNull() & F.col("target").isNotNull())
    )
    by = ["column", "value"]
    found = exact_percentiles(values, "target", (0.0, *QUARTILES, 1.0), by, few_groups=True)
    names = ("least", "p25", "p50", "p75", "greatest")
    return found.select(
        *by, "n", *[F.col("percentiles")[i].alias(name) for i, name in enumerate(names)]
    )


def histogram(df: DataFrame, column: str, bins: int) -> DataFrame:
    """Rows per bin of equal width between the least and the greatest value."""
    number = named(column).cast("double")
    least, greatest = df.agg(F.min(number), F.max(number)).first()
    known = df.where(number.isNotNull())
    if least is None or least == greatest:
        bin_number = F.lit(1)
    else:
        place = F.floor((number - least) / (greatest - least) * bins) + 1
        bin_number = F.least(place, F.lit(bins))
    return known.groupBy(bin_number.cast("int").alias("bin")).agg(F.count("*").alias("n"))


def profile_report(df: DataFrame, target: str | None = None) -> dict[str, DataFrame]:
    """Every part of the profile by name."""
    numeric, categorical = split_kinds(df)
    parts = {
        "null_share": null_share(df),
        "identifiers": identifier_profile(df),
        "constants": constant_columns(df),
        "kinds": column_kinds(df),
        "quartiles": quartiles(df, numeric),
        "category_counts": category_counts(df, categorical),
    }
    if target is not None:
        others = [c for c in categorical if c != target]
        parts["target_by_category"] = target_by_category(df, others, target)
    return parts
