"""Feature preparation: fills, scaling, indicator columns, vectors."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import LinearRegression
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.functions.nulls import named
from custvalue.operators.aggregates import MAX_VALUES, one_hot_columns
from custvalue.operators.profile import long_values
from custvalue.session import cut_lineage, held

# The penalty of the small regressions that fill unknown numbers.
FILL_PENALTY = 0.1
FILL_L1_SHARE = 0.5

# Projections stack up in the imputation loop; cut the lineage after this many.
_COLUMNS_PER_CUT = 8


def column_means(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Means of all columns in one pass; a single row comes to the driver."""
    if not columns:
        return {}
    row = df.agg(*[F.avg(named(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


def column_spreads(df: DataFrame, columns: Sequence[str]) -> dict[str, float | None]:
    """Sample deviations of the known values of all columns in one pass."""
    if not columns:
        return {}
    row = df.agg(*[F.stddev_samp(named(c)).alias(str(i)) for i, c in enumerate(columns)]).first()
    return dict(zip(columns, row))


def _filled(column: str, mean: float | None) -> Column:
    number = named(column).cast("double")
    return number if mean is None else F.coalesce(number, F.lit(mean))


def mean_filled(
    df: DataFrame, columns: Sequence[str], means: dict[str, float | None] | None = None
) -> DataFrame:
    """Nulls of numeric columns become the column mean; ``means`` may come from other rows."""
    means = column_means(df, columns) if means is None else means
    return df.withColumns({c: _filled(c, means[c]) for c in columns})


def null_counts(df: DataFrame, columns: Sequence[str]) -> dict[str, int]:
    if not columns:
        return {}
    row = df.agg(
        *[F.count_if(named(c).isNull()).alias(str(i)) for i, c in enumerate(columns)]
    ).first()
    return dict(zip(columns, row))


def without_null_columns(
    train: DataFrame, test: DataFrame, columns: Sequence[str]
) -> tuple[DataFrame, DataFrame, list[str]]:
    """Drop the columns that hold a null in either part; also returns the kept columns."""
    in_train, in_test = null_counts(train, columns), null_counts(test, columns)
    gone = [c for c in columns if in_train[c] or in_test[c]]
    return train.drop(*gone), test.drop(*gone), [c for c in columns if c not in gone]


def as_vectors(
    df: DataFrame, features: Sequence[str], keep: Sequence[str] = (), output: str = "features"
) -> DataFrame:
    """``keep`` columns and one vector column. Names are replaced on the way, as feature
    names hold characters that Spark ML would read as paths."""
    inner = [f"__f{i}" for i in range(len(features))]
    numbers = [named(c).cast("double").alias(n) for c, n in zip(features, inner)]
    assembler = VectorAssembler(inputCols=inner, outputCol=output, handleInvalid="error")
    return assembler.transform(df.select(*map(named, keep), *numbers)).drop(*inner)


def elastic_net(label: str, spread: float, penalty: float, l1_share: float) -> LinearRegression:
    """Least squares / 2n + penalty * (l1_share * |w| + (1 - l1_share) / 2 * w^2).

    Spark divides both penalty parts by the spread of the label, which has to be undone for
    the squared part. The normal-equation solver takes one pass over the rows.
    """
    l1 = penalty * l1_share
    total = l1 + penalty * (1 - l1_share) * spread
    return LinearRegression(
        labelCol=label,
        regParam=total,
        elasticNetParam=l1 / total if total else 0.0,
        standardization=False,
        solver="auto",
        maxIter=1000,
        tol=1e-10,
    )


def predict_missing(
    train: DataFrame,
    test: DataFrame,
    targets: Sequence[str],
    features: Sequence[str],
    penalty: float = FILL_PENALTY,
    l1_share: float = FILL_L1_SHARE,
) -> tuple[DataFrame, DataFrame]:
    """Fill unknown numbers with an elastic net on all other feature columns.

    Each model learns from the train rows where its column is known, with unknown other
    columns at their train mean. Columns are filled one after another, so later models see
    earlier predictions. Known values are never touched, and both parts get the same model.
    A prediction is a sum over the nonzero coefficients: a projection, no shuffle.
    """
    means = column_means(train, features)
    spreads = column_spreads(train, targets)
    in_train, in_test = null_counts(train, targets), null_counts(test, targets)
    todo = [c for c in targets if in_train[c] or in_test[c]]
    for done, column in enumerate(todo, start=1):
        others = [c for c in features if c != column and means[c] is not None]
        known = train.where(named(column).isNotNull())
        label = named(column).cast("double")
        spread = spreads[column]
        if means[column] is None:
            continue
        guess = F.lit(means[column])
        if spread and others:
            rows = mean_filled(known.withColumn("__label", label), others, means)
            vectors = as_vectors(rows, others, keep=["__label"])
            model = elastic_net("__label", spread, penalty, l1_share).fit(vectors)
            guess = F.lit(float(model.intercept))
            for name, weight in zip(others, model.coefficients):
                if weight:
                    guess = guess + _filled(name, means[name]) * float(weight)
        fill = {column: F.coalesce(label, guess)}
        train, test = train.withColumns(fill), test.withColumns(fill)
        if done % _COLUMNS_PER_CUT == 0 and done < len(todo):
            train, test = cut_lineage(train), cut_lineage(test)
    return train, test


def scaling(df: DataFrame, columns: Sequence[str]) -> dict[str, tuple[float, float]]:
    """Mean and population deviation per column; a deviation of 0 counts as 1."""
    cells = []
    for i, c in enumerate(columns):
        cells += [F.avg(named(c)).alias(f"{i}m"), F.stddev_pop(named(c)).alias(f"{i}s")]
    row = df.agg(*cells).first()
    return {c: (row[f"{i}m"], row[f"{i}s"] or 1.0) for i, c in enumerate(columns)}


def scaled(df: DataFrame, scales: dict[str, tuple[float, float]]) -> DataFrame:
    """Standard scores by means and deviations learnt with ``scaling``."""
    return df.withColumns({c: (named(c) - mean) / spread for c, (mean, spread) in scales.items()})


def category_values(
    df: DataFrame, columns: Sequence[str], limit: int = MAX_VALUES
) -> dict[str, list]:
    """Sorted known values of each column as text, all columns in two passes.

    Refuses a column with more than ``limit`` values before any value reaches the driver.
    """
    if not columns:
        return {}
    values = held(
        long_values(df, columns).where("value IS NOT NULL").groupBy("column", "value").agg(
            F.lit(1).alias("one")
        )
    )
    counts = values.groupBy("column").count().where(F.col("count") > limit).collect()
    wide = sorted(row.column for row in counts)
    found: dict[str, list] = {c: [] for c in columns}
    if not wide:
        for row in values.select("column", "value").collect():
            found[row.column].append(row.value)
    values.unpersist()
    if wide:
        raise ValueError(f"not categories, more than {limit} values: {', '.join(wide)}")
    return {c: sorted(v) for c, v in found.items()}


def dummies(df: DataFrame, columns: Sequence[str], limit: int = MAX_VALUES) -> DataFrame:
    """Replace each category by 0/1 columns without its first value; null gives all zeros."""
    values = category_values(df, columns, limit)
    flags = {}
    for c in columns:
        as_text = one_hot_columns(c, values[c], drop_first=True)
        flags.update(as_text)
    texts = {c: named(c).cast("string") for c in columns}
    return df.withColumns(texts).withColumns(flags).drop(*columns)
