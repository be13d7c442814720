"""Projections: names, drops, casts."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.nulls import named
from custvalue.functions.text import normalized_name

# Parts of a column name that mark an indicator as useless for a model.
USELESS_NAME_PARTS = ("_nan", "_unknown", "@")


def prefixed(df: DataFrame, prefix: str) -> DataFrame:
    """Prefix every column name, nothing else."""
    return df.toDF(*[prefix + name for name in df.columns])


def normalized(df: DataFrame, prefix: str = "") -> DataFrame:
    """Prefixed names, trimmed, in lower case, with underscores for blanks."""
    return df.toDF(*[normalized_name(name, prefix) for name in df.columns])


def renamed(df: DataFrame, names: Mapping[str, str]) -> DataFrame:
    return df.withColumnsRenamed(dict(names))


def subset(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.select(*[named(c) for c in columns])


def without(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    return df.drop(*columns)


def without_useless_names(df: DataFrame, parts: Sequence[str] = USELESS_NAME_PARTS) -> DataFrame:
    """Drop columns whose name holds one of ``parts``."""
    return df.drop(*[c for c in df.columns if any(part in c for part in parts)])


def recast(df: DataFrame, types: Mapping[str, str], strict: bool = True) -> DataFrame:
    """Cast columns in place; with ``strict=False`` text that does not fit becomes null."""
    return df.withColumns(
        {c: named(c).cast(t) if strict else named(c).try_cast(t) for c, t in types.items()}
    )


def with_label(df: DataFrame, column: str, label: str = "label") -> DataFrame:
    """Take the target out of the features and put it in ``label`` as an integer."""
    return df.withColumn(label, F.coalesce(named(column), F.lit(0)).cast("int")).drop(column)
