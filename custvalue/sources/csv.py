"""CSV in and out.

A cell is read as text, null tokens are removed, then each column is cast to its declared or
inferred type, because Spark's own ``nullValue`` option knows one token only and its inference
takes the tokens for text. A cell that does not fit its type is an error unless asked otherwise.
"""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.nulls import named, nan_to_null, null_tokens

_SURPLUS, _RAW = "__surplus", "__raw"


def _as_schema(schema: T.StructType | str) -> T.StructType:
    return schema if isinstance(schema, T.StructType) else T.StructType.fromDDL(schema)


# Tried in this order for columns without a declared type; what fits none is text.
_INFERRED = ("int", "bigint", "double", "boolean")


def _typed(
    df: DataFrame, schema: T.StructType, tokens: Sequence[str], bad_cells: str
) -> DataFrame:
    cells = []
    for f in schema:
        text = null_tokens(named(f.name), tokens)
        cell = text.try_cast(f.dataType)
        if bad_cells == "error" and not isinstance(f.dataType, T.StringType):
            wrong = F.concat(F.lit(f"column {f.name} is no {f.dataType.simpleString()}: "), text)
            cell = F.when(text.isNotNull() & cell.isNull(), F.raise_error(wrong)).otherwise(cell)
        cells.append(cell.cast(f.dataType).alias(f.name))
    return nan_to_null(df.select(*cells))


def _text_rows(spark: SparkSession, path, names: Sequence[str], multiline: bool) -> DataFrame:
    text = T.StructType([T.StructField(n, T.StringType()) for n in names])
    return spark.read.options(header=True, multiLine=multiline, escape='"').schema(text).csv(path)


def inferred_schema(rows: DataFrame, null_values: Sequence[str] = ()) -> T.StructType:
    """The narrowest type that fits every known cell of each text column, in one aggregate."""
    counts = []
    for i, name in enumerate(rows.columns):
        text = null_tokens(named(name), null_values)
        counts.append(F.count(text).alias(f"{i}"))
        counts += [F.count(text.try_cast(kind)).alias(f"{i}{kind}") for kind in _INFERRED]
    found = rows.agg(*counts).first()
    fields = []
    for i, name in enumerate(rows.columns):
        fits = [k for k in _INFERRED if found[f"{i}{k}"] == found[f"{i}"]] if found[f"{i}"] else []
        fields.append(f"`{name.replace('`', '``')}` {fits[0] if fits else 'string'}")
    return T.StructType.fromDDL(", ".join(fields))


def bad_cell_counts(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str,
    null_values: Sequence[str] = (),
    multiline: bool = False,
) -> dict[str, int]:
    """Per column the known cells that do not fit its type, in one pass."""
    schema = _as_schema(schema)
    rows = _text_rows(spark, path, [f.name for f in schema], multiline)
    counts = []
    for i, f in enumerate(schema):
        text = null_tokens(named(f.name), null_values)
        counts.append(
            F.count_if(text.isNotNull() & text.try_cast(f.dataType).isNull()).alias(f"{i}")
        )
    return dict(zip((f.name for f in schema), rows.agg(*counts).first()))


def read_csv(
    spark: SparkSession,
    path: str | list[str],
    schema: T.StructType | str | None = None,
    null_values: Sequence[str] = (),
    skip_long_rows: bool = False,
    multiline: bool = False,
    bad_cells: str = "error",
) -> DataFrame:
    """CSV with a header row; ``null_values`` adds to the default null tokens.

    Give ``schema`` (one entry per file column, in file order) for anything that matters;
    without it types are inferred in an extra pass, after null tokens are gone. All files of
    ``path`` must share one header: use ``read_csv_layouts`` for files that differ.
    ``multiline`` allows line breaks inside quotes; each file is then one task's work.
    ``skip_long_rows`` drops rows with more fields than columns; short rows stay, filled
    with nulls. ``bad_cells`` says what becomes of a cell that does not fit its type: an
    "error", or "null" (``bad_cell_counts`` tells how many).
    """
    if bad_cells not in ("error", "null"):
        raise ValueError(f"unknown treatment of bad cells: {bad_cells}")
    if schema is None:
        names = spark.read.options(header=True, escape='"', multiLine=multiline).csv(path).columns
        schema = inferred_schema(_text_rows(spark, path, names, multiline), null_values)
    schema = _as_schema(schema)
    names = [f.name for f in schema]
    if not skip_long_rows:
        rows = _text_rows(spark, path, names, multiline)
        return _typed(rows, schema, null_values, bad_cells)
    # Read with one column more than the file has: then a row of the right width or shorter is
    # kept as raw text too, and a row that fills the surplus column is not. In the raw text
    # the separators outside quotes tell the width.
    wide = T.StructType([T.StructField(n, T.StringType()) for n in (*names, _SURPLUS, _RAW)])
    rows = (
        spark.read.options(
            header=True, multiLine=multiline, escape='"', mode="PERMISSIVE",
            columnNameOfCorruptRecord=_RAW, columnPruning=False,
        )
        .schema(wide)
        .csv(path)
    )
    separators = F.regexp_count(F.regexp_replace(named(_RAW), '"([^"]|"")*"', ""), F.lit(","))
    fits = named(_SURPLUS).isNull() & named(_RAW).isNotNull() & (separators < len(schema))
    return _typed(rows.where(fits), schema, null_values, bad_cells)


def union_all_by_name(frames: Iterable[DataFrame]) -> DataFrame:
    """All rows of all frames; columns meet by name and missing ones are null."""
    return reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), frames)


def read_csv_layouts(
    spark: SparkSession,
    layouts: Sequence[tuple[list[str], T.StructType | str]],
    null_values: Sequence[str] = (),
    multiline: bool = False,
) -> DataFrame:
    """Files of several layouts: one scan per layout, joined up by column name."""
    return union_all_by_name(
        read_csv(spark, paths, schema, null_values, multiline=multiline)
        for paths, schema in layouts
    )


def write_csv(
    df: DataFrame, path: str, partition_by: Sequence[str] = (), keep_others: bool = False
) -> None:
    """CSV folder with header; nested cells go out as JSON text.

    ``partition_by`` gives one export per value, such as one per date range. With ``keep_others``
    only the exports of values that occur in ``df`` are replaced.
    """
    nested = (T.ArrayType, T.MapType, T.StructType)
    cells = [
        (F.to_json(named(f.name)).alias(f.name) if isinstance(f.dataType, nested) else named(f.name))
        for f in df.schema
    ]
    writer = df.select(*cells).write.mode("overwrite").option("escape", '"')
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    if keep_others:
        writer = writer.option("partitionOverwriteMode", "dynamic")
    writer.csv(path, header=True)
