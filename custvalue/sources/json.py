"""JSON answers of web services that were landed as files."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.nulls import named

# The fields of the landed records, by the names the service gives them.
PAGE_OF_CONTACTS = "pages int, items array<struct<id: bigint, firstName: string, lastName: string>>"
CONTACT_DETAIL = """
item struct<
  id: bigint,
  emails: array<struct<location: string, value: string>>,
  socialProfiles: array<struct<type: string, value: string>>,
  websites: array<struct<value: string>>,
  chats: array<struct<type: string>>,
  phones: array<struct<location: string, value: string>>,
  address: struct<city: string, country: string, postalCode: string, state: string>>
"""
CONVERSATIONS = """
items array<struct<id: bigint, customer: struct<id: bigint>, createdAt: string, closedAt: string>>
"""
HEADER_AND_ROWS = "columnHeaders array<struct<name: string>>, rows array<array<string>>"


def read_json(
    spark: SparkSession, path: str | list[str], schema: T.StructType | str, multiline: bool = False
) -> DataFrame:
    """JSON files, one document per line, or one per file (``multiline``), which is one task's
    work each."""
    return spark.read.schema(schema).json(path, multiLine=multiline)


def page_items(pages: DataFrame, items: str = "items") -> DataFrame:
    """One row per item of paged answers; items that came twice count once."""
    item = pages.select(F.explode(named(items)).alias("item"))
    return item.select("item.*").dropDuplicates()


def parsed(text: Column, schema: T.StructType | str) -> Column:
    """JSON text as a nested record, null when it is not valid."""
    return F.from_json(text, schema)


def header_rows(answers: DataFrame, columns: Sequence[str], keep: Sequence[str] = ()) -> DataFrame:
    """Header-and-rows answers as a table with the named columns.

    Answers with different headers may be mixed: a column an answer lacks is null.
    ``keep`` carries columns beside the answer, such as its date range.
    """
    cells = answers.select(
        *keep,
        F.col("columnHeaders.name").alias("names"),
        F.explode("rows").alias("cells"),
    ).select(*keep, F.map_from_arrays("names", "cells").alias("cell"))
    return cells.select(*keep, *[F.col("cell")[name].alias(name) for name in columns])


def header_rows_long(
    answers: DataFrame, keys: Sequence[str], keep: Sequence[str] = ()
) -> DataFrame:
    """Header-and-rows answers as (keys…, field, value) rows, one per cell beside the keys."""
    cells = answers.select(
        *keep,
        F.col("columnHeaders.name").alias("names"),
        F.explode("rows").alias("cells"),
    ).select(*keep, F.map_from_arrays("names", "cells").alias("cell"))
    rest = F.map_filter("cell", lambda name, _: ~name.isin(list(keys)))
    return cells.select(
        *keep,
        *[F.col("cell")[key].alias(key) for key in keys],
        F.explode(rest).alias("field", "value"),
    )
