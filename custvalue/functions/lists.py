"""List and nested-record functions."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column
from pyspark.sql import functions as F


def first_item(items: Column) -> Column:
    """First element, null for an empty or missing list."""
    return F.try_element_at(items, F.lit(1))


def distinct_items(items: Column) -> Column:
    """Each item once; empty for null."""
    return F.coalesce(F.array_distinct(items), F.array())


def item_field(records: Column, field: str) -> Column:
    """One field out of each record of a list; null when the list is missing."""
    return F.transform(records, lambda record: record[field])


def nested_field(record: Column, path: Iterable[str]) -> Column:
    """Field of a nested record, null when any part of the way is missing."""
    for part in path:
        record = record[part]
    return record


def indicator(items: Column, value: str) -> Column:
    """1 when the list holds ``value``, null otherwise."""
    return F.when(F.array_contains(items, F.lit(value)), F.lit(1))
