"""Support load: tickets and open hours per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.nulls import at_least_zero, differs, named, sum_or_zero
from custvalue.functions.times import business_roll_forward, hours_between, parse_time
from custvalue.operators.joins import outer_join


def open_hours(created: Column, closed: Column) -> Column:
    """Hours from the first business moment after creation to closing, never below 0; an
    open ticket counts as 0."""
    return at_least_zero(hours_between(business_roll_forward(created), closed))


def _time(df: DataFrame, column: str) -> Column:
    text = isinstance(df.schema[column].dataType, T.StringType)
    return parse_time(named(column)) if text else named(column).cast("timestamp_ntz")


def ticket_hours(conversations: DataFrame) -> DataFrame:
    """(id, time_spent) per conversation; ``id`` is the customer's."""
    return conversations.select(
        named("customer")["id"].cast("bigint").alias("id"),
        open_hours(_time(conversations, "createdAt"), _time(conversations, "closedAt")).alias(
            "time_spent"
        ),
    )


def load_per_customer(conversations: DataFrame, test_ids: Sequence[int] = ()) -> DataFrame:
    """(id, number_support_tickets, time_spent): count and hours in one grouping."""
    hours = ticket_hours(conversations).where(F.col("id").isNotNull())
    for test in test_ids:
        hours = hours.where(differs(named("id"), test))
    return hours.groupBy("id").agg(
        F.count("*").alias("number_support_tickets"),
        sum_or_zero(F.col("time_spent")).alias("time_spent"),
    )


def support_load(
    contacts: DataFrame, conversations: DataFrame, test_ids: Sequence[int] = ()
) -> DataFrame:
    """Contacts with ``number_support_tickets`` and ``time_spent`` hours.

    Customers known only from tickets get a row too; contacts without tickets hold nulls.
    """
    contacts = contacts.withColumn("id", named("id").cast("bigint"))
    for test in test_ids:
        contacts = contacts.where(differs(named("id"), test))
    return outer_join(contacts, load_per_customer(conversations, test_ids), "id")
