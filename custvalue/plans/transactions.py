"""Payments: web analytics beside them, and one row per customer."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from custvalue.functions.nulls import differs, latest_known, named, sum_or_zero
from custvalue.functions.text import license_names, normalized_name
from custvalue.functions.times import parse_time
from custvalue.operators.aggregates import any_flag, first_known_per_key, item_values
from custvalue.operators.columns import prefixed
from custvalue.operators.filters import without_ids
from custvalue.operators.joins import left_join, suffixed_join

# Names and marks in the payment export and in the analytics tables.
PREFIX = "EDD:"
ANALYTICS_ID = "ga:transactionId"
COMPLETE = "complete"
TEST_METHOD = "Test Payment"
NO_CODE = "none"


def enrich_transactions(
    payments: DataFrame, analytics: Sequence[DataFrame], order_by: Sequence[str]
) -> DataFrame:
    """Payments with one row of web analytics each.

    Every analytics table is cut down to one row per transaction before it is joined: first
    known values by ``order_by``. Tables meet by full join, clashing columns get suffixes.
    """
    reduced = [first_known_per_key(table, ANALYTICS_ID, order_by) for table in analytics]
    together = reduced[0].drop(*order_by)
    for table in reduced[1:]:
        together = suffixed_join(together, table.drop(*order_by), ANALYTICS_ID, how="full")
    payment_id = PREFIX + "Payment ID"
    payments = prefixed(payments, PREFIX)
    wanted = payments.schema[payment_id].dataType
    if together.schema[ANALYTICS_ID].dataType != wanted:
        as_id = named(ANALYTICS_ID).cast("string").try_cast(wanted)
        together = together.withColumn(ANALYTICS_ID, as_id)
    return left_join(payments, together, payment_id, ANALYTICS_ID)


def paid_transactions(transactions: DataFrame, renewals: DataFrame) -> DataFrame:
    """Completed payments that are neither renewals nor tests; an unknown method is no test."""
    complete = transactions.where(named(PREFIX + "Status") == COMPLETE)
    kept = complete.where(differs(named(PREFIX + "Payment Method"), TEST_METHOD))
    return without_ids(kept, PREFIX + "Payment ID", renewals)


def customer_purchases(
    transactions: DataFrame,
    renewals: DataFrame,
    licenses: Sequence[str] | None = None,
    methods: Sequence[str] | None = None,
) -> DataFrame:
    """One row per e-mail: total spent, licence and payment-method flags, latest known values.

    One shuffle of the transactions: total, sets of categories and latest values are all
    aggregates of the same group, each pre-aggregated on the map side. ``licenses`` and
    ``methods`` are looked up in its result when not given.
    """
    method_of = named(PREFIX + "Payment Method")
    email, method = PREFIX + "Email", PREFIX + "Payment Method"
    date, amount = PREFIX + "Date", PREFIX + "Amount ($)"
    paid = paid_transactions(transactions, renewals).withColumn(
        "__licenses", license_names(named(PREFIX + "Products (Verbose)"))
    )
    if isinstance(paid.schema[date].dataType, T.StringType):
        paid = paid.withColumn(date, parse_time(named(date)))
    latest = F.struct(named(date), named(PREFIX + "Payment ID"))
    used = differs(named(PREFIX + "Discount Code"), NO_CODE)
    values = {
        "EDD:total_spent": sum_or_zero(named(amount)),
        "EDD:used_code": latest_known(used, latest),
        "__licenses": F.array_distinct(F.flatten(F.collect_set("__licenses"))),
        "__methods": F.collect_set(method_of),
        "__no_method": any_flag(named(method).isNull()),
    }
    for column in transactions.columns:
        if column not in (email, method, amount):
            values[column] = latest_known(named(column), latest)
    rows = paid.where(named(email).isNotNull()).groupBy(named(email))
    # Flags are looked up in each customer's sets, which hold categories only.
    found = rows.agg(*[v.alias(n) for n, v in values.items()])
    if licenses is None or methods is None:
        # One row per customer: kept for the lists and for the result.
        found = found.persist()
        licenses = item_values(found, "__licenses") if licenses is None else licenses
        methods = item_values(found, "__methods") if methods is None else methods
    flags = {f"EDD:licenses_{n}": F.array_contains("__licenses", n) for n in licenses}
    flags |= {f"{method}_{n}": F.array_contains("__methods", n) for n in methods}
    flags = {n: F.coalesce(c.cast("int"), F.lit(0)) for n, c in flags.items()}
    flags[f"{method}_nan"] = F.col("__no_method")
    order = ["EDD:total_spent", "EDD:used_code", *flags]
    order += [c for c in values if c not in order and not c.startswith("__")]
    found = found.withColumns(flags).select(
        named(email).alias(normalized_name(email)),
        *[named(c).alias(normalized_name(c)) for c in order],
    )
    return found
