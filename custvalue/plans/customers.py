"""The customer table: every source joined, cleaned, and priced."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.functions.nulls import named
from custvalue.operators.aggregates import first_known_per_key
from custvalue.operators.columns import recast, renamed
from custvalue.operators.filters import without_free_manual, without_ids, without_listed
from custvalue.operators.joins import left_join, outer_join

# What a day with an open ticket costs, and hours per day.
LOSS_PER_DAY = 10.0
HOURS_PER_DAY = 24.0

EMAIL, DOMAIN = "revenue:email", "revenue:domain"


def _reduced(table: DataFrame, key: str, order: Sequence[str] | None) -> DataFrame:
    return table if order is None else first_known_per_key(table, key, order)


def join_sources(
    revenue: DataFrame,
    purchases: DataFrame,
    by_email: Sequence[tuple[DataFrame, str, Sequence[str] | None]] = (),
    by_domain: Sequence[tuple[DataFrame, str, Sequence[str] | None]] = (),
) -> DataFrame:
    """One row per e-mail of ``revenue`` with every source's columns.

    A source is (table, key column, order). Each is cut down to one row per key, first known
    values by its order (None only for a table already grouped by its key; purchases go by
    e-mail), before it is joined, so no join can multiply rows; that is the same
    as joining everything and then taking first known values per e-mail, without the
    multiplied rows in between. Joins are grouped by key: id, then e-mail (the grouping by
    e-mail already put the rows where these joins need them), then domain. The left side is
    shuffled three times however many sources there are. A shared mail domain is a hot key on
    the left: the domain sources are put together first, so that a single join meets it, which
    adaptive execution can split as nothing after it needs the rows by domain. Blank domains
    match nothing.
    """
    purchases = first_known_per_key(purchases, "edd:customer_id", ["edd:email"])
    customers = left_join(revenue, purchases, "revenue:id", "edd:customer_id")
    customers = first_known_per_key(customers, EMAIL, ["revenue:id"])
    for table, column, order in by_email:
        reduced = _reduced(table, column, order)
        customers = left_join(customers, reduced, EMAIL, column, skip_blank=True)
    domains = None
    for table, column, order in by_domain:
        reduced = _reduced(table, column, order).withColumn("__domain", named(column))
        domains = reduced if domains is None else outer_join(domains, reduced, "__domain")
    if domains is None:
        return customers
    joined = left_join(
        customers, domains, DOMAIN, "__domain", skip_blank=True, hot_keys=True
    )
    return joined.drop("__domain")


def with_adjusted_revenue(
    customers: DataFrame,
    revenue: str = "revenue:purchase_value",
    days_open: str = "helpscout:days_open",
    loss_per_day: float = LOSS_PER_DAY,
    no_ticket_fill: float | None = None,
) -> DataFrame:
    """Add ``helpscout:loss_per_customer`` and ``adjusted_revenue``.

    A customer without tickets has unknown loss and adjusted revenue, unless
    ``no_ticket_fill`` says how many days to count.
    """
    days = named(days_open).cast("double")
    if no_ticket_fill is not None:
        days = F.coalesce(days, F.lit(float(no_ticket_fill)))
    loss = days * loss_per_day
    return customers.withColumns(
        {
            "helpscout:loss_per_customer": loss,
            "adjusted_revenue": named(revenue).cast("double") - loss,
        }
    )


def clean_customers(
    customers: DataFrame,
    test_emails: DataFrame | Sequence[str] = (),
    names: Mapping[str, str] | None = None,
    flags: Sequence[str] = (),
    as_text: Sequence[str] = (),
    as_number: Sequence[str] = (),
    manual_flag: str = "edd:payment_method_manual_purchases",
    no_ticket_fill: float | None = None,
) -> DataFrame:
    """Drop test customers and gifts, fill flags, recast, price the support load.

    ``test_emails`` is a short list or a one-column table. ``flags`` are indicator columns
    whose null means 0.
    """
    if names:
        customers = renamed(customers, names)
    if isinstance(test_emails, DataFrame):
        customers = without_ids(customers, EMAIL, test_emails)
    elif test_emails:
        customers = without_listed(customers, EMAIL, test_emails)
    if manual_flag in customers.columns:
        customers = without_free_manual(customers, "revenue:purchase_value", manual_flag)
    customers = customers.withColumns({c: F.coalesce(named(c), F.lit(0)) for c in flags})
    types = {**dict.fromkeys(as_text, "string"), **dict.fromkeys(as_number, "double")}
    customers = recast(customers, types)
    if "helpscout:days_open" not in customers.columns:
        hours = named("helpscout:time_spent").cast("double")
        customers = customers.withColumn("helpscout:days_open", hours / HOURS_PER_DAY)
    return with_adjusted_revenue(customers, no_ticket_fill=no_ticket_fill)
