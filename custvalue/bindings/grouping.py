"""Queries for keyed aggregates, indicators, reshaping and the profile."""

from __future__ import annotations

from pyspark.sql import functions as F

from custvalue.bindings import standins as S
from custvalue.bindings.registry import query, table
from custvalue.functions import lists as L
from custvalue.operators import aggregates as A
from custvalue.operators import joins as J
from custvalue.operators import profile as P
from custvalue.operators.features import mean_filled, scaled, scaling

# --- first, latest, sums, counts ---------------------------------------------------------


# Some orders have no date: they come last.
_DATED_SQL = f"""{S.KNOWN_ORDERS_SQL}, dated AS (
  SELECT * REPLACE (CASE WHEN o_orderkey % 5 <> 0 THEN o_orderdate END AS o_orderdate) FROM known),
placed AS (SELECT *, row_number() OVER (PARTITION BY o_custkey
  ORDER BY o_orderdate NULLS LAST, o_orderkey) AS place FROM dated)"""


@query(
    f"WITH {_DATED_SQL} SELECT o_custkey, arg_min(o_orderkey, place) AS o_orderkey, "
    "arg_min(o_totalprice, place) FILTER (o_totalprice IS NOT NULL) AS o_totalprice, "
    "arg_min(o_orderpriority, place) FILTER (o_orderpriority IS NOT NULL) AS o_orderpriority "
    "FROM placed GROUP BY o_custkey"
)
def first_known(spark, sf):
    orders = S.known_orders(spark, sf).withColumn(
        "o_orderdate", F.when(F.col("o_orderkey") % 5 != 0, F.col("o_orderdate"))
    )
    first = A.first_known_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return first.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT o_custkey, "
    "arg_max(o_orderkey, (o_orderdate, o_orderkey)) AS o_orderkey, "
    "arg_max(o_totalprice, (o_orderdate, o_orderkey)) FILTER (o_totalprice IS NOT NULL) "
    "AS o_totalprice, "
    "arg_max(o_orderpriority, (o_orderdate, o_orderkey)) FILTER (o_orderpriority IS NOT NULL) "
    "AS o_orderpriority FROM known GROUP BY o_custkey"
)
def latest_known(spark, sf):
    orders = S.known_orders(spark, sf)
    latest = A.latest_known_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT o_custkey, o_orderkey, o_totalprice, o_orderpriority FROM "
    "(SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, "
    "o_orderkey DESC) AS place FROM known) WHERE place = 1"
)
def latest_row(spark, sf):
    orders = S.known_orders(spark, sf)
    latest = A.latest_row_per_key(orders, "o_custkey", ["o_orderdate", "o_orderkey"])
    return latest.select("o_custkey", "o_orderkey", "o_totalprice", "o_orderpriority")


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT o_orderkey, o_custkey, "
    "round(coalesce(sum(o_totalprice) OVER (PARTITION BY o_custkey), 0), 2) AS total_spent "
    "FROM known"
)
def total_spent(spark, sf):
    from custvalue.functions.nulls import sum_or_zero

    orders = S.known_orders(spark, sf).select("o_orderkey", "o_custkey", "o_totalprice")
    total = F.round(sum_or_zero(F.col("o_totalprice")), 2)
    return J.with_group_values(orders, "o_custkey", {"total_spent": total}).drop("o_totalprice")


@query(
    f"SELECT page_id, host, round(avg(page_id % 5) OVER (PARTITION BY host), 4) AS rating "
    f"FROM (SELECT page_id, {S.HOST_SQL} AS host FROM pages)"
)
def avg_rating(spark, sf):
    from custvalue.functions.text import url_host

    pages = table(spark, sf, "pages").select("page_id", url_host(F.col("url")).alias("host"))
    rating = F.round(F.avg(F.col("page_id") % 5), 4)
    return J.with_group_values(pages, "host", {"rating": rating})


@query("SELECT user_id, count(*) AS n_tickets FROM events GROUP BY 1")
def ticket_counts(spark, sf):
    return A.count_per_key(table(spark, sf, "events"), "user_id", "n_tickets")


@query("SELECT DISTINCT o_custkey, o_orderstatus, o_orderpriority FROM orders")
def distinct_rows(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.select("o_custkey", "o_orderstatus", "o_orderpriority").dropDuplicates()


# --- indicators and reshaping ------------------------------------------------------------

_METHODS = ["1-URGENT", "2-HIGH", "3-MEDIUM", "5-LOW"]


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT o_custkey, "
    + ", ".join(
        f"max(CASE WHEN o_orderpriority = '{m}' THEN 1 ELSE 0 END) AS \"method_{m}\"" for m in _METHODS
    )
    + ", max(CASE WHEN o_orderpriority IS NULL THEN 1 ELSE 0 END) AS method_nan "
    "FROM known GROUP BY o_custkey"
)
def payment_flags(spark, sf):
    orders = S.known_orders(spark, sf).select("o_custkey", "o_orderpriority")
    values = A.distinct_values(orders, F.col("o_orderpriority"))
    flags = A.one_hot_columns("o_orderpriority", values, null_column=True, prefix="method")
    return A.group_values(orders, "o_custkey", {name: F.max(flag) for name, flag in flags.items()})


@query(
    "SELECT conv_id, "
    + ", ".join(
        f"max(CASE WHEN role = '{r}' THEN 1 END) AS role_{r}" for r in ("assistant", "system", "user")
    )
    + ", count(DISTINCT role) AS n_roles FROM conversations GROUP BY 1"
)
def role_indicators(spark, sf):
    turns = table(spark, sf, "conversations").select("conv_id", "role")
    roles = A.distinct_values(turns, F.col("role"))
    flags = A.key_indicators(turns, "conv_id", "role", roles, prefix="role_")
    present = L.distinct_items(F.array_compact(F.array(*[
        F.when(F.col(f"role_{r}") == 1, F.lit(r)) for r in roles
    ])))
    return flags.withColumn("n_roles", F.size(present).cast("bigint"))


@query(
    "SELECT c_custkey, "
    + ", ".join(
        f"CAST(c_mktsegment = '{s}' AS INTEGER) AS \"segment_{s}\""
        for s in ("BUILDING", "FURNITURE", "HOUSEHOLD", "MACHINERY")
    )
    + " FROM customer"
)
def onehot_drop_first(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    return A.one_hot(customers, "c_mktsegment", drop_first=True, prefix="segment")


_METRICS = ["signup", "click", "error", "purchase", "view"]


def _widen_sql() -> str:
    """The chain of left joins, one field after the other, per day; then a day's first field."""
    sides = [f"f{i} AS (SELECT day, user_id, v FROM long WHERE event_type = '{m}')"
             for i, m in enumerate(_METRICS)]
    chains = []
    for first in range(len(_METRICS)):
        values = ", ".join(
            ("NULL" if i < first else f"f{i}.v") + f" AS {m}" for i, m in enumerate(_METRICS)
        )
        joins = " ".join(
            f"LEFT JOIN f{i} ON f{i}.day = f{first}.day AND f{i}.user_id = f{first}.user_id"
            for i in range(first + 1, len(_METRICS))
        )
        chains.append(
            f"SELECT f{first}.day, f{first}.user_id, {values} FROM f{first} {joins} "
            f"JOIN first_metric m ON m.day = f{first}.day AND m.p = {first + 1}"
        )
    return (
        "WITH long AS (SELECT strftime(ts, '%Y-%m-%d') AS day, user_id, event_type, "
        "round(value) AS v FROM events), first_metric AS (SELECT day, min(list_position("
        f"{_METRICS}, event_type)) AS p FROM long GROUP BY 1), " + ", ".join(sides) + " "
        + " UNION ALL ".join(chains)
    )


@query(_widen_sql())
def metric_widen(spark, sf):
    """Users have several events of a kind on a day: every combination is kept."""
    long = table(spark, sf, "events").select(
        F.col("ts").cast("date").cast("string").alias("day"), "user_id", "event_type",
        F.round("value").alias("value"),
    )
    return A.widened(long, ["user_id"], "event_type", "value", _METRICS, "day")


# --- profile -----------------------------------------------------------------------------


def _customer_names(spark, sf):
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("customer_id"),
        F.col("c_name").alias("full_name"),
        S.email().alias("email"),
        F.when(F.col("c_mktsegment") != "BUILDING", F.col("c_nationkey")).alias("nation_id"),
        "c_acctbal",
    )


def _identifier_sql(column: str, value: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", count(DISTINCT v) + max(CAST(v IS NULL AS INTEGER)) "
        "AS n_distinct, (SELECT string_agg(v, '|' ORDER BY v) FROM (SELECT DISTINCT v FROM "
        f"(SELECT CAST({value} AS VARCHAR) AS v FROM customer) WHERE v IS NOT NULL "
        f"ORDER BY v LIMIT 20)) AS sample FROM (SELECT CAST({value} AS VARCHAR) AS v FROM customer)"
    )


@query(
    " UNION ALL ".join(
        _identifier_sql(c, v)
        for c, v in (
            ("customer_id", "c_custkey"),
            ("full_name", "c_name"),
            ("email", S.EMAIL_SQL),
            ("nation_id", "CASE WHEN c_mktsegment <> 'BUILDING' THEN c_nationkey END"),
        )
    )
)
def identifier_profile(spark, sf):
    found = P.identifier_profile(_customer_names(spark, sf))
    return found.select("column", "n_distinct", F.array_join("sample", "|").alias("sample"))


@query(
    "WITH lines AS (SELECT *, 'x' AS one, CASE WHEN l_quantity > 10 THEN 7 END AS one_or_none "
    "FROM lineitem) "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", max(CAST({c} AS VARCHAR)) AS value, "
        f"max(CAST({c} IS NULL AS INTEGER)) AS has_null FROM lines "
        f"HAVING count(DISTINCT {c}) = 1"
        for c in (
            "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity",
            "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus",
            "l_shipdate", "one", "one_or_none",
        )
    )
)
def constant_columns(spark, sf):
    lines = table(spark, sf, "lineitem").withColumns(
        {"one": F.lit("x"), "one_or_none": F.when(F.col("l_quantity") > 10, 7)}
    )
    found = P.constant_columns(lines)
    return found.select("column", "value", F.col("has_null").cast("int").alias("has_null"))


_ORDER_COLUMNS = [
    "o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority",
]


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} "
    + " UNION ALL ".join(
        f"SELECT '{c}' AS \"column\", round(avg(CASE WHEN {c} IS NULL THEN 1.0 ELSE 0.0 END), 6) "
        "AS null_share FROM known"
        for c in _ORDER_COLUMNS
    )
)
def null_share(spark, sf):
    shares = P.null_share(S.known_orders(spark, sf))
    return shares.select("column", F.round("null_share", 6).alias("null_share"))


_LINE_NUMBERS = [
    "l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice",
    "l_discount", "l_tax",
]
_LINE_TEXTS = ["l_returnflag", "l_linestatus", "l_shipdate"]


@query(
    " UNION ALL ".join(
        [
            f"SELECT '{c}' AS \"column\", CASE WHEN count(DISTINCT {c}) > 3 THEN 'numeric' "
            f"ELSE 'categorical' END AS kind, CASE WHEN count(DISTINCT {c}) > 3 AND "
            f"(count(DISTINCT {c}) < 10 OR {'TRUE' if 'id' in c else 'FALSE'}) THEN 1 ELSE 0 END "
            "AS looks_categorical FROM lineitem"
            for c in _LINE_NUMBERS
        ]
        + [
            f"SELECT '{c}', 'categorical', 0 FROM lineitem HAVING count(*) > 0"
            for c in _LINE_TEXTS
        ]
    )
)
def column_kinds(spark, sf):
    return P.column_kinds(table(spark, sf, "lineitem"))


@query(
    f"WITH {S.KNOWN_ORDERS_SQL}, filled AS (SELECT coalesce(o_totalprice, "
    "(SELECT avg(o_totalprice) FROM known)) AS p, CAST(o_custkey AS DOUBLE) AS c, "
    "CAST(o_orderkey AS DOUBLE) AS k FROM known) "
    + " UNION ALL ".join(
        f"SELECT '{name}' AS \"column\", round(quantile_cont({c}, 0.25), 4) AS p25, "
        f"round(quantile_cont({c}, 0.5), 4) AS p50, round(quantile_cont({c}, 0.75), 4) AS p75 "
        "FROM filled"
        for name, c in (("o_totalprice", "p"), ("o_custkey", "c"), ("o_orderkey", "k"))
    )
)
def quartiles(spark, sf):
    found = P.quartiles(S.known_orders(spark, sf))
    return found.select("column", *[F.round(c, 4).alias(c) for c in ("p25", "p50", "p75")])


@query(
    "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS n FROM customer "
    "GROUP BY 2 UNION ALL SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*) "
    "FROM customer GROUP BY 2"
)
def category_counts(spark, sf):
    customers = table(spark, sf, "customer")
    return P.category_counts(customers, customers.columns)


def _target_sql(column: str) -> str:
    return (
        f"SELECT '{column}' AS \"column\", CAST({column} AS VARCHAR) AS value, count(*) AS n, "
        "round(min(spent), 4) AS least, round(quantile_cont(spent, 0.25), 4) AS p25, "
        "round(quantile_cont(spent, 0.5), 4) AS p50, round(quantile_cont(spent, 0.75), 4) AS p75, "
        "round(max(spent), 4) AS greatest FROM spent GROUP BY 2"
    )


@query(
    "WITH spent AS (SELECT c_mktsegment, c_nationkey, sum(o_totalprice) AS spent FROM customer "
    "JOIN orders ON c_custkey = o_custkey GROUP BY c_custkey, c_mktsegment, c_nationkey) "
    + _target_sql("c_mktsegment")
    + " UNION ALL "
    + _target_sql("c_nationkey")
)
def target_by_category(spark, sf):
    customers = table(spark, sf, "customer")
    spent = table(spark, sf, "orders").groupBy("o_custkey").agg(F.sum("o_totalprice").alias("spent"))
    # The percentiles read their input several times: keep the join behind it from repeating.
    rows = customers.join(spent, F.col("c_custkey") == F.col("o_custkey")).persist()
    found = P.target_by_category(rows, customers.columns, "spent")
    numbers = [F.round(c, 4).alias(c) for c in ("least", "p25", "p50", "p75", "greatest")]
    return found.select("column", "value", "n", *numbers)


@query(
    "WITH ends AS (SELECT min(o_totalprice) AS lo, max(o_totalprice) AS hi FROM orders) "
    "SELECT CAST(least(floor((o_totalprice - lo) / (hi - lo) * 20) + 1, 20) AS INTEGER) AS bin, "
    "count(*) AS n FROM orders, ends GROUP BY 1"
)
def revenue_histogram(spark, sf):
    return P.histogram(table(spark, sf, "orders"), "o_totalprice", 20)


# --- numeric features --------------------------------------------------------------------


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, "
    "CAST(o_custkey AS DOUBLE) AS o_custkey, round(coalesce(o_totalprice, "
    "avg(o_totalprice) OVER ()), 4) AS o_totalprice FROM known"
)
def mean_fill(spark, sf):
    orders = S.known_orders(spark, sf)
    numbers = P.numeric_columns(orders)
    filled = mean_filled(orders.select(*numbers), numbers)
    return filled.withColumn("o_totalprice", F.round("o_totalprice", 4))


@query(
    "SELECT o_orderkey, "
    + ", ".join(
        f"round((CAST({c} AS DOUBLE) - avg({c}) OVER ()) / stddev_pop({c}) OVER (), 6) AS {c}_score"
        for c in ("o_orderkey", "o_custkey", "o_totalprice")
    )
    + " FROM orders"
)
def standard_scale(spark, sf):
    orders = table(spark, sf, "orders")
    numbers = P.numeric_columns(orders)
    copies = orders.select("o_orderkey", *[F.col(c).alias(f"{c}_score") for c in numbers])
    names = [f"{c}_score" for c in numbers]
    scores = scaled(copies, scaling(copies, names))
    return scores.select("o_orderkey", *[F.round(c, 6).alias(c) for c in names])
