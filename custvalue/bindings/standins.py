"""The driver's tables in the shape of the customer data, in Spark and in SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from custvalue.bindings.registry import table
from custvalue.plans.support import ticket_hours

EMAIL_SQL = "concat('c', c_custkey, '@', lower(c_mktsegment), '.com')"


def email() -> Column:
    return F.concat(
        F.lit("c"), F.col("c_custkey").cast("string"), F.lit("@"), F.lower("c_mktsegment"), F.lit(".com")
    )


def revenue(spark, sf: str) -> DataFrame:
    """Revenue rows of customers: id, e-mail, purchase value; nothing spent below 0."""
    value = F.greatest(F.col("c_acctbal"), F.lit(0.0))
    return table(spark, sf, "customer").select(
        F.col("c_custkey").alias("ID"), email().alias("Email"), value.alias("Purchase Value")
    )


def conversations(spark, sf: str) -> DataFrame:
    """Events as support tickets: open for ``value`` hours, those of type error still open."""
    seconds = F.round(F.col("value") * 3600).cast("decimal(18,6)")
    closed = F.col("ts") + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), seconds)
    return table(spark, sf, "events").select(
        F.col("event_id").alias("id"),
        F.struct(F.col("user_id").alias("id")).alias("customer"),
        F.col("ts").alias("createdAt"),
        F.when(F.col("event_type") != "error", closed).alias("closedAt"),
    )


ROLLED_SQL = """CASE
  WHEN isodow(ts) <= 5 AND ts BETWEEN date_trunc('day', ts) + INTERVAL 9 HOUR
       AND date_trunc('day', ts) + INTERVAL 17 HOUR THEN ts
  WHEN isodow(ts) <= 5 AND ts < date_trunc('day', ts) + INTERVAL 9 HOUR
       THEN date_trunc('day', ts) + INTERVAL 9 HOUR
  WHEN isodow(ts) <= 4 THEN date_trunc('day', ts) + INTERVAL 33 HOUR
  ELSE date_trunc('day', ts) + INTERVAL 9 HOUR + to_days(CAST(8 - isodow(ts) AS INTEGER)) END"""

TICKETS_SQL = f"""tickets AS (
  SELECT event_id, user_id,
         CASE WHEN closed > opened
              THEN (epoch_us(closed) - epoch_us(opened)) / 3600000000.0 ELSE 0 END AS hours
  FROM (SELECT event_id, user_id, {ROLLED_SQL} AS opened,
               CASE WHEN event_type <> 'error'
                    THEN ts + to_seconds(CAST(round(value * 3600) AS BIGINT)) END AS closed
        FROM events))"""


def tickets(spark, sf: str) -> DataFrame:
    return ticket_hours(conversations(spark, sf))


def spending(spark, sf: str) -> DataFrame:
    """Licences (part types) and what each customer spent on them."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey", "l_extendedprice")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    return (
        lines.join(orders, lines.l_orderkey == orders.o_orderkey)
        .join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("o_custkey", "p_type")
        .agg(F.sum("l_extendedprice").alias("spent"))
    )


def customer_licenses(spark, sf: str) -> DataFrame:
    """(c_custkey, license, revenue): the licence a customer spent most on, and all spending."""
    best = F.struct(F.round("spent", 2), F.col("p_type"))
    return spending(spark, sf).groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.max_by("p_type", best).alias("license"), F.sum("spent").alias("revenue")
    )


LICENSES_SQL = """spending AS (
  SELECT o_custkey, p_type, sum(l_extendedprice) AS spent
  FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN part ON l_partkey = p_partkey
  GROUP BY 1, 2),
licenses AS (
  SELECT c_custkey, license, revenue FROM (
    SELECT o_custkey AS c_custkey, p_type AS license,
           sum(spent) OVER (PARTITION BY o_custkey) AS revenue,
           row_number() OVER (PARTITION BY o_custkey
                              ORDER BY round(spent, 2) DESC, p_type DESC) AS place
    FROM spending) WHERE place = 1)"""


def order_products(spark, sf: str) -> DataFrame:
    """(l_orderkey, products): product text per order. The set holds part types only, so a
    large order does not make a large cell."""
    lines = table(spark, sf, "lineitem").select("l_orderkey", "l_partkey")
    parts = table(spark, sf, "part").select("p_partkey", "p_type")
    names = F.sort_array(F.collect_set(F.concat("p_type", F.lit(" License"))))
    return (
        lines.join(parts, lines.l_partkey == parts.p_partkey)
        .groupBy("l_orderkey")
        .agg(F.array_join(names, ", ").alias("products"))
    )


PRODUCTS_SQL = """products AS (
  SELECT l_orderkey, string_agg(DISTINCT p_type || ' License', ', ' ORDER BY p_type || ' License')
         AS products
  FROM lineitem JOIN part ON l_partkey = p_partkey GROUP BY 1)"""


def payments(spark, sf: str) -> DataFrame:
    """Orders as the payment export. Some methods, codes and products are unknown."""
    customers = table(spark, sf, "customer").select("c_custkey", email().alias("email"))
    orders = table(spark, sf, "orders")
    priority = F.col("o_orderpriority")
    method = (
        F.when(priority == "5-LOW", "Test Payment")
        .when(priority == "3-MEDIUM", "Manual Purchases")
        .when(priority != "4-NOT SPECIFIED", priority)
    )
    code = F.when(priority == "1-URGENT", "none").when(priority != "2-HIGH", priority)
    status = F.when(F.col("o_orderstatus") == "F", "complete").otherwise(F.col("o_orderstatus"))
    products = order_products(spark, sf)
    return (
        orders.join(customers, orders.o_custkey == customers.c_custkey)
        .join(products, orders.o_orderkey == products.l_orderkey, "left")
        .select(
            F.col("o_orderkey").alias("Payment ID"),
            F.col("o_custkey").alias("Customer ID"),
            F.col("email").alias("Email"),
            F.col("o_orderdate").alias("Date"),
            status.alias("Status"),
            method.alias("Payment Method"),
            F.col("products").alias("Products (Verbose)"),
            code.alias("Discount Code"),
            F.col("o_totalprice").alias("Amount ($)"),
        )
    )


PAYMENTS_SQL = f"""{PRODUCTS_SQL},
payments AS (
  SELECT o_orderkey AS payment_id, o_custkey AS customer_id, {EMAIL_SQL} AS email,
         o_orderdate AS date,
         CASE WHEN o_orderstatus = 'F' THEN 'complete' ELSE o_orderstatus END AS status,
         CASE o_orderpriority WHEN '5-LOW' THEN 'Test Payment'
              WHEN '3-MEDIUM' THEN 'Manual Purchases'
              WHEN '4-NOT SPECIFIED' THEN NULL ELSE o_orderpriority END AS method,
         CASE o_orderpriority WHEN '1-URGENT' THEN 'none' WHEN '2-HIGH' THEN NULL
              ELSE o_orderpriority END AS code,
         products, o_totalprice AS amount
  FROM orders JOIN customer ON o_custkey = c_custkey
  LEFT JOIN products ON o_orderkey = l_orderkey)"""


def meta_rows(spark, sf: str) -> DataFrame:
    """Order lines as key/value rows: the first returned line of an order marks a renewal,
    lines of large quantity are broken rows without a numeric id."""
    number = F.col("l_linenumber").cast("string")
    broken = F.col("l_quantity") >= 45
    renewal = (F.col("l_returnflag") == "R") & (F.col("l_linenumber") == 1)
    return table(spark, sf, "lineitem").select(
        F.when(broken, F.concat(F.lit("<"), number, F.lit(">"))).otherwise(number).alias("meta_id"),
        F.col("l_orderkey").alias("post_id"),
        F.when(renewal, "_edd_sl_is_renewal").otherwise("other").alias("meta_key"),
    )


RENEWALS_SQL = """renewals AS (
  SELECT DISTINCT l_orderkey AS payment_id FROM lineitem
  WHERE l_returnflag = 'R' AND l_linenumber = 1 AND l_quantity < 45)"""


def known_orders(spark, sf: str) -> DataFrame:
    """Orders with unknown cells: no priority where it is not specified, no price when open."""
    return table(spark, sf, "orders").select(
        "o_orderkey",
        "o_custkey",
        "o_orderstatus",
        F.when(F.col("o_orderstatus") != "P", F.col("o_totalprice")).alias("o_totalprice"),
        "o_orderdate",
        F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED")).alias("o_orderpriority"),
    )


KNOWN_ORDERS_SQL = """known AS (
  SELECT o_orderkey, o_custkey, o_orderstatus,
         CASE WHEN o_orderstatus <> 'P' THEN o_totalprice END AS o_totalprice, o_orderdate,
         nullif(o_orderpriority, '4-NOT SPECIFIED') AS o_orderpriority FROM orders)"""


def survey_answers(spark, sf: str) -> DataFrame:
    """Pages as survey answers: industry from the language part of the address."""
    industry = F.regexp_extract("url", "//[^/]*/([a-z]+)/", 1)
    return table(spark, sf, "pages").select(
        F.col("url").alias("Input.website_url"),
        F.when(F.contains("url", F.lit("#top")), "no").otherwise("yes").alias("Answer.can_access"),
        F.when(F.contains("url", F.lit(".html")), "no").otherwise("yes").alias("Answer.does_it_load"),
        F.nullif(industry, F.lit("fr")).alias("Answer.industry"),
        (F.col("page_id") % 5).cast("double").alias("Answer.well-made"),
    )


HOST_SQL = (
    "replace(split_part(CASE WHEN instr(url, '//') > 0 "
    "THEN substr(url, instr(url, '//') + 2) ELSE '' END, '/', 1), 'www.', '')"
)
