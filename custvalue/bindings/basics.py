"""Queries for projections, filters, joins and set operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from custvalue.bindings import standins as S
from custvalue.bindings.registry import query, safe_names, table
from custvalue.functions import lists as L
from custvalue.functions import nulls as N
from custvalue.functions import text as X
from custvalue.functions import times as D
from custvalue.operators import aggregates as A
from custvalue.operators import columns as C
from custvalue.operators import filters as R
from custvalue.operators import joins as J
from custvalue.plans import analytics
from custvalue.sources.csv import union_all_by_name
from custvalue.sources.json import parsed

# --- sources and projections -------------------------------------------------------------


@query("SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS priority FROM orders")
def null_sentinel(spark, sf):
    priority = N.null_tokens(F.col("o_orderpriority"), ["4-NOT SPECIFIED"])
    return table(spark, sf, "orders").select("o_orderkey", priority.alias("priority"))


@query("SELECT event_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS k FROM events")
def json_field(spark, sf):
    record = parsed(F.col("props"), "k bigint")
    return table(spark, sf, "events").select(
        "event_id", L.nested_field(record, ["k"]).alias("k")
    )


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders")
def select_subset(spark, sf):
    some = C.subset(
        table(spark, sf, "orders"), ["o_orderkey", "o_custkey", "o_totalprice", "o_orderstatus"]
    )
    return C.without(some, ["o_orderstatus"])


@query(
    'SELECT c_custkey AS crm_customer_id, c_name AS crm_full_name, c_nationkey AS crm_nation, '
    "c_acctbal AS crm_account_balance, c_mktsegment AS crm_industry FROM customer"
)
def normalized_names(spark, sf):
    messy = C.renamed(
        table(spark, sf, "customer"),
        {
            "c_custkey": "Customer ID",
            "c_name": "FULL NAME ",
            "c_nationkey": "Nation",
            "c_acctbal": "Account Balance",
            "c_mktsegment": "Industry",
        },
    )
    return safe_names(C.normalized(messy, "crm:"))


@query(
    "WITH coded AS (SELECT o_orderkey, nullif(o_orderpriority, '4-NOT SPECIFIED') AS code "
    "FROM orders) SELECT o_orderkey, CAST(code IS DISTINCT FROM '5-LOW' AS INTEGER) AS used_code "
    "FROM coded"
)
def used_code_flag(spark, sf):
    code = F.nullif("o_orderpriority", F.lit("4-NOT SPECIFIED"))
    return table(spark, sf, "orders").select(
        "o_orderkey", N.differs(code, "5-LOW").cast("int").alias("used_code")
    )


@query(
    "SELECT CAST(o_orderkey AS DOUBLE) AS o_orderkey, CAST(o_custkey AS VARCHAR) AS o_custkey, "
    "TRY_CAST(CASE WHEN o_orderstatus = 'P' THEN o_orderpriority "
    "ELSE substr(o_orderpriority, 1, 1) END AS INTEGER) AS priority FROM orders"
)
def recast(spark, sf):
    number = F.when(F.col("o_orderstatus") == "P", F.col("o_orderpriority")).otherwise(
        F.substring("o_orderpriority", 1, 1)
    )
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", number.alias("priority"))
    typed = C.recast(orders, {"o_orderkey": "double", "o_custkey": "string"})
    return C.recast(typed, {"priority": "int"}, strict=False)


# --- filters -----------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders WHERE o_orderstatus = 'F'")
def completed_orders(spark, sf):
    orders = table(spark, sf, "orders")
    return orders.where(F.col("o_orderstatus") == "F").select("o_orderkey", "o_totalprice")


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT o_orderkey, o_orderpriority FROM known "
    "WHERE o_orderpriority IS DISTINCT FROM '5-LOW'"
)
def not_test_payment(spark, sf):
    orders = S.known_orders(spark, sf).select("o_orderkey", "o_orderpriority")
    return orders.where(N.differs(F.col("o_orderpriority"), "5-LOW"))


@query(
    "WITH meta AS (SELECT event_id, CASE WHEN event_type = 'error' THEN props "
    "ELSE json_extract_string(props, '$.k') END AS meta_id FROM events) "
    "SELECT event_id, meta_id FROM meta WHERE regexp_full_match(meta_id, '[0-9]+')"
)
def digits_only(spark, sf):
    number = F.get_json_object("props", "$.k")
    meta = F.when(F.col("event_type") == "error", F.col("props")).otherwise(number)
    events = table(spark, sf, "events").select("event_id", meta.alias("meta_id"))
    return events.where(X.is_digits(F.col("meta_id")))


@query(
    f"WITH {S.RENEWALS_SQL} SELECT o_orderkey, o_totalprice FROM orders "
    "WHERE o_orderkey NOT IN (SELECT payment_id FROM renewals)"
)
def exclude_renewals(spark, sf):
    ids = R.renewal_ids(S.meta_rows(spark, sf))
    orders = table(spark, sf, "orders").select("o_orderkey", "o_totalprice")
    return R.without_ids(orders, "o_orderkey", ids)


@query(
    f"SELECT c_custkey, {S.EMAIL_SQL} AS email FROM customer WHERE NOT EXISTS "
    "(SELECT 1 FROM supplier WHERE s_suppkey = c_custkey AND s_acctbal > 5000)"
)
def exclude_test_customers(spark, sf):
    customers = table(spark, sf, "customer")
    testers = table(spark, sf, "supplier").where("s_acctbal > 5000").select("s_suppkey")
    tests = customers.join(testers, F.col("c_custkey") == F.col("s_suppkey")).select(S.email())
    return R.without_ids(customers.select("c_custkey", S.email().alias("email")), "email", tests)


_MANUAL_SQL = (
    "SELECT c_custkey, greatest(c_acctbal, 0.0) AS revenue, CASE c_mktsegment "
    "WHEN 'BUILDING' THEN 1 WHEN 'MACHINERY' THEN NULL ELSE 0 END AS manual FROM customer"
)


@query(
    f"SELECT c_custkey, revenue, manual FROM ({_MANUAL_SQL}) "
    "WHERE NOT coalesce(revenue = 0 AND manual = 1, FALSE)"
)
def exclude_free_manual(spark, sf):
    segment = F.col("c_mktsegment")
    manual = F.when(segment == "BUILDING", 1).when(segment != "MACHINERY", 0)
    customers = table(spark, sf, "customer").select(
        "c_custkey",
        F.greatest(F.col("c_acctbal"), F.lit(0.0)).alias("revenue"),
        manual.alias("manual"),
    )
    return R.without_free_manual(customers, "revenue", "manual")


@query(
    "SELECT event_id, value AS latitude FROM events WHERE event_type IN ('click', 'purchase') "
    "AND value <> 0"
)
def valid_points(spark, sf):
    kind = F.col("event_type")
    latitude = (
        F.when(kind == "signup", F.lit(0.0))
        .when(kind == "view", F.lit(float("nan")))
        .when(kind != "error", F.col("value"))
    )
    points = table(spark, sf, "events").select("event_id", latitude.alias("latitude"))
    return R.known_points(points, "latitude")


_RANGES = analytics.periods([f"{year}-01-01" for year in range(1996, 2001)], "2001-01-01")


@query(
    "SELECT o_orderkey, strftime(o_orderdate, '%Y') || '-01-01' AS period FROM orders "
    "WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '2001-01-01' "
    "AND o_orderkey <> 0"
)
def date_ranges(spark, sf):
    first, last = F.lit(_RANGES[0][0]).cast("date"), F.lit(_RANGES[-1][1]).cast("date")
    date = F.col("o_orderdate")
    orders = table(spark, sf, "orders").where(R.in_range(date, first, last))
    orders = orders.where("o_orderkey <> 0")
    return orders.select("o_orderkey", analytics.period_of(date, _RANGES).alias("period"))


# --- joins and set operations ------------------------------------------------------------


@query(
    "SELECT c_custkey, o_orderkey, o_totalprice FROM customer LEFT JOIN orders "
    "ON c_custkey = o_custkey"
)
def left_join(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey")
    orders = table(spark, sf, "orders").select("o_orderkey", "o_custkey", "o_totalprice")
    # One customer may hold a third of all orders.
    return J.left_join_hot_right(customers, orders, "c_custkey", "o_custkey").drop("o_custkey")


@query(
    "SELECT coalesce(c_custkey, user_id) AS id, c_acctbal, n_tickets FROM "
    "customer FULL JOIN "
    "(SELECT user_id, count(*) AS n_tickets FROM events GROUP BY 1) ON c_custkey = user_id"
)
def outer_ticket_counts(spark, sf):
    customers = table(spark, sf, "customer").select(F.col("c_custkey").alias("id"), "c_acctbal")
    tickets = A.count_per_key(table(spark, sf, "events"), "user_id", "n_tickets")
    return J.outer_join(customers, C.renamed(tickets, {"user_id": "id"}), "id")


@query(
    "SELECT l_orderkey, l_linenumber, quantity, round(price, 2) AS price FROM "
    "(SELECT l_orderkey, l_linenumber, max(l_quantity) AS quantity FROM lineitem GROUP BY 1, 2) "
    "LEFT JOIN (SELECT l_orderkey, l_linenumber, sum(l_extendedprice) AS price FROM lineitem "
    "GROUP BY 1, 2) USING (l_orderkey, l_linenumber)"
)
def two_key_join(spark, sf):
    lines = table(spark, sf, "lineitem")
    keys = ["l_orderkey", "l_linenumber"]
    left = lines.groupBy(*keys).agg(F.max("l_quantity").alias("quantity"))
    right = lines.groupBy(*keys).agg(F.round(F.sum("l_extendedprice"), 2).alias("price"))
    return J.left_join(left, right, keys)


@query(
    "SELECT s_suppkey AS id, s_name AS name_x, s_acctbal AS balance_x, c_name AS name_y, "
    "c_acctbal AS balance_y, c_mktsegment AS segment "
    "FROM supplier LEFT JOIN customer ON s_suppkey = c_custkey"
)
def suffix_join(spark, sf):
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_suppkey").alias("id"), F.col("s_name").alias("name"), F.col("s_acctbal").alias("balance")
    )
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    return J.suffixed_join(suppliers, customers, "id")


@query(
    "SELECT c_custkey AS id, c_name AS name, c_acctbal AS balance, c_mktsegment AS segment "
    "FROM customer UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL FROM supplier"
)
def union_by_name(spark, sf):
    customers = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"),
        F.col("c_name").alias("name"),
        F.col("c_acctbal").alias("balance"),
        F.col("c_mktsegment").alias("segment"),
    )
    suppliers = table(spark, sf, "supplier").select(
        F.col("s_acctbal").alias("balance"), F.col("s_suppkey").alias("id"), F.col("s_name").alias("name")
    )
    return union_all_by_name([customers, suppliers])


# --- scalar functions --------------------------------------------------------------------


@query(
    "SELECT c_custkey, CASE WHEN instr(email, '@') > 0 "
    "THEN substr(email, instr(email, '@') + 1) ELSE '' END AS domain FROM ("
    "SELECT c_custkey, CASE WHEN c_mktsegment = 'BUILDING' THEN c_name "
    "WHEN c_mktsegment = 'MACHINERY' THEN concat(c_name, '@a@b.org') "
    f"ELSE {S.EMAIL_SQL} END AS email FROM customer)"
)
def email_domain(spark, sf):
    segment = F.col("c_mktsegment")
    address = (
        F.when(segment == "BUILDING", F.col("c_name"))
        .when(segment == "MACHINERY", F.concat("c_name", F.lit("@a@b.org")))
        .otherwise(S.email())
    )
    return table(spark, sf, "customer").select("c_custkey", X.email_domain(address).alias("domain"))


@query(f"SELECT page_id, {S.HOST_SQL} AS host FROM pages")
def url_host(spark, sf):
    return table(spark, sf, "pages").select("page_id", X.url_host(F.col("url")).alias("host"))


@query(
    f"WITH {S.PRODUCTS_SQL} SELECT l_orderkey, array_to_string(list_sort(list_distinct("
    r"regexp_extract_all(products, '(\S+)\s*License', 1))), '|') AS licenses, "
    r"len(list_distinct(regexp_extract_all(products, '(\S+)\s*License', 1))) AS n FROM products"
)
def license_names(spark, sf):
    names = X.license_names(F.col("products"))
    return S.order_products(spark, sf).select(
        "l_orderkey",
        F.array_join(F.sort_array(names), "|").alias("licenses"),
        F.size(names).cast("bigint").alias("n"),
    )


@query(
    "SELECT event_id, array_to_string([trim(x, '\"') for x in string_split(segment, ',')], '|') "
    "AS items, len(string_split(segment, ',')) AS n FROM "
    "(SELECT event_id, concat('\"', event_type, '\",', user_id, ', \"x\"') AS segment FROM events)"
)
def segment_list(spark, sf):
    segment = F.concat(
        F.lit('"'), "event_type", F.lit('",'), F.col("user_id").cast("string"), F.lit(', "x"')
    )
    items = X.comma_list(segment)
    return table(spark, sf, "events").select(
        "event_id",
        F.array_join(items, "|").alias("items"),
        F.size(items).cast("bigint").alias("n"),
    )


@query(
    "WITH lists AS (SELECT conv_id, string_agg(DISTINCT '\"' || role || '\"', ',' "
    "ORDER BY '\"' || role || '\"') AS campaigns FROM conversations GROUP BY 1) "
    "SELECT conv_id, array_to_string([trim(x, '\"') for x in string_split(campaigns, ',')], '|') "
    "AS items, CASE WHEN instr(campaigns, ',') > 0 THEN "
    "replace(campaigns, ',', '|') ELSE trim(campaigns, '\"') END AS strict_items FROM lists"
)
def campaign_list(spark, sf):
    roles = F.collect_set(F.concat(F.lit('"'), "role", F.lit('"')))
    lists = table(spark, sf, "conversations").groupBy("conv_id").agg(
        F.array_join(F.sort_array(roles), ",").alias("campaigns")
    )
    return lists.select(
        "conv_id",
        F.array_join(X.comma_list(F.col("campaigns")), "|").alias("items"),
        F.array_join(X.comma_list_strict(F.col("campaigns")), "|").alias("strict_items"),
    )


@query("SELECT vec_id, round(CAST(embedding[1] AS DOUBLE), 6) AS first FROM embeddings")
def first_item(spark, sf):
    item = L.first_item(F.col("embedding")).cast("double")
    return table(spark, sf, "embeddings").select("vec_id", F.round(item, 6).alias("first"))


@query(
    "SELECT event_id, ts AS parsed, strptime(strftime(ts, '%d/%m/%Y %H:%M'), '%d/%m/%Y %H:%M') "
    "AS parsed_minute, CAST(NULL AS TIMESTAMP) AS bad FROM events"
)
def parse_dates(spark, sf):
    # The text is made from the parts of the time, so no session zone is involved.
    text = F.col("ts").cast("string")
    minute = F.concat_ws(
        " ",
        F.concat_ws("/", F.substring(text, 9, 2), F.substring(text, 6, 2), F.substring(text, 1, 4)),
        F.substring(text, 12, 5),
    )
    return table(spark, sf, "events").select(
        "event_id",
        D.parse_time(text).alias("parsed"),
        D.parse_time(minute, "dd/MM/yyyy HH:mm").alias("parsed_minute"),
        D.parse_time(F.col("event_type"), strict=False).alias("bad"),
    )


@query(f"SELECT event_id, {S.ROLLED_SQL} AS opened FROM events")
def business_roll_forward(spark, sf):
    opened = D.business_roll_forward(F.col("ts"))
    return table(spark, sf, "events").select("event_id", opened.alias("opened"))


@query(f"WITH {S.TICKETS_SQL} SELECT event_id, round(hours, 4) AS hours FROM tickets")
def ticket_hours(spark, sf):
    from custvalue.plans.support import open_hours

    hours = open_hours(F.col("createdAt"), F.col("closedAt"))
    return S.conversations(spark, sf).select(
        F.col("id").alias("event_id"), F.round(hours, 4).alias("hours")
    )


# --- null rows, lists of records ---------------------------------------------------------


@query(
    f"WITH {S.KNOWN_ORDERS_SQL} SELECT o_orderkey, "
    "CASE WHEN o_orderpriority IS NULL THEN 'unknown' ELSE 'known' END AS part FROM known"
)
def null_split(spark, sf):
    orders = S.known_orders(spark, sf).select("o_orderkey", "o_orderpriority")
    known, unknown = R.null_rows(orders, "o_orderpriority")
    both = known.withColumn("part", F.lit("known")).unionByName(
        unknown.withColumn("part", F.lit("unknown"))
    )
    return both.drop("o_orderpriority")


@query("SELECT l_orderkey, l_quantity, l_discount FROM lineitem")
def drop_by_name_pattern(spark, sf):
    lines = table(spark, sf, "lineitem").select(
        "l_orderkey", "l_quantity", "l_discount", F.col("l_tax").alias("tax_nan"),
        F.col("l_returnflag").alias("flag@x"),
    )
    return C.without_useless_names(lines)
