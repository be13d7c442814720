"""Queries for the jobs: sources, transactions, customer table, value questions."""

from __future__ import annotations

from pyspark.sql import functions as F

from custvalue.bindings import standins as S
from custvalue.bindings.registry import query, safe_names, table
from custvalue.functions.nulls import named, sum_or_zero
from custvalue.operators.aggregates import label_rates
from custvalue.operators.filters import renewal_ids
from custvalue.operators.quantiles import exact_percentiles
from custvalue.plans import customers as customer_plan
from custvalue.plans import sources, support, transactions
from custvalue.session import held

# --- adjusted revenue, the flagship ------------------------------------------------------


@query(
    f"WITH {S.TICKETS_SQL}, load AS (SELECT user_id, count(*) AS n, sum(hours) AS hours "
    "FROM tickets GROUP BY 1), spent AS (SELECT o_custkey, sum(o_totalprice) AS revenue "
    "FROM orders GROUP BY 1) "
    "SELECT c_custkey, c_mktsegment, round(coalesce(revenue, 0), 2) AS revenue, "
    "n AS number_support_tickets, round(hours, 4) AS time_spent, "
    "round(hours / 24 * 10, 4) AS loss, "
    "round(coalesce(revenue, 0) - hours / 24 * 10, 4) AS adjusted_revenue "
    "FROM customer LEFT JOIN spent ON c_custkey = o_custkey LEFT JOIN load ON c_custkey = user_id"
)
def adjusted_revenue(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment")
    spent = table(spark, sf, "orders").groupBy(F.col("o_custkey").alias("c_custkey")).agg(
        F.sum("o_totalprice").alias("spent")
    )
    load = support.load_per_customer(S.conversations(spark, sf)).withColumnRenamed(
        "id", "c_custkey"
    )
    priced = customer_plan.with_adjusted_revenue(
        customers.join(spent, "c_custkey", "left")
        .join(load, "c_custkey", "left")
        .withColumns(
            {
                "revenue": F.coalesce("spent", F.lit(0.0)),
                "days_open": F.col("time_spent") / customer_plan.HOURS_PER_DAY,
            }
        ),
        revenue="revenue",
        days_open="days_open",
    )
    return priced.select(
        "c_custkey",
        "c_mktsegment",
        F.round("revenue", 2).alias("revenue"),
        "number_support_tickets",
        F.round("time_spent", 4).alias("time_spent"),
        F.round(named("helpscout:loss_per_customer"), 4).alias("loss"),
        F.round("adjusted_revenue", 4).alias("adjusted_revenue"),
    )


# --- one job per source ------------------------------------------------------------------


@query(
    f"WITH {S.TICKETS_SQL} SELECT coalesce(c_custkey, user_id) AS id, c_name AS name, "
    "number_support_tickets, round(time_spent, 4) AS time_spent FROM "
    "(SELECT c_custkey, c_name FROM customer WHERE c_custkey IS DISTINCT FROM 3) FULL JOIN "
    "(SELECT user_id, count(*) AS number_support_tickets, sum(hours) AS time_spent FROM tickets "
    "WHERE user_id IS DISTINCT FROM 3 GROUP BY 1) ON c_custkey = user_id"
)
def support_load(spark, sf):
    contacts = table(spark, sf, "customer").select(
        F.col("c_custkey").alias("id"), F.col("c_name").alias("name")
    )
    load = support.support_load(contacts, S.conversations(spark, sf), test_ids=[3])
    return load.withColumn("time_spent", F.round("time_spent", 4))


_KINDS = ["click", "error", "purchase", "signup", "view"]


@query(
    "WITH days AS (SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, min(ts) AS first_seen, "
    + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN 1 END) AS {k}" for k in _KINDS)
    + " FROM events GROUP BY 1, 2) SELECT CAST(user_id AS VARCHAR) AS email, first_seen, "
    + ", ".join(_KINDS)
    + " FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY first_seen) AS place "
    "FROM days) WHERE place = 1"
)
def segment_indicators(spark, sf):
    kinds = F.collect_set(F.concat(F.lit('"'), "event_type", F.lit('"')))
    contacts = (
        table(spark, sf, "events")
        .groupBy("user_id", F.col("ts").cast("date").alias("day"))
        .agg(F.min("ts").alias("First Seen (MDT)"), F.array_join(kinds, ",").alias("Segment"))
        .select(F.col("user_id").cast("string").alias("Email"), "First Seen (MDT)", "Segment")
    )
    clean = sources.clean_contacts(contacts)
    return clean.select(
        named("intercom:email").alias("email"),
        named("intercom:first_seen_(mdt)").alias("first_seen"),
        *_KINDS,
    )


@query(
    "SELECT conv_id AS email, "
    + ", ".join(
        f"max(CASE WHEN role = '{r}' THEN 1 END) AS \"{r}\"" for r in ("assistant", "system", "user")
    )
    + " FROM conversations GROUP BY 1"
)
def campaign_indicators(spark, sf):
    roles = F.array_join(F.collect_set("role"), ",")
    subscribers = (
        table(spark, sf, "conversations")
        .groupBy(F.col("conv_id").alias("Email"))
        .agg(roles.alias("Campaign Names"))
    )
    clean = sources.clean_subscribers(subscribers)
    return safe_names(clean.drop("drip:campaign_names")).withColumnRenamed("drip_email", "email")


@query(
    f"SELECT c_custkey AS revenue_id, {S.EMAIL_SQL} AS revenue_email, "
    "greatest(c_acctbal, 0.0) AS revenue_purchase_value, "
    "concat(lower(c_mktsegment), '.com') AS revenue_domain FROM customer"
)
def clean_revenue(spark, sf):
    return safe_names(sources.clean_revenue(S.revenue(spark, sf)))


_SURVEY_SQL = f"""survey AS (
  SELECT url, industry, host, avg(rating) OVER (PARTITION BY url) AS rating FROM (
    SELECT url, nullif(regexp_extract(url, '//[^/]*/([a-z]+)/', 1), 'fr') AS industry,
           {S.HOST_SQL} AS host, CAST(page_id % 5 AS DOUBLE) AS rating FROM pages
    WHERE NOT contains(url, '#top') AND NOT contains(url, '.html')))"""


@query(
    f"WITH {_SURVEY_SQL} SELECT url, host, round(rating, 4) AS rating, "
    "CASE WHEN industry = 'en' THEN 1 ELSE 0 END AS industry_en, "
    "CASE WHEN industry = 'es' THEN 1 ELSE 0 END AS industry_es, "
    "CASE WHEN industry IS NULL THEN 1 ELSE 0 END AS industry_nan FROM survey"
)
def site_survey(spark, sf):
    survey = sources.clean_survey(S.survey_answers(spark, sf))
    return survey.select(
        named("turk:input.website_url").alias("url"),
        named("turk:turk_domain").alias("host"),
        F.round(named("turk:answer.well-made_y"), 4).alias("rating"),
        *[named(f"turk:answer.industry_{i}").alias(f"industry_{i}") for i in ("en", "es", "nan")],
    )


# --- transactions ------------------------------------------------------------------------


def _analytics(spark, sf):
    """Three analytics tables by order: two sets of dimensions and one of metrics."""
    lines = table(spark, sf, "lineitem")
    order = F.col("l_orderkey").alias("ga:transactionId")
    known_flag = F.nullif("l_returnflag", F.lit("N"))
    first = lines.select(
        order,
        F.col("l_shipdate").alias("seen"),
        F.col("l_extendedprice").alias("tie"),
        known_flag.alias("ga:source"),
        F.dayofweek(F.col("l_shipdate").cast("date")).alias("ga:dayOfWeek"),
    )
    second = lines.select(
        order,
        F.col("l_shipdate").alias("seen"),
        F.col("l_extendedprice").alias("tie"),
        F.dayofweek(F.date_add(F.col("l_shipdate").cast("date"), F.col("l_linenumber"))).alias(
            "ga:dayOfWeek"
        ),
    )
    metrics = lines.select(
        order,
        F.col("l_shipdate").alias("seen"),
        F.col("l_extendedprice").alias("tie"),
        F.col("l_quantity").alias("ga:itemQuantity"),
    )
    return [first, second, metrics]


@query(
    f"WITH {S.PAYMENTS_SQL}, a AS (SELECT l_orderkey, "
    "arg_min(l_returnflag, (l_shipdate, l_extendedprice)) FILTER (l_returnflag <> 'N') AS source, "
    "arg_min(dayofweek(l_shipdate) + 1, (l_shipdate, l_extendedprice)) AS day_x, "
    "arg_min(dayofweek(l_commit) + 1, (l_shipdate, l_extendedprice)) AS day_y, "
    "arg_min(l_quantity, (l_shipdate, l_extendedprice)) AS quantity FROM (SELECT *, "
    "l_shipdate + to_days(CAST(l_linenumber AS INTEGER)) AS l_commit FROM lineitem) GROUP BY 1) "
    "SELECT payment_id, email, method, source, CAST(day_x AS INTEGER) AS day_x, "
    "CAST(day_y AS INTEGER) AS day_y, quantity FROM payments LEFT JOIN a ON payment_id = l_orderkey"
)
def transactions_enriched(spark, sf):
    enriched = transactions.enrich_transactions(
        S.payments(spark, sf), _analytics(spark, sf), ["seen", "tie"]
    )
    return enriched.select(
        named("EDD:Payment ID").alias("payment_id"),
        named("EDD:Email").alias("email"),
        named("EDD:Payment Method").alias("method"),
        named("ga:source").alias("source"),
        named("ga:dayOfWeek_x").alias("day_x"),
        named("ga:dayOfWeek_y").alias("day_y"),
        named("ga:itemQuantity").alias("quantity"),
    )


_LICENSES = ["ECONOMY", "LARGE", "MEDIUM", "PROMO", "SMALL", "STANDARD"]
PAID_SQL = f"""{S.PAYMENTS_SQL}, {S.RENEWALS_SQL}, paid AS (
  SELECT * FROM payments WHERE status = 'complete' AND method IS DISTINCT FROM 'Test Payment'
  AND payment_id NOT IN (SELECT payment_id FROM renewals))"""
_PURCHASES_SQL = (
    "SELECT email, max(customer_id) AS customer_id, round(sum(amount), 2) AS total_spent, "
    "CAST(arg_max(code IS DISTINCT FROM 'none', (date, payment_id)) AS INTEGER) AS used_code, "
    "arg_max(payment_id, (date, payment_id)) AS payment_id, max(date) AS date, "
    "arg_max(code, (date, payment_id)) FILTER (code IS NOT NULL) AS discount_code, "
    + ", ".join(
        f"max(CASE WHEN contains(products, '{n} License') THEN 1 ELSE 0 END) AS licenses_{n.lower()}"
        for n in _LICENSES
    )
    + ", max(CASE WHEN method = 'Manual Purchases' THEN 1 ELSE 0 END) AS method_manual, "
    "max(CASE WHEN method IS NULL THEN 1 ELSE 0 END) AS method_nan FROM paid GROUP BY email"
)


def _purchases(spark, sf):
    payments = transactions.prefixed(S.payments(spark, sf), transactions.PREFIX)
    renewals = renewal_ids(S.meta_rows(spark, sf))
    return transactions.customer_purchases(payments, renewals)


@query(f"WITH {PAID_SQL} {_PURCHASES_SQL}")
def customer_purchases(spark, sf):
    found = _purchases(spark, sf)
    return found.select(
        named("edd:email").alias("email"),
        named("edd:customer_id").alias("customer_id"),
        F.round(named("edd:total_spent"), 2).alias("total_spent"),
        named("edd:used_code").cast("int").alias("used_code"),
        named("edd:payment_id").alias("payment_id"),
        named("edd:date").alias("date"),
        named("edd:discount_code").alias("discount_code"),
        *[named(f"edd:licenses_{n.lower()}").alias(f"licenses_{n.lower()}") for n in _LICENSES],
        named("edd:payment_method_manual_purchases").alias("method_manual"),
        named("edd:payment_method_nan").alias("method_nan"),
    )


# --- the customer table ------------------------------------------------------------------

_MAILS = [f"mail_{k}" for k in _KINDS if k != "error"]


def customer_table(spark, sf):
    """All sources joined and cleaned, with the stand-ins of the driver's tables."""
    events = table(spark, sf, "events")
    address = table(spark, sf, "customer").select("c_custkey", S.email().alias("Email"))
    by_user = events.join(address, events.user_id == address.c_custkey)
    mailed = F.col("event_type") != "error"
    # Two sources, each of which is read for its lists and for the result: grouped once.
    seen = held(
        by_user.groupBy("Email").agg(
            F.min("ts").alias("first"),
            F.collect_set("event_type").alias("kinds"),
            F.collect_set(F.when(mailed, F.concat(F.lit("mail_"), "event_type"))).alias("mails"),
            F.max(F.when(mailed, F.col("ts"))).alias("last"),
            F.count_if(mailed).alias("n_mails"),
        )
    )
    contacts = seen.select(
        "Email",
        F.col("first").alias("First Seen (MDT)"),
        F.array_join("kinds", ",").alias("Segment"),
    )
    subscribers = seen.where("n_mails > 0").select(
        "Email", F.array_join("mails", ",").alias("Campaign Names"), "last"
    )
    people = table(spark, sf, "customer").select(
        S.email().alias("Email"), F.col("c_nationkey").alias("Original Source")
    )
    nations = table(spark, sf, "nation").join(
        table(spark, sf, "region"), F.col("n_regionkey") == F.col("r_regionkey")
    )
    companies = table(spark, sf, "customer").join(
        nations, F.col("c_nationkey") == F.col("n_nationkey")
    ).select(
        F.concat(F.lower("c_mktsegment"), F.lit(".com")).alias("Company Domain Name"),
        F.col("r_name").alias("Industry"),
        F.col("c_custkey").alias("Company"),
    )
    hosts = sources.clean_survey(S.survey_answers(spark, sf))
    load = support.support_load(
        table(spark, sf, "customer").select(F.col("c_custkey").alias("id")),
        S.conversations(spark, sf),
    )
    emails = load.join(address, load.id == address.c_custkey).select(
        F.array("Email").alias("emails"),
        F.lit(None).cast("array<string>").alias("email_types"),
        F.lit(None).cast("array<string>").alias("phone_types"),
        "id",
        "number_support_tickets",
        "time_spent",
    )
    contacts, subscribers = sources.clean_contacts(contacts), sources.clean_subscribers(subscribers)
    marks = [c for c in (*contacts.columns, *subscribers.columns) if ":" not in c]
    joined = customer_plan.join_sources(
        sources.clean_revenue(S.revenue(spark, sf)),
        _purchases(spark, sf),
        by_email=[
            (contacts, "intercom:email", None),
            (subscribers, "drip:email", ["drip:last"]),
            (sources.clean_crm_contacts(people), "hubcust:email", ["hubcust:original_source"]),
            (sources.clean_support(emails), "helpscout:emails", ["helpscout:id"]),
        ],
        by_domain=[
            (
                sources.clean_crm_companies(companies),
                "hubcomp:company_domain_name",
                ["hubcomp:company"],
            ),
            (hosts, "turk:turk_domain", ["turk:input.website_url"]),
        ],
    )
    return customer_plan.clean_customers(
        joined,
        test_emails=["c0@household.com", "c1@machinery.com"],
        flags=marks,
        as_text=["turk:answer.well-made_y"],
        as_number=["helpscout:number_support_tickets"],
    )


@query(
    f"WITH {PAID_SQL}, purchases AS ({_PURCHASES_SQL}), {S.TICKETS_SQL}, "
    "load AS (SELECT user_id, count(*) AS n, sum(hours) AS hours FROM tickets GROUP BY 1), "
    "contacts AS (SELECT user_id, min(ts) AS first_seen, "
    + ", ".join(f"max(CASE WHEN event_type = '{k}' THEN 1 END) AS {k}" for k in _KINDS)
    + "".join(
        f", max(CASE WHEN event_type = '{k}' THEN 1 END) AS mail_{k}" for k in _KINDS if k != "error"
    )
    + ", max(CASE WHEN event_type <> 'error' THEN ts END) AS last_mail FROM events GROUP BY 1), "
    "companies AS (SELECT c_mktsegment AS segment, arg_min(r_name, c_custkey) AS industry FROM "
    "customer JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey "
    "GROUP BY 1) "
    f"SELECT c_custkey AS id, {S.EMAIL_SQL} AS email, greatest(c_acctbal, 0.0) AS purchase_value, "
    "total_spent, licenses_promo, method_manual, first_seen, "
    + ", ".join(f"coalesce({k}, 0) AS {k}" for k in (*_KINDS, *_MAILS))
    + ", last_mail, c_nationkey AS original_source, industry, "
    "CAST(n AS DOUBLE) AS number_support_tickets, round(hours / 24 * 10, 4) AS loss, "
    "round(greatest(c_acctbal, 0.0) - hours / 24 * 10, 4) AS adjusted_revenue "
    "FROM customer LEFT JOIN purchases ON c_custkey = customer_id "
    "LEFT JOIN contacts ON c_custkey = contacts.user_id LEFT JOIN load ON c_custkey = load.user_id "
    "LEFT JOIN companies ON c_mktsegment = segment "
    f"WHERE {S.EMAIL_SQL} NOT IN ('c0@household.com', 'c1@machinery.com') "
    "AND NOT coalesce(greatest(c_acctbal, 0.0) = 0 AND method_manual = 1, FALSE)"
)
def customer_360(spark, sf):
    return customer_table(spark, sf).select(
        named("revenue:id").alias("id"),
        named("revenue:email").alias("email"),
        named("revenue:purchase_value").alias("purchase_value"),
        F.round(named("edd:total_spent"), 2).alias("total_spent"),
        named("edd:licenses_promo").alias("licenses_promo"),
        named("edd:payment_method_manual_purchases").alias("method_manual"),
        named("intercom:first_seen_(mdt)").alias("first_seen"),
        *_KINDS,
        *_MAILS,
        named("drip:last").alias("last_mail"),
        named("hubcust:original_source").alias("original_source"),
        named("hubcomp:industry").alias("industry"),
        named("helpscout:number_support_tickets").alias("number_support_tickets"),
        F.round(named("helpscout:loss_per_customer"), 4).alias("loss"),
        F.round("adjusted_revenue", 4).alias("adjusted_revenue"),
    )


# --- which licence is worth what ---------------------------------------------------------


@query(
    f"WITH {S.LICENSES_SQL} SELECT license, count(*) AS n, "
    "round(quantile_cont(revenue, 0.5), 3) AS median_revenue FROM licenses GROUP BY 1"
)
def median_revenue_by_license(spark, sf):
    # The percentiles read their input several times: keep the joins behind it from repeating.
    customers = S.customer_licenses(spark, sf).persist()
    found = exact_percentiles(customers, "revenue", [0.5], ["license"])
    return found.select(
        "license", "n", F.round(F.col("percentiles")[0], 3).alias("median_revenue")
    )


@query(
    f"WITH {S.LICENSES_SQL} SELECT license, coalesce(CAST(sum(n) AS BIGINT), 0) AS tickets, "
    "round(avg(coalesce(n, 0)), 4) AS mean_tickets FROM licenses LEFT JOIN "
    "(SELECT user_id, count(*) AS n FROM events GROUP BY 1) ON c_custkey = user_id GROUP BY 1"
)
def tickets_by_license(spark, sf):
    tickets = table(spark, sf, "events").groupBy("user_id").agg(F.count("*").alias("n"))
    rows = S.customer_licenses(spark, sf).join(
        tickets, F.col("c_custkey") == F.col("user_id"), "left"
    )
    return rows.groupBy("license").agg(
        sum_or_zero(F.col("n")).alias("tickets"),
        F.round(F.avg(F.coalesce("n", F.lit(0))), 4).alias("mean_tickets"),
    )


@query(
    f"WITH {S.LICENSES_SQL}, {S.TICKETS_SQL}, "
    "load AS (SELECT user_id, sum(hours) AS hours FROM tickets GROUP BY 1) "
    "SELECT license, round(avg(revenue - coalesce(hours, 0) / 24 * 10), 2) AS adjusted_revenue, "
    "round(avg(revenue), 2) AS revenue FROM licenses LEFT JOIN load ON c_custkey = user_id GROUP BY 1"
)
def adjusted_revenue_by_license(spark, sf):
    load = S.tickets(spark, sf).groupBy("id").agg(
        (sum_or_zero(F.col("time_spent")) / customer_plan.HOURS_PER_DAY).alias("days")
    )
    rows = S.customer_licenses(spark, sf).join(load, F.col("c_custkey") == F.col("id"), "left")
    priced = customer_plan.with_adjusted_revenue(rows, "revenue", "days", no_ticket_fill=0)
    return priced.groupBy("license").agg(
        F.round(F.avg("adjusted_revenue"), 2).alias("adjusted_revenue"),
        F.round(F.avg("revenue"), 2).alias("revenue"),
    )


@query(
    f"WITH {S.LICENSES_SQL} SELECT count(*) AS n, "
    "round(avg(CASE WHEN license = 'PROMO' THEN 1.0 ELSE 0.0 END), 6) AS share FROM licenses"
)
def class_balance(spark, sf):
    label = (F.col("license") == "PROMO").cast("double")
    return S.customer_licenses(spark, sf).agg(
        F.count("*").alias("n"), F.round(F.avg(label), 6).alias("share")
    )


@query(
    f"WITH {S.LICENSES_SQL}, labelled AS (SELECT c_mktsegment, c_nationkey, "
    "CASE WHEN license = 'PROMO' THEN 1.0 ELSE 0.0 END AS label "
    "FROM customer JOIN licenses USING (c_custkey)) "
    "SELECT 'c_mktsegment' AS \"column\", c_mktsegment AS value, count(*) AS n, "
    "round(avg(label), 6) AS label_rate FROM labelled GROUP BY 2 UNION ALL "
    "SELECT 'c_nationkey', CAST(c_nationkey AS VARCHAR), count(*), round(avg(label), 6) "
    "FROM labelled GROUP BY 2"
)
def label_rate_by_category(spark, sf):
    customers = table(spark, sf, "customer").select("c_custkey", "c_mktsegment", "c_nationkey")
    rows = customers.join(S.customer_licenses(spark, sf), "c_custkey").withColumn(
        "label", (F.col("license") == "PROMO").cast("int")
    )
    rates = label_rates(rows, ["c_mktsegment", "c_nationkey"], "label")
    return rates.withColumn("label_rate", F.round("label_rate", 6))
