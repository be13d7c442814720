"""Plans that have to hold for large tables and hot keys."""

import re

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from custvalue.functions.nulls import named
from custvalue.operators import joins as J
from custvalue.plans import customers as K

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture
def no_broadcast_small_partitions(spark):
    """Joins by shuffle, and partitions that count as skewed from a few kilobytes on."""
    settings = {
        "spark.sql.autoBroadcastJoinThreshold": "-1",
        "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "2k",
        "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1.5",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": "2k",
        "spark.sql.adaptive.coalescePartitions.enabled": "false",
        "spark.sql.shuffle.partitions": "8",
    }
    before = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in before.items():
        spark.conf.set(k, v)


def executed(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def hot(spark, n=20000):
    """A key that holds a third of all rows."""
    key = F.when(F.col("id") % 3 == 0, 0).otherwise(F.col("id") % 500)
    return spark.range(0, n, 1, 8).select("id", key.alias("k"), F.rand(1).alias("v"))


def test_a_hot_key_is_split_when_group_values_come_back(spark, no_broadcast_small_partitions):
    df = J.with_group_values(hot(spark), "k", {"total": F.sum("v")})
    assert "skew=true" in executed(df)
    assert df.count() == 20000


@pytest.mark.parametrize("sources", [1, 2])
def test_a_hot_domain_is_split_in_the_customer_table(
    spark, no_broadcast_small_partitions, sources
):
    people = hot(spark).select(
        F.col("id").alias("revenue:id"),
        F.concat(F.lit("u"), "id", F.lit("@d"), "k").alias("revenue:email"),
        F.concat(F.lit("d"), "k").alias("revenue:domain"),
    )
    purchases = spark.range(10).select(
        F.col("id").alias("edd:customer_id"), F.lit("2020").alias("edd:date"), F.lit("e").alias("edd:email")
    )
    companies = spark.range(500).select(
        F.concat(F.lit("d"), "id").alias("company"), F.col("id").alias("m")
    )
    pages = companies.select(F.col("company").alias("site"), F.col("m").alias("s"))
    by_domain = [(companies, "company", ["m"]), (pages, "site", ["s"])][:sources]
    table = K.join_sources(people, purchases, by_domain=by_domain)
    assert "skew=true" in executed(table)
    assert table.count() == 20000
    assert table.where(named("company").isNull()).count() == 0


def test_a_hot_right_key_of_a_left_join_is_split(spark, no_broadcast_small_partitions):
    left = spark.range(600).select(F.col("id").alias("key"), (F.col("id") * 2).alias("l"))
    left = left.unionByName(spark.sql("SELECT CAST(NULL AS BIGINT) AS key, -1L AS l"))
    right = hot(spark).select(F.col("k").cast("bigint").alias("k"), F.col("id").alias("r"))
    joined = J.left_join_hot_right(left, right, "key", "k")
    assert "skew=true" in executed(joined)
    plain = J.left_join(left, right, "key", "k")
    assert joined.columns == plain.columns
    assert joined.exceptAll(plain).count() == 0 and plain.exceptAll(joined).count() == 0


def plan(spark, name):
    return entry.queries()[name](spark, FOLDER)._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name, pushed",
    [
        ("completed_orders", "EqualTo(o_orderstatus,F)"),
        ("date_ranges", "GreaterThanOrEqual(o_orderdate"),
    ],
)
def test_filters_reach_the_scan(spark, name, pushed):
    assert pushed in plan(spark, name)


def test_scans_read_only_what_is_used(spark):
    schemas = re.findall(r"ReadSchema: (struct<[^\n]*>)", plan(spark, "adjusted_revenue"))
    assert "struct<c_custkey:bigint,c_mktsegment:string>" in schemas
    assert "struct<o_custkey:bigint,o_totalprice:double>" in schemas
    assert all("props" not in s and "c_name" not in s for s in schemas)


def test_email_joins_reuse_the_grouping_by_email(spark, no_broadcast_small_partitions):
    def source(prefix, key):
        return spark.range(10).select(
            F.col("id").cast("string").alias(f"{prefix}:{key}"), F.col("id").alias(f"{prefix}:n")
        )

    revenue = spark.range(10).select(
        F.col("id").alias("revenue:id"),
        F.col("id").cast("string").alias("revenue:email"),
        F.lit("d").alias("revenue:domain"),
    )
    purchases = spark.range(10).select(
        F.col("id").alias("edd:customer_id"), F.lit("2020").alias("edd:date"), F.lit("e").alias("edd:email")
    )

    def shuffles(n):
        names = ["a", "b", "c", "d"][:n]
        by_email = [(source(p, "email"), f"{p}:email", [f"{p}:n"]) for p in names]
        df = K.join_sources(revenue, purchases, by_email)
        text = df._jdf.queryExecution().executedPlan().toString()
        return text.count("Exchange hashpartitioning")

    # Each further source costs the shuffle of its own grouping, and none of the customers.
    assert [shuffles(n) - shuffles(0) for n in (1, 2, 4)] == [1, 2, 4]


def test_null_keys_meet_nothing_in_a_join_for_hot_keys(rows):
    left = rows([(None, 1), ("a", 2)], "k string, l int")
    right = rows([(None, 3), ("a", 4)], "k string, r int")
    got = {r.l: r.r for r in J.left_join(left, right, "k", hot_keys=True).collect()}
    assert got == {1: None, 2: 4}


def test_identifier_sample_is_cut_before_the_shuffle(spark):
    assert "WindowGroupLimit" in plan(spark, "identifier_profile")


def test_borders_of_all_classes_are_counted_together(spark, monkeypatch):
    from custvalue.operators.splits import with_folds

    df = spark.range(3000).select(F.col("id").alias("key"), (F.col("id") % 6).alias("label"))
    counted, collect = [], type(df).collect
    monkeypatch.setattr(type(df), "collect", lambda self: (counted.append(self.columns), collect(self))[1])
    parts = with_folds(df, "label", "key")
    assert len([c for c in counted if "n" in c and "b" in c]) == 1
    assert {r["count"] for r in parts.groupBy("label", "fold").count().collect()} == {100}


def test_events_are_grouped_once_for_both_sources_by_email(spark):
    from custvalue.bindings.customer_jobs import customer_table

    table = customer_table(spark, "/root/testdata/sf0.001")
    plan = table._jdf.queryExecution().withCachedData().toString()
    assert plan.count("InMemoryRelation [Email#") == 2
