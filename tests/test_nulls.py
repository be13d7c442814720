"""Null rules on hand-written rows."""

import pandas as pd
from pyspark.sql import functions as F

from custvalue.functions import nulls as N
from custvalue.operators import aggregates as A
from custvalue.operators import columns as C
from custvalue.operators import filters as R
from custvalue.operators import joins as J


def one(df):
    return df.first()[0]


def test_first_known_is_per_column_and_drops_null_keys(rows):
    data = [("a", 1, None, 5.0), ("a", 2, "x", None), ("b", 3, None, None), (None, 4, "y", 1.0)]
    df = rows(data, "k string, t int, s string, v double")
    got = {r.k: (r.s, r.v) for r in A.first_known_per_key(df, "k", ["t"]).collect()}
    assert got == {"a": ("x", 5.0), "b": (None, None)}
    latest = {r.k: (r.t, r.s, r.v) for r in A.latest_known_per_key(df, "k", ["t"]).collect()}
    assert latest == {"a": (2, "x", 5.0), "b": (3, None, None)}


def test_first_known_agrees_with_pandas(rows):
    data = [(i % 7, i, None if i % 3 else float(i), None if i % 5 else str(i)) for i in range(200)]
    df = rows(data, "k int, t int, v double, s string")
    frame = pd.DataFrame(data, columns=["k", "t", "v", "s"]).sort_values("t")
    expected = frame.groupby("k")[["v", "s"]].first()
    got = A.first_known_per_key(df, "k", ["t"]).toPandas().set_index("k").sort_index()
    assert list(got["v"]) == list(expected["v"])
    assert list(got["s"]) == list(expected["s"])


def test_latest_row_keeps_nulls_of_the_row(rows):
    df = rows([("a", 1, "x"), ("a", 2, None), (None, 9, "z")], "k string, t int, s string")
    assert [(r.k, r.t, r.s) for r in A.latest_row_per_key(df, "k", ["t"]).collect()] == [("a", 2, None)]


def test_null_date_ranks_last_when_latest_is_wanted(rows):
    df = rows([("a", None, "undated"), ("a", "2020-01-01", "dated")], "k string, d string, s string")
    df = df.withColumn("d", F.to_date("d"))
    assert A.latest_known_per_key(df, "k", ["d"]).first().s == "dated"


def test_inequality_keeps_null_rows(rows):
    df = rows([("a",), ("b",), (None,)], "c string")
    assert df.where(N.differs(F.col("c"), "a")).count() == 2
    assert df.where(F.col("c") != "a").count() == 1


def test_negated_unknown_condition_keeps_the_row(rows):
    df = rows([(0.0, 1), (0.0, None), (None, 1), (5.0, 1)], "revenue double, manual int")
    kept = [tuple(r) for r in R.without_free_manual(df, "revenue", "manual").collect()]
    assert sorted(kept, key=repr) == sorted([(0.0, None), (None, 1), (5.0, 1)], key=repr)


def test_sum_of_nothing_known_is_zero(rows):
    df = rows([("a", None), ("b", 2.0)], "k string, v double")
    got = {r.k: r.s for r in A.group_values(df, "k", {"s": N.sum_or_zero(F.col("v"))}).collect()}
    assert got == {"a": 0.0, "b": 2.0}


def test_null_keys_meet_only_when_asked(rows):
    left = rows([(1, "l1"), (None, "l2")], "k int, l string")
    right = rows([(1, "r1"), (None, "r2")], "j int, r string")
    plain = {r.l: r.r for r in J.left_join(left, right, "k", "j").collect()}
    safe = {r.l: r.r for r in J.left_join(left, right, "k", "j", null_safe=True).collect()}
    assert plain == {"l1": "r1", "l2": None}
    assert safe == {"l1": "r1", "l2": "r2"}


def test_clamp_maps_null_to_zero(rows):
    df = rows([(-2.0,), (None,), (3.0,)], "x double")
    assert [r[0] for r in df.select(N.at_least_zero(F.col("x"))).collect()] == [0.0, 0.0, 3.0]


def test_nan_becomes_null(rows):
    df = N.nan_to_null(rows([(float("nan"), 1), (2.0, 2)], "x double, i int"))
    assert [r.x for r in df.collect()] == [None, 2.0]


def test_null_tokens_add_to_the_defaults(rows):
    df = rows([("NA",), ("(not set)",), ("x",), ("",), (None,)], "c string")
    column = F.col("c")
    assert [r[0] for r in df.select(N.null_tokens(column, ["(not set)"])).collect()] == [
        None, None, "x", None, None,
    ]
    only = df.select(N.null_tokens(column, ["(not set)"], defaults=False)).collect()
    assert [r[0] for r in only] == ["NA", None, "x", "", None]


def test_unknown_tickets_leave_adjusted_revenue_unknown(rows):
    from custvalue.plans.customers import with_adjusted_revenue

    df = rows([(100.0, 2.0), (100.0, None)], "revenue double, days double")
    got = [r.adjusted_revenue for r in with_adjusted_revenue(df, "revenue", "days").collect()]
    assert got == [80.0, None]
    filled = with_adjusted_revenue(df, "revenue", "days", no_ticket_fill=0).collect()
    assert [r.adjusted_revenue for r in filled] == [80.0, 100.0]


def test_exclusions_keep_null_rows(rows):
    df = rows([("a",), (None,), ("b",)], "e string")
    listed = rows([("a",)], "x string")
    assert {r.e for r in R.without_ids(df, "e", listed).collect()} == {None, "b"}
    assert {r.e for r in R.without_listed(df, "e", ["a"]).collect()} == {None, "b"}


def test_names_and_casts(rows):
    df = rows([(1, "7", 1), (2, "x", None)], "`My Col ` int, t string, flag int")
    assert C.normalized(df, "Pre:").columns == ["pre:my_col", "pre:t", "pre:flag"]
    assert [r.t for r in C.recast(df, {"t": "int"}, strict=False).collect()] == [7, None]
    assert [r.label for r in C.with_label(df, "flag").collect()] == [1, 0]
    wide = rows([(1, 1, 1, 1)], "a_nan int, `b@c` int, d_unknown int, e int")
    assert C.without_useless_names(wide).columns == ["e"]
    known, unknown = R.null_rows(df, "flag")
    assert (known.count(), unknown.count()) == (1, 1)
