"""Scalar functions against plain Python and pandas."""

import datetime as dt
import re

import pandas as pd
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from custvalue.functions import lists as L
from custvalue.functions import text as X
from custvalue.functions import times as D

few = settings(
    max_examples=8, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture]
)


def column(rows, values, function, kind="string"):
    df = rows([(i, v) for i, v in enumerate(values)], f"i int, v {kind}")
    return [r.out for r in df.select("i", function(F.col("v")).alias("out")).orderBy("i").collect()]


@few
@given(st.lists(st.text("ab@. ", max_size=8), min_size=1, max_size=30))
def test_email_domain(rows, values):
    assert column(rows, values, X.email_domain) == [v.partition("@")[2] for v in values]


def host(url):
    return url.partition("//")[2].partition("/")[0].replace("www.", "")


@few
@given(st.lists(st.text("aw./:?", max_size=14), min_size=1, max_size=30))
def test_url_host(rows, values):
    assert column(rows, values, X.url_host) == [host(v) for v in values]


def test_known_hosts_and_nulls(rows):
    values = ["http://www.www.x.com:80/p?q", "x.com/p", "https://a.www.b/c", None, "//h?x=1"]
    assert column(rows, values, X.url_host) == ["x.com:80", "", "a.b", None, "h?x=1"]
    assert column(rows, ["a@b@c", "none", None], X.email_domain) == ["b@c", "", None]


@few
@given(st.lists(st.text("Pro License,", max_size=40), min_size=1, max_size=20))
def test_license_names(rows, values):
    got = column(rows, values, X.license_names)
    expected = [set(re.findall(r"(\S+)\s*License", v)) for v in values]
    assert [set(g) for g in got] == expected
    assert all(len(g) == len(set(g)) for g in got)


def test_license_names_of_bad_text(rows):
    values = ["Pro License, Big  License, Pro License", "License", None]
    assert column(rows, values, X.license_names) == [["Pro", "Big"], [], []]


def plain_items(v):
    return [] if v is None else [item.strip('"') for item in v.split(",")]


def strict_items(v):
    if v is None:
        return []
    return v.split(",") if "," in v else [v.strip('"')]


@few
@given(st.lists(st.none() | st.text('ab," ', max_size=12), min_size=1, max_size=30))
def test_comma_lists(rows, values):
    assert column(rows, values, X.comma_list) == [plain_items(v) for v in values]
    assert column(rows, values, X.comma_list_strict) == [strict_items(v) for v in values]


def test_digits(rows):
    assert column(rows, ["12", "1a", "", None, "٣"], X.is_digits) == [True, False, False, False, False]


def test_list_functions(rows):
    df = rows([(["b", "a", "b"],), ([],), (None,)], "v array<string>")
    v = F.col("v")
    got = df.select(
        L.first_item(v).alias("f"), L.distinct_items(v).alias("d"), L.indicator(v, "a").alias("i")
    ).collect()
    assert [r.f for r in got] == ["b", None, None]
    assert [r.d for r in got] == [["b", "a"], [], []]
    assert [r.i for r in got] == [1, None, None]


def test_parse_time(rows):
    values = ["2020-02-03 04:05:06", "2020-02-03", None]
    expected = [dt.datetime(2020, 2, 3, 4, 5, 6), dt.datetime(2020, 2, 3), None]
    assert column(rows, values, D.parse_time) == expected
    lenient = column(rows, ["bad", "2020-01-01"], lambda c: D.parse_time(c, strict=False))
    assert lenient == [None, dt.datetime(2020, 1, 1)]
    by_pattern = column(rows, ["03/02/2020"], lambda c: D.parse_time(c, "dd/MM/yyyy"))
    assert by_pattern == [dt.datetime(2020, 2, 3)]
    zoned = column(rows, ["2020-02-03T04:05:06Z"], D.parse_time)
    assert zoned == [dt.datetime(2020, 2, 3, 4, 5, 6)]


week = st.datetimes(dt.datetime(2023, 12, 28), dt.datetime(2024, 3, 5))
edges = st.builds(
    lambda day, hour, micro: dt.datetime(2024, 1, 1)
    + dt.timedelta(days=day, hours=hour, microseconds=micro),
    st.integers(0, 13),
    st.sampled_from([0, 9, 17, 23]),
    st.sampled_from([-1, 0, 1]),
)


@few
@given(st.lists(week | edges, min_size=20, max_size=80))
def test_business_roll_forward(rows, times):
    hours = pd.offsets.BusinessHour()
    expected = [hours.rollforward(pd.Timestamp(t)).to_pydatetime() for t in times]
    assert column(rows, times, D.business_roll_forward, "timestamp_ntz") == expected


def test_business_roll_forward_of_zoned_times(rows, spark):
    friday = dt.datetime(2024, 1, 5, 18, 30)
    df = rows([(friday,)], "t timestamp_ntz").select(F.col("t").cast("timestamp").alias("t"))
    rolled = df.select(D.business_roll_forward(F.col("t"), "timestamp").cast("string")).first()[0]
    assert rolled == "2024-01-08 09:00:00"


def test_hours_between(rows):
    start = dt.datetime(2024, 1, 1)
    df = rows([(start, start + dt.timedelta(days=3, hours=1, microseconds=36))], "a timestamp_ntz, b timestamp_ntz")
    got = df.select(D.hours_between(F.col("a"), F.col("b"))).first()[0]
    assert abs(got - (73 + 36e-6 / 3600)) < 1e-12
