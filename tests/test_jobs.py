"""Whole jobs on small hand-written inputs."""

import datetime as dt
import json

import pandas as pd
from pyspark.sql import functions as F

from custvalue.functions.nulls import named
from custvalue.plans import customers as K
from custvalue.plans import sources as S
from custvalue.plans import support, transactions
from custvalue.sources import json as J

# --- transactions ------------------------------------------------------------------------

PAYMENT_SCHEMA = (
    "`Payment ID` bigint, `Customer ID` bigint, Email string, Date string, Status string, "
    "`Payment Method` string, `Products (Verbose)` string, `Discount Code` string, "
    "`Amount ($)` double"
)
PAYMENTS = [
    (1, 7, "a@x.com", "2016-01-01", "complete", "Stripe", "Solo License", "none", 10.0),
    (2, 7, "a@x.com", "2016-03-01", "complete", None, "Team License, Solo License", None, 20.0),
    (3, 7, "a@x.com", "2016-05-01", "refunded", "Stripe", "Team License", "none", 40.0),
    (4, 7, "a@x.com", "2016-06-01", "complete", "Test Payment", "Team License", "none", 80.0),
    (5, 7, "a@x.com", "2016-07-01", "complete", "Stripe", "Big License", "none", 160.0),
    (6, 8, "b@y.com", "2016-02-01", "complete", "Manual Purchases", None, "SAVE", None),
    (7, None, None, "2016-02-01", "complete", "Stripe", None, "none", 5.0),
]


def test_one_row_per_customer(rows):
    payments = transactions.prefixed(rows(PAYMENTS, PAYMENT_SCHEMA), transactions.PREFIX)
    renewals = rows([(5,)], "payment_id bigint")
    got = {r["edd:email"]: r.asDict() for r in transactions.customer_purchases(payments, renewals).collect()}
    assert set(got) == {"a@x.com", "b@y.com"}
    a, b = got["a@x.com"], got["b@y.com"]
    assert a["edd:total_spent"] == 30.0 and b["edd:total_spent"] == 0.0
    # The latest code is unknown, which counts as used; the latest known code is the earlier one.
    assert a["edd:used_code"] is True and a["edd:discount_code"] == "none"
    assert (a["edd:licenses_solo"], a["edd:licenses_team"]) == (1, 1)
    assert "edd:licenses_big" not in a
    assert (b["edd:licenses_solo"], b["edd:licenses_team"]) == (0, 0)
    assert (a["edd:payment_method_stripe"], a["edd:payment_method_nan"]) == (1, 1)
    assert (b["edd:payment_method_manual_purchases"], b["edd:payment_method_nan"]) == (1, 0)
    assert a["edd:date"] == dt.datetime(2016, 3, 1) and a["edd:payment_id"] == 2
    assert "edd:amount_($)" not in a and "edd:payment_method" not in a


def test_payments_get_one_row_of_analytics(rows):
    payments = rows(PAYMENTS, PAYMENT_SCHEMA)
    first = rows(
        [("1", 1, None, "mon"), ("1", 2, "ads", "tue"), ("9", 1, "mail", "wed"), (None, 1, "x", "y")],
        "`ga:transactionId` string, n int, `ga:source` string, `ga:dayOfWeek` string",
    )
    second = rows([("1", 1, "fri"), ("2", 1, "sat")], "`ga:transactionId` string, n int, `ga:dayOfWeek` string")
    metrics = rows([("2", 1, 3.0)], "`ga:transactionId` string, n int, `ga:users` double")
    got = transactions.enrich_transactions(payments, [first, second, metrics], ["n"])
    assert got.count() == len(PAYMENTS)
    cells = {r["EDD:Payment ID"]: r for r in got.collect()}
    assert (cells[1]["ga:source"], cells[1]["ga:dayOfWeek_x"], cells[1]["ga:dayOfWeek_y"]) == ("ads", "mon", "fri")
    assert (cells[2]["ga:source"], cells[2]["ga:dayOfWeek_y"], cells[2]["ga:users"]) == (None, "sat", 3.0)
    assert cells[3]["ga:transactionId"] is None


# --- single sources ----------------------------------------------------------------------


def test_revenue_gets_domains(rows):
    got = S.clean_revenue(rows([(1, "a@x.com", 5.0), (2, "nobody", 1.0)], "ID int, Email string, `Purchase Value` double"))
    assert got.columns == ["revenue:id", "revenue:email", "revenue:purchase_value", "revenue:domain"]
    assert [r["revenue:domain"] for r in got.orderBy("`revenue:id`").collect()] == ["x.com", ""]


def test_contacts_keep_the_earliest_known_values(rows):
    data = [
        ("a", "2017-02-01", '"x","y"', "Art"), ("a", "2017-01-01", None, None),
        ("b", "2017-01-01", "y", "Law"), ("c", "2017-01-01", None, None),
    ]
    df = rows(data, "Email string, `First Seen (MDT)` string, Segment string, Industry string")
    got = {r["intercom:email"]: r for r in S.clean_contacts(df).collect()}
    assert got["a"]["intercom:first_seen_(mdt)"] == "2017-01-01"
    assert (got["a"]["intercom:industry"], got["a"]["x"], got["a"]["y"]) == ("Art", 1, 1)
    assert (got["b"]["x"], got["b"]["y"]) == (None, 1)
    assert got["c"]["intercom:segment"] == []


def test_subscribers_get_campaign_columns(rows):
    df = rows([("a", '"one","two"'), ("b", '"one"'), ("c", None)], "Email string, `Campaign Names` string")
    got = {r["drip:email"]: (r["one"], r["two"]) for r in S.clean_subscribers(df).collect()}
    assert got == {"a": (1, 1), "b": (1, None), "c": (None, None)}
    strict = S.clean_subscribers(df, strict=True)
    assert set(strict.columns) >= {'"one"', '"two"', "one"}


def test_survey(rows):
    data = [
        ("http://www.a.com/x", "yes", "yes", "Art", 1.0), ("http://www.a.com/x", "yes", "yes", "Law", 3.0),
        ("http://a.com", "yes", "yes", None, 5.0), ("http://b.com", "no", "yes", "Art", 5.0),
        ("http://c.com", "yes", None, "Art", 5.0),
    ]
    schema = (
        "`Input.website_url` string, `Answer.can_access` string, `Answer.does_it_load` string, "
        "`Answer.industry` string, `Answer.well-made` double"
    )
    got = S.clean_survey(rows(data, schema))
    assert sorted(got.columns) == sorted([
        "turk:input.website_url", "turk:turk_domain", "turk:answer.well-made_y",
        "turk:answer.industry_law", "turk:answer.industry_nan",
    ])
    cells = sorted(
        (r["turk:turk_domain"], r["turk:answer.well-made_y"], r["turk:answer.industry_law"], r["turk:answer.industry_nan"])
        for r in got.collect()
    )
    assert cells == [("a.com", 2.0, 0, 0), ("a.com", 2.0, 1, 0), ("a.com", 5.0, 0, 1)]


def test_support_contacts_from_landed_answers(spark, tmp_path):
    (tmp_path / "pages").mkdir()
    (tmp_path / "details").mkdir()
    page = {"pages": 1, "items": [{"id": 1, "firstName": "A"}, {"id": 2, "firstName": "B"}]}
    for i in (0, 1):
        (tmp_path / "pages" / f"{i}.json").write_text(json.dumps(page))
    details = [
        {"item": {
            "id": 1,
            "emails": [{"location": "work", "value": "a@x.com"}, {"location": "work", "value": "a2@x.com"}],
            "phones": [{"location": "mobile", "value": "1"}],
            "address": {"city": "Ulm", "country": "DE"},
            "socialProfiles": [{"type": "t", "value": "u"}], "websites": [{"value": "w"}],
            "chats": [{"type": "c"}],
        }},
        {"item": {"id": 3, "emails": []}},
    ]
    for i, detail in enumerate(details):
        (tmp_path / "details" / f"{i}.json").write_text(json.dumps(detail))
    pages = J.page_items(J.read_json(spark, str(tmp_path / "pages"), J.PAGE_OF_CONTACTS))
    detail = J.read_json(spark, str(tmp_path / "details"), J.CONTACT_DETAIL)
    contacts = S.support_contacts(pages, detail)
    raw = {r.id: r for r in contacts.collect()}
    assert set(raw) == {1, 2, 3}
    assert (raw[1].city, raw[1].state, raw[1].websites, raw[1].chats) == ("Ulm", None, ["w"], ["c"])
    assert (raw[1].socialProfiles, raw[1].socialProfiles_links) == (["t"], ["u"])
    assert raw[2].emails is None
    clean = {r["helpscout:id"]: r for r in S.clean_support(contacts).collect()}
    assert clean[1]["helpscout:emails"] == "a@x.com" and clean[3]["helpscout:emails"] is None
    assert clean[1]["helpscout:email_types"] == ["work"] and clean[2]["helpscout:email_types"] == []
    assert (clean[1]["mobile_phone"], clean[1]["home_phone"], clean[1]["work_email"]) == (1, None, 1)


def test_support_load_from_landed_answers(spark, rows, tmp_path):
    answer = {"items": [
        {"id": 10, "customer": {"id": 1}, "createdAt": "2017-06-03T10:00:00Z", "closedAt": "2017-06-05T11:00:00Z"},
        {"id": 11, "customer": {"id": 1}, "createdAt": "2017-06-06T10:00:00Z", "closedAt": None},
        {"id": 12, "customer": {"id": 4}, "createdAt": "2017-06-06T10:00:00Z", "closedAt": "2017-06-06T09:00:00Z"},
        {"id": 13, "customer": {"id": 99}, "createdAt": "2017-06-06T10:00:00Z", "closedAt": "2017-06-06T12:00:00Z"},
    ]}
    (tmp_path / "0.json").write_text(json.dumps(answer))
    conversations = J.page_items(J.read_json(spark, str(tmp_path), J.CONVERSATIONS))
    contacts = rows([("1", "a"), ("2", "b"), ("99", "test")], "id string, name string")
    got = {
        r.id: (r.name, r.number_support_tickets, r.time_spent)
        for r in support.support_load(contacts, conversations, test_ids=[99]).collect()
    }
    # Saturday rolls to Monday 09:00; an open or backdated ticket costs nothing.
    assert got == {1: ("a", 2, 2.0), 2: ("b", None, None), 4: (None, 1, 0.0)}


# --- the customer table ------------------------------------------------------------------


def test_joins_equal_merging_all_and_taking_first_known(rows):
    """Against pandas: merge everything, rows multiplied, then first known value per e-mail."""
    revenue = pd.DataFrame(
        {"revenue:id": [1, 2, 3, 4], "revenue:email": ["a@x", "b@x", "c@y", "a@x"],
         "revenue:purchase_value": [10.0, 0.0, 5.0, None], "revenue:domain": ["x", "x", "", "x"]}
    )
    purchases = pd.DataFrame(
        {"edd:email": ["a@x", "b@x", "d"], "edd:customer_id": [1, 2, 4],
         "edd:date": ["2016-01-01", "2016-02-01", "2016-03-01"],
         "edd:payment_method_manual_purchases": [0, 1, 1], "edd:total_spent": [7.0, None, 9.0]}
    )
    contacts = pd.DataFrame({"intercom:email": ["a@x", "a@x", "c@y"], "n": [1, 2, 3], "ind": [None, "Art", "Law"]})
    companies = pd.DataFrame({"hubcomp:company_domain_name": ["x", "x", "z"], "m": [1, 2, 3], "what": [None, "P", "Q"]})
    merged = (
        revenue.merge(purchases, how="left", left_on="revenue:id", right_on="edd:customer_id")
        .merge(contacts, how="left", left_on="revenue:email", right_on="intercom:email")
        .merge(companies, how="left", left_on="revenue:domain", right_on="hubcomp:company_domain_name")
    )
    expected = merged.groupby("revenue:email").first().reset_index()

    def spark_frame(frame, schema):
        data = [tuple(None if pd.isna(v) else v for v in row) for row in frame.itertuples(index=False)]
        return rows(data, schema)

    got = K.join_sources(
        spark_frame(revenue, "`revenue:id` bigint, `revenue:email` string, `revenue:purchase_value` double, `revenue:domain` string"),
        spark_frame(purchases, "`edd:email` string, `edd:customer_id` bigint, `edd:date` string, `edd:payment_method_manual_purchases` bigint, `edd:total_spent` double"),
        by_email=[(spark_frame(contacts, "`intercom:email` string, n bigint, ind string"), "intercom:email", ["n"])],
        by_domain=[(spark_frame(companies, "`hubcomp:company_domain_name` string, m bigint, what string"), "hubcomp:company_domain_name", ["m"])],
    )
    columns = ["revenue:email", "revenue:id", "revenue:purchase_value", "edd:total_spent", "edd:payment_method_manual_purchases", "ind", "what"]
    mine = sorted(
        (tuple(r[c] for c in columns) for r in got.select(*map(named, columns)).collect()), key=repr
    )
    theirs = sorted(
        (tuple(None if pd.isna(v) else v for v in row) for row in expected[columns].itertuples(index=False)),
        key=repr,
    )
    assert mine == theirs


def test_cleaning_drops_tests_and_gifts_and_prices_support(rows):
    schema = (
        "`revenue:email` string, `revenue:purchase_value` double, "
        "`edd:payment_method_manual_purchases` int, `helpscout:time_spent` double, "
        "`helpscout:number_support_tickets` int, seg int, rating double"
    )
    data = [
        ("test@x", 5.0, 0, 24.0, 1, 1, 2.0), ("gift@x", 0.0, 1, None, None, None, None),
        ("none@x", 0.0, None, None, None, None, None), ("a@x", 100.0, 0, 48.0, 2, 1, 3.5),
    ]
    df = rows(data, schema)
    for tests in (["test@x"], rows([("test@x",)], "e string")):
        got = K.clean_customers(
            df, tests, names={"seg": "segment"}, flags=["segment"], as_text=["rating"],
            as_number=["helpscout:number_support_tickets"],
        )
        cells = {r["revenue:email"]: r for r in got.collect()}
        assert set(cells) == {"none@x", "a@x"}
        assert cells["a@x"]["adjusted_revenue"] == 80.0
        assert cells["a@x"]["helpscout:loss_per_customer"] == 20.0
        assert cells["none@x"]["adjusted_revenue"] is None and cells["none@x"]["segment"] == 0
        assert cells["a@x"]["rating"] == "3.5"


def test_label_rates(rows):
    from custvalue.operators.aggregates import label_rates

    df = rows([("a", 1, 1), ("a", 2, 0), ("b", 1, 1), (None, 1, 0)], "c string, n int, label int")
    got = {(r.column, r.value): (r.n, r.label_rate) for r in label_rates(df, ["c", "n"], "label").collect()}
    assert got == {("c", "a"): (2, 0.5), ("c", "b"): (1, 1.0), ("n", "1"): (3, 2 / 3), ("n", "2"): (1, 0.0)}
    assert df.agg(F.count("*")).first()[0] == 4
