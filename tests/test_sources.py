"""Files in and out."""

import json

import pytest
from pyspark.sql import functions as F

from custvalue.models.classifiers import logistic
from custvalue.operators.filters import renewal_ids
from custvalue.plans import analytics
from custvalue.sources import csv as C
from custvalue.sources import json as J
from custvalue.sources import snapshots as S


def write(path, text):
    path.write_text(text)
    return str(path)


def test_csv_with_types_and_null_tokens(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name,v\n1,"x, ""y""",2.5\n2,(not set),NA\n3,NaN,NaN\n')
    df = C.read_csv(spark, path, "id int, name string, v double", ["(not set)"])
    assert [tuple(r) for r in df.collect()] == [(1, 'x, "y"', 2.5), (2, None, None), (3, None, None)]
    guessed = C.read_csv(spark, path)
    assert dict(guessed.dtypes)["id"] == "int"
    assert guessed.where("id = 2").first().name == "(not set)"


def test_types_are_inferred_after_null_tokens(spark, tmp_path):
    path = write(
        tmp_path / "a.csv",
        "lat,n,big,flag,text,none\n1.5,(not set),5000000000,true,1,NA\n(not set),7,NA,NA,x,\nNA,8,1,false,,\n",
    )
    df = C.read_csv(spark, path, null_values=["(not set)"])
    assert [kind for _, kind in df.dtypes] == ["double", "int", "bigint", "boolean", "string", "string"]
    assert [r.lat for r in df.collect()] == [1.5, None, None]


def test_cells_that_do_not_fit_are_errors_or_counted(spark, tmp_path):
    path = write(tmp_path / "a.csv", "id,v\n1,2.5\n2,12x\n3,NA\nz,12x\n")
    schema = "id int, v double"
    with pytest.raises(Exception, match="column v is no double: 12x"):
        C.read_csv(spark, path, "id string, v double").collect()
    assert C.bad_cell_counts(spark, path, schema) == {"id": 1, "v": 2}
    lenient = C.read_csv(spark, path, schema, bad_cells="null")
    assert [tuple(r) for r in lenient.collect()] == [(1, 2.5), (2, None), (3, None), (None, None)]
    with pytest.raises(ValueError):
        C.read_csv(spark, path, schema, bad_cells="zero")


def test_line_breaks_inside_quotes(spark, tmp_path):
    path = write(tmp_path / "a.csv", 'id,name\n1,"two\nlines"\n2,x\n')
    assert [r.name for r in C.read_csv(spark, path, "id int, name string", multiline=True).collect()] == ["two\nlines", "x"]


def test_only_long_rows_are_skipped(spark, tmp_path):
    lines = [
        "meta_id,post_id,meta_key", "1,10,_edd_sl_is_renewal", "2,11", "3,12,a,b", "4,13,a,",
        "5,14,a,,c", "6,14,a,b,c", '8,17,"q,r"', "<x>,15,_edd_sl_is_renewal", "7,16,other",
    ]
    text = "\n".join(lines) + "\n"
    path = write(tmp_path / "meta.csv", text)
    schema = "meta_id string, post_id bigint, meta_key string"
    df = C.read_csv(spark, path, schema, skip_long_rows=True)
    assert [tuple(r) for r in df.collect()] == [
        ("1", 10, "_edd_sl_is_renewal"), ("2", 11, None), ("8", 17, "q,r"),
        ("<x>", 15, "_edd_sl_is_renewal"),
        ("7", 16, "other"),
    ]
    assert df.count() == 5 and df.select("post_id").where("post_id > 10").count() == 4
    assert [r.payment_id for r in renewal_ids(df).collect()] == [10]


def test_files_of_two_layouts(spark, tmp_path):
    a1 = write(tmp_path / "a1.csv", "id,x\n1,p\n")
    a2 = write(tmp_path / "a2.csv", "id,x\n2,(not set)\n")
    b1 = write(tmp_path / "b1.csv", "y,id\nq,3\n")
    layouts = [([a1, a2], "id int, x string"), ([b1], "y string, id int")]
    df = C.read_csv_layouts(spark, layouts, ["(not set)"]).orderBy("id")
    assert df.columns == ["id", "x", "y"]
    assert [tuple(r) for r in df.collect()] == [(1, "p", None), (2, None, None), (3, None, "q")]


def test_csv_sink_round_trip(spark, rows, tmp_path):
    df = rows([(1, 'a"b, c', ["x", "y"]), (2, None, [])], "id int, t string, l array<string>")
    out = str(tmp_path / "out")
    C.write_csv(df, out)
    back = C.read_csv(spark, out, "id int, t string, l string").orderBy("id").collect()
    assert [tuple(r) for r in back] == [(1, 'a"b, c', '["x","y"]'), (2, None, "[]")]


def test_one_export_per_period(spark, rows, tmp_path):
    df = rows([("2014-07-25", "1"), ("2014-11-01", "2")], "range_end string, id string")
    out = tmp_path / "out"
    analytics.export_by_period(df, str(out))
    assert sorted(p.name for p in out.glob("range_end=*")) == [
        "range_end=2014-07-25", "range_end=2014-11-01",
    ]


def test_a_period_is_exported_again_by_itself(spark, rows, tmp_path):
    schema, out = "range_end string, id string", str(tmp_path / "out")

    def held():
        back = spark.read.schema("id string, range_end string").csv(out, header=True)
        return sorted((r.range_end, r.id) for r in back.collect())

    assert analytics.finished_periods(spark, out) == {}
    analytics.export_by_period(rows([("2014-07-25", "1"), ("2014-11-01", "2")], schema), out)
    assert analytics.finished_periods(spark, out) == {"2014-07-25": 1, "2014-11-01": 1}
    more = rows([("2014-11-01", "3"), ("2014-11-01", "4"), ("2014-07-25", "9")], schema)
    for _ in range(2):
        analytics.export_by_period(more, out, ranges=["2014-11-01"])
        assert held() == [("2014-07-25", "1"), ("2014-11-01", "3"), ("2014-11-01", "4")]
    assert analytics.finished_periods(spark, out) == {"2014-07-25": 1, "2014-11-01": 2}
    # A listed period that has no rows any more loses its export, and only that one.
    analytics.export_by_period(more, out, ranges=["2014-07-24", "2014-11-01"])
    analytics.export_by_period(more.where("id = '9'"), out, ranges=["2014-11-01"])
    assert held() == [("2014-07-25", "1")]
    assert analytics.finished_periods(spark, out) == {
        "2014-07-24": 0, "2014-07-25": 1, "2014-11-01": 0,
    }


def test_a_stopped_export_is_not_finished(spark, rows, tmp_path):
    schema, out = "range_end string, id string", str(tmp_path / "out")
    analytics.export_by_period(rows([("2014-07-25", "1"), ("2014-11-01", "2")], schema), out)
    new = rows([("2014-11-01", "5"), ("2014-11-01", "6")], schema)
    stops = new.withColumn("id", F.when(F.col("id") == "6", F.raise_error(F.lit("stop"))).otherwise("5"))
    with pytest.raises(Exception, match="stop"):
        analytics.export_by_period(stops, out)
    assert analytics.finished_periods(spark, out) == {"2014-07-25": 1}
    back = spark.read.schema("id string, range_end string").csv(out, header=True)
    assert sorted(r.id for r in back.collect()) == ["1", "2"]
    analytics.export_by_period(new, out)
    assert analytics.finished_periods(spark, out) == {"2014-07-25": 1, "2014-11-01": 2}


def test_snapshots(spark, rows, tmp_path):
    df = rows([(1, None, ["a"]), (2, "x", [])], "id int, s string, l array<string>")
    back = S.write_snapshot(df, str(tmp_path / "t"))
    assert back.exceptAll(df).count() == 0 and back.count() == 2
    parts = S.write_snapshot(df, str(tmp_path / "p"), ["id"])
    assert parts.where("id = 2").first().s == "x"


def test_feature_sets_and_models(spark, rows, tmp_path):
    from pyspark.ml import Pipeline, PipelineModel
    from pyspark.ml.feature import VectorAssembler

    df = rows([(float(i), i % 2) for i in range(20)], "x double, label int")
    assembler = VectorAssembler(inputCols=["x"], outputCol="features")
    vectors = assembler.transform(df)
    S.write_feature_set(vectors, vectors.limit(5), str(tmp_path / "f"))
    train, test = S.read_feature_set(spark, str(tmp_path / "f"))
    assert (train.count(), test.count()) == (20, 5)
    model = PipelineModel(stages=[Pipeline(stages=[assembler]).fit(df).stages[0], logistic(17.0).fit(train, 20)])
    S.write_model(model, str(tmp_path / "m"))
    again = S.read_model(str(tmp_path / "m"))
    assert list(again.stages[-1].coefficients) == list(model.stages[-1].coefficients)


def test_paged_json_counts_repeated_items_once(spark, tmp_path):
    pages = [
        {"pages": 2, "items": [{"id": 1, "firstName": "a"}, {"id": 2, "firstName": "b"}]},
        {"pages": 2, "items": [{"id": 1, "firstName": "a"}, {"id": 2, "firstName": "b"}]},
        {"pages": 2, "items": [{"id": 3, "lastName": "c"}]},
    ]
    for i, page in enumerate(pages):
        write(tmp_path / f"{i}.json", json.dumps(page, indent=1))
    items = J.page_items(J.read_json(spark, str(tmp_path), J.PAGE_OF_CONTACTS, multiline=True))
    assert sorted((r.id, r.firstName, r.lastName) for r in items.collect()) == [
        (1, "a", None), (2, "b", None), (3, None, "c"),
    ]


ANSWERS = [
    {"columnHeaders": [{"name": "ga:transactionId"}, {"name": "ga:users"}], "rows": [["1", "5"], ["0", "9"], ["2", "6"]]},
    {"columnHeaders": [{"name": "ga:transactionId"}, {"name": "ga:hits"}], "rows": [["2", "7"], ["3", "8"]]},
]


def answers(spark, tmp_path, documents, period):
    folder = tmp_path / period
    folder.mkdir()
    for i, document in enumerate(documents):
        write(folder / f"{i}.json", json.dumps(document))
    return J.read_json(spark, str(folder), J.HEADER_AND_ROWS).withColumn("range_end", F.lit(period))


def test_header_and_rows(spark, tmp_path):
    df = answers(spark, tmp_path, ANSWERS, "p1")
    got = J.header_rows(df, ["ga:transactionId", "ga:users", "ga:hits"])
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(
        [("1", "5", None), ("0", "9", None), ("2", "6", None), ("2", None, "7"), ("3", None, "8")],
        key=repr,
    )


def test_metric_answers_side_by_side(spark, tmp_path):
    later = [dict(ANSWERS[1])]
    df = answers(spark, tmp_path, ANSWERS, "p1").unionByName(answers(spark, tmp_path, later, "p2"))
    wide = analytics.metrics_by_period(df, ["ga:users", "ga:hits"], ["p1", "p2"])
    # The last period counts like any other; its first metric with an answer is another one.
    assert sorted(map(tuple, wide.collect()), key=repr) == sorted(
        [("p1", "1", "5", None), ("p1", "2", "6", "7"), ("p2", "2", None, "7"), ("p2", "3", None, "8")],
        key=repr,
    )


def test_dimension_answers_meet_on_id_and_value(spark, tmp_path):
    def answer(name, cells):
        headers = ["ga:transactionId", name, "ga:totalValue"]
        return {"columnHeaders": [{"name": h} for h in headers], "rows": cells}

    documents = [
        answer("ga:city", [["1", "Ulm", "9.0"], ["2", "Bonn", "8.0"]]),
        answer("ga:browser", [["1", "B1", "9.0"], ["2", "B2", "7.0"]]),
    ]
    df = answers(spark, tmp_path, documents, "p1")
    wide = analytics.dimensions_by_period(df, ["ga:city", "ga:browser"], ["p1"])
    assert sorted(map(tuple, wide.collect())) == [
        ("p1", "1", "9.0", "Ulm", "B1"), ("p1", "2", "8.0", "Bonn", None),
    ]


STARTS = ["2014-07-25", "2014-11-01", "2015-02-01", "2015-05-01", "2017-08-01"]


def test_periods_leave_no_day_out():
    ranges = analytics.periods(STARTS, "2017-09-01")
    assert len(ranges) == 5
    assert ranges[2] == ("2015-02-01", "2015-05-01")
    assert all(end == start for (_, end), (start, _) in zip(ranges, ranges[1:]))


def test_period_of_a_time(rows):
    df = rows([("2014-07-24",), ("2014-07-25",), ("2015-04-30",), ("2017-08-31",), ("2017-09-01",)], "d string")
    got = df.select(analytics.period_of(F.to_date("d"), analytics.periods(STARTS, "2017-09-01"))).collect()
    assert [r[0] for r in got] == [None, "2014-07-25", "2015-02-01", "2017-08-01", None]


def test_bad_json_text_is_null(rows):
    df = rows([('{"k": 3}',), ("broken",), (None,)], "t string")
    got = df.select(J.parsed(F.col("t"), "k bigint").k).collect()
    assert [r[0] for r in got] == [3, None, None]


def test_without_a_shared_folder_tables_are_kept_not_written(rows, monkeypatch):
    from custvalue import session

    df = rows([(1,), (2,)], "a int")
    monkeypatch.setattr(session, "has_checkpoint_folder", lambda spark: False)
    kept = session.cut_lineage(df)
    assert kept.storageLevel.useDisk and kept.count() == 2
    kept.unpersist()


def test_the_folder_is_the_one_the_session_names(spark):
    from custvalue import session

    assert session.has_checkpoint_folder(spark)
    assert spark.conf.get("spark.checkpoint.dir") in spark.sparkContext.getCheckpointDir()
