"""Every registered query: its SQL, its plan, its contract."""

import pytest

import __spark_entry__ as entry
from compare import connect, difference

FOLDER = "/root/testdata/sf0.001"
QUERIES, ORACLES = entry.queries(), entry.oracle_sql()
# Distances are computed on arrays in Arrow batches; everything else stays in the JVM.
WITH_ARRAYS = {"knn_vote", "over_sampled_classes"}


@pytest.fixture(scope="module")
def connection():
    return connect(FOLDER)


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_query_equals_its_sql(spark, connection, name):
    df = QUERIES[name](spark, FOLDER)
    assert difference(df, connection.execute(ORACLES[name])) is None
    plan = df._jdf.queryExecution().executedPlan().toString()
    for bad in ("CartesianProduct", "BroadcastNestedLoopJoin", "BatchEvalPython"):
        assert bad not in plan
    assert name in WITH_ARRAYS or ("ArrowEvalPython" not in plan and "MapInPandas" not in plan)


@pytest.mark.parametrize("name", ["predictive_imputation", "license_model"])
def test_query_without_sql_gives_rows(spark, name):
    assert QUERIES[name](spark, FOLDER).count() > 0


def test_contract(spark):
    assert set(ORACLES) <= set(QUERIES)
    flagship = entry.entry(spark)
    assert flagship.columns == [
        "c_custkey", "c_mktsegment", "revenue", "number_support_tickets", "time_spent", "loss",
        "adjusted_revenue",
    ]
