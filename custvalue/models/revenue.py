"""Regression of revenue per customer."""

from __future__ import annotations

from pyspark.ml.evaluation import RegressionEvaluator
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import DecisionTreeRegressor, RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.operators.features import FILL_L1_SHARE, FILL_PENALTY, elastic_net
from custvalue.operators.neighbors import nearest
from custvalue.session import held


def neighbor_means(train: DataFrame, test: DataFrame, k: int) -> DataFrame:
    """Test rows with the mean label of their ``k`` nearest train rows as prediction."""
    as_array = vector_to_array("features").alias("vector")
    near = nearest(test.select("key", as_array), train.select("key", as_array), k, "key", "vector")
    means = (
        near.join(train.select(F.col("key").alias("neighbor"), "label"), "neighbor")
        .groupBy(F.col("query").alias("key"))
        .agg(F.avg("label").alias("prediction"))
    )
    return test.join(means, "key")


def compare_revenue_models(train: DataFrame, test: DataFrame, k: int = 5) -> DataFrame:
    """Errors on the test rows per regressor: (model, rmse, mae, r2, rows).

    Rows have ``key``, ``label`` and ``features``. Predictions are made once for all scores.
    """
    spread = train.agg(F.stddev_samp("label")).first()[0] or 1.0
    fitted = {
        "elastic_net": elastic_net("label", spread, FILL_PENALTY, FILL_L1_SHARE).fit(train),
        "decision_tree": DecisionTreeRegressor(seed=42).fit(train),
        "random_forest": RandomForestRegressor(seed=42).fit(train),
    }
    predictions = {name: model.transform(test) for name, model in fitted.items()}
    predictions["neighbors"] = neighbor_means(train, test, k)
    rows = []
    for name, predicted in predictions.items():
        predicted = held(predicted.select(F.col("label").cast("double"), "prediction"))
        try:
            scores = [
                RegressionEvaluator(metricName=m).evaluate(predicted) for m in ("rmse", "mae", "r2")
            ]
            rows.append((name, *scores, predicted.where("prediction IS NOT NULL").count()))
        finally:
            predicted.unpersist()
    return train.sparkSession.createDataFrame(
        rows, "model string, rmse double, mae double, r2 double, rows bigint"
    )
