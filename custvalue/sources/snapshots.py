"""Table and feature-set snapshots as Parquet, fitted models as Spark ML folders."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml import PipelineModel
from pyspark.sql import DataFrame, SparkSession


def write_snapshot(df: DataFrame, path: str, partition_by: Sequence[str] = ()) -> DataFrame:
    """Write ``df`` and return it read back, so later steps start from the files."""
    writer = df.write.mode("overwrite")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    writer.parquet(path)
    return read_snapshot(df.sparkSession, path)


def read_snapshot(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.parquet(path)


def write_feature_set(train: DataFrame, test: DataFrame, path: str) -> None:
    """Prepared train and test rows (feature vectors and labels) under one folder."""
    train.write.mode("overwrite").parquet(f"{path}/train")
    test.write.mode("overwrite").parquet(f"{path}/test")


def read_feature_set(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    return spark.read.parquet(f"{path}/train"), spark.read.parquet(f"{path}/test")


def write_model(model: PipelineModel, path: str) -> None:
    model.write().overwrite().save(path)


def read_model(path: str) -> PipelineModel:
    return PipelineModel.load(path)
