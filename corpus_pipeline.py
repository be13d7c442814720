"""From raw documents to packed token sequences, stage by stage.

Each stage is written as Parquet and read again as the next one's documents, so a lost executor
never replays an earlier stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from custvalue.llm import stages
from custvalue.llm.queries import vocabulary
from custvalue.llm.shared import saved


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.good_documents(docs, stages.labels_of(spark, sf_dir))


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.one_of_each_group(docs)


def passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.unrepeated_text(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.mixed_sources(docs)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return stages.sequences(docs, vocabulary())


STAGES = [
    ("quality classifier", quality),
    ("n-gram Jaccard join", near_copies),
    ("substring dedup", passages),
    ("mixing sources to target weights", mix),
    ("best-fit packing", pack),
]

# The classifier's and the tokenizer's results cannot be expressed in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = saved(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
