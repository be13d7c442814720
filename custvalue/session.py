"""Session settings for stand-alone runs, and how a table is held that is read again."""

from __future__ import annotations

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession


def build_session(app: str = "custvalue", master: str | None = None, **conf: str) -> SparkSession:
    """A session with adaptive execution and UTC; a cluster adds its own settings on top."""
    builder = (
        SparkSession.builder.appName(app)
        .config("spark.sql.adaptive.enabled", "true")
        .config("spark.sql.adaptive.skewJoin.enabled", "true")
        .config("spark.sql.adaptive.coalescePartitions.enabled", "true")
        .config("spark.sql.session.timeZone", "UTC")
    )
    if master:
        builder = builder.master(master)
    for name, value in conf.items():
        builder = builder.config(name, value)
    return builder.getOrCreate()


def has_checkpoint_folder(spark: SparkSession) -> bool:
    """Whether the session names a shared folder for checkpoints, which then is in use."""
    context = spark.sparkContext
    if context.getCheckpointDir():
        return True
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if folder:
        context.setCheckpointDir(folder)
    return bool(folder)


def held(df: DataFrame) -> DataFrame:
    """``df`` evaluated once for several readers, kept by column in memory and on disk.

    What a lost executor held is computed again from the input.
    """
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def cut_lineage(df: DataFrame) -> DataFrame:
    """For iterative jobs: write ``df`` to the shared folder and go on from there.

    Files in shared storage outlive a lost executor, so later steps never replay the whole
    history. A session that names no folder keeps the table instead, with its history.
    """
    if has_checkpoint_folder(df.sparkSession):
        return df.checkpoint(eager=True)
    return held(df)
