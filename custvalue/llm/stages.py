"""Stages of a corpus pipeline: each takes documents and gives documents, the last one sequences.

A stage keeps the columns of its input, whatever they are called. Where it changes a text and the
documents have ``n_chars``, that column follows the text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from custvalue.llm import cotraining, jaccard, mixing, packing, substrings
from custvalue.llm.shared import named


def _counted(docs: DataFrame) -> DataFrame:
    if "n_chars" not in docs.columns:
        return docs
    kind = docs.schema["n_chars"].dataType
    return docs.withColumn("n_chars", F.length("text").cast(kind))


def good_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    bad = labels.select("doc_id", (1 - F.col("quality")).alias("bad"))
    model = cotraining.fit(docs, bad)
    kept = cotraining.scored(docs, model).where("accepted")
    return kept.select(*map(named, docs.columns))


def one_of_each_group(docs: DataFrame) -> DataFrame:
    """Of each group of near copies the document with the smallest id.

    Equal rows of that id are one document. Rows without an id stay only where no row with an id
    is in their group; of those equal in text one stays.
    """
    groups = jaccard.similar_groups(docs)
    stays = groups.where(F.col("doc_id").eqNullSafe(F.col("component_id")))
    stays = stays.select(F.struct("doc_id").alias("__id")).distinct()
    kept = docs.join(stays, F.struct("doc_id").eqNullSafe(F.col("__id")), "left_semi")
    kept = kept.withColumn("__text", F.xxhash64("text"))
    return kept.dropDuplicates(["doc_id", "__text"]).drop("__text")


def unrepeated_text(docs: DataFrame) -> DataFrame:
    """With the words taken out that an earlier passage covers. What has no word left goes."""
    stripped = substrings.without_repeats(docs)
    text = F.when(F.col("n_removed") > 0, F.col("kept_text")).otherwise(F.col("text"))
    kept = stripped.where("n_removed < n_words OR n_words = 0").withColumn("text", text)
    return _counted(kept).select(*map(named, docs.columns))


def mixed_sources(docs: DataFrame) -> DataFrame:
    """In the proportions asked for, as often as a document comes in the mix, in its order."""
    mixed = mixing.mix(docs)
    return _counted(mixed).select(*map(named, docs.columns))


def sequences(docs: DataFrame, tokenizer: str) -> DataFrame:
    """The pieces of all documents with their place in sequences of tokens."""
    return packing.packed(packing.pieces(docs, tokenizer))


def labels_of(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")
