"""Connected components of links between numbered nodes, in rounds of joins."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.llm.shared import Scratch, saved

_MOST_ROUNDS = 100


def components(links: DataFrame) -> DataFrame:
    """(node, component): the smallest node that links (columns a and b) reach, for linked nodes.

    Every round points each node at the smallest node among its neighbours' neighbours
    (alternating stars around the larger and the smaller end), so chains halve and a group of
    any shape is a star after a number of rounds that grows with the logarithm of its length.
    Each round is stored; sums over a hot centre are taken before the shuffle.
    """
    scratch = Scratch()
    both = links.where("a IS NOT NULL AND b IS NOT NULL AND a <> b")
    edges = scratch.saved(
        both.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    )
    for _ in range(_MOST_ROUNDS):
        # Larger neighbours of a node, and itself, go to its smallest neighbour.
        round_trip = edges.select("a", "b").union(edges.select(F.col("b"), F.col("a")))
        round_trip = round_trip.toDF("node", "to")
        least = round_trip.groupBy("node").agg(F.min("to").alias("least"))
        least = least.select(
            F.col("node").alias("__node"), F.least("node", "least").alias("__least")
        )
        large = (
            edges.join(least, F.struct("b") == F.struct("__node"))
            .select("a", F.col("__least").alias("b"))
            .where("a <> b")
        )
        stars = scratch.saved(large.distinct())
        # Then all smaller neighbours of a node go to the smallest of them.
        lowest = stars.groupBy("a").agg(F.min("b").alias("__low"))
        lowest = lowest.withColumnRenamed("a", "__a")
        small = (
            stars.join(lowest, F.struct("a") == F.struct("__a"))
            .select(F.explode(F.array(F.struct("a", F.col("__low").alias("b")), F.struct(F.col("b").alias("a"), F.col("__low").alias("b")))).alias("e"))
            .select("e.*")
            .where("a <> b")
            .distinct()
        )
        edges = scratch.saved(small)
        # Done when every node has one target and no target points on.
        heads = edges.select(F.col("b").alias("__head")).distinct()
        several = edges.groupBy("a").count().where("count > 1").limit(1).count()
        onward = edges.join(heads, F.col("a") == F.col("__head"), "left_semi").limit(1).count()
        if not several and not onward:
            break
    else:
        raise RuntimeError(f"components did not settle in {_MOST_ROUNDS} rounds")
    stars = edges.select(F.col("a").alias("node"), F.col("b").alias("component"))
    centres = edges.select(F.col("b").alias("node"), F.col("b").alias("component")).distinct()
    found = saved(stars.union(centres))
    scratch.clear()
    return found
