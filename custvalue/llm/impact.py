"""Exact top-k inner products by an impact-ordered, score-at-a-time index.

Components are whole numbers, the impacts. In a block of vectors a posting is one component of one
vector; postings are cut into segments by descending quantised impact. A block of queries adds the
segments to its accumulators one after the other, largest impacts first. What is still to come is
bounded for every pair (Cauchy-Schwarz on the components not yet added), so after each segment a
query's k-th best lower bound proves which vectors can no longer be members. Only when few
possible members are left does the work stop; these are scored exactly, in whole numbers.

Query blocks meet vector blocks in a grid of cells of bounded size; a cell returns at most k rows
per query, and the best k of all cells are the answer.

Defined results: vectors that are null, empty, or hold null or non-finite components take no
part, nor do rows without an id. Vectors meet only those of their own length. Ties go to the
smaller id. Rows that repeat id and vector (in whole numbers) are one row, made one before the
blocks are cut, so it does not matter where they lie; it is asked if any of them is. An id with
several vectors has several rows, and as a query the k best pairs of them all. A row never meets
its own id. An empty table gives an empty result. Other columns are not read. Scores beyond 64
bits raise.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from custvalue.llm.shared import named

BLOCK = 2048  # vectors in a block
QUERIES_PER_CELL = 2048
VECTORS_PER_CELL = 16384
_SEGMENTS = (0.35, 0.6, 0.8, 1.0)  # shares of the postings added by and with each segment
_FEW = 0.02  # possible members, as a share of all pairs, that are scored exactly at once


def _blocks():
    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            column = batch.column(2)
            length = np.asarray(column.value_lengths().fill_null(0))
            values = np.asarray(column.flatten())
            edges = np.concatenate([[0], np.cumsum(length)])
            ids = batch.column(0).to_numpy(zero_copy_only=False)
            asked = batch.column(1).to_numpy(zero_copy_only=False).astype(bool)
            rows: dict[str, list] = {k: [] for k in ("kind", "width", "cell", "ids", "values")}
            for width in np.unique(length).tolist():
                for kind in (0, 1):
                    mine = np.flatnonzero((length == width) & (asked | (kind == 0)))
                    for low in range(0, len(mine), BLOCK):
                        part = mine[low : low + BLOCK]
                        matrix = values[edges[part][:, None] + np.arange(width)]
                        if np.abs(matrix.astype(np.float64)).max() >= 2.0**31:
                            raise ValueError("components beyond 31 bits")
                        rows["kind"].append(kind)
                        rows["width"].append(width)
                        rows["cell"].append(int(ids[part[0]]))
                        rows["ids"].append(ids[part].astype(np.int64).tobytes())
                        rows["values"].append(matrix.astype(np.int32).tobytes())
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(rows["kind"], pa.int32()),
                    pa.array(rows["width"], pa.int32()),
                    pa.array(rows["cell"], pa.int64()),
                    pa.array(rows["ids"], pa.binary()),
                    pa.array(rows["values"], pa.binary()),
                ],
                names=list(rows),
            )

    return cut


class Index:
    """Postings of a block of vectors in segments of descending quantised impact."""

    def __init__(self, ids: np.ndarray, vectors: np.ndarray, kind: type):
        self.ids, self.vectors = ids, vectors
        impact = np.abs(vectors)
        most = int(impact.max(initial=0))
        # Quantised impact: as many levels as there are values, at most 64.
        level = impact // max(1, -(-(most + 1) // 64))
        count = np.bincount(level.ravel(), minlength=1)[::-1].cumsum()
        levels = len(count)
        limits = sorted(
            {levels - 1 - int(np.searchsorted(count, share * impact.size)) for share in _SEGMENTS},
            reverse=True,
        )
        self.segments, above = [], levels
        for limit in [x for x in limits if x > 0] + [0]:
            inside = (level >= limit) & (level < above)
            rest = np.where(level < limit, vectors, 0).astype(np.float64)
            norm = np.sqrt((rest * rest).sum(axis=1))
            self.segments.append((np.where(inside, vectors, 0).astype(kind), norm))
            above = limit

    def best(
        self, query_ids: np.ndarray, queries: np.ndarray, k: int, floor: np.ndarray
    ) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query row, vector row, score) of the possible members, exactly scored.

        ``floor`` has, per query, a score that k members are already known to reach.
        """
        kind = self.segments[0][0].dtype
        q = queries.astype(kind)
        reach = np.sqrt((queries.astype(np.float64) ** 2).sum(axis=1))
        added = np.zeros((len(q), len(self.ids)), kind)
        own = query_ids[:, None] == self.ids[None, :]
        possible = ~own
        for part, rest in self.segments:
            added += q @ part.T
            slack = (reach[:, None] * rest[None, :] * (1 + 1e-9)).astype(np.float64)
            lower = added - slack
            lower[own] = -np.inf
            limit = floor
            if lower.shape[1] > k:
                # k rows that reach this at least: no vector below it can be a member.
                kth = np.partition(lower, lower.shape[1] - k, axis=1)[:, lower.shape[1] - k]
                limit = np.maximum(floor, kth)
            possible = (added + slack >= limit[:, None]) & ~own
            if possible.sum() <= _FEW * possible.size:
                break
        row, col = np.nonzero(possible)
        score = np.empty(len(row), np.int64)
        for low in range(0, len(row), 1 << 16):
            some = slice(low, low + (1 << 16))
            score[some] = (
                queries[row[some]].astype(np.int64) * self.vectors[col[some]].astype(np.int64)
            ).sum(axis=1)
        return row, col, score


def _top(k, query, ids, score):
    """The k best of each query, ties to the smaller id."""
    order = np.lexsort((ids, -score, query))
    query, ids, score = query[order], ids[order], score[order]
    first = np.searchsorted(query, query)
    keep = np.arange(len(query)) - first < k
    return query[keep], ids[keep], score[keep]


def _search(k: int):
    def search(cell: pa.Table) -> pa.Table:
        width = cell.column("width")[0].as_py()
        kinds = cell.column("kind").to_numpy()

        def matrix(row: int) -> tuple[np.ndarray, np.ndarray]:
            ids = np.frombuffer(cell.column("ids")[row].as_py(), np.int64)
            values = np.frombuffer(cell.column("values")[row].as_py(), np.int32)
            return ids, values.reshape(-1, width)

        asked = [matrix(int(i)) for i in np.flatnonzero(kinds == 1)]
        found = []
        if asked and (kinds == 0).any():
            query_ids = np.concatenate([ids for ids, _ in asked])
            queries = np.concatenate([values for _, values in asked])
            best = (np.empty(0, np.int64),) * 3
            floor = np.full(len(query_ids), -np.inf)
            most = float(np.abs(queries).max(initial=0))
            for i in np.flatnonzero(kinds == 0).tolist():
                ids, vectors = matrix(i)
                bound = most * float(np.abs(vectors).max(initial=0)) * width
                if bound >= 2.0**53:
                    raise ValueError("scores beyond 53 bits")
                index = Index(ids, vectors, np.float32 if bound < 2.0**24 else np.float64)
                row, col, score = index.best(query_ids, queries, k, floor)
                best = _top(
                    k,
                    np.concatenate([best[0], row]),
                    np.concatenate([best[1], ids[col]]),
                    np.concatenate([best[2], score]),
                )
                full = np.flatnonzero(np.bincount(best[0], minlength=len(floor)) >= k)
                last = np.searchsorted(best[0], full, "right") - 1
                floor[full] = best[2][last]
            found = [query_ids[best[0]], best[1], best[2]]
        else:
            found = [np.empty(0, np.int64)] * 3
        return pa.table([pa.array(x) for x in found], names=["query_id", "vec_id", "score"])

    return search


def top_k(
    vectors: DataFrame,
    asked: Column,
    k: int = 20,
    scale: float = 64.0,
    id_column: str = "vec_id",
    vector_column: str = "embedding",
) -> DataFrame:
    """query_id, rank, vec_id, score: the k best vectors of every row for which ``asked`` holds.

    Components count as ``floor(scale * x)``.
    """
    rows = vectors.select(
        named(id_column).cast("long").alias("id"),
        F.coalesce(asked, F.lit(False)).alias("asked"),
        named(vector_column).cast("array<double>").alias("vector"),
    ).where("id IS NOT NULL AND size(vector) > 0")
    rows = rows.where(F.forall("vector", lambda x: x.isNotNull() & (F.abs(x) < float("inf"))))
    size = rows.agg(F.count("*").alias("n"), F.count_if("asked").alias("q")).first()
    down = max(1, -(-size["q"] // QUERIES_PER_CELL))
    across = max(1, -(-size["n"] // VECTORS_PER_CELL))
    # Beyond 63 bits floor() ends at the largest number, which is refused later.
    whole = F.transform("vector", lambda x: F.floor(x * F.lit(scale)))
    rows = rows.select("id", "asked", whole.alias("vector"))
    rows = rows.groupBy("id", "vector").agg(F.max("asked").alias("asked"))
    # In order, so that a repeated task cuts the same blocks.
    rows = rows.select("id", "asked", "vector").sortWithinPartitions("id", "vector")
    blocks = rows.mapInArrow(
        _blocks(), "kind int, width int, cell long, ids binary, values binary"
    )
    place = F.xxhash64("cell", "width", "kind")

    def spread(kind: int, own: int, other: int, names: tuple[str, str]) -> DataFrame:
        return blocks.where(F.col("kind") == kind).select(
            "kind", "width", "ids", "values",
            F.pmod(place, F.lit(own).cast("long")).alias(names[0]),
            F.explode(F.sequence(F.lit(0).cast("long"), F.lit(other - 1).cast("long"))).alias(
                names[1]
            ),
        )

    cells = spread(1, down, across, ("down", "across")).unionByName(
        spread(0, across, down, ("across", "down"))
    )
    found = cells.groupBy("width", "down", "across").applyInArrow(
        _search(k), "query_id long, vec_id long, score long"
    )
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    ranked = found.withColumn("rank", F.row_number().over(order))
    return ranked.where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
