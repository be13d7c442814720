"""Exact nearest neighbours and what is built on them."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from custvalue.functions.nulls import named
from custvalue.operators.splits import stratified_parts
from custvalue.session import held

_BLOCK_ROWS = 1024  # points in a block, and queries that look at blocks together
_POINTS_PER_CELL = 65536
_LEAST_PER_CELL = 4096
_QUERIES_PER_CELL = 65536
_CELLS = 32  # wanted at least, for as many tasks
_SAMPLE = 50_000  # points that place the borders of regions
_SLACK = 1e-9

# The array helpers travel with the job, so executors need no copy of this package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


def _halves(values: np.ndarray) -> tuple[int, float] | None:
    """(dimension, border) that halves these rows where they are spread most; None if all equal."""
    if len(values) < 2:
        return None
    low, high = values.min(axis=0), values.max(axis=0)
    f = int(np.argmax(np.where(high > low, values.std(axis=0), -1.0)))
    if not high[f] > low[f]:
        return None
    ordered = np.sort(values[:, f])
    border = ordered[(len(ordered) - 1) // 2]
    if border == ordered[-1]:
        border = ordered[ordered < border][-1]
    return f, float(border)


def _in_space(vectors: np.ndarray, size: int) -> list[np.ndarray]:
    """Positions in groups of at most ``size`` rows that lie close together."""
    found, waiting = [], [np.arange(len(vectors))]
    while waiting:
        some = waiting.pop()
        if len(some) <= size:
            found.append(some)
            continue
        half = _halves(vectors[some])
        if half is None:
            found += [some[low : low + size] for low in range(0, len(some), size)]
            continue
        low = vectors[some, half[0]] <= half[1]
        waiting += [some[~low], some[low]]
    return found


class _Regions:
    """Space in halves of halves, by borders from a sample; every row has a region."""

    def __init__(self, sample: np.ndarray, depth: int):
        self.depth = depth
        inner = 2**depth - 1
        self.feature, self.border = np.zeros(inner, np.int64), np.full(inner, np.inf)
        there = {0: sample}
        for node in range(inner):
            mine = there.pop(node)
            half = _halves(mine)
            low = np.ones(len(mine), bool)
            if half is not None:
                self.feature[node], self.border[node] = half
                low = mine[:, half[0]] <= half[1]
            if 2 * node + 1 < inner:
                there[2 * node + 1], there[2 * node + 2] = mine[low], mine[~low]

    def of(self, x: np.ndarray) -> np.ndarray:
        node = np.zeros(len(x), np.int64)
        for _ in range(self.depth):
            beyond = x[np.arange(len(x)), self.feature[node]] > self.border[node]
            node = 2 * node + 1 + beyond
        return node - (2**self.depth - 1)


def _to_boxes(rows: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """The least distance that a point in each box can have from each row."""
    found = np.empty((len(rows), len(low)))
    for i in range(len(low)):
        way = np.maximum(np.maximum(low[i] - rows, rows - high[i]), 0.0)
        found[:, i] = np.sqrt((way * way).sum(axis=1))
    return found


def _batch_rows(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    apart = batch.column("apart").fill_null(np.iinfo(np.int64).min).to_numpy(zero_copy_only=False)
    vectors = batch.column("vector").flatten().to_numpy(zero_copy_only=False)
    return (
        batch.column("key").to_numpy(zero_copy_only=False), apart,
        vectors.reshape(batch.num_rows, -1),
    )


@dataclass(frozen=True)
class _Cells:
    """Regions that have points, with their boxes; a region of many points is several cells, which
    share its points by key."""

    regions: _Regions
    numbers: np.ndarray
    low: np.ndarray
    high: np.ndarray
    first: np.ndarray
    parts: np.ndarray

    @property
    def count(self) -> int:
        return int(self.parts.sum())

    def of_points(self, keys: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        return self._part(np.searchsorted(self.numbers, self.regions.of(vectors)), keys)

    def homes(self, keys: np.ndarray, vectors: np.ndarray) -> np.ndarray:
        """The cell where a query looks first."""
        return self._part(_to_boxes(vectors, self.low, self.high).argmin(axis=1), keys)

    def _part(self, place: np.ndarray, keys: np.ndarray) -> np.ndarray:
        mixed = (keys.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)
        return self.first[place] + (mixed % self.parts[place].astype(np.uint64)).astype(np.int64)

    def others(self, keys, vectors, limits) -> Iterator[tuple[int, np.ndarray]]:
        """(cell, queries) for all cells but the first where a point can be within the limit."""
        home = self.homes(keys, vectors)
        reach = limits * (1 + _SLACK) + _SLACK
        for place in range(len(self.numbers)):
            one = slice(place, place + 1)
            near = _to_boxes(vectors, self.low[one], self.high[one])[:, 0] <= reach
            for cell in range(self.first[place], self.first[place] + self.parts[place]):
                some = np.flatnonzero(near & (home != cell))
                if len(some):
                    yield cell, some


_PACK = "cell long, slice long, kind int, width int, keys binary, apart binary, vectors binary, limits binary"


def _pack(cell, slice_, kind, keys, apart, vectors, limits=None) -> tuple:
    return (
        int(cell), int(slice_), kind, vectors.shape[1], keys.tobytes(), apart.tobytes(),
        np.ascontiguousarray(vectors).tobytes(), b"" if limits is None else limits.tobytes(),
    )


def _batch_of(rows: list[tuple], schema: str) -> pa.RecordBatch:
    kinds = {
        "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "bigint": pa.int64(),
        "double": pa.float64(),
    }
    fields = [field.split() for field in schema.split(", ")]
    columns = list(zip(*rows)) or [()] * len(fields)
    return pa.RecordBatch.from_arrays(
        [pa.array(c, kinds[k]) for c, (_, k) in zip(columns, fields)], [n for n, _ in fields]
    )


def _read_packs(packs) -> Iterator[tuple[np.ndarray, ...]]:
    names = ("width", "keys", "apart", "vectors", "limits")
    for width, keys, apart, vectors, limits in zip(*(packs.column(n) for n in names)):
        keys = np.frombuffer(keys.as_py(), np.int64)
        limits = np.frombuffer(limits.as_py(), np.float64)
        yield (
            keys, np.frombuffer(apart.as_py(), np.int64),
            np.frombuffer(vectors.as_py(), np.float64).reshape(-1, width.as_py()),
            limits if len(limits) else np.full(len(keys), np.inf),
        )


class _Block:
    """Points with their own box."""

    def __init__(self, keys: np.ndarray, apart: np.ndarray, vectors: np.ndarray):
        order = np.argsort(keys, kind="stable")
        self.keys, self.apart, self.vectors = keys[order], apart[order], vectors[order]
        self.squares = (self.vectors * self.vectors).sum(axis=1)


def _cell_search(k: int, separate: bool):
    """Per some queries of a cell: their k nearest points there, and the queries with the distance
    beyond which they look for no more."""

    def search(cell: pa.Table) -> Iterator[tuple]:
        kinds = cell.column("kind").to_numpy()
        asked = list(_read_packs(cell.filter(pa.array(kinds == 1))))
        there = list(_read_packs(cell.filter(pa.array(kinds == 0))))
        if not asked:
            return
        keys, apart, queries, limits = (np.concatenate(c) for c in zip(*asked))
        blocks = []
        if there:
            names, folds, points, _ = (np.concatenate(c) for c in zip(*there))
            blocks = [_Block(names[i], folds[i], points[i]) for i in _in_space(points, _BLOCK_ROWS)]
        for some in _in_space(queries, _BLOCK_ROWS):
            mine = keys[some], apart[some], queries[some], limits[some].copy()
            found = _nearest_in_cell(*mine, blocks, k, separate)
            yield mine, found

    return search


def _nearest_in_cell(keys, apart, queries, limit, blocks: list[_Block], k: int, separate: bool):
    """The k nearest points of a cell's blocks for each query, none beyond its limit: (query,
    neighbor, distance). Limits shrink to the distance of the k-th."""
    best = [np.empty(0, np.int64), np.empty(0, np.int64), np.empty(0)]
    if not blocks:
        return best
    to_box = _to_boxes(
        queries,
        np.stack([b.vectors.min(axis=0) for b in blocks]),
        np.stack([b.vectors.max(axis=0) for b in blocks]),
    )
    # Nearest blocks first, so that limits are tight when the far ones come.
    for i in np.argsort(np.median(to_box, axis=0), kind="stable"):
        block = blocks[i]
        # A block can be left out where its nearest possible point is too far.
        near = np.flatnonzero(to_box[:, i] <= limit * (1 + _SLACK) + _SLACK)
        if not len(near):
            continue
        q = queries[near]
        squares = (q * q).sum(axis=1)[:, None] + block.squares[None, :]
        about = squares - 2 * (q @ block.vectors.T)
        # What rounding may do to the quick distances, as a bound on their squares.
        slack = 1e-11 * squares.max() * max(8, q.shape[1] / 8) + 1e-300
        if separate:
            about[apart[near][:, None] == block.apart[None, :]] = np.inf
        bound = np.full(len(near), np.inf)
        if about.shape[1] > k:
            bound = np.partition(about, k - 1, axis=1)[:, k - 1]
        bound = np.minimum(bound + slack, limit[near] ** 2 * (1 + _SLACK) + slack)
        row, col = np.nonzero(about <= bound[:, None])
        row, col = row[np.isfinite(about[row, col])], col[np.isfinite(about[row, col])]
        exact = np.empty(len(row))
        for low in range(0, len(row), 1 << 16):
            some = slice(low, low + (1 << 16))
            way = q[row[some]] - block.vectors[col[some]]
            exact[some] = np.sqrt((way**2).sum(axis=1))
        name = np.concatenate([best[0], near[row]])
        point = np.concatenate([best[1], block.keys[col]])
        distance = np.concatenate([best[2], exact])
        order = np.lexsort((point, distance, name))
        name, point, distance = name[order], point[order], distance[order]
        place = np.arange(len(name)) - np.searchsorted(name, name)
        best = [name[place < k], point[place < k], distance[place < k]]
        full = np.flatnonzero(np.bincount(best[0], minlength=len(limit)) >= k)
        last = best[2][np.searchsorted(best[0], full, "right") - 1]
        limit[full] = np.minimum(limit[full], last)
    return keys[best[0]], best[1], best[2]


def nearest(
    queries: DataFrame,
    points: DataFrame,
    k: int,
    key: str,
    vector: str,
    apart: str | None = None,
) -> DataFrame:
    """(query, neighbor, distance, place): the ``k`` nearest points of each query row.

    Both tables have a unique integer ``key`` and a ``vector`` as an array of numbers; equal
    distances rank by key. Points that share the query's value of the integer column
    ``apart`` are left out: with the key, a row is no neighbour of itself; with a fold number,
    rows find neighbours in the other folds only.

    Points are dealt to cells of bounded size that lie close together. Each query looks into one
    cell first; the distance of its k-th point there is a limit, and of the other cells it visits
    only those whose box is not beyond it. A cell that many queries visit is searched in slices of
    bounded size. In a cell, blocks beyond a query's limit are left out, the others are compared by
    one matrix product, and what may be among the nearest is measured exactly. Where nothing can be
    left out, every query meets every cell: rows then travel ``points / _POINTS_PER_CELL`` times.
    """
    columns = [
        named(key).cast("bigint").alias("key"),
        (F.lit(None) if apart is None else named(apart)).cast("bigint").alias("apart"),
        named(vector).cast("array<double>").alias("vector"),
    ]
    points, queries = points.select(*columns), queries.select(*columns)
    cells = _cells(points)
    if cells is None:
        empty = "query bigint, neighbor bigint, distance double, place int"
        return points.sparkSession.createDataFrame([], empty)
    search = _cell_search(k, apart is not None)

    def to_cells(kind: int, place):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if not batch.num_rows:
                    continue
                keys, away, vectors = _batch_rows(batch)
                at = place(keys, vectors)
                rows = [
                    _pack(c, 0, kind, keys[at == c], away[at == c], vectors[at == c])
                    for c in np.unique(at)
                ]
                yield _batch_of(rows, _PACK)

        return run

    dealt = points.mapInArrow(to_cells(0, cells.of_points), _PACK)
    asked = queries.mapInArrow(to_cells(1, cells.homes), _PACK)

    def looked(cell: pa.Table) -> pa.Table:
        rows = []
        for (keys, away, vectors, limits), found in search(cell):
            pack = _pack(0, 0, 1, keys, away, vectors, limits)
            rows.append((*pack, *(f.tobytes() for f in found)))
        return pa.Table.from_batches([_batch_of(rows, _LOOKED)])

    def unpack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for query, neighbor, distance in zip(*(batch.column(n) for n in _FOUND_NAMES)):
                yield _found(
                    np.frombuffer(query.as_py(), np.int64), np.frombuffer(neighbor.as_py(), np.int64),
                    np.frombuffer(distance.as_py(), np.float64),
                )

    first = held(_met(dealt, asked).groupBy("cell", "slice").applyInArrow(looked, _LOOKED))
    best = first.mapInArrow(unpack, _FOUND)
    if cells.count > 1:
        def visits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for keys, away, vectors, limits in _read_packs(batch):
                    for cell, i in cells.others(keys, vectors, limits):
                        pack = _pack(cell, 0, 1, keys[i], away[i], vectors[i], limits[i])
                        yield _batch_of([pack], _PACK)

        def further(cell: pa.Table) -> pa.Table:
            found = [f for _, f in search(cell)]
            columns = [np.concatenate(c) for c in zip(*found)] if found else [[], [], []]
            return pa.Table.from_batches([_found(*columns)])

        again = _met(dealt, first.mapInArrow(visits, _PACK))
        best = best.unionByName(again.groupBy("cell", "slice").applyInArrow(further, _FOUND))
    rank = F.row_number().over(Window.partitionBy("query").orderBy("distance", "neighbor"))
    return best.withColumn("place", rank).where(F.col("place") <= k)


_FOUND_NAMES = ("query", "neighbor", "distance")
_FOUND = "query bigint, neighbor bigint, distance double"
_LOOKED = _PACK + ", query binary, neighbor binary, distance binary"


def _found(query, neighbor, distance) -> pa.RecordBatch:
    kinds = [pa.int64(), pa.int64(), pa.float64()]
    arrays = [pa.array(f, k) for f, k in zip((query, neighbor, distance), kinds)]
    return pa.RecordBatch.from_arrays(arrays, list(_FOUND_NAMES))


def _cells(points: DataFrame) -> _Cells | None:
    """Cells for all points; only the borders between them come from a sample."""
    total = points.count()
    if not total:
        return None
    size = min(_POINTS_PER_CELL, max(_LEAST_PER_CELL, math.ceil(total / _CELLS)))
    depth = math.ceil(math.log2(math.ceil(total / size))) if total > size else 0
    every = max(1, total // _SAMPLE)
    sample = np.zeros((0, 1))
    if depth:
        some = points.where(F.pmod(F.xxhash64("key"), F.lit(every)) == 0).limit(2 * _SAMPLE)
        sample = np.array([r.vector for r in some.select("vector").collect()], np.float64)
        sample = sample[np.isfinite(sample).all(axis=1)] if len(sample) else np.zeros((0, 1))
    regions = _Regions(sample, depth)

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: dict[int, list] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            vectors = _batch_rows(batch)[2]
            at = regions.of(vectors)
            for r in np.unique(at).tolist():
                mine = vectors[at == r]
                n, low, high = seen.get(r, (0, mine[0], mine[0]))
                seen[r] = [
                    n + len(mine), np.fmin(low, np.fmin.reduce(mine)),
                    np.fmax(high, np.fmax.reduce(mine)),
                ]
        yield _batch_of([(r, n, a.tobytes(), b.tobytes()) for r, (n, a, b) in seen.items()], _BOX)

    def merge(boxes: pa.Table) -> pa.Table:
        low, high = (
            [np.frombuffer(b.as_py(), np.float64) for b in boxes.column(c)] for c in ("low", "high")
        )
        n = sum(boxes.column("n").to_pylist())
        row = (
            boxes.column("region")[0].as_py(), n, np.fmin.reduce(low).tobytes(),
            np.fmax.reduce(high).tobytes(),
        )
        return pa.Table.from_batches([_batch_of([row], _BOX)])

    boxes = points.mapInArrow(measure, _BOX).groupBy("region").applyInArrow(merge, _BOX).collect()
    boxes = sorted(boxes, key=lambda b: b.region)
    # A region may be larger than its share, up to twice that, before it is shared out.
    parts = np.array([max(1, math.ceil(b.n / (2 * size))) for b in boxes])
    return _Cells(
        regions, np.array([b.region for b in boxes]),
        np.stack([np.frombuffer(b.low, np.float64) for b in boxes]),
        np.stack([np.frombuffer(b.high, np.float64) for b in boxes]),
        np.cumsum(parts) - parts, parts,
    )


_BOX = "region long, n long, low binary, high binary"


def _met(dealt: DataFrame, asked: DataFrame) -> DataFrame:
    """Packs of points and of queries by cell, each with its share of the queries."""
    spark = dealt.sparkSession
    size = F.octet_length("keys") / 8
    counts = asked.groupBy("cell").agg(F.sum(size).alias("n")).collect()
    slices = [(r.cell, max(1, math.ceil(r.n / _QUERIES_PER_CELL))) for r in counts]
    known = F.broadcast(spark.createDataFrame(slices, "cell long, slices long"))
    mixed = F.pmod(F.xxhash64("keys"), F.col("slices"))
    names = [field.split()[0] for field in _PACK.split(", ")]
    # Cells that no query visits have no slices.
    points = dealt.join(known, "cell").withColumn(
        "slice", F.explode(F.sequence(F.lit(0).cast("long"), F.col("slices") - 1))
    )
    queries = asked.join(known, "cell").withColumn("slice", mixed)
    both = points.select(*names).unionByName(queries.select(*names))
    tasks = max(sum(n for _, n in slices), spark.sparkContext.defaultParallelism)
    return both.repartition(min(4096, 2 * tasks), "cell", "slice")


def knn_votes(neighbors: DataFrame, labels: DataFrame, key: str, label: str, k: int) -> DataFrame:
    """(query, prediction): the commonest label of the first ``k``; ties to the least label."""
    votes = (
        neighbors.where(F.col("place") <= k)
        .join(labels.select(named(key).alias("neighbor"), named(label).alias("vote")), "neighbor")
        .groupBy("query", "vote")
        .agg(F.count("*").alias("n"))
    )
    return votes.groupBy("query").agg(
        F.max_by("vote", F.struct("n", -F.col("vote"))).alias("prediction")
    )


def over_sample(
    df: DataFrame, key: str, vector: str, label: str, k: int = 5, seed: int = 42
) -> DataFrame:
    """The rows, and synthetic rows of the rarer label until both labels (0 and 1) are equally
    many.

    A synthetic row lies at a random place between a row of that label and one of its ``k``
    nearest neighbours of the same label. All random choices are hashes of the row key, so a
    repeated task makes the same rows. Synthetic rows have a null key.
    """
    sizes = {row.c: row.n for row in df.groupBy(named(label).alias("c")).agg(
        F.count("*").alias("n")).where("c IN (0, 1)").collect()}
    rare = 1 if sizes.get(1, 0) <= sizes.get(0, 0) else 0
    few, need = sizes.get(rare, 0), abs(sizes.get(0, 0) - sizes.get(1, 0))
    plain = df.select(
        named(key).cast("bigint").alias(key),
        named(vector).cast("array<double>").alias(vector),
        named(label).cast("int").alias(label),
    )
    if need <= 0 or few < 2:
        return plain
    k = min(k, few - 1)
    minority = plain.where(named(label) == rare)
    each, extra = divmod(need, few)
    share = extra / few
    counted = stratified_parts(minority, label, key, [share, 1 - share], seed, "__part")
    copies = F.lit(each) + F.when((F.col("__part") == 0) & F.lit(extra > 0), 1).otherwise(0)
    copy = F.explode(F.sequence(F.lit(1), copies))
    chosen = (
        counted.withColumn("copies", copies)
        .where("copies > 0")
        .select(named(key).alias("query"), named(vector).alias("mine"), copy.alias("copy"))
        .withColumn("place", (F.pmod(F.xxhash64("query", "copy", F.lit(seed)), F.lit(k)) + 1).cast("int"))
        .withColumn(
            "way", F.pmod(F.xxhash64("copy", "query", F.lit(seed + 1)), F.lit(2**53)) / F.lit(2.0**53)
        )
    )
    neighbors = nearest(minority, minority, k, key, vector, apart=key)
    theirs = minority.select(named(key).alias("neighbor"), named(vector).alias("theirs"))
    between = F.zip_with("mine", "theirs", lambda a, b: a + (b - a) * F.col("way"))
    made = (
        chosen.join(neighbors.select("query", "place", "neighbor"), ["query", "place"])
        .join(theirs, "neighbor")
        .select(
            F.lit(None).cast("bigint").alias(key),
            between.alias(vector),
            F.lit(rare).alias(label),
        )
    )
    return plain.unionByName(made)
