"""Many classification trees on the same rows at once, each on the rows outside its fold.

Nodes with many rows are split level by level: a pass over the rows counts labels by node, feature
and slice of values for every open node of every tree, and the driver takes the best of at most
``_CUTS`` quantiles as borders. A node with few rows (``FEW``, or ``_FEW_CELLS`` values) is finished
in one task: its rows meet there, and the rest of the tree tries every border between two different
values, to any depth. The rows that a tree is asked about travel to the same node and leave with its
votes, so no full-grown tree is ever gathered. Rows that end in a leaf above travel nowhere.

The rules: a node is split if it holds both labels, lies above the tree's depth and has at least two
rows and ``split_share`` of the rows that the tree learns from (rows, not draws). It looks at a
random ``node_share`` of the features that differ in it, at least one, and takes the border with the
purest sides, even where that gains nothing. Draws are whole numbers, so sums are exact and no order
of rows matters; a repeated task gives the same tree.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, field
from functools import reduce

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

FEW = 50_000
NO_LIMIT = 2**31 - 1
# The fold of rows that are only asked about.
ASKED = -9
_FEW_CELLS = 4_000_000
_CUTS = 255
_CELLS_AT_ONCE = 4_000_000
_SEED = 42
_OPEN, _SMALL, _LEAF, _SPLIT = range(4)

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Rule:
    """How trees of one kind grow. ``sample`` is the share of rows drawn with replacement; without
    it a tree learns from every row once. ``tree_share`` is the share of features a tree sees,
    ``node_share`` the share of these a split looks at (None: the root of their number)."""

    criterion: str = "gini"
    split_share: float = 0.0
    node_share: float | None = 1.0
    tree_share: float = 1.0
    sample: float | None = None


@dataclass(frozen=True)
class Tree:
    """Tree number ``number`` under ``rule``, learning from the rows outside fold ``left_out``.
    ``learned`` is their number; votes are given for each of ``depths``."""

    rule: Rule
    number: int
    left_out: int | None
    learned: int
    depths: tuple[int, ...] = (NO_LIMIT,)

    @property
    def least(self) -> int:
        return max(2, int(np.ceil(round(self.rule.split_share * self.learned, 9))))

    def seen(self, width: int) -> np.ndarray:
        if self.rule.tree_share >= 1:
            return np.arange(width)
        count = max(1, int(self.rule.tree_share * width))
        random = np.random.default_rng([_SEED, self.number])
        return np.sort(random.choice(width, count, replace=False))


def _impurity(zeros, ones, criterion: str):
    """Impurity times weight."""
    total = np.maximum(zeros + ones, 1e-300)
    if criterion == "gini":
        return 2 * zeros * ones / total
    share = ones / total
    bits = np.zeros_like(share)
    for s in (share, 1 - share):
        bits -= s * np.log2(np.where(s > 0, s, 1.0))
    return bits * total


def _looked_at(differing: np.ndarray, rule: Rule, width: int, random) -> np.ndarray:
    """A random share of the features, taken from those that differ in the node."""
    share = rule.node_share
    count = max(1, int(width**0.5 if share is None else share * width))
    return random.permutation(differing)[:count]


@dataclass
class Nodes:
    """A tree, or its top, as lists by node; node 0 is the root."""

    feature: list[int] = field(default_factory=list)
    border: list[float] = field(default_factory=list)
    left: list[int] = field(default_factory=list)
    right: list[int] = field(default_factory=list)
    chance: list[float] = field(default_factory=list)
    depth: list[int] = field(default_factory=list)
    parent: list[int] = field(default_factory=list)
    state: list[int] = field(default_factory=list)

    def add(self, chance: float, depth: int, parent: int, state: int = _LEAF) -> int:
        for name, value in (
            ("feature", -1), ("border", 0.0), ("left", -1), ("right", -1),
            ("chance", chance), ("depth", depth), ("parent", parent), ("state", state),
        ):
            getattr(self, name).append(value)
        return len(self.feature) - 1

    def split(self, node: int, feature: int, border: float, left: int, right: int) -> None:
        self.feature[node], self.border[node] = int(feature), float(border)
        self.left[node], self.right[node], self.state[node] = left, right, _SPLIT

    def node_of(self, x: np.ndarray, deepest: int = NO_LIMIT) -> np.ndarray:
        """Where each row ends, ``deepest`` levels below the root at most."""
        feature, border = np.array(self.feature), np.array(self.border)
        left, right = np.array(self.left), np.array(self.right)
        node, level = np.zeros(len(x), np.int64), 0
        going = np.flatnonzero(feature[node] >= 0)
        while len(going) and level < deepest:
            at = node[going]
            low = x[going, feature[at]] <= border[at]
            node[going] = np.where(low, left[at], right[at])
            going, level = going[feature[node[going]] >= 0], level + 1
        return node

    def path(self, node: int) -> list[float]:
        """Chances from the root to ``node``."""
        found = []
        while node >= 0:
            found.append(self.chance[node])
            node = self.parent[node]
        return found[::-1]


def _chance(zeros: float, ones: float) -> float:
    return float(ones / (zeros + ones)) if zeros + ones > 0 else 0.0


def _best_border(x, y, w, features, criterion):
    """(impurity of both sides, feature, border) over all borders between different values."""
    values = x[:, features]
    order = np.argsort(values, axis=0, kind="stable")
    values = np.take_along_axis(values, order, axis=0)
    ones = np.cumsum((w * y)[order], axis=0)
    zeros = np.cumsum((w * (1 - y))[order], axis=0)
    cost = _impurity(zeros[:-1], ones[:-1], criterion) + _impurity(
        zeros[-1] - zeros[:-1], ones[-1] - ones[:-1], criterion
    )
    cost[values[:-1] == values[1:]] = np.inf
    rows = cost.argmin(axis=0)
    best = int(cost[rows, np.arange(len(features))].argmin())
    row = rows[best]
    low, high = values[row, best], values[row + 1, best]
    middle = low + (high - low) / 2
    return cost[row, best], int(features[best]), float(middle if low <= middle < high else low)


def grown(
    x: np.ndarray, y: np.ndarray, w: np.ndarray, tree: Tree, seed: Sequence[int], depth: int = 0
) -> tuple[Nodes, np.ndarray]:
    """The tree below a node with these rows (``w`` draws each), level by level, and how much
    impurity each feature takes off."""
    nodes, gains = Nodes(), np.zeros(x.shape[1])
    random, rule = np.random.default_rng(list(seed)), tree.rule
    seen, deepest = tree.seen(x.shape[1]), max(tree.depths)
    waiting = [(nodes.add(_chance((w * (1 - y)).sum(), (w * y).sum()), depth, -1), np.arange(len(x)))]
    while waiting:
        following = []
        for node, rows in waiting:
            if nodes.depth[node] >= deepest or len(rows) < tree.least:
                continue
            if nodes.chance[node] in (0.0, 1.0):
                continue
            xs, ys, ws = x[rows], y[rows], w[rows]
            differing = seen[(xs[:, seen] != xs[:1, seen]).any(axis=0)]
            if not len(differing):
                continue
            features = _looked_at(differing, rule, len(seen), random)
            cost, feature, border = _best_border(xs, ys, ws, features, rule.criterion)
            ones = (ws * ys).sum()
            gains[feature] += _impurity(ws.sum() - ones, ones, rule.criterion) - cost
            low = xs[:, feature] <= border
            children = []
            for side in (low, ~low):
                part, p = rows[side], (ws * ys)[side].sum() / ws[side].sum()
                child = nodes.add(float(p), nodes.depth[node] + 1, node)
                children.append(child)
                following.append((child, part))
            nodes.split(node, feature, border, *children)
        waiting = following
    return nodes, gains


# --- the rows ------------------------------------------------------------------------------


def tree_rows(data: DataFrame) -> DataFrame:
    """(key, label, fold, x): what the trees read. Fold is -1 when there is none."""
    fold = F.col("fold") if "fold" in data.columns else F.lit(-1)
    label = F.col("label") if "label" in data.columns else F.lit(0)
    return data.select(
        "key", label.cast("int").alias("label"), fold.cast("int").alias("fold"),
        vector_to_array("features").alias("x"),
    )


def poisson_draws(share: float, number: int, seed: int = _SEED):
    """How often a row is drawn into a sample with replacement of ``share * rows`` rows.

    A Poisson count from a hash of the row key, so a repeated task draws the same sample.
    """
    u, draws = _draw_hash(number, seed) / F.lit(2.0**53), F.lit(0.0)
    for below in _bounds(share).tolist():
        draws = draws + F.when(u >= below, 1.0).otherwise(0.0)
    return draws


def _draw_hash(number: int, seed: int = _SEED):
    return F.pmod(F.xxhash64("key", F.lit(number), F.lit(seed)), F.lit(2**53))


def _bounds(share: float) -> np.ndarray:
    """A row is drawn once for each of these that its hash reaches."""
    bounds, below, term = [], 0.0, float(np.exp(-share))
    for times in range(1, 16):
        below += term
        bounds.append(below)
        term *= share / times
    return np.array(bounds)


def _with_draws(rows: DataFrame, trees: Sequence[Tree]) -> tuple[DataFrame, list]:
    """``rows`` with the hashes that samples are drawn by, and per tree which of them and the
    bounds of its draws (None: every row once)."""
    numbers = sorted({t.number for t in trees if t.rule.sample is not None})
    places = [
        None if t.rule.sample is None else (numbers.index(t.number), _bounds(t.rule.sample))
        for t in trees
    ]
    hashes = [_draw_hash(number) for number in numbers] or [F.lit(0).cast("bigint")]
    return rows.withColumn("draws", F.array(*hashes)), places


def _read(batch: pa.RecordBatch):
    x, hashes = (
        batch.column(c).flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
        for c in ("x", "draws")
    )
    label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
    return x, label.astype(np.float64), fold, hashes / 2.0**53


def _learns(tree: Tree, place, fold: np.ndarray, hashes: np.ndarray):
    """Rows that a tree learns from, and their draws."""
    w = np.ones(len(fold))
    if place is not None:
        # Bounds that rounding lets fall are no higher than those before.
        which, bounds = place
        w = np.searchsorted(bounds, hashes[:, which], "right").astype(np.float64)
    used = (fold != ASKED) & (w > 0)
    if tree.left_out is not None:
        used &= fold != tree.left_out
    rows = np.flatnonzero(used)
    return rows, w[rows]


# --- nodes with many rows ------------------------------------------------------------------


def _histograms(rows, trees, places, tops, lot, cuts) -> DataFrame:
    """(spot, counts): for each node of the lot that a task has rows of, these and draws by label,
    per feature that its tree sees and slice of values."""
    width, slices = len(cuts), _CUTS + 1
    wanted: dict[int, list[tuple[int, int]]] = {}
    for i, (t, node) in enumerate(lot):
        wanted.setdefault(t, []).append((node, i))
    # Per tree: the place among its own nodes of each node, and their places in the lot.
    own = {}
    for t, nodes in wanted.items():
        place = np.full(len(tops[t].state), -1)
        place[[node for node, _ in nodes]] = np.arange(len(nodes))
        own[t] = place, np.array([i for _, i in nodes])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals = {
            t: np.zeros((len(spots), len(trees[t].seen(width)), slices, 3))
            for t, (_, spots) in own.items()
        }
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold, hashes = _read(batch)
            at = [np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)]
            label = y.astype(np.int64)
            for t, (place_of, spots) in own.items():
                some, w = _learns(trees[t], places[t], fold, hashes)
                place = place_of[tops[t].node_of(x[some])]
                in_lot = place >= 0
                some, w, place = some[in_lot], w[in_lot], place[in_lot]
                base, cells = place * slices * 2 + label[some], len(spots) * slices * 2
                for i, f in enumerate(trees[t].seen(width)):
                    code = base + 2 * at[f][some]
                    n = np.bincount(code, minlength=cells).reshape(-1, slices, 2)
                    drawn = n
                    if places[t] is not None:
                        drawn = np.bincount(code, w, cells).reshape(-1, slices, 2)
                    totals[t][:, i, :, 0] += n.sum(axis=2)
                    totals[t][:, i, :, 1:] += drawn
        for t, (_, spots) in own.items():
            for spot, counts in zip(spots.tolist(), totals.pop(t)):
                if counts.any():
                    yield pa.RecordBatch.from_arrays(
                        [pa.array([spot], pa.int32()), pa.array([_packed(counts)], pa.binary())],
                        ["spot", "counts"],
                    )

    return rows.mapInArrow(run, "spot int, counts binary")


def _packed(counts: np.ndarray) -> bytes:
    """Whole numbers in as few bytes as the largest takes."""
    kind = np.min_scalar_type(int(counts.max())).newbyteorder("<")
    return counts.astype(kind).tobytes()


def _unpacked(data: bytes, shape: tuple[int, ...]) -> np.ndarray:
    kind = f"<u{len(data) // int(np.prod(shape))}"
    return np.frombuffer(data, kind).astype(np.float64).reshape(shape)


_CUT = (
    "spot int, counts array<double>, feature int, cut int, below array<double>, "
    "above array<double>, cost double"
)


def _best_cuts(rows, trees, places, tops, lot, cuts) -> list:
    """Per node of the lot the counts of its rows and its best cut (feature -1: none), with the
    counts below and above. Tasks add up the histograms node by node: the driver gets none."""
    width = len(cuts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        totals: dict[int, np.ndarray] = {}
        for batch in batches:
            for spot, data in zip(batch.column(0).to_pylist(), batch.column(1)):
                seen = trees[lot[spot][0]].seen(width)
                counts = _unpacked(data.as_buffer(), (len(seen), _CUTS + 1, 3))
                if spot in totals:
                    totals[spot] += counts
                else:
                    totals[spot] = counts
        names = [part.split()[0] for part in _CUT.split(", ")]
        for spot, counts in totals.items():
            t, node = lot[spot]
            found = (spot, *_best_cut(counts, trees[t], node, width))
            yield pa.RecordBatch.from_pylist([dict(zip(names, found))], schema=kinds)

    kinds = pa.schema([
        ("spot", pa.int32()), ("counts", pa.list_(pa.float64())), ("feature", pa.int32()),
        ("cut", pa.int32()), ("below", pa.list_(pa.float64())),
        ("above", pa.list_(pa.float64())), ("cost", pa.float64()),
    ])
    counted = _histograms(rows, trees, places, tops, lot, cuts)
    return counted.repartition("spot").mapInArrow(run, _CUT).collect()


def _best_cut(counts: np.ndarray, tree: Tree, node: int, width: int):
    """(counts of the node, feature, cut, counts below, counts above, impurity of both sides)."""
    seen = tree.seen(width)
    whole = counts[0].sum(axis=0)
    differing = seen[(counts[:, :, 0] > 0).sum(axis=1) > 1]
    if not len(differing):
        return whole, -1, -1, whole, whole, 0.0
    random = np.random.default_rng([_SEED, tree.number, node])
    features = _looked_at(differing, tree.rule, len(seen), random)
    some = counts[np.searchsorted(seen, features)]
    below = some.cumsum(axis=1)[:, :-1]
    above = some.sum(axis=1)[:, None] - below
    criterion = tree.rule.criterion
    cost = _impurity(below[..., 1], below[..., 2], criterion) + _impurity(
        above[..., 1], above[..., 2], criterion
    )
    cost[(below[..., 0] == 0) | (above[..., 0] == 0)] = np.inf
    f, cut = np.unravel_index(cost.argmin(), cost.shape)
    return whole, int(features[f]), int(cut), below[f, cut], above[f, cut], float(cost[f, cut])


def _state(tree: Tree, depth: int, rows, zeros, ones, few: int) -> int:
    """A node that the rules leave whole is a leaf at once: its rows need not meet."""
    if depth >= max(tree.depths) or rows < tree.least or not zeros or not ones:
        return _LEAF
    return _SMALL if rows <= few else _OPEN


def _split_large(nodes: Nodes, node: int, found, tree: Tree, cuts, few, gains):
    """Split one node at its best cut, or make it a leaf; gives its children with many rows."""
    rows, zeros, ones = found.counts
    nodes.chance[node] = _chance(zeros, ones)
    nodes.state[node] = _state(tree, nodes.depth[node], rows, zeros, ones, few)
    if nodes.state[node] != _OPEN:
        return []
    nodes.state[node] = _LEAF
    if found.feature < 0:
        return []
    gains[found.feature] += _impurity(zeros, ones, tree.rule.criterion) - found.cost
    children = []
    for side in (found.below, found.above):
        state = _state(tree, nodes.depth[node] + 1, *side, few)
        children.append(nodes.add(_chance(*side[1:]), nodes.depth[node] + 1, node, state))
    nodes.split(node, found.feature, cuts[found.feature][found.cut], *children)
    return [child for child in children if nodes.state[child] == _OPEN]


def _tops(rows, trees, places, width, total, few):
    """Per tree the nodes with more than ``few`` rows, and what their splits gain per feature."""
    gains = np.zeros((len(trees), width))
    tops = [Nodes() for _ in trees]
    for top in tops:
        top.add(0.0, 0, -1, _SMALL if total <= few else _OPEN)
    if total <= few:
        return tops, gains
    shares = [(i + 1) / (_CUTS + 1) for i in range(_CUTS)]
    columns = [F.col("x")[f].alias(f"x{f}") for f in range(width)]
    found = rows.where(F.col("fold") != ASKED).select(*columns).approxQuantile(
        [f"x{f}" for f in range(width)], shares, 0.5 / _CUTS
    )
    # A slice ends with its cut, so the largest value needs none.
    cuts = [np.unique(values) for values in found]
    waiting = [(t, 0) for t in range(len(trees))]
    at_once = max(1, _CELLS_AT_ONCE // (width * (_CUTS + 1) * 3))
    while waiting:
        following = []
        for low in range(0, len(waiting), at_once):
            lot = waiting[low : low + at_once]
            found = {cut.spot: cut for cut in _best_cuts(rows, trees, places, tops, lot, cuts)}
            for spot, (t, node) in enumerate(lot):
                if spot not in found:  # a sample without any row
                    tops[t].state[node] = _LEAF
                    continue
                opened = _split_large(tops[t], node, found[spot], trees[t], cuts, few, gains[t])
                following += [(t, child) for child in opened]
        waiting = following
    return tops, gains


# --- nodes with few rows, and votes --------------------------------------------------------


def _at_nodes(rows, trees, places, tops, asked: bool) -> DataFrame:
    """The rows of each task, packed by the node with few rows that they belong to."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold, hashes = _read(batch)
            keys = batch.column("key").to_numpy(zero_copy_only=False)
            for t, tree in enumerate(trees):
                if _SMALL not in tops[t].state:
                    continue
                some, w = _learns(tree, places[t], fold, hashes)
                packs = [(False, some, w)]
                if asked and tree.left_out is not None:
                    out = np.flatnonzero(fold == tree.left_out)
                    packs.append((True, out, np.zeros(len(out))))
                found = []
                for ask, some, w in packs:
                    node = tops[t].node_of(x[some])
                    for n in np.unique(node):
                        if tops[t].state[n] == _LEAF:
                            continue
                        here = node == n
                        at = some[here]
                        found.append((
                            t, int(n), 0, ask, keys[at] if ask else [], x[at].tobytes(),
                            y[at].tobytes(), w[here].tobytes(),
                        ))
                if found:
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(c, k) for c, k in zip(zip(*found), kinds)], names
                    )

    key_kind = to_arrow_type(rows.schema["key"].dataType)
    names = ["tree", "node", "part", "ask", "keys", "x", "y", "w"]
    kinds = [
        pa.int32(), pa.int32(), pa.int64(), pa.bool_(), pa.list_(key_kind), *[pa.binary()] * 3
    ]
    key = rows.schema["key"].dataType.simpleString()
    packed = rows.mapInArrow(
        run,
        f"tree int, node int, part bigint, ask boolean, keys array<{key}>, x binary, y binary, "
        "w binary",
    )
    spark = rows.sparkSession
    spread = max(
        spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions"))
    )
    return packed.repartition(spread, "tree", "node", "part")


def _joined(packs: pd.DataFrame, width: int):
    def numbers(name):
        return np.frombuffer(b"".join(packs[name]), np.float64)

    return numbers("x").reshape(-1, width), numbers("y"), numbers("w")


def _finished(packs: pd.DataFrame, trees, tops, width: int):
    """A node's subtree with its gains, and the path of chances that leads to it."""
    t, node = int(packs["tree"].iloc[0]), int(packs["node"].iloc[0])
    path = tops[t].path(node)
    if tops[t].state[node] == _LEAF:
        return t, path, None, np.zeros(width)
    x, y, w = _joined(packs[~packs["ask"]], width)
    below, gains = grown(x, y, w, trees[t], [_SEED, trees[t].number, node], len(path) - 1)
    return t, path, below, gains


def votes(rows: DataFrame, trees: Sequence[Tree], few: int | None = None) -> DataFrame:
    """(tree, key, label, p): for each row of a tree's left-out fold, its chance of label 1 by
    that tree, one for each of the tree's depths. ``rows`` come from ``tree_rows``; keys are unique.
    """
    rows, trees, places, tops, _, width = _prepared(rows, trees, few)

    def vote(packs: pd.DataFrame) -> pd.DataFrame:
        t, path, below, _ = _finished(packs, trees, tops, width)
        ask = packs[packs["ask"]]
        if not len(ask):
            return pd.DataFrame(columns=["tree", "key", "label", "p"], dtype=object)
        x, y, _ = _joined(ask, width)
        level, columns = len(path) - 1, []
        for depth in trees[t].depths:
            if depth <= level or below is None:
                columns.append(np.full(len(x), path[min(depth, level)]))
            else:
                columns.append(np.array(below.chance)[below.node_of(x, depth - level)])
        return pd.DataFrame({
            "tree": t, "key": np.concatenate(ask["keys"].to_numpy()), "label": y.astype(int),
            "p": list(np.stack(columns, axis=1)),
        })

    key = rows.schema["key"].dataType.simpleString()
    schema = f"tree int, key {key}, label int, p array<double>"
    packs = _at_nodes(rows, trees, places, tops, asked=True)
    grown_on = packs.groupBy("tree", "node", "part").applyInPandas(vote, schema)
    return grown_on.unionByName(rows.mapInArrow(_leaf_votes(trees, tops), schema))


def _leaf_votes(trees, tops):
    """Votes on rows that end in a leaf of a top: they need not meet the rows it learned from."""
    paths = [
        {n: top.path(n) for n, state in enumerate(top.state) if state == _LEAF} for top in tops
    ]

    def vote(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold, _ = _read(batch)
            for t, tree in enumerate(trees):
                some = np.flatnonzero(fold == tree.left_out) if tree.left_out is not None else []
                if not len(some) or not paths[t]:
                    continue
                node = tops[t].node_of(x[some])
                chances = np.zeros((len(tops[t].state), len(tree.depths)))
                leaf = np.zeros(len(tops[t].state), bool)
                for n, path in paths[t].items():
                    leaf[n] = True
                    chances[n] = [path[min(depth, len(path) - 1)] for depth in tree.depths]
                ends = leaf[node]
                some, p = some[ends], chances[node[ends]]
                if not len(some):
                    continue
                borders = np.arange(0, p.size + 1, p.shape[1], dtype=np.int32)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.full(len(some), t, np.int32)),
                        batch.column("key").take(pa.array(some)),
                        pa.array(y[some].astype(np.int32)),
                        pa.ListArray.from_arrays(pa.array(borders), pa.array(p.ravel())),
                    ],
                    ["tree", "key", "label", "p"],
                )

    return vote


@dataclass(frozen=True)
class Forest:
    """The first ``count`` trees under ``rule``, cut at ``depth``; their chances are averaged."""

    rule: Rule
    count: int = 1
    depth: int = NO_LIMIT

    def trees(self, left_out: int | None, learned: int) -> list[Tree]:
        return [Tree(self.rule, i, left_out, learned, (self.depth,)) for i in range(self.count)]


def _asked_for(spark, forests: Sequence[tuple[int, Forest]], sizes: dict[int, int]):
    """The trees that serve numbered forests, and which serve which: (tree, forest, fold, place,
    count)."""
    total = sum(sizes.values())
    trees, numbers, wanted = [], [], []
    for family, rule in enumerate(dict.fromkeys(f.rule for _, f in forests)):
        same = [(i, f) for i, f in forests if f.rule == rule]
        depths = tuple(sorted({f.depth for _, f in same}))
        wanted += [(i, family, depths.index(f.depth), f.count) for i, f in same]
        for fold in sorted(sizes):
            for number in range(max(f.count for _, f in same)):
                numbers.append((len(trees), family, fold, number))
                trees.append(Tree(rule, number, fold, total - sizes[fold], depths))
    # Both have a row per tree or forest asked for.
    numbered = spark.createDataFrame(numbers, "tree int, family int, fold int, number int")
    wanted = spark.createDataFrame(wanted, "forest int, family int, place int, count int")
    return trees, F.broadcast(numbered.join(wanted, "family").where("number < count").drop("number"))


def forest_guesses(
    rows: DataFrame, forests: Sequence[Forest], sizes: dict[int, int], few: int | None = None
) -> DataFrame:
    """(forest, fold, key, label, prediction) of every row by trees of the other folds.

    Trees serve all forests of their rule: fewer trees are the first of more, and a lower depth is
    the top of a deeper tree. ``sizes`` has the rows of each fold.
    """
    trees, which = _asked_for(rows.sparkSession, list(enumerate(forests)), sizes)
    chance = F.round(F.element_at("p", F.col("place") + 1), 12)
    sums = votes(rows, trees, few).join(which, "tree").groupBy(
        "forest", "fold", "key", "label", "count"
    ).agg(F.sum(chance).alias("sum"))
    above = F.round(2 * F.col("sum") - F.col("count"), 9) > 0
    return sums.select("forest", "fold", "key", "label", above.cast("double").alias("prediction"))


def forest_counts(
    rows: DataFrame, forests: Sequence[Forest], sizes: dict[int, int], few: int | None = None
) -> DataFrame:
    """(forest, fold, label, prediction, n): how many rows have each label and guess.

    A forest of one tree guesses as that tree votes, so its votes are counted where they are, for
    all depths together; only trees of larger forests meet row by row.
    """
    found = []
    many = [(i, f) for i, f in enumerate(forests) if f.count > 1]
    if many:
        number = F.element_at(F.array(*[F.lit(i) for i, _ in many]), F.col("forest") + 1)
        guesses = forest_guesses(rows, [f for _, f in many], sizes, few)
        found.append(
            guesses.withColumn("forest", number)
            .groupBy("forest", "fold", "label", "prediction")
            .agg(F.count("*").alias("n"))
        )
    single = [(i, f) for i, f in enumerate(forests) if f.count == 1]
    if single:
        trees, which = _asked_for(rows.sparkSession, single, sizes)
        tally = votes(rows, trees, few).groupBy("tree", "label", "p").agg(F.count("*").alias("n"))
        chance = F.round(F.element_at("p", F.col("place") + 1), 12)
        above = F.round(2 * chance - F.col("count"), 9) > 0
        found.append(
            tally.join(which, "tree").select(
                "forest", "fold", "label", above.cast("double").alias("prediction"), "n"
            )
        )
    return reduce(DataFrame.unionByName, found)


def importances(rows: DataFrame, trees: Sequence[Tree], few: int | None = None) -> np.ndarray:
    """Per feature how much impurity the trees take off by it: shares of 1 in each tree, then the
    mean over the trees. Trees without a split count as 0."""
    rows, trees, places, tops, above, width = _prepared(rows, trees, few)

    def gain(packs: pd.DataFrame) -> pd.DataFrame:
        t, _, _, gains = _finished(packs, trees, tops, width)
        return pd.DataFrame({"tree": t, "feature": np.arange(width), "gain": gains})

    packs = _at_nodes(rows, trees, places, tops, asked=False)
    found = packs.groupBy("tree", "node", "part").applyInPandas(
        gain, "tree int, feature int, gain double"
    )
    total = above.copy()
    for row in found.groupBy("tree", "feature").agg(F.sum("gain").alias("gain")).collect():
        total[row.tree, row.feature] += row.gain
    whole = total.sum(axis=1, keepdims=True)
    return (total / np.where(whole > 0, whole, 1.0)).mean(axis=0)


def _prepared(rows: DataFrame, trees: Sequence[Tree], few: int | None):
    trees = list(trees)
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    width = first.n
    few = min(FEW, max(1, _FEW_CELLS // width)) if few is None else few
    rows, places = _with_draws(rows, trees)
    total = max(tree.learned for tree in trees)
    tops, gains = _tops(rows, trees, places, width, total, few)
    return rows, trees, places, tops, gains, width
