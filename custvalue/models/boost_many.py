"""Many boosted stumps on the same rows at once.

Boosting with class probabilities (the real-valued variant for two classes): each stump splits the
weighted rows by one feature, and a row's weight follows from the stumps before. Weights are not
kept but derived from those stumps, so all rates of all folds share one pass over the rows per
round, and fewer rounds are the first of more. Rows are packed once, each value as the number of
its slice between at most ``_CUTS`` borders, half way between quantiles; a pass adds up
weights by fit, feature, slice and label, and the driver takes the border with the purest sides.
"""

from __future__ import annotations

import sys
from collections.abc import Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import StorageLevel, cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.models.logistic_many import _added, _arrays
from custvalue.models.metrics import weighted_metrics

_CUTS = 255
_LEAST_PROBABILITY = 2.220446049250313e-16
# Costs that differ by less than this share of all weight are equal: sums come in any order.
_EQUAL = 1e-11

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Boost:
    """``rounds`` stumps; ``rate`` is how far a stump's odds move the weights."""

    rounds: int
    rate: float


@dataclass(frozen=True)
class Stump:
    """Odds (logarithms) of label 1 up to ``border`` of ``feature``, the end of slice ``cut``, and
    beyond. Without a feature the odds are the same everywhere."""

    feature: int
    cut: int
    border: float
    low: float
    high: float


class BoostedStumps:
    """Stumps whose odds are added up; a positive sum predicts label 1."""

    def __init__(self, stumps: Sequence[Stump], width: int):
        self.stumps, self.width = list(stumps), width

    def transform(self, df: DataFrame) -> DataFrame:
        x, total = vector_to_array("features"), F.lit(0.0)
        for s in self.stumps:
            odds = F.lit(s.low)
            if s.feature >= 0:
                odds = F.when(x[s.feature] <= s.border, s.low).otherwise(s.high)
            total = total + odds
        return df.withColumn("prediction", F.when(total > 0, 1.0).otherwise(0.0))

    def importances(self) -> list[float]:
        """The share of the stumps that split by each feature."""
        counts = np.zeros(self.width)
        for s in self.stumps:
            if s.feature >= 0:
                counts[s.feature] += 1 / len(self.stumps)
        return counts.tolist()


def _log_odds(ones: float, zeros: float) -> float:
    share = ones / (ones + zeros)
    return float(
        np.log(max(share, _LEAST_PROBABILITY)) - np.log(max(1 - share, _LEAST_PROBABILITY))
    )


def _cuts(rows: DataFrame) -> list[np.ndarray]:
    """Per feature the values that end a slice; the last slice has no end."""
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    names = [f"x{f}" for f in range(first.n)]
    shares = [i / _CUTS for i in range(_CUTS + 1)]
    columns = rows.select(*[F.col("x")[f].alias(n) for f, n in enumerate(names)])
    found = columns.approxQuantile(names, shares, 0.5 / _CUTS)
    cuts = []
    for values in found:
        values = np.unique(values)
        # The largest value ends no slice; a border lies half way to the next value seen.
        low, high = values[:-1], values[1:]
        middle = low + (high - low) / 2
        cuts.append(np.where((low <= middle) & (middle < high), middle, low))
    return cuts


def _packed(rows: DataFrame, cuts: list[np.ndarray]) -> DataFrame:
    """Labels, folds and slices of a batch of rows as bytes."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _arrays(batch)
            at = np.stack([np.searchsorted(c, x[:, f], "left") for f, c in enumerate(cuts)])
            parts = [y.astype(np.uint8), fold.astype(np.int32), at.astype(np.uint8)]
            yield pa.RecordBatch.from_arrays(
                [pa.array([p.tobytes()], pa.binary()) for p in parts], ["label", "fold", "at"]
            )

    return rows.mapInArrow(pack, "label binary, fold binary, at binary")


def _unpacked(batch: pa.RecordBatch) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    for y, fold, at in zip(*(batch.column(c) for c in ("label", "fold", "at"))):
        y = np.frombuffer(y.as_py(), np.uint8)
        at = np.frombuffer(at.as_py(), np.uint8).reshape(-1, len(y))
        yield y, np.frombuffer(fold.as_py(), np.int32), at


def _odds(stump: Stump, at: np.ndarray) -> np.ndarray | float:
    if stump.feature < 0:
        return stump.low
    return np.where(at[stump.feature] <= stump.cut, stump.low, stump.high)


def _weights_by_slice(packs: DataFrame, fits, grown, width: int) -> np.ndarray:
    """Weights by fit, feature, slice and label."""
    shape = (len(fits), width, _CUTS + 1, 2)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(shape)
        for batch in batches:
            for y, fold, at in _unpacked(batch):
                code, sign = 2 * at.astype(np.intp) + y, np.where(y == 1, 1.0, -1.0)
                for m, (rate, left_out) in enumerate(fits):
                    odds = sum((_odds(s, at) for s in grown[m]), np.zeros(len(y)))
                    weight = np.exp(-0.5 * rate * sign * odds)
                    if left_out is not None:
                        weight[fold == left_out] = 0.0
                    for f in range(width):
                        total[m, f] += np.bincount(
                            code[f], weight, 2 * (_CUTS + 1)
                        ).reshape(-1, 2)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return _added(packs.mapInArrow(run, "sums binary"), shape)


def _cost(weights: np.ndarray) -> np.ndarray:
    """Gini impurity times weight; the last axis has the labels."""
    return 2 * weights[..., 0] * weights[..., 1] / np.maximum(weights.sum(axis=-1), 1e-300)


def _best(weights: np.ndarray, cuts: list[np.ndarray]) -> Stump:
    whole = weights[0].sum(axis=0)
    if not whole.sum() > 0:
        raise ValueError("no rows to learn from")
    below = weights.cumsum(axis=1)[:, :-1]
    above = weights.sum(axis=1)[:, None] - below
    above = np.where(weights[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:] > 0, above, 0.0)
    cost = _cost(below) + _cost(above)
    cost[(below.sum(axis=-1) <= 0) | (above.sum(axis=-1) <= 0)] = np.inf
    none, equal = float(_cost(whole)), _EQUAL * whole.sum()
    if not cost.min() < none - equal:
        odds = _log_odds(whole[1], whole[0])
        return Stump(-1, -1, 0.0, odds, odds)
    # The first feature and border of the least cost.
    f, cut = np.unravel_index(np.flatnonzero(cost.ravel() <= cost.min() + equal)[0], cost.shape)
    sides = [np.maximum(side[f, cut], 0.0) for side in (below, above)]
    low, high = (_log_odds(side[1], side[0]) for side in sides)
    return Stump(int(f), int(cut), float(cuts[f][cut]), low, high)


def _grow(packs: DataFrame, fits, rounds: int, cuts) -> list[list[Stump]]:
    """The stumps of each fit (rate, fold left out)."""
    grown: list[list[Stump]] = [[] for _ in fits]
    for _ in range(rounds):
        sums = _weights_by_slice(packs, fits, grown, len(cuts))
        for stumps, weights in zip(grown, sums):
            stumps.append(_best(weights, cuts))
    return grown


def _held_packs(rows: DataFrame, cuts) -> DataFrame:
    return _packed(rows, cuts).persist(StorageLevel.MEMORY_AND_DISK)


def fit_boost(rows: DataFrame, boost: Boost) -> BoostedStumps:
    """Stumps learned from all ``rows`` (from ``logistic_many.model_rows``)."""
    cuts = _cuts(rows)
    packs = _held_packs(rows, cuts)
    try:
        (stumps,) = _grow(packs, [(boost.rate, None)], boost.rounds, cuts)
    finally:
        packs.unpersist()
    return BoostedStumps(stumps, len(cuts))


def boost_scores(
    rows: DataFrame, boosts: Sequence[Boost], folds: Sequence[int]
) -> dict[Boost, list[float]]:
    """Weighted F1 of each setting on each fold, by stumps of the other folds."""
    cuts = _cuts(rows)
    rates = sorted({b.rate for b in boosts})
    fits = [(rate, fold) for rate in rates for fold in folds]
    wanted = [
        (m, b.rounds) for b in boosts for m in [fits.index((b.rate, fold)) for fold in folds]
    ]
    packs = _held_packs(rows, cuts)
    try:
        grown = _grow(packs, fits, max(b.rounds for b in boosts), cuts)

        def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            counts = np.zeros((len(wanted), 4), np.int64)
            for batch in batches:
                for y, fold, at in _unpacked(batch):
                    for i, (m, rounds) in enumerate(wanted):
                        out = fold == fits[m][1]
                        there = at[:, out]
                        odds = sum(
                            (_odds(s, there) for s in grown[m][:rounds]), np.zeros(there.shape[1])
                        )
                        # Cell 2 * label + prediction of the two by two table of each fit.
                        cells = 2 * y[out].astype(np.intp) + (odds > 0)
                        counts[i] += np.bincount(cells, minlength=4)
            fit, cell = np.nonzero(counts)
            found = {
                "fit": fit.astype("int32"), "label": cell // 2 * 1.0, "prediction": cell % 2 * 1.0,
                "n": counts[fit, cell],
            }
            yield pa.RecordBatch.from_pydict({k: pa.array(v) for k, v in found.items()})

        tables = packs.mapInArrow(judge, "fit int, label double, prediction double, n bigint")
        scores = {r.fit: r.f1 for r in weighted_metrics(tables, by=["fit"], count="n").collect()}
    finally:
        packs.unpersist()
    n = len(folds)
    return {
        b: [scores.get(i * n + j, 0.0) for j in range(n)] for i, b in enumerate(boosts)
    }
