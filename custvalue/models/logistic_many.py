"""Many logistic regressions on the same rows at once.

Leaving out each feature in each fold, or trying each strength in each fold, takes hundreds
of fits that differ little. Fitted one by one, each would read the rows dozens of times. Here
one pass over the rows serves one step of every fit. Per fold one base fit takes Newton steps;
all other fits of the fold start from it and share its curvature, corrected by their own last
steps (limited-memory BFGS), so a pass adds up only slopes for them: as many numbers per fit as
there are features. Tasks add up matrices, which are summed in a tree of two levels.
"""

from __future__ import annotations

import sys
from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import cloudpickle
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.models.metrics import weighted_metrics

_MAX_PASSES = 200
_TOLERANCE = 1e-13
_MEMORY = 8
_BRANCHES = 16
_CELLS_AT_ONCE = 4_000_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class Fit:
    """One regression: feature positions, strength ``c``, and the fold it does not learn from."""

    features: tuple[int, ...]
    c: float
    left_out: int | None = None


def model_rows(data: DataFrame) -> DataFrame:
    """(label, fold, x): what the passes read. Fold is -1 when there is none."""
    fold = F.col("fold") if "fold" in data.columns else F.lit(-1)
    return data.select(
        F.col("label").cast("double").alias("label"),
        fold.cast("int").alias("fold"),
        vector_to_array("features").alias("x"),
    )


def _arrays(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    x = batch.column("x").flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
    label, fold = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("label", "fold"))
    return np.hstack([x, np.ones((len(x), 1))]), label, fold


def _added(parts: DataFrame, shape: tuple[int, ...]) -> np.ndarray:
    """The sum of one matrix per task (column sums, as bytes)."""

    def add(table: pa.Table) -> pa.Table:
        total = sum(np.frombuffer(x.as_py(), np.float64) for x in table.column("sums"))
        return pa.table({"sums": pa.array([total.tobytes()], pa.binary())})

    branch = F.pmod(F.spark_partition_id(), F.lit(_BRANCHES)).alias("branch")
    few = parts.select("sums", branch).groupBy("branch").applyInArrow(add, "sums binary")
    total = np.zeros(int(np.prod(shape)))
    for row in few.collect():
        total += np.frombuffer(row.sums, np.float64)
    return total.reshape(shape)


def _per_task(add_up: Callable[[np.ndarray, ...], None], size: int):
    """Calls ``add_up(x, y, fold, total)`` for the rows of a task, a bounded number at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(size)
        for batch in batches:
            if batch.num_rows:
                add_up(*_arrays(batch), total)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["sums"])

    return run


def _chances(margins: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(margins, -500, 500)))


def _slopes(rows: DataFrame, left_out: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per fit: loss and slopes, summed over its rows."""
    shape = (len(left_out), 1 + weights.shape[1])
    step = max(1, _CELLS_AT_ONCE // len(left_out))

    def add_up(x, y, fold, total):
        out = total.reshape(shape)
        for low in range(0, len(x), step):
            xs, t = x[low : low + step], y[low : low + step, None]
            used = fold[low : low + step, None] != left_out[None, :]
            margins = xs @ weights.T
            out[:, 0] += (np.where(used, np.logaddexp(0, margins) - t * margins, 0)).sum(axis=0)
            out[:, 1:] += np.where(used, _chances(margins) - t, 0).T @ xs

    parts = rows.mapInArrow(_per_task(add_up, shape[0] * shape[1]), "sums binary")
    return _added(parts, shape)


def _curvatures(rows: DataFrame, left_out: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """Per base fit the matrix of second derivatives, summed over its rows."""
    size = weights.shape[1]
    shape = (len(left_out), size, size)

    def add_up(x, y, fold, total):
        out = total.reshape(shape)
        chances = _chances(x @ weights.T)
        for m in range(len(left_out)):
            used = fold != left_out[m]
            xs, p = x[used], chances[used, m]
            out[m] += xs.T @ (xs * (p * (1 - p))[:, None])

    parts = rows.mapInArrow(_per_task(add_up, int(np.prod(shape))), "sums binary")
    return _added(parts, shape)


def _inverse(system: np.ndarray) -> np.ndarray:
    scale = 1 / np.sqrt(np.maximum(np.diag(system), 1e-300))
    scaled = system * scale[:, None] * scale[None, :]
    return scale[:, None] * np.linalg.pinv(scaled, hermitian=True) * scale[None, :]


class _Descent:
    """One fit on its way: weights, slope, and the last steps."""

    def __init__(self, fit: Fit, size: int, start: np.ndarray):
        self.fit, self.free = fit, np.zeros(size, bool)
        self.free[[*fit.features, size - 1]] = True
        self.penalty = np.zeros(size)
        self.penalty[list(fit.features)] = 1 / fit.c
        self.weights = np.where(self.free, start, 0.0)
        self.loss, self.slope, self.step = np.inf, None, np.zeros(size)
        self.steps: list[tuple[np.ndarray, np.ndarray]] = []
        self.length, self.done = 1.0, False

    def settle(self, curvature: np.ndarray, inverses: dict) -> None:
        """The shared curvature's inverse, with the rows of features left out taken out."""
        name = (self.fit.left_out, self.fit.c)
        if name not in inverses:
            penalty = np.full(len(self.penalty), 1 / self.fit.c)
            penalty[-1] = 1e-12
            inverses[name] = _inverse(curvature + np.diag(penalty))
        self.inverse, gone = inverses[name], np.flatnonzero(~self.free)
        self.gone = gone
        if len(gone) > len(self.free) // 2:
            inner = np.linalg.pinv(self.inverse, hermitian=True)[np.ix_(self.free, self.free)]
            self.inverse = np.zeros_like(self.inverse)
            self.inverse[np.ix_(self.free, self.free)] = _inverse(inner)
            self.gone = np.empty(0, int)
        elif len(gone):
            self.corner = np.linalg.pinv(self.inverse[np.ix_(gone, gone)], hermitian=True)

    def solved(self, v: np.ndarray) -> np.ndarray:
        out = self.inverse @ np.where(self.free, v, 0.0)
        if len(self.gone):
            out -= self.inverse[:, self.gone] @ (self.corner @ out[self.gone])
        return np.where(self.free, out, 0.0)

    @property
    def trial(self) -> np.ndarray:
        return self.weights + self.length * self.step

    def take(self, sums: np.ndarray) -> None:
        """Accept the trial or shorten it; then choose the next step."""
        trial = self.trial
        loss = sums[0] + 0.5 * float(np.sum(self.penalty * trial**2))
        slope = np.where(self.free, sums[1:] + self.penalty * trial, 0.0)
        if self.slope is not None:
            fall = float(self.slope @ self.step) * self.length
            if loss > self.loss + 1e-4 * fall + 1e-13 * abs(self.loss):
                self.length /= 2
                # So short a step that rounding hides what it gains.
                self.done = self.length < 1e-6 and -fall < 1e-9 * max(1.0, abs(self.loss))
                return
            move, change = trial - self.weights, slope - self.slope
            if move @ change > 1e-14 * np.sqrt((move @ move) * (change @ change) + 1e-300):
                self.steps = [*self.steps[1 - _MEMORY :], (move, change)]
        self.weights, self.loss, self.slope, self.length = trial, loss, slope, 1.0
        self.done = float(slope @ self.solved(slope)) <= _TOLERANCE * max(1.0, abs(loss))
        direction, parts = slope.copy(), []
        for move, change in reversed(self.steps):
            share = move @ direction / (move @ change)
            parts.append(share)
            direction -= share * change
        direction = self.solved(direction)
        for (move, change), share in zip(self.steps, reversed(parts)):
            direction += move * (share - change @ direction / (move @ change))
        self.step = -direction


def _folds(fits: Sequence[Fit]) -> np.ndarray:
    return np.array([-2 if f.left_out is None else f.left_out for f in fits])


def fit_many(
    rows: DataFrame, fits: Sequence[Fit], on_pass: Callable[[], None] = lambda: None
) -> np.ndarray:
    """Weights per fit, one per feature and the intercept last; features left out weigh 0.

    Minimises ``c * loss + |weights|^2 / 2``. ``rows`` come from ``model_rows`` and should be
    cached. Raises when the passes do not suffice. ``on_pass`` is called for every pass.
    """
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    size = first.n + 1
    strengths = sorted(f.c for f in fits)
    everything = tuple(sorted({i for f in fits for i in f.features}))
    left_out = sorted({f.left_out for f in fits}, key=str)
    bases = [
        _Descent(Fit(everything, strengths[len(strengths) // 2], fold), size, np.zeros(size))
        for fold in left_out
    ]
    folds = _folds([b.fit for b in bases])

    def run(going: list[_Descent], newton: bool) -> None:
        for _ in range(_MAX_PASSES):
            going = [d for d in going if not d.done]
            if not going:
                return
            on_pass()
            if newton and all(d.length == 1.0 for d in going):
                # Fresh curvature where the trial is; its steps need no memory.
                found = _curvatures(rows, folds, np.stack([d.trial for d in bases]))
                for d, curvature in zip(bases, found):
                    d.curvature, d.steps = curvature, []
                    d.settle(curvature, {})
            trials = np.stack([d.trial for d in going])
            for d, sums in zip(going, _slopes(rows, _folds([d.fit for d in going]), trials)):
                d.take(sums)
                if newton:
                    d.steps = []
        if any(not d.done for d in going):
            raise RuntimeError(f"logistic fits did not converge in {_MAX_PASSES} passes")

    run(bases, newton=True)
    by_fold = {d.fit.left_out: d for d in bases}
    inverses: dict = {}
    descents = []
    for fit in fits:
        base = by_fold[fit.left_out]
        descent = _Descent(fit, size, base.weights)
        descent.settle(base.curvature, inverses)
        descents.append(descent)
    run(descents, newton=False)
    return np.stack([d.weights for d in descents])


def fold_scores(rows: DataFrame, fits: Sequence[Fit], weights: np.ndarray) -> list[float]:
    """Weighted F1 of each fit on the fold it left out, in one pass."""
    left_out = np.array([f.left_out for f in fits])

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, y, fold = _arrays(batch)
            # Cell 2 * label + prediction of the two by two table of each fit.
            cells = 2 * y.astype(int)[:, None] + (x @ weights.T > 0)
            tables = [
                np.bincount(cells[fold == left_out[m], m], minlength=4)
                for m in range(len(left_out))
            ]
            n = np.concatenate(tables)
            found = {
                "fit": np.repeat(np.arange(len(left_out), dtype="int32"), 4),
                "label": np.tile([0.0, 0.0, 1.0, 1.0], len(left_out)),
                "prediction": np.tile([0.0, 1.0, 0.0, 1.0], len(left_out)),
                "n": n,
            }
            yield pa.RecordBatch.from_pydict({k: pa.array(v[n > 0]) for k, v in found.items()})

    counts = rows.mapInArrow(predict, "fit int, label double, prediction double, n bigint")
    scores = {r.fit: r.f1 for r in weighted_metrics(counts, by=["fit"], count="n").collect()}
    return [scores.get(m, 0.0) for m in range(len(fits))]


def cross_validated(
    data: DataFrame, candidates: Sequence[tuple[Sequence[int], float]]
) -> list[float]:
    """Mean weighted F1 over the folds for each candidate (feature positions, strength)."""
    rows = model_rows(data).cache()
    try:
        folds = sorted(row.fold for row in rows.select("fold").distinct().collect())
        fits = [Fit(tuple(some), c, fold) for some, c in candidates for fold in folds]
        scores = fold_scores(rows, fits, fit_many(rows, fits))
    finally:
        rows.unpersist()
    n = len(folds)
    return [sum(scores[i * n : (i + 1) * n]) / n for i in range(len(candidates))]
