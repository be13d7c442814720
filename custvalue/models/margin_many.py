"""Many linear classifiers with hinge loss on the same rows at once.

All strengths of all folds are fitted together: one pass over the rows serves one step of every
fit. The kink of the hinge is rounded off over a width that shrinks until the duality gap, which
bounds what is lost to the best weights there are, is small enough; each width starts from the
weights of the one before. A step takes two passes: one adds up slopes and curvature of every fit,
the other the losses at several lengths along every fit's direction. Tasks add up matrices of a
fixed size (fits times features squared), whatever the rows.
"""

from __future__ import annotations

import sys
from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
from pyspark import cloudpickle
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from custvalue.models.logistic_many import _added, _per_task

GAP = 0.01
# Widths of the rounded kink; the first ones only lead to the others.
_WIDTHS = 0.5 ** np.arange(0, 18, 2)
_LEADING = 2
_LENGTHS = np.concatenate([[0.0], 0.5 ** np.arange(12)])
_STEPS_PER_WIDTH = 40
_SETTLED = 1e-7
_NEARLY = 1e-3
_SMALL = 1e-4
_LAST_FEW = 0.5
# Rows away from the kink count a little, so that a step is defined where none lies in it. Where
# few rows lie in the kink, steps that fail for that are tried again with more of it.
_ELSEWHERE = 0.02
_MORE_ELSEWHERE = (0.2, 2.0, 20.0)
_CELLS_AT_ONCE = 200_000

cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass(frozen=True)
class MarginFit:
    """``c * sum of hinge losses + |weights|^2 / 2`` over the rows outside fold ``left_out``. The
    intercept is free."""

    c: float
    left_out: int | None = None


def _misses(x: np.ndarray, y: np.ndarray, weights: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Signs, and how far each row is on the wrong side of each fit's margin."""
    sign = np.where(y > 0.5, 1.0, -1.0)[:, None]
    return sign, 1 - sign * (x @ weights.T)


def _rounded(miss: np.ndarray, width: float) -> np.ndarray:
    inner = np.clip(miss, 0, width)
    return np.maximum(miss, 0) - inner + inner * inner / (2 * width)


def _pushes(miss: np.ndarray, width: float) -> np.ndarray:
    """What each row adds to the slope: its dual value, 0 to 1."""
    return np.clip(miss / width, 0, 1)


def _sums(rows: DataFrame, shape: tuple[int, ...], left_out: np.ndarray, add) -> np.ndarray:
    """``add(x, y, used, out)`` over all rows, some at a time; ``used`` says per row and fit
    whether the fit learns from the row."""
    step = max(1, _CELLS_AT_ONCE // len(left_out))

    def add_up(x, y, fold, total):
        out = total.reshape(shape)
        for low in range(0, len(x), step):
            some = slice(low, low + step)
            add(x[some], y[some], fold[some, None] != left_out[None, :], out)

    parts = rows.mapInArrow(_per_task(add_up, int(np.prod(shape))), "sums binary")
    return _added(parts, shape)


def _slopes(rows: DataFrame, left_out, weights, width, elsewhere) -> tuple[np.ndarray, np.ndarray]:
    fits, size = weights.shape
    one, other = np.triu_indices(size)

    def add(x, y, used, out):
        sign, miss = _misses(x, y, weights)
        out[:, :size] -= (used * sign * _pushes(miss, width)).T @ x
        bend = used * np.where((miss > 0) & (miss < width), 1 / width, elsewhere)
        out[:, size:] += bend.T @ (x[:, one] * x[:, other])

    sums = _sums(rows, (fits, size + len(one)), left_out, add)
    bends = np.empty((fits, size, size))
    bends[:, one, other] = bends[:, other, one] = sums[:, size:]
    return sums[:, :size], bends


def _losses(rows: DataFrame, left_out, weights, steps, width) -> np.ndarray:
    """Per fit the loss at every length along its step."""

    def add(x, y, used, out):
        sign, miss = _misses(x, y, weights)
        move = sign * (x @ steps.T)
        for i, length in enumerate(_LENGTHS):
            out[:, i] += (used * _rounded(miss - length * move, width)).sum(axis=0)

    return _sums(rows, (len(weights), len(_LENGTHS)), left_out, add)


def _gaps(rows: DataFrame, left_out, c, weights, width, least) -> np.ndarray:
    """Duality gap per fit as a share of its loss, with the rounded hinge's dual values."""
    fits, size = weights.shape

    def add(x, y, used, out):
        sign, miss = _misses(x, y, weights)
        dual = used * _pushes(miss, width)
        out[:, 0] += (used * np.maximum(miss, 0)).sum(axis=0)
        out[:, 1] += dual.sum(axis=0)
        out[:, 2:] += (dual * sign).T @ x

    sums = _sums(rows, (fits, 2 + size), left_out, add)
    loss = sums[:, 0] + (weights[:, :-1] ** 2).sum(axis=1) / (2 * c)
    reach = sums[:, 1] - c / 2 * (sums[:, 2:-1] ** 2).sum(axis=1)
    # A dual point needs as much push from either label; what is missing counts as gap.
    unequal = np.abs(weights[:, -1] * sums[:, -1])
    return (loss - reach + unequal) / np.maximum(loss, least)


def fit_margins(
    rows: DataFrame, fits: Sequence[MarginFit], gap: float = GAP
) -> tuple[np.ndarray, np.ndarray]:
    """Weights per fit (the intercept last) and duality gaps, as shares of the loss.

    ``rows`` come from ``logistic_many.model_rows`` and should be cached. Raises where a gap stays
    above ``gap``.
    """
    first = rows.select(F.size("x").alias("n")).first()
    if first is None:
        raise ValueError("no rows to learn from")
    size = first.n + 1
    c = np.array([f.c for f in fits])
    left_out = np.array([-2 if f.left_out is None else f.left_out for f in fits])
    weights, gaps = np.zeros((len(fits), size)), np.full(len(fits), np.inf)
    # Losses far below that of no weights at all (half a row each, rounded off) count as that.
    least = _SMALL * _losses(rows, left_out, weights, weights, 1.0)[:, 0]
    for width in _WIDTHS[:_LEADING]:
        weights = _settled(rows, left_out, c, weights, width, _NEARLY, least)
    for width in _WIDTHS[_LEADING:]:
        wide = np.flatnonzero(gaps > gap)
        if not len(wide):
            break
        weights[wide] = _settled(
            rows, left_out[wide], c[wide], weights[wide], width, _SETTLED, least[wide]
        )
        gaps[wide] = _gaps(rows, left_out[wide], c[wide], weights[wide], width, least[wide])
        for elsewhere in _MORE_ELSEWHERE:
            wide = np.flatnonzero(gaps > gap)
            # Most fits come close at a smaller width; these steps are for the last few.
            if not len(wide) or len(wide) > _LAST_FEW * len(fits):
                break
            weights[wide] = _settled(
                rows, left_out[wide], c[wide], weights[wide], width, _SETTLED, least[wide], elsewhere
            )
            gaps[wide] = _gaps(rows, left_out[wide], c[wide], weights[wide], width, least[wide])
    if (gaps > gap).any():
        raise RuntimeError(f"hinge fits did not come closer than {gaps.max():.3g} of their loss")
    return weights, gaps


def _settled(
    rows, left_out, c, weights, width, share, least, elsewhere=_ELSEWHERE
) -> np.ndarray:
    """Newton steps of all fits until none gains ``share`` of its loss."""
    weights, going = weights.copy(), np.arange(len(c))
    free = np.ones(weights.shape[1])
    free[-1] = 0.0
    for _ in range(_STEPS_PER_WIDTH):
        at, penalty = weights[going], free / c[going, None]
        slope, bend = _slopes(rows, left_out[going], at, width, elsewhere)
        slope = slope + penalty * at
        bend = bend + penalty[:, :, None] * np.eye(len(free))
        bend += 1e-9 * np.trace(bend, axis1=1, axis2=2)[:, None, None] * np.eye(len(free))
        steps = -np.linalg.solve(bend, slope[:, :, None])[:, :, 0]
        losses = _losses(rows, left_out[going], at, steps, width)
        for i, length in enumerate(_LENGTHS):
            losses[:, i] += (penalty * (at + length * steps) ** 2).sum(axis=1) / 2
        best = losses.argmin(axis=1)
        weights[going] = at + _LENGTHS[best][:, None] * steps
        gain = losses[:, 0] - losses[np.arange(len(going)), best]
        going = going[gain > share * np.maximum(losses[:, 0], least[going])]
        if not len(going):
            break
    return weights
