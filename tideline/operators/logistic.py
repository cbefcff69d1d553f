"""Logistic models of several training sets and penalties at once, by Newton's method.

A step is one pass over the rows for all models: every task adds up each model's loss, gradient and curvature, whose size
depends on the columns alone, and the driver solves for the next step (coordinate by coordinate where weights are bounded
by an absolute penalty). A step that raises the loss is halved. The loss is convex, so the result doesn't depend on the way.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.boosting import numbered
from tideline.plans.settled import settled

#: Columns up to which the curvature is small enough to be sent about.
WIDE = 128
_SUMS = "model int, at int, value double"


@dataclass
class Model:
    """One model: the fold that it isn't trained on (None: all rows) and its penalties, of the mean loss (or, ``in_sum``, of
    the loss in sum); then its weights and, last, the intercept, which is never penalised."""

    left_out: int | None = None
    l1: float = 0.0
    l2: float = 0.0
    in_sum: bool = False
    weights: np.ndarray | None = None
    at: np.ndarray | None = field(default=None, repr=False)
    loss: float = np.inf
    done: bool = False

    @property
    def coefficients(self) -> list[float]:
        return self.weights[:-1].tolist()

    @property
    def intercept(self) -> float:
        return float(self.weights[-1])

    def accept(self, sums: np.ndarray) -> None:
        """Takes the sums at ``at`` (weight, loss, gradient, curvature) and finds the next point."""
        d = len(self.at)
        total, loss, g, h = sums[0], sums[1], sums[2 : 2 + d], np.zeros((d, d))
        if not total:
            raise ValueError("no rows to fit on")
        l1, l2 = (x / total if self.in_sum else x for x in (self.l1, self.l2))
        h[np.triu_indices(d)] = sums[2 + d :]
        h = (h + np.triu(h, 1).T) / total
        free = np.arange(d) < d - 1
        loss = loss / total + l1 * np.abs(self.at[free]).sum() + l2 / 2 * (self.at[free] ** 2).sum()
        if loss > self.loss + 1e-12 * abs(self.loss):
            self.at = (self.at + self.weights) / 2
            self.done = np.abs(self.at - self.weights).max() < 1e-12
            return
        gained, self.loss, self.weights = self.loss - loss, loss, self.at
        step = _step(g / total + l2 * self.weights * free, h + l2 * np.diag(free) + 1e-12 * np.eye(d), self.weights, l1 * free)
        self.at = self.weights + step
        if np.abs(step).max() < 1e-9 * (1 + np.abs(self.weights).max()) or gained < 1e-14:
            self.done = True


def _step(g: np.ndarray, h: np.ndarray, b: np.ndarray, l1: np.ndarray) -> np.ndarray:
    """The step of the least quadratic model of the loss with absolute penalties."""
    if not l1.any():
        return -np.linalg.solve(h, g)
    x = b.copy()
    slope = g.copy()  # of the quadratic model at x
    for _ in range(10_000):
        most = 0.0
        for i in range(len(x)):
            z = h[i, i] * x[i] - slope[i]
            new = np.sign(z) * max(abs(z) - l1[i], 0.0) / h[i, i]
            if new != x[i]:
                slope += h[:, i] * (new - x[i])
                most = max(most, abs(new - x[i]))
                x[i] = new
        if most < 1e-12:
            break
    return x - b


def _pass(points: list[tuple[int, int | None, np.ndarray]], n: int, weight: float):
    def run(batches):
        sums = {}
        for batch in batches:
            y, fold = (np.asarray(batch.column(c)) for c in ("y", "fold"))
            x = np.stack([*(np.asarray(batch.column(f"c{k}").fill_null(np.nan)) for k in range(n)), np.ones(len(y))], 1)
            if np.isnan(x).any():
                raise ValueError("a missing value among the columns of a logistic model")
            upper = np.triu_indices(n + 1)
            for k, left_out, b in points:
                rows = slice(None) if left_out is None else fold != left_out
                own, of = x[rows], y[rows]
                z = own @ b
                w = np.where(of == 1, weight, 1.0)
                p = 1 / (1 + np.exp(-np.clip(z, -700, 700)))
                loss = np.logaddexp(0, np.where(of == 1, -z, z))
                curve = (own * (w * p * (1 - p))[:, None]).T @ own
                found = np.concatenate([[w.sum(), (w * loss).sum()], own.T @ (w * (p - of)), curve[upper]])
                sums[k] = sums.get(k, 0) + found
        size = [len(s) for s in sums.values()]
        yield pa.RecordBatch.from_arrays([pa.array(np.repeat([*sums], size), pa.int32()), pa.array(np.concatenate([np.arange(s) for s in size]) if size else [], pa.int32()), pa.array(np.concatenate([*sums.values()]) if size else [], pa.float64())], names=["model", "at", "value"])

    return run


def fit(rows: DataFrame, columns: Sequence[str], models: Sequence[Model], weight: float = 1.0, passes: int = 100) -> list[Model]:
    """Trains ``models`` on rows with y (0 or 1), fold (where a model leaves one out) and the columns; ``weight`` is that of
    a row of label 1. Rows without a label are left out, a missing value is an error."""
    n = len(columns)
    fold = F.col("fold").cast("int") if any(m.left_out is not None for m in models) else F.lit(-1)
    for m in models:
        m.at = np.zeros(n + 1)
    with settled(rows.where(F.col("y").isin(0, 1)).select(F.col("y").cast("int").alias("y"), fold.alias("fold"), *numbered(columns))) as table:
        for _ in range(passes):
            points = [(k, m.left_out, m.at) for k, m in enumerate(models) if not m.done]
            if not points:
                break
            found = {k: np.zeros(2 + (n + 1) + (n + 1) * (n + 2) // 2) for k, *_ in points}
            for r in table.mapInArrow(_pass(points, n, weight), _SUMS).groupBy("model", "at").agg(F.sum("value").alias("value")).collect():  # models x columns^2
                found[r.model][r["at"]] = r.value
            for k, *_ in points:
                models[k].accept(found[k])
    for m in models:
        if m.done and m.loss < np.inf:
            m.weights = m.at
    return list(models)
