"""Exact attributions of tree models: what each feature adds to a row's margin, fair over all orders of features.

A tree is a table of its leaves' paths. On a path each feature is one interval of bins, with the share of training rows
that its splits let through. For a row and a path it only matters which of the path's features the row satisfies, so the
weights are found by dynamic programming once for each pattern of satisfied features: for all patterns of a path of up to
seven features once in a task, for longer ones, of any depth, once for each pattern that a batch has.

A row's attributions and the model's base value add up to its margin. Rows are independent: one pass, without a shuffle.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.boosting import Model, Tree, _slices, binned, numbered

#: Features of a path of which all patterns are weighed beforehand, once in a task: 128 at most.
PATTERNS = 7


@dataclass
class Path:
    """A leaf: its value, and by feature the interval (above, at most) of bins and the share let through."""

    value: float
    features: list[int]
    above: list[int]
    at_most: list[int]
    share: list[float]


def paths(tree: Tree) -> list[Path]:
    """The paths of all leaves; a feature that comes again narrows its interval."""
    out = []

    def down(node: int, found: dict[int, tuple[int, int, float]]) -> None:
        f = tree.feature[node]
        if f < 0:
            columns = [list(c) for c in zip(*found.values(), strict=True)] or [[], [], []]
            out.append(Path(tree.value[node], list(found), *columns))
            return
        above, at_most, share = found.get(f, (-1, 256, 1.0))
        cover = tree.cover[node]
        for child, lo, hi in ((tree.left[node], above, min(at_most, tree.bin[node])), (tree.right[node], max(above, tree.bin[node]), at_most)):
            down(child, found | {f: (lo, hi, share * (tree.cover[child] / cover if cover else 0.0))})

    down(0, {})
    return out


def weights(satisfied: np.ndarray, share: np.ndarray) -> np.ndarray:
    """For each pattern (a row of 0 and 1 by feature of a path) what each feature gets of the leaf's value.

    For a feature, ``w[i]`` sums over the subsets of i other features: the indicators of those inside times the shares of
    those outside. A subset weighs as much as orders have it before the feature.
    """
    n, m = satisfied.shape
    size = np.full(m, 1.0 / m)
    for i in range(1, m):
        size[i] = size[i - 1] * i / (m - i)
    out = np.zeros((n, m))
    for k in range(m):
        w = np.zeros((n, m))
        w[:, 0] = 1.0
        for j in range(m):
            if j != k:
                w[:, 1:] = w[:, 1:] * share[j] + w[:, :-1] * satisfied[:, j : j + 1]
                w[:, 0] *= share[j]
        out[:, k] = (w * size).sum(1) * (satisfied[:, k] - share[k])
    return out


def _shares(p: Path, patterns: np.ndarray) -> np.ndarray:
    """What each feature of a path (a row) gets in each pattern of satisfied features, given as bits."""
    return np.ascontiguousarray((p.value * weights(patterns[:, None] >> np.arange(len(p.features)) & 1, np.array(p.share))).T)


def prepared(tables: Sequence[Sequence[Path]]) -> list[tuple[Path, list[np.ndarray], np.ndarray | None]]:
    """Paths with each feature's bit by bin and, for those of up to PATTERNS patterns, what features get in every one."""
    out = []
    for p in (p for tree in tables for p in tree if p.features):
        bits = []
        for j, (above, at_most) in enumerate(zip(p.above, p.at_most, strict=True)):
            bins = np.arange(max(above, at_most) + 2)  # bins beyond are like the last one
            bits.append(((bins > above) & (bins <= at_most)).astype(int) << j)
        out.append((p, bits, _shares(p, np.arange(1 << len(p.features))) if len(p.features) <= PATTERNS else None))
    return out


def attribute(x: np.ndarray, tables: Sequence[Sequence[Path]], n_features: int) -> np.ndarray:
    """Attributions of rows of bins, a column for each feature."""
    return _added(x, prepared(tables), n_features)


def _added(x: np.ndarray, ready: list[tuple[Path, list[np.ndarray], np.ndarray | None]], n_features: int) -> np.ndarray:
    out = np.zeros((n_features, len(x))).T
    for p, bits, known in ready:
        code = sum(b.take(x[:, f], mode="clip") for f, b in zip(p.features, bits, strict=True))
        if known is None:
            patterns, code = np.unique(code, return_inverse=True)
            known = _shares(p, patterns)
        for f, share in zip(p.features, known, strict=True):
            out[:, f] += share.take(code)
    return out


def base_value(model: Model) -> float:
    """The margin that attributions start from: each leaf by the share of rows in it."""
    return model.base + sum(p.value * float(np.prod(p.share)) for t in model.trees for p in paths(t))


def _attributed(models: Sequence[Model]):
    tables, base = [[paths(t) for t in m.trees] for m in models], [base_value(m) for m in models]

    def run(batches):
        ready = [prepared(t) for t in tables]
        for batch in _slices(batches):
            x = binned(batch, models[0].edges)
            found = sum(_added(x, r, len(models[0].columns)) for r in ready) / len(models)
            margin = sum(m.margins(x) for m in models) / len(models)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(np.full(len(x), sum(base) / len(base))), pa.array(margin), *map(pa.array, np.ascontiguousarray(found.T))], names=["id", "base", "margin", *(f"c{k}" for k in range(found.shape[1]))])

    return run


def attributions(df: DataFrame, models: Sequence[Model]) -> DataFrame:
    """``id, base, margin`` and a column for each feature of the models: their mean attributions.

    ``base`` and the features' columns add up to ``margin``, the mean margin of the models.
    """
    columns = models[0].columns
    if any(m.columns != columns or m.edges != models[0].edges for m in models):
        raise ValueError("the models don't share columns and edges")
    kind = df.schema["id"].dataType.simpleString()
    found = df.select("id", *numbered(columns)).mapInArrow(_attributed(models), ", ".join([f"id {kind}", "base double", "margin double", *(f"c{k} double" for k in range(len(columns)))]))
    return found.select("id", "base", "margin", *(F.col(f"c{k}").alias(c) for k, c in enumerate(columns)))
