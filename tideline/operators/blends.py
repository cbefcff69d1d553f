"""Composite scores of many weighted averages of models at once, exactly.

A round is one job over a narrow table: tasks average the models' scores with all candidate weights, equal scores of one
label become one entry, and entries meet by candidate and range of scores, where they are sorted. The driver gets a row for
each candidate and range. Ranges lie between quantiles of a bounded sample of rows; the result doesn't depend on them.
The weights are data of the tasks and no text of the plan, so a search of many rounds compiles its stages once.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence
from contextlib import contextmanager
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.metrics import LOSS, RANK, TINY
from tideline.operators.ranks import RANGES
from tideline.plans.settled import settled

#: Rows of the sample, and rows of a task whose scores are held at once.
SAMPLE, ROWS = 16_384, 1 << 17
_PARTS = "candidate int, range int, entries binary"
_SUMS = "candidate int, range int, n1 double, n0 double, won double, loss double"


@dataclass
class Scores:
    """Rows of a label and the models' scores, as a table, and some of the scores."""

    table: DataFrame
    some: np.ndarray

    def composites(self, candidates: Sequence[Sequence[float]]) -> list[float | None]:
        """The composite score of each candidate's weighted average; None where a class is absent."""
        weights = np.array(candidates, float)
        cuts = [np.unique(np.quantile(_average(self.some, w), np.arange(1, RANGES) / RANGES)) if len(self.some) else np.array([]) for w in weights]
        parts = self.table.mapInArrow(_parts(weights, cuts), _PARTS)
        rows = parts.groupBy("candidate", "range").applyInArrow(_sums, _SUMS).collect()  # candidates x RANGES
        out: list[float | None] = []
        for k in range(len(weights)):
            own = np.array(sorted((r.range, r.n1, r.n0, r.won, r.loss) for r in rows if r.candidate == k)).reshape(-1, 5)
            n1, n0, won, loss = own[:, 1], own[:, 2], own[:, 3], own[:, 4]
            pairs = n1.sum() * n0.sum()
            area = (won + n1 * (n0.cumsum() - n0)).sum() / pairs if pairs else None
            out.append(None if area is None else float(LOSS * loss.sum() / (n1.sum() + n0.sum()) + RANK * (1 - area)))
        return out


@contextmanager
def scores(scored: DataFrame, models: Sequence[str]) -> Iterator[Scores]:
    """The rows that have a label and all scores, for the length of a ``with``."""
    x = scored.select(F.col("y").cast("int").alias("y"), *(F.col("`" + m.replace("`", "``") + "`").cast("double").alias(f"c{k}") for k, m in enumerate(models)))
    columns = x.columns[1:]
    for c in columns:
        x = x.where(F.col(c).isNotNull() & ~F.isnan(c))
    with settled(x.where(F.col("y").isin(0, 1))) as table:
        some = table.select(*columns, F.xxhash64(F.monotonically_increasing_id()).alias("h")).orderBy("h").limit(SAMPLE).toArrow()
        yield Scores(table, np.stack([np.asarray(some.column(c)) for c in columns], 1))


def _average(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    out = np.zeros(len(x))
    for k, w in enumerate(weights):  # column by column: sums don't depend on the batch
        out += x[:, k] * w
    return np.clip(out, TINY, 1 - TINY)


def _merged(p: np.ndarray, n1: np.ndarray, n0: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """One entry for each score, in order."""
    order = np.argsort(p, kind="stable")
    p, n1, n0 = p[order], n1[order], n0[order]
    first = np.flatnonzero(np.concatenate([[True], p[1:] != p[:-1]])) if len(p) else np.array([], int)
    return (p[first], np.add.reduceat(n1, first), np.add.reduceat(n0, first)) if len(first) < len(p) else (p, n1, n0)


_ENTRY = np.dtype([("p", "<f8"), ("n1", "<i8"), ("n0", "<i8")])


def _parts(weights: np.ndarray, cuts: list[np.ndarray]):
    def of(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
        y = np.concatenate([np.asarray(b.column("y")) for b in batches])
        x = np.concatenate([np.stack([np.asarray(b.column(f"c{k}")) for k in range(weights.shape[1])], 1) for b in batches])
        rows = []
        for k, (w, own) in enumerate(zip(weights, cuts, strict=True)):
            p, n1, n0 = _merged(_average(x, w), (y == 1).astype("i8"), (y == 0).astype("i8"))
            entries = np.empty(len(p), _ENTRY)
            entries["p"], entries["n1"], entries["n0"] = p, n1, n0
            at = np.searchsorted(own, p)  # in order, as the scores are
            starts = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
            rows += [(k, int(at[lo]), entries[lo:hi].tobytes()) for lo, hi in zip(starts, [*starts[1:], len(p)], strict=True)]
        columns = list(zip(*rows, strict=True))
        return pa.RecordBatch.from_arrays([pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.binary())], names=["candidate", "range", "entries"])

    def run(batches):
        held, n = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                n += batch.num_rows
            if n >= ROWS:
                yield of(held)
                held, n = [], 0
        if held:
            yield of(held)

    return run


def _sums(part: pa.Table) -> pa.Table:
    """A range's labels, its pairs won within (ties count half) and its losses."""
    e = np.frombuffer(b"".join(part.column("entries").to_pylist()), _ENTRY)
    p, n1, n0 = _merged(e["p"], e["n1"], e["n0"])
    won = (n1 * (n0.cumsum() - n0 / 2)).sum()
    loss = -(n1 * np.log(p) + n0 * np.log1p(-p)).sum()
    first = part.slice(0, 1)
    return pa.table([first.column("candidate"), first.column("range"), *(pa.array([float(v)]) for v in (n1.sum(), n0.sum(), won, loss))], names=["candidate", "range", "n1", "n0", "won", "loss"])
