"""Folds, calibration, ensembles and drift over scored rows keyed by id, never by position."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators import blends, logistic
from tideline.operators.ranks import present

#: The clip of final scores and the limits of drift checks.
FINAL, WARN, FAIL, BASE_RATE = 1e-6, 0.05, 0.10, (0.13, 0.17)


def folds(df: DataFrame, k: int = 5, seed: int = 42, key: str = "id", y: str = "y") -> DataFrame:
    """Stratified folds: within a class, rows in the order of a hash of seed and key are dealt in turn.

    The order within a class is found over hash ranges: counts of 4,096 ranges first, then a rank inside a range. So no
    task sorts a whole class.
    """
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.col(key).cast("string")))
    x = df.withColumns({"__h": digest, "__r": F.substring(digest, 1, 3)})
    counts = x.groupBy(y, "__r").agg(F.count("*").alias("__n"))
    before = Window.partitionBy(y).orderBy("__r").rowsBetween(Window.unboundedPreceding, -1)  # at most 4,096 rows a class
    offsets = counts.select(y, "__r", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"))
    rank = F.row_number().over(Window.partitionBy(y, "__r").orderBy("__h", key))
    return x.join(F.broadcast(offsets), [y, "__r"]).withColumn("fold", F.pmod(F.col("__before") + rank - 1, F.lit(k)).cast("int")).drop("__h", "__r", "__before")


def sigmoid(z: Column) -> Column:
    return 1 / (1 + F.exp(-z))


def apply_platt(p: str, slope: float | None, intercept: float | None) -> Column:
    """A fitted calibrator on a raw score, clipped; a missing parameter is an error, never an identity."""
    if slope is None or intercept is None:
        raise ValueError("a calibrator needs slope and intercept")
    return F.least(F.greatest(sigmoid(F.col(p) * slope + intercept), F.lit(FINAL)), F.lit(1 - FINAL))


def fit_platt(scored: DataFrame, c: float = 1e10) -> tuple[float, float]:
    """Slope and intercept by Newton's method: each step is one pass to six sums."""
    return _platts(scored, [None], c)[0]


def _platts(scored: DataFrame, left_out: Sequence[int | None], c: float) -> list[tuple[float, float]]:
    """Slope and intercept without each of the folds, all of them in the same passes."""
    rows = scored.where(present("p"))
    found = logistic.fit(rows, ["p"], [logistic.Model(k, l2=1 / c, in_sum=True) for k in left_out], passes=60)
    return [(m.coefficients[0], m.intercept) for m in found]


def _folds_of(scored: DataFrame) -> list[int]:
    return [r.fold for r in scored.select("fold").distinct().orderBy("fold").collect()]


def _by_fold(of: Mapping[int, Column]) -> Column:
    """A row's value by its fold."""
    out = F.lit(None).cast("double")
    for k, value in of.items():
        out = F.when(F.col("fold") == k, value).otherwise(out)
    return out


def cross_platt(scored: DataFrame, c: float = 1e10) -> tuple[DataFrame, tuple[float, float]]:
    """``scored`` (with a column fold) with ``calibrated`` by a fit on the other folds, and a fit on all rows."""
    found = _folds_of(scored)
    *by, whole = _platts(scored, [*found, None], c)
    return scored.withColumn("calibrated", _by_fold({k: apply_platt("p", *of) for k, of in zip(found, by, strict=True)})), whole


def temperature_grid(scored: DataFrame, low: float = 0.5, high: float = 3.0, n: int = 50, digits: int = 6) -> DataFrame:
    """Log loss of sigmoid(logit(p) / T) on a grid of T: all columns of one aggregation."""
    grid = [low + (high - low) * i / (n - 1) for i in range(n)]
    p = F.least(F.greatest(F.col("p"), F.lit(FINAL)), F.lit(1 - FINAL))
    x = scored.withColumn("z", F.ln(p / (1 - p)))
    row = x.agg(*((-F.avg(F.when(F.col("y") == 1, F.ln(sigmoid(F.col("z") / t))).otherwise(F.ln(1 - sigmoid(F.col("z") / t))))).alias(f"t{i}") for i, t in enumerate(grid)))
    parts = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(t).alias("t"), F.round(f"t{i}", digits).alias("logloss")) for i, t in enumerate(grid)))
    return row.select(F.explode(parts).alias("g")).select("g.i", F.round("g.t", digits).alias("t"), "g.logloss")


def blend(weights: Mapping[str, float], present: Sequence[str]) -> Column:
    """A weighted average of model columns: a missing model is an error, weights off 1 by over 1e-4 are rescaled."""
    if missing := [m for m in weights if m not in present]:
        raise ValueError(f"no scores of {missing}")
    total = sum(weights.values())
    scale = total if abs(total - 1) > 1e-4 else 1.0
    out = sum((F.col(m) * (w / scale) for m, w in weights.items()), F.lit(0.0))
    return F.least(F.greatest(out, F.lit(FINAL)), F.lit(1 - FINAL))


def spread(models: Sequence[str]) -> Column:
    """Population deviation between models, a meta feature."""
    mean = sum(map(F.col, models)) / len(models)
    return F.sqrt(sum((F.col(m) - mean) * (F.col(m) - mean) for m in models) / len(models))


def candidate_weights(k: int, n: int, seed: int = 42) -> list[tuple[float, ...]]:
    """Equal weights, single models, and points of the simplex from a seeded generator."""
    rng = np.random.default_rng(seed)
    return [tuple([1 / k] * k), *(tuple(float(i == j) for i in range(k)) for j in range(k)), *map(tuple, rng.dirichlet(np.ones(k), n).tolist())]


def composites(scored: DataFrame, models: Sequence[str], candidates: Sequence[Sequence[float]]) -> list[float | None]:
    """The composite score of each candidate's weighted average, over the rows that have a label and all scores."""
    with blends.scores(scored, models) as rows:
        return rows.composites(candidates)


def optimise_weights(scored: DataFrame, models: Sequence[str], n: int = 24, tolerance: float = 1e-8, rounds: int = 60, seed: int = 42) -> dict[str, float]:
    """Weights of the least composite score, found by a pattern search on the simplex.

    ``n`` starts are scored at once. From the best one, each round scores a step towards and away from every model at
    once; a round without gain halves the step. It ends when the step's gain can't reach ``tolerance`` any more (a step
    of 1e-4, as the composite is flat around its minimum) or after ``rounds``.
    """
    k = len(models)
    starts = candidate_weights(k, max(1, n - k - 1), seed)
    with blends.scores(scored, models) as rows:
        losses = rows.composites(starts)
        if None in losses:
            raise ValueError("weights need rows of both classes")
        least = min(losses)
        best, step = np.array(starts[losses.index(least)]), 0.25
        for _ in range(rounds):
            ends = [np.eye(k)[i] * sign for i in range(k) for sign in (1, -1)]
            moved = [np.maximum(best + step * (e if e.sum() > 0 else -(np.eye(k)[e.argmin()] - best)), 0) for e in ends]
            moved = [m / m.sum() for m in moved if m.sum() > 1e-10]
            losses = rows.composites(moved)
            if least - min(losses) > tolerance:
                least, best = min(losses), moved[losses.index(min(losses))]
            else:
                step /= 2
                if step < 1e-4:
                    break
    return dict(zip(models, best.tolist(), strict=True))


@dataclass(frozen=True)
class MetaModel:
    """A logistic model over the models' scores and their spread."""

    models: tuple[str, ...]
    weights: tuple[float, ...]
    intercept: float

    def score(self) -> Column:
        terms = zip([*map(F.col, self.models), spread(self.models)], self.weights, strict=True)
        return sigmoid(sum((c * float(w) for c, w in terms), F.lit(float(self.intercept))))


def fit_meta(scored: DataFrame, models: Sequence[str], c: float = 0.05, extra: Sequence[str] = ()) -> MetaModel:
    """The meta model of all rows of ``scored``; ``extra`` columns may stand beside the models."""
    return _metas(scored, models, [(None, c)], extra)[0]


def _metas(scored: DataFrame, models: Sequence[str], wanted: Sequence[tuple[int | None, float]], extra: Sequence[str]) -> list[MetaModel]:
    """The meta models without a fold and of a strength, for each of ``wanted``: all of them in the same passes."""
    names = [*models, *extra]
    rows = scored.select("y", *(["fold"] if any(k is not None for k, _ in wanted) else []), *names, spread(names).alias("__spread"))
    found = logistic.fit(rows, [*names, "__spread"], [logistic.Model(k, l2=1 / c, in_sum=True) for k, c in wanted], passes=1000)
    return [MetaModel(tuple(names), tuple(m.coefficients), m.intercept) for m in found]


def stacked_columns(scored: DataFrame, models: Sequence[str], settings: Sequence[float], extra: Sequence[str] = ()) -> list[Column]:
    """For each strength, a row's score by the meta model of the other folds."""
    found = _folds_of(scored)
    fitted = iter(_metas(scored, models, [(k, c) for c in settings for k in found], extra))
    return [_by_fold({k: next(fitted).score() for k in found}) for _ in settings]


def stack(scored: DataFrame, models: Sequence[str], c: float = 0.05, extra: Sequence[str] = ()) -> DataFrame:
    """``scored`` (with a fold) and ``stacked``: each row's score by the meta model of the other folds."""
    return scored.withColumn("stacked", stacked_columns(scored, models, [c], extra)[0])


def calibrated_stack(scored: DataFrame, models: Sequence[str], c: float = 0.05) -> DataFrame:
    """``stack`` and then a calibration of its scores by the other folds: ``stacked``, ``calibrated``."""
    stacked = stack(scored, models, c)
    found = _folds_of(scored)
    by = _platts(stacked.select("y", "fold", F.col("stacked").alias("p")), found, 1e10)
    return stacked.withColumn("calibrated", _by_fold({k: apply_platt("stacked", *of) for k, of in zip(found, by, strict=True)}))


def prediction_drift(scored: DataFrame, reference: DataFrame, digits: int = 6) -> DataFrame:
    """The shift of the mean score against that of out-of-fold scores (p), what it calls for, and whether that one is usual."""
    shift = F.abs(F.col("mean_p") - F.col("mean_oof"))
    out = scored.agg(F.avg("p").alias("mean_p")).crossJoin(reference.agg(F.avg("p").alias("mean_oof")))  # one row each
    return out.select(F.round("mean_p", digits).alias("mean_p"), F.round("mean_oof", digits).alias("mean_oof"), F.round(shift, digits).alias("shift"), F.when(shift > FAIL, "fail").when(shift > WARN, "warn").otherwise("ok").alias("status"), F.col("mean_oof").between(*BASE_RATE).alias("oof_in_range"))


def pick(strategies: DataFrame) -> DataFrame:
    """The strategy of the least score; the first wins a tie. ``strategies``: seq, name, score."""
    return strategies.orderBy("score", "seq").limit(1)
