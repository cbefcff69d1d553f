"""Offline scoring and ensembles: fold models to calibrated, weighted, checked scores, and the strategies' table.

Fold models are logistic ones and boosted trees. Logistic ones alone are column expressions; with trees among them, all
models score a row in one pass of Arrow batches over the frame. An ensemble is published as one run and read back
from its manifest alone.
"""

from __future__ import annotations

import json
from collections.abc import Mapping, Sequence
from dataclasses import asdict, dataclass
from itertools import combinations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import boosting, learning
from tideline.operators.contract import align
from tideline.operators.metrics import evaluate
from tideline.operators.serving import risk_tier, submission_checks
from tideline.sources import runs


@dataclass(frozen=True)
class Linear:
    """A fold's logistic model as a column expression, so that all folds of all models are one projection."""

    weights: Mapping[str, float]
    intercept: float

    @classmethod
    def of(cls, model, columns: Sequence[str]) -> Linear:
        return cls(dict(zip(columns, model.coefficients.toArray().tolist(), strict=True)), float(model.intercept))

    def probability(self) -> Column:
        return learning.sigmoid(sum((F.col(c) * float(w) for c, w in self.weights.items()), F.lit(float(self.intercept))))


@dataclass(frozen=True)
class Ensemble:
    """Fold models, calibrators (slope, intercept) and weights by model, and the contract of columns."""

    columns: Sequence[str]
    folds: Mapping[str, Sequence[Linear | boosting.Model]]
    calibrators: Mapping[str, tuple[float, float]]
    weights: Mapping[str, float]
    n_folds: int = 5

    def check(self) -> None:
        if wrong := {m: len(f) for m, f in self.folds.items() if len(f) != self.n_folds}:
            raise ValueError(f"{self.n_folds} folds are needed: {wrong}")
        if missing := [m for m in self.weights if m not in self.folds or m not in self.calibrators]:
            raise ValueError(f"no folds or calibrator of {missing}")
        if mixed := [m for m, f in self.folds.items() if len({type(x) for x in f}) > 1]:
            raise ValueError(f"folds of several kinds: {mixed}")
        needed = {c for f in self.folds.values() for x in f for c in (x.columns if isinstance(x, boosting.Model) else x.weights)}
        if unknown := needed - {*self.columns}:
            raise ValueError(f"columns that aren't in the contract: {sorted(unknown)}")


def score(df: DataFrame, e: Ensemble, key: str = "id") -> DataFrame:
    """``key``, each model's calibrated score, the blend ``p`` and its ``tier``; a missing column is an error."""
    e.check()
    x = align(df, [*e.columns], (key,), strict=True)
    trees = {m: f for m, f in e.folds.items() if isinstance(f[0], boosting.Model)}
    if trees:
        x = boosting.fold_means(x, trees, [key], {m: [(f.weights, f.intercept) for f in own] for m, own in e.folds.items() if m not in trees})
    else:
        x = x.select(key, *((sum(f.probability() for f in folds) / len(folds)).alias(m) for m, folds in e.folds.items()))
    x = x.select(key, *(learning.apply_platt(m, *e.calibrators[m]).alias(m) for m in e.folds))
    return x.withColumn("p", learning.blend(e.weights, [*e.folds])).withColumn("tier", risk_tier("p"))


def publish(spark: SparkSession, root: str, stage: str, name: str, run: str, e: Ensemble, texts: Mapping[str, str] | None = None) -> str:
    """An ensemble as a run: a row for each fold model, calibrators and weights; it must be whole. ``texts`` go with it, such
    as the specifications that its columns are made by."""
    e.check()
    folds = [(m, k, "trees" if isinstance(f, boosting.Model) else "linear", f.dumps() if isinstance(f, boosting.Model) else json.dumps(asdict(f))) for m, own in e.folds.items() for k, f in enumerate(own)]
    tables = {
        "folds": spark.createDataFrame(folds, "model string, fold int, kind string, body string"),
        "calibrators": spark.createDataFrame([(m, *map(float, c)) for m, c in e.calibrators.items()], "model string, slope double, intercept double"),
        "weights": spark.createDataFrame([(m, float(w)) for m, w in e.weights.items()], "model string, weight double"),
    }
    tables["texts"] = spark.createDataFrame([*(texts or {}).items()], "name string, body string")
    return runs.publish(spark, root, stage, name, run, tables, {"columns": [*e.columns], "n_folds": e.n_folds, "models": [*e.folds]})


def load(spark: SparkSession, root: str, name: str, stages: tuple[str, ...]) -> Ensemble:
    return load_with(spark, root, name, stages)[0]


def load_with(spark: SparkSession, root: str, name: str, stages: tuple[str, ...]) -> tuple[Ensemble, dict[str, str]]:
    """The last published ensemble of a name and its texts; tables that aren't those of its manifest, or folds that lack,
    are an error."""
    found = runs.latest(spark, root, stages).get(name)
    if found is None:
        raise FileNotFoundError(f"{root} has no published run of {name} in {stages}")
    table = lambda t: runs.read(spark, found, t).collect()
    rows = sorted(table("folds"), key=lambda r: r.fold)
    body = {"trees": boosting.Model.loads, "linear": lambda s: Linear(**json.loads(s))}
    folds = {m: [body[r.kind](r.body) for r in rows if r.model == m] for m in found["facts"]["models"]}
    e = Ensemble(found["facts"]["columns"], folds, {r.model: (r.slope, r.intercept) for r in table("calibrators")}, {r.model: r.weight for r in table("weights")}, found["facts"]["n_folds"])
    e.check()
    return e, {r.name: r.body for r in table("texts")}


def checked_submission(scored: DataFrame, expected: int, key: str = "id") -> DataFrame:
    """``submission``, once it has passed all checks of a scored file; what fails is named in the error."""
    out = submission(scored, key)
    row = submission_checks(out, expected).first()
    if wrong := [c for c, ok in row.asDict().items() if not ok]:
        raise ValueError(f"the scored file fails {wrong}")
    return out


def submission(scored: DataFrame, key: str = "id") -> DataFrame:
    """The scored file: the same score for each of its three targets."""
    return scored.select(F.col(key).alias("ID"), *(F.col("p").alias(c) for c in ("Target", "TargetLogLoss", "TargetRAUC")))


def strategies(scored: DataFrame, models: Sequence[str], c: float = 0.05) -> DataFrame:
    """``seq, name`` and metrics of simple average, optimised weights, stacking and calibrated stacking (with a fold)."""
    weights = learning.optimise_weights(scored, models)
    stacked = learning.calibrated_stack(scored, models, c)
    made = [
        ("simple_average", scored.select("y", learning.blend(dict.fromkeys(models, 1 / len(models)), models).alias("p"))),
        ("weighted_average", scored.select("y", learning.blend(weights, models).alias("p"))),
        ("stacking", stacked.select("y", F.col("stacked").alias("p"))),
        ("calibrated_stacking", stacked.select("y", F.col("calibrated").alias("p"))),
    ]
    rows = None
    for seq, (name, df) in enumerate(made):
        one = df.withColumns({"seq": F.lit(seq), "name": F.lit(name)})
        rows = one if rows is None else rows.unionByName(one)
    return evaluate(rows, "seq", "name")


def ablation(scored: DataFrame, models: Sequence[str], at_least: int = 2, digits: int = 6) -> DataFrame:
    """Metrics of the simple average over each subset of models: all of them in one pass over the rows."""
    subsets = [s for n in range(at_least, len(models) + 1) for s in combinations(models, n)]
    p = F.array(*(F.struct(F.lit("+".join(s)).alias("subset"), learning.blend(dict.fromkeys(s, 1 / len(s)), models).alias("p")) for s in subsets))
    return evaluate(scored.select("y", F.explode(p).alias("x")).select("y", "x.subset", "x.p"), "subset", digits=digits)


def augmented(scored: DataFrame, models: Sequence[str], extra: Sequence[str], c: float = 0.05) -> DataFrame:
    """``features`` (plain, augmented) and metrics of out-of-fold stacking without and with ``extra`` columns, scaled to
    a mean of 0 and a deviation of 1."""
    row = scored.agg(*(f(x).alias(f"{x}|{k}") for x in extra for k, f in enumerate((F.avg, F.stddev_pop)))).first()
    scaled = scored.withColumns({x: (F.col(x) - row[f"{x}|0"]) / (row[f"{x}|1"] or 1.0) for x in extra})
    rows = learning.stack(scored, models, c).select("y", F.col("stacked").alias("p"), F.lit("plain").alias("features"))
    more = learning.stack(scaled, models, c, extra).select("y", F.col("stacked").alias("p"), F.lit("augmented").alias("features"))
    return evaluate(rows.unionByName(more), "features")


def stacking_by_c(scored: DataFrame, models: Sequence[str], settings: Sequence[float] = (0.10, 0.05, 0.01)) -> DataFrame:
    """Metrics of out-of-fold stacking at several strengths of regularisation."""
    columns = learning.stacked_columns(scored, models, settings)
    rows = F.array(*(F.struct(F.lit(c).alias("c"), p.alias("p")) for c, p in zip(settings, columns, strict=True)))
    return evaluate(scored.select("y", F.inline(rows)), "c")
