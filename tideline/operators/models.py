"""Learners under one registry, cross-validated training and tuning.

Trees are this library's own (``boosting``): leaf-wise, depth-wise, and oblivious ones over ordered codes of categories.
Logistic regression and the perceptron are ``pyspark.ml``'s. Scores can't equal those of other libraries' learners.
"""

from __future__ import annotations

import json
import traceback
from collections.abc import Callable
from dataclasses import dataclass, field, fields, replace
from typing import Any

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import boosting, logistic, search, target_codes
from tideline.operators.boosting import Boosting
from tideline.operators.learning import cross_platt, folds
from tideline.operators.metrics import evaluate
from tideline.operators.profiling import correlations
from tideline.operators.search import Dim
from tideline.plans.settled import kept
from tideline.sources.runs import exists


@dataclass
class Experiment:
    """One model's settings. ``categories`` are columns that symmetric trees see as ordered target statistics."""

    name: str
    kind: str
    params: dict[str, Any] = field(default_factory=dict)
    scaled: bool = False
    positive_weight: float = 1.0
    n_folds: int = 5
    seed: int = 42
    balanced: bool = False
    patience: int | None = None
    categories: tuple[str, ...] = ()

    def check(self) -> None:
        if self.kind not in KINDS:
            raise ValueError(f"kind must be one of {sorted(KINDS)}")
        if self.kind in LEARNERS and not self.scaled:
            raise ValueError(f"{self.kind} needs scaled features")
        if self.n_folds < 2:
            raise ValueError("two folds at least")
        if self.positive_weight <= 0:
            raise ValueError("a weight is above 0")
        if self.kind in LEARNERS and self.patience is not None:
            raise ValueError("only trees stop early")
        if self.categories and self.kind != "trees_symmetric":
            raise ValueError("only symmetric trees take categories")
        if self.kind == "perceptron" and (self.balanced or self.positive_weight != 1.0):
            raise ValueError("the perceptron takes no weights")
        if self.kind in TREES:
            self.boosting(self.positive_weight).check()

    def boosting(self, weight: float) -> Boosting:
        """The settings of trees, over the kind's defaults; an unknown name is an error."""
        params = TREES[self.kind] | self.params
        policy = params.pop("grow", None)
        if policy == "depth" or (policy is None and self.kind == "trees_depthwise"):
            params["leaves"] = 2 ** params["depth"]
        if unknown := params.keys() - {f.name for f in fields(Boosting)}:
            raise ValueError(f"trees have no {sorted(unknown)}")
        return Boosting(**params, positive_weight=weight, patience=self.patience, seed=self.seed)


def _logistic(n_features: int, seed: int, **params):
    from pyspark.ml.classification import LogisticRegression

    return LogisticRegression(labelCol="y", weightCol="w", standardization=False, **({"elasticNetParam": 0.5, "regParam": 0.01, "maxIter": 100} | params))


def _perceptron(n_features: int, seed: int, **params):
    from pyspark.ml.classification import MultilayerPerceptronClassifier

    return MultilayerPerceptronClassifier(labelCol="y", seed=seed, layers=[n_features, *params.pop("hidden", [16]), 2], **({"maxIter": 100} | params))


#: Learners of ``pyspark.ml``, and the defaults of this library's trees.
LEARNERS: dict[str, Callable] = {"logistic": _logistic, "perceptron": _perceptron}
TREES: dict[str, dict[str, Any]] = {
    "trees_leafwise": {"trees": 100, "rate": 0.05, "leaves": 31, "min_rows": 50, "subsample": 0.8, "colsample": 0.8, "l1": 0.5},
    "trees_depthwise": {"trees": 100, "rate": 0.05, "depth": 5, "min_rows": 1, "min_weight": 1.0, "subsample": 0.8, "colsample": 0.8},
    "trees_symmetric": {"trees": 100, "rate": 0.05, "depth": 6, "symmetric": True, "l2": 3.0},
}
KINDS = {*LEARNERS, *TREES}


def _vectors(df: DataFrame, columns: list[str], positive_weight: float) -> DataFrame:
    from pyspark.ml.feature import VectorAssembler

    weighted = df.withColumn("w", F.when(F.col("y") == 1, positive_weight).otherwise(1.0))
    return VectorAssembler(inputCols=columns, outputCol="features").transform(weighted)


def probability(model, df: DataFrame) -> DataFrame:
    """``df`` with the positive class's probability ``p``."""
    from pyspark.ml.functions import vector_to_array

    return model.transform(df).withColumn("p", vector_to_array("probability")[1]).drop("rawPrediction", "probability", "prediction")


def importances(model, columns: list[str]) -> list[float]:
    """Shares of gain of trees (a category's codes under its name), or absolute coefficients; zeros where a model has none."""
    if isinstance(model, boosting.Model):
        by = dict.fromkeys(columns, 0.0)
        for c, v in zip(model.columns, model.importances(), strict=True):
            of = c if c in by else c.rsplit("|", 1)[0]
            by[of] += v
        return list(by.values())
    if getattr(model, "coefficients", None) is not None:
        return np.abs(model.coefficients.toArray()).tolist()
    return [0.0] * len(columns)


@dataclass
class Result:
    """Out-of-fold scores keyed by id, the models, scores by fold and importances by fold."""

    oof: DataFrame
    models: list
    by_fold: DataFrame
    importance: list[tuple[str, float, int]]
    steps: list[float] = field(default_factory=list)
    pruned: bool = False
    cached: DataFrame | None = None

    def release(self) -> None:
        """Gives up the cached rows that the scores are computed from."""
        if self.cached is not None:
            self.cached.unpersist()


def cross_validate(data: DataFrame, columns: list[str], e: Experiment, stop: Callable[[list[float]], bool] | None = None) -> Result:
    """Trains on all folds but one, scores that one; ``data`` has id, y and the columns (and the experiment's categories).

    ``stop`` is asked after each fold but the last, with the composite scores of the folds so far; if it says so, the
    result is pruned and has those folds alone. Trees of all folds grow at once, so for them it spares no work.
    """
    e.check()
    weight = e.positive_weight
    if e.balanced:
        n = {r.y: r.n for r in data.groupBy("y").agg(F.count("*").alias("n")).collect()}
        weight = n.get(0, 1) / max(n.get(1, 1), 1)
    dealt = kept(folds(data, e.n_folds, e.seed))  # read by every pass, so dealt once
    names = [*columns, *e.categories]
    parts, models, importance, steps, pruned, cached = [], [], [], [], False, None
    if e.kind in TREES:
        s, full = e.boosting(weight), dealt
        if e.categories:
            models, full = target_codes.fit_symmetric(dealt, columns, e.categories, s, e.n_folds)
        else:
            models = boosting.fit(dealt, columns, s, e.n_folds)
        cached = boosting.out_of_fold(full, models).persist()
        scored = lambda k: cached.where(F.col("fold") == k)
    else:
        cached = _vectors(dealt, columns, weight).select("id", "y", "w", "fold", "features").persist()

        together = _lines(dealt, columns, e, weight)

        def scored(k: int) -> DataFrame:
            models.append(together[k] if together else LEARNERS[e.kind](len(columns), e.seed, **e.params).fit(cached.where(F.col("fold") != k)))
            return probability(models[k], cached.where(F.col("fold") == k)).select("id", "fold", "y", "p")

    for k in range(e.n_folds):
        parts.append(scored(k))
        importance += [(c, float(v), k) for c, v in zip(names, importances(models[k], names), strict=True)]
        if stop and k + 1 < e.n_folds:
            steps.append(evaluate(parts[-1]).first().composite)
            if pruned := stop(steps):
                break
    oof = parts[0]
    for p in parts[1:]:
        oof = oof.unionByName(p)
    return Result(oof, models, evaluate(oof, "fold"), importance, steps, pruned, cached)


def _lines(dealt: DataFrame, columns: list[str], e: Experiment, weight: float) -> list | None:
    """The folds' logistic models, trained in the same passes, as models of ``pyspark.ml``: the minimum of the same loss as
    its own learner's; None for wide frames, whose curvature is too large, and settings beyond the penalty."""
    from pyspark.ml.classification import LogisticRegressionModel
    from pyspark.ml.common import _py2java
    from pyspark.ml.linalg import Vectors
    from pyspark.ml.wrapper import JavaWrapper

    s = {"elasticNetParam": 0.5, "regParam": 0.01, "maxIter": 100} | e.params
    if e.kind != "logistic" or len(columns) > logistic.WIDE or s.keys() - {"elasticNetParam", "regParam", "maxIter"}:
        return None
    l1, l2 = s["regParam"] * s["elasticNetParam"], s["regParam"] * (1 - s["elasticNetParam"])
    found = logistic.fit(dealt, columns, [logistic.Model(k, l1, l2) for k in range(e.n_folds)], weight, s["maxIter"])
    sc = dealt.sparkSession.sparkContext
    return [LogisticRegressionModel(JavaWrapper._new_java_obj("org.apache.spark.ml.classification.LogisticRegressionModel", f"logistic_{k}", _py2java(sc, Vectors.dense(m.coefficients)), m.intercept)) for k, m in enumerate(found)]


def save_models(models: list, path: str, spark: SparkSession | None = None) -> None:
    """A folder for each fold's model."""
    for k, m in enumerate(models):
        if isinstance(m, boosting.Model):
            (spark or SparkSession.active()).createDataFrame([(m.dumps(),)], "model string").write.mode("overwrite").parquet(f"{path}/fold_{k}")
        else:
            m.write().overwrite().save(f"{path}/fold_{k}")


def load_trees(path: str) -> boosting.Model:
    """A tree model, as ``load_models`` takes a loader."""
    return boosting.Model.loads(SparkSession.active().read.parquet(path).first().model)


def load_models(load: Callable[[str], Any], path: str, n_folds: int = 5) -> list:
    """Exactly ``n_folds`` models; one that is missing is an error. ``load`` is a model class's loader, or ``load_trees``."""
    spark = SparkSession.active()
    if missing := [k for k in range(n_folds) if not exists(spark, f"{path}/fold_{k}")]:
        raise FileNotFoundError(f"{path} has no model of folds {missing}; {n_folds} are needed")
    return [load(f"{path}/fold_{k}") for k in range(n_folds)]


def preflight(data: DataFrame, columns: list[str], experiments: list[Experiment]) -> dict[str, str]:
    """What is wrong with experiments before any of them runs, by name: settings, names that come again, missing columns, a fold without both classes."""
    least = data.where(F.col("y").isin(0, 1)).groupBy("y").count().agg(F.count("*").alias("classes"), F.min("count").alias("rows")).first()
    out: dict[str, str] = {}
    for k, e in enumerate(experiments):
        try:
            e.check()
            if e.name in (x.name for x in experiments[:k]):
                raise ValueError("an earlier experiment has this name")
            if gone := [c for c in (*columns, *e.categories, "id", "y") if c not in data.columns]:
                raise ValueError(f"no columns {gone}")
            if least.classes < 2 or least.rows < e.n_folds:
                raise ValueError(f"{e.n_folds} folds need as many rows of both classes")
        except ValueError as error:
            out[e.name] = str(error)
    return out


def run_experiments(data: DataFrame, columns: list[str], experiments: list[Experiment]) -> dict[str, Result | str]:
    """One model after the other; what ``preflight`` rejects doesn't start, a failure is kept as text and stops no other."""
    wrong = preflight(data, columns, experiments)
    out: dict[str, Result | str] = {}
    for e in experiments:
        if e.name in wrong:
            out.setdefault(e.name, wrong[e.name])
            continue
        try:
            out[e.name] = cross_validate(data, columns, e)
        except Exception:
            out[e.name] = traceback.format_exc(limit=3)
    return out


def summary(results: dict[str, Result | str]) -> list[dict[str, Any]]:
    """A row for each experiment: whether it ran, its mean scores over folds, or its error."""
    rows = []
    for name, r in results.items():
        if isinstance(r, str):
            rows.append({"name": name, "ok": False, "error": r.strip().splitlines()[-1], "logloss": None, "auc": None, "composite": None, "folds": 0})
        else:
            mean = r.by_fold.agg(*(F.avg(c).alias(c) for c in ("logloss", "auc", "composite")), F.count("*").alias("folds")).first()
            rows.append({"name": name, "ok": True, "error": None, **mean.asDict()})
    return rows


def score_folds(models: list, df: DataFrame, columns: list[str]) -> DataFrame:
    """The mean probability of a model's folds, by id: trees in one pass, others in a projection each."""
    if isinstance(models[0], boosting.Model):
        x = boosting.predict(df, models)
    else:
        x = _vectors(df.withColumn("y", F.lit(0)), columns, 1.0)
        for i, m in enumerate(models):
            x = probability(m, x).withColumnRenamed("p", f"p{i}")
    return x.select("id", (sum(F.col(f"p{i}") for i in range(len(models))) / len(models)).alias("p"))


#: Search spaces: the twelve dimensions of leaf-wise trees, the thirteen of depth-wise ones, and those of the logistic model.
SPACES: dict[str, search.Space] = {
    "trees_leafwise": {
        "rate": Dim("log", 0.005, 0.1), "trees": Dim("int", 500, 3000, step=100), "leaves": Dim("log_int", 16, 256), "depth": Dim("int", 2, 13), "min_rows": Dim("log_int", 10, 200), "min_weight": Dim("log", 1e-4, 1e-1),
        "subsample": Dim("float", 0.5, 1.0), "sample_every": Dim("int", 1, 5), "colsample": Dim("float", 0.5, 1.0), "l1": Dim("log", 1e-3, 10.0), "l2": Dim("log", 1e-3, 10.0), "bins": Dim("choice", choices=(127, 255, 511)),
    },
    "trees_depthwise": {
        "grow": Dim("choice", choices=("depth", "leaf")), "rate": Dim("log", 0.005, 0.1), "trees": Dim("int", 500, 3000, step=100), "depth": Dim("int", 3, 10), "min_weight": Dim("log", 5.0, 100.0), "min_gain": Dim("float", 0.0, 5.0),
        "leaves": Dim("log_int", 16, 256, when=("grow", "leaf")), "subsample": Dim("float", 0.5, 1.0), "colsample": Dim("float", 0.5, 1.0), "colsample_level": Dim("float", 0.5, 1.0), "l1": Dim("log", 1e-3, 10.0), "l2": Dim("log", 1e-3, 10.0),
        "bins": Dim("choice", choices=(128, 256, 512)),
    },
    "logistic": {"regParam": Dim("log", 1e-4, 1.0), "elasticNetParam": Dim("float", 0.0, 1.0)},
}


def behind(steps: list[float], earlier: list[list[float]], startup: int = 5, warm: int = 2) -> bool:
    """The median rule: whether a trial's best fold so far is worse than the median of earlier trials at this fold.

    It needs ``startup`` trials that came to their end, and the first ``warm`` folds are never judged.
    """
    k = len(steps) - 1
    peers = [s[k] for s in earlier if len(s) > k]
    return k >= warm and len(peers) >= startup and min(steps) > float(np.median(peers))


def trial(data: DataFrame, columns: list[str], e: Experiment, number: int, before: list[dict], startup: int = 5, warm: int = 2, space: search.Space | None = None) -> dict:
    """One trial: the experiment's own settings as trial 0, else a proposal from the trials before; its score is the
    calibrated pooled composite. A trial that falls ``behind`` is given up after its fold: it has its ``steps`` (composite
    by fold) and no score.
    """
    params = {} if number == 0 else search.propose(space or SPACES[e.kind], [{**t, "params": json.loads(t["params"])} for t in before if t["trial"]], number, e.seed)
    peers = [t["steps"] for t in before if t["score"] is not None and t.get("steps")]
    result = cross_validate(data, columns, replace(e, params=e.params | params), lambda steps: behind(steps, peers, startup, warm))
    try:
        score = None
        if not result.pruned:
            calibrated, _ = cross_platt(result.oof)
            score = evaluate(calibrated.drop("p").withColumnRenamed("calibrated", "p")).first().composite
    finally:
        result.release()
    return {"trial": number, "score": score, "params": json.dumps(params, sort_keys=True), "steps": result.steps}


def tune(data: DataFrame, columns: list[str], e: Experiment, trials: int = 10, earlier: list[dict] | None = None, startup: int = 5, warm: int = 2, space: search.Space | None = None) -> list[dict]:
    """A Parzen search of so many trials, the experiment's own settings first; ``earlier`` trials are resumed."""
    out = list(earlier or [])
    for k in range(len(out), trials):
        out.append(trial(data, columns, e, k, out, startup, warm, space))
    return out


def tune_shared(data: DataFrame, columns: list[str], e: Experiment, study, trials: int, **options) -> list[dict]:
    """Works on a ``runs.Study`` that other drivers may work on too, until each of ``trials`` has a result or a holder."""
    while (k := study.claim(trials)) is not None:
        found = trial(data, columns, e, k, [t for t in stored_trials(study) if t["trial"] < k], **options)
        study.finish(k, found["score"], {"settings": found["params"]}, found["steps"])
    return stored_trials(study)


def stored_trials(study) -> list[dict]:
    """A study's results as ``tune`` gives them."""
    return [{"trial": t["trial"], "score": t["score"], "params": t["params"]["settings"], "steps": t["steps"]} for t in study.results()]


def append_trials(trials: DataFrame, path: str) -> None:
    trials.write.mode("append").parquet(path)


def next_trial(spark, path: str) -> int:
    """The number at which a stored search goes on: 0 where nothing is stored; what can't be read is an error."""
    if not exists(spark, path):
        return 0
    last = spark.read.parquet(path).agg(F.max("trial").alias("m")).first().m
    return 0 if last is None else last + 1


def tuned(e: Experiment, trials: list[dict]) -> Experiment:
    """The experiment with the parameters of its best trial; its own stay where the trial has none. Pruned trials don't count."""
    best = min((t for t in trials if t["score"] is not None), key=lambda t: (t["score"], t["trial"]))
    return replace(e, params=e.params | json.loads(best["params"]))


#: Correlations from which two models count as alike, and as too alike.
ALIKE, TOO_ALIKE = 0.95, 0.97


def diversity(scored: DataFrame, models: list[str], digits: int = 6) -> DataFrame:
    """``a, b, r, verdict`` of each pair of models' scores."""
    r = F.col("r")
    return correlations(scored, models, digits).withColumn("verdict", F.when(r > TOO_ALIKE, "too alike").when(r > ALIKE, "alike").otherwise("diverse"))


def rank_trials(trials: DataFrame, digits: int = 4) -> DataFrame:
    """Trials by score with their gain over trial 0 in percent: null without that trial, or where its score is 0."""
    base = trials.where("trial = 0").agg(F.min("score").alias("base"))
    return trials.crossJoin(base).select("trial", "score", F.round(F.try_divide(F.col("base") - F.col("score"), "base") * 100, digits).alias("gain")).orderBy(F.col("score").asc_nulls_last(), "trial")  # base: one row
