"""Registered queries over this library's own trees: scores by fold, attributions and what is built on them, the scoring path.

Trees can't be expressed in SQL; ``tests/test_boosting.py`` and ``tests/test_attributions.py`` hold them against plain
versions, ``tests/test_scoring_trees.py`` these queries.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.operators import attributions, contract, features, importance, isotonic, learning, models, scoring
from tideline.operators.models import Experiment
from tideline.plans.panel import customers, table
from tideline.plans.settled import kept, shared_dir
from tideline.queries import _SCORED, _training, query, scored
from tideline.queries_more import _frame as frame_rows

#: What every kind of tree is trained with here.
_LEAF = Experiment("leafwise", "trees_leafwise", {"trees": 8, "rate": 0.3, "leaves": 15, "min_rows": 10}, balanced=True, patience=3)
_DEPTH = Experiment("depthwise", "trees_depthwise", {"trees": 8, "rate": 0.3, "depth": 4}, balanced=True, patience=3)
_EVEN = Experiment("symmetric", "trees_symmetric", {"trees": 8, "rate": 0.3, "depth": 4}, balanced=True, patience=3, categories=("segment", "earning_pattern"))
_LINE = Experiment("logistic", "logistic", {"maxIter": 200}, scaled=True, balanced=True)
KINDS = (_LEAF, _DEPTH, _EVEN)


def training(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, list[str]]:
    """``id, y``, the cleaned cash flow and balance features and two categories of every customer, and the features' names."""
    data, columns = _training(spark, sf_dir)
    return kept(data.join(customers(spark, sf_dir).select("id", "segment", "earning_pattern"), "id")), columns


_PAVA = f"""with {_SCORED}, d as (select floor(p * 256) / 256 as p, count(*) as n, sum(y) as s from e group by 1),
  c as (select p, n, row_number() over (order by p) as i, sum(n) over (order by p) as n_to, sum(s) over (order by p) as s_to from d),
  pairs as (select a.i as a, b.i as b, (b.s_to - coalesce(z.s_to, 0)) / (b.n_to - coalesce(z.n_to, 0))::double as mean from c a join c b on b.i >= a.i left join c z on z.i = a.i - 1),
  least_mean as (select a, b, min(mean) over (partition by a order by b rows between current row and unbounded following) as m from pairs),
  fitted as (select b as i, max(m) as rate from least_mean group by b)
  select min(p) as lo, max(p) as hi, sum(n)::bigint as n, round(rate, 6) as rate from c join fitted using (i) group by rate"""


@query(_PAVA)
def isotonic_pools(spark, sf_dir):
    """Pools of the isotonic fit of the events' scores, in steps of 1/256; the SQL has its min-max form."""
    rows = scored(spark, sf_dir).select("y", (F.floor(F.col("p") * 256) / 256).alias("p"))
    return isotonic.fit(rows).select("lo", "hi", "n", F.round("rate", 6).alias("rate"))


@query()
def boosted_by_fold(spark, sf_dir):
    """``kind, fold`` and metrics of out-of-fold scores, for leaf-wise, depth-wise and symmetric trees."""
    data, columns = training(spark, sf_dir)
    out = None
    for e in KINDS:
        rows = models.cross_validate(data, columns, e).by_fold.select(F.lit(e.name).alias("kind"), "*")
        out = rows if out is None else out.unionByName(rows)
    return out


@query()
def boosted_importances(spark, sf_dir):
    """``feature, mean_importance`` over the folds of leaf-wise trees."""
    data, columns = training(spark, sf_dir)
    found = models.cross_validate(data, columns, _LEAF)
    return importance.mean_importance(spark.createDataFrame(found.importance, "feature string, importance double, fold int"))


def _attributed(spark, sf_dir) -> tuple[models.Result, DataFrame, list[str]]:
    data, columns = training(spark, sf_dir)
    found = models.cross_validate(data, columns, _LEAF)
    return found, attributions.attributions(data, found.models), columns


@query()
def tree_attributions(spark, sf_dir):
    """Every customer's margin and what each feature adds to it, over the base value."""
    return _attributed(spark, sf_dir)[1]


@query()
def attributed_subsets(spark, sf_dir):
    """``k, rank, feature, theme, mean_importance``: subsets of the 5, 10 and 20 features of the largest mean absolute attribution."""
    _, rows, columns = _attributed(spark, sf_dir)
    return importance.subsets(importance.mean_absolute(rows, columns), (5, 10, 20))


@query()
def augmented_stacking(spark, sf_dir):
    """Out-of-fold stacking of three kinds of trees, with and without the attributions of the five strongest features."""
    data, columns = training(spark, sf_dir)
    by = {e.name: models.cross_validate(data, columns, e) for e in KINDS}
    rows = attributions.attributions(data, by["leafwise"].models)
    top = [r.feature for r in importance.top_features(importance.mean_absolute(rows, columns), 5).collect()]
    scored = by["leafwise"].oof.select("id", "fold", "y", F.col("p").alias("leafwise"))
    for name in ("depthwise", "symmetric"):
        scored = scored.join(by[name].oof.select("id", F.col("p").alias(name)), "id")
    extra = [f"x{k}" for k in range(len(top))]
    scored = scored.join(rows.select("id", *(F.col(c).alias(x) for c, x in zip(top, extra, strict=True))), "id").persist()
    return scoring.augmented(scored, [e.name for e in KINDS], extra)


def ensemble(spark: SparkSession, sf_dir: str) -> tuple[scoring.Ensemble, DataFrame]:
    """Leaf-wise and depth-wise trees and logistic models of five folds, calibrated on their out-of-fold scores, and the training rows."""
    data, columns = training(spark, sf_dir)
    folds, calibrators = {}, {}
    for e in (_LEAF, _DEPTH, _LINE):
        found = models.cross_validate(data, columns, e)
        folds[e.name] = found.models if e is not _LINE else [scoring.Linear.of(m, columns) for m in found.models]
        calibrators[e.name] = learning.fit_platt(found.oof)
        found.release()
    return scoring.Ensemble(columns, folds, calibrators, {"leafwise": 0.4, "depthwise": 0.4, "logistic": 0.2}), data


@query()
def scoring_trees(spark, sf_dir):
    """The whole scoring path: models are trained and published, the ensemble is read back from its manifest, every customer
    gets each model's calibrated score, the blend and its tier."""
    found, data = ensemble(spark, sf_dir)
    root = f"{shared_dir(spark)}/published/{uuid.uuid4().hex}"
    scoring.publish(spark, root, "baseline", "ensemble", "run_1", found)
    return scoring.score(data, scoring.load(spark, root, "ensemble", ("stage_2", "baseline")))


# ---------------------------------------------------------------- the scoring path over the whole frame

_WHOLE = (
    Experiment("leafwise", "trees_leafwise", {"trees": 6, "rate": 0.3, "leaves": 15, "min_rows": 10}, balanced=True),
    Experiment("depthwise", "trees_depthwise", {"trees": 6, "rate": 0.3, "depth": 4}, balanced=True),
    Experiment("symmetric", "trees_symmetric", {"trees": 6, "rate": 0.3, "depth": 4}, balanced=True),
    Experiment("logistic", "logistic", {"maxIter": 30}, scaled=True, balanced=True),
    Experiment("ridge", "logistic", {"maxIter": 30, "elasticNetParam": 0.0, "regParam": 0.1}, scaled=True),
)


def train_frame(spark: SparkSession, sf_dir: str, root: str) -> None:
    """Fits the whole feature frame and its contract, trains five kinds of models by five folds, calibrates and publishes."""
    rows = frame_rows(spark, sf_dir)
    spec = rows.fit()
    frame = kept(_numbers(rows.build(spec)))
    pre = contract.Preprocessing.fit(frame, [c for c in frame.columns if c != "id"], scaled=True)
    y = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_acctbal < 1000 as int) as y")
    data = kept(pre.transform(frame).join(y, "id"))
    folds, calibrators = {}, {}
    for e in _WHOLE:
        found = models.cross_validate(data, pre.columns, e)
        folds[e.name] = found.models if e.kind in models.TREES else [scoring.Linear.of(m, pre.columns) for m in found.models]
        calibrators[e.name] = learning.fit_platt(found.oof)
        found.release()
    whole = scoring.Ensemble(pre.columns, folds, calibrators, {"leafwise": 0.3, "depthwise": 0.25, "symmetric": 0.25, "logistic": 0.1, "ridge": 0.1})
    scoring.publish(spark, root, "baseline", "frame", "run_1", whole, {"frame": spec.dumps(), "contract": pre.dumps()})


def _numbers(frame: DataFrame) -> DataFrame:
    return frame.select(F.col("ID").cast("long").alias("id"), *(c for c, kind in frame.dtypes if c != "ID" and kind != "string"))


def score_frame(spark: SparkSession, sf_dir: str, root: str) -> DataFrame:
    """Every customer's scores by what is published at ``root``: frame, contract, 25 fold models, calibration, blend, checks."""
    whole, texts = scoring.load_with(spark, root, "frame", ("stage_2", "baseline"))
    spec, pre = features.FrameSpec.loads(texts["frame"]), contract.Preprocessing.loads(texts["contract"])
    frame = kept(_numbers(frame_rows(spark, sf_dir).build(spec)))  # planned once, read by one pass of all models
    scored = kept(scoring.score(pre.transform(frame), whole))
    scoring.checked_submission(scored, frame.count())
    return scored
