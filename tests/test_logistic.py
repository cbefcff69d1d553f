"""Logistic models that are trained together, against the conditions of their minimum and pyspark.ml."""

import numpy as np
import pytest
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.sql import functions as F

from tideline.operators import learning, logistic, models


@pytest.fixture(scope="module")
def rows(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(600, 3)) * [1.0, 4.0, 0.2]
    y = (rng.random(600) < 1 / (1 + np.exp(-(x @ [1.0, -0.3, 0.5] - 0.5)))).astype(int)
    return spark.createDataFrame([(k, int(y[k]), k % 3, *map(float, x[k])) for k in range(600)], "id long, y int, fold int, a double, b double, c double").persist()


def test_against_pyspark(spark, rows):
    wanted = [logistic.Model(0, 0.02, 0.03), logistic.Model(None, 0.0, 0.1), logistic.Model(2)]
    found = logistic.fit(rows, ["a", "b", "c"], wanted, 2.0)
    v = VectorAssembler(inputCols=["a", "b", "c"], outputCol="features").transform(rows.withColumn("w", F.when(F.col("y") == 1, 2.0).otherwise(1.0)))
    for m, settings in zip(found, ({"regParam": 0.05, "elasticNetParam": 0.4}, {"regParam": 0.1, "elasticNetParam": 0.0}, {}), strict=True):
        own = v if m.left_out is None else v.where(F.col("fold") != m.left_out)
        want = LogisticRegression(labelCol="y", weightCol="w", standardization=False, maxIter=1000, tol=1e-12, **settings).fit(own)
        assert m.done
        assert m.coefficients == pytest.approx(want.coefficients.toArray().tolist(), abs=2e-5)
        assert m.intercept == pytest.approx(want.intercept, abs=2e-5)


def test_passes_are_few(spark, rows, monkeypatch):
    """All folds and strengths are trained in the same passes, however high the limit of iterations."""
    passes = []
    monkeypatch.setattr(logistic, "_pass", lambda *a, own=logistic._pass: passes.append(1) or own(*a))
    learning.stacked_columns(rows, ["a", "b"], [0.1, 0.05, 0.01])
    assert 0 < len(passes) < 15
    passes.clear()
    learning.cross_platt(rows.withColumn("p", learning.sigmoid(F.col("a"))))
    assert 0 < len(passes) < 15
    passes.clear()
    models.cross_validate(rows.drop("fold"), ["a", "b", "c"], models.Experiment("m", "logistic", {"maxIter": 2000}, scaled=True))
    assert 0 < len(passes) < 25


def test_missing_values_and_one_class(spark, rows):
    with pytest.raises(Exception, match="missing value"):
        logistic.fit(rows.withColumn("a", F.when(F.col("id") > 5, F.col("a"))), ["a"], [logistic.Model()])
    m = logistic.fit(rows.where("y = 0"), ["a"], [logistic.Model(l2=0.1)])[0]
    assert m.intercept < -10 and abs(m.coefficients[0]) < 1e-3
