"""Ranks, percentiles and AUC on columns that are narrow, skewed, infinite, odd or empty, against NumPy."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import encoding, importance, metrics, models, profiling, ranks, serving
from tideline.plans import panel

SHARES = (0.0, 0.001, 0.25, 0.5, 0.99, 1.0)


def columns():
    rng = np.random.default_rng(4)
    return {
        "narrow": 1000 + 2 * rng.random(20_000),
        "skewed": np.exp(12 * rng.normal(size=5_000)),
        "ends": np.concatenate([rng.normal(size=50), [-math.inf, math.inf, math.inf]]),
        "tied": np.repeat([0.0, 1.0, 7.0], [4000, 10, 1]),
        "two": np.array([3.0, 1.0]),
        "one": np.array([5.0]),
        "same": np.full(30, -2.5),
        "no_numbers": np.array([math.nan, math.nan]),
    }


@pytest.fixture(scope="module")
def long(spark):
    rows = [(k, float(x)) for k, v in columns().items() for x in v] + [("two", None), ("ends", math.nan)]
    return spark.createDataFrame(rows, "feature string, value double")


def test_percentiles(spark, long):
    found = {r.feature: list(r.q) for r in ranks.exact_percentiles(long, SHARES).collect()}
    assert found.keys() == columns().keys() - {"no_numbers"}
    for k, got in found.items():
        with np.errstate(invalid="ignore"):
            want = np.sort(columns()[k])
        for s, g in zip(SHARES, got, strict=True):
            at = s * (len(want) - 1)
            lo, hi = want[math.floor(at)], want[math.ceil(at)]
            assert g == pytest.approx(lo if lo == hi or at == math.floor(at) or lo == -math.inf else lo + (at - math.floor(at)) * (hi - lo), rel=1e-12), (k, s)


def test_no_range_holds_much(spark, long):
    values = long.where(ranks.present("value")).select("feature", "value").distinct()
    by = values.transform(lambda v: ranks.ranged(v, ["feature"], "value"))
    most = {r.feature: r.m for r in by.groupBy("feature", "range").count().groupBy("feature").agg(F.max("count").alias("m")).collect()}
    for k in ("narrow", "skewed"):
        n = len(set(columns()[k].tolist()))
        assert most[k] <= max(2, math.ceil(n * (1 / ranks.RANGES + 2 / ranks.SKETCH)) + 1)
    order = by.groupBy("feature", "range").agg(F.min("value").alias("a"), F.max("value").alias("b")).orderBy("feature", "range").collect()
    assert all(x.b < y.a for x, y in zip(order, order[1:], strict=False) if x.feature == y.feature)


@pytest.mark.parametrize("scores", ["narrow", "tied", "ends"])
def test_auc(spark, scores):
    rng = np.random.default_rng(1)
    p = rng.permutation(columns()[scores])[:1500]
    y = rng.integers(0, 2, len(p))
    won = sum((p[i] > p[y == 0]).sum() + (p[i] == p[y == 0]).sum() / 2 for i in np.nonzero(y == 1)[0])
    rows = [(int(a), float(b)) for a, b in zip(y, p, strict=True)]
    odd = [(1, None), (0, math.nan), (1, math.nan), (None, 0.5)]
    found = metrics.auc(spark.createDataFrame(rows + odd, "y int, p double")).first().auc
    assert found == pytest.approx(won / (y == 1).sum() / (y == 0).sum(), rel=1e-12)


def test_rows_without_a_score_are_left_out(spark):
    rows = [(1, 0.9), (0, 0.2), (1, 0.4), (0, 0.6)]
    a, b = (metrics.evaluate(spark.createDataFrame(r, "y int, p double")).first() for r in (rows, [*rows, (1, math.nan), (0, None), (None, 0.1)]))
    assert a == b
    assert metrics.evaluate(spark.createDataFrame([], "y int, p double")).first().n == 0


def test_profiles_of_odd_columns(spark):
    df = spark.createDataFrame([(1.0, math.inf, None), (2.0, 3.0, None)], "two double, inf double, none double")
    by = {r.feature: r for r in profiling.summary(df, df.columns).collect()}
    assert by["two"].skew is None
    assert by["two"].mean == 1.5
    d = {r.feature: r for r in profiling.describe(df, df.columns).collect()}
    assert (d["two"].p50, d["inf"].max, d["none"].n, d["none"].p50) == (1.5, math.inf, 0, None)
    assert profiling.describe(df.limit(0), df.columns).where("n > 0").count() == 0


def test_report_without_scores(spark):
    r = serving.score_report(spark.createDataFrame([(None,)], "p double")).collect()
    assert [(x.n, x.mean, x.p50) for x in r] == [(1, None, None)]


def test_gains_and_shares_without_a_base(spark):
    trials = lambda rows: [(r.trial, r.gain) for r in models.rank_trials(spark.createDataFrame(rows, "trial int, score double")).collect()]
    assert trials([(0, 0.0), (1, 1.0)]) == [(0, None), (1, None)]
    assert trials([(2, 0.5), (1, 1.0)]) == [(2, None), (1, None)]
    assert trials([(0, 2.0), (1, 1.0)]) == [(1, 50.0), (0, 0.0)]
    shares = importance.theme_summary(spark.createDataFrame([("withdraw_x", 0.0)], "feature string, mean_importance double")).collect()
    assert [(r.theme, r.share) for r in shares] == [("Spending Stress", None)]


def test_zero_rates_without_customers(spark, tmp_path):
    source = "/root/testdata/sf0.001"
    for name in ("customer", "orders", "lineitem", "events"):
        df = spark.read.parquet(f"{source}/{name}.parquet")
        (df.limit(0) if name == "customer" else df).write.parquet(f"{tmp_path}/{name}.parquet")
    rows = panel.zero_rates(spark, str(tmp_path)).collect()
    assert len(rows) == 168
    assert all(r.zero_rate is None for r in rows)


@pytest.mark.parametrize("n", [0, 1, 20, 5000])
def test_codes_of_alike_values(spark, n):
    values = [f"same beginning {i * 7919 % 10007:05d}" for i in range(n)]
    df = spark.createDataFrame([(v,) for v in [*values, *values[:5], *([None] if n else [])]], "v string")
    got = {r.value: r.code for r in encoding.code_table(df, "v").collect()}
    assert got == {v: i for i, v in enumerate(sorted({*values, *(["nan"] if n else [])}))}


def test_percentiles_of_columns_by_brackets(spark, monkeypatch):
    """Values far beyond a sketch's state and ties: the same as by ranking every value, also where brackets miss."""
    rng = np.random.default_rng(7)
    x = {"a": rng.normal(size=30_000), "b": np.round(rng.exponential(size=30_000), 1), "c": np.concatenate([rng.random(29_000), np.full(1000, np.nan)])}
    df = spark.createDataFrame([tuple(map(float, r)) for r in zip(*x.values(), strict=True)], "a double, b double, c double").withColumn("d", F.lit(None).cast("double")).persist()
    shares = (0.0, 0.001, 0.5, 0.99, 1.0)
    want = {k: np.quantile(v[~np.isnan(v)], shares) for k, v in x.items()}
    found = ranks.brackets(df, [*x, "d"], shares)
    assert found.keys() == x.keys() and all(math.isfinite(e) for _, own in found.values() for side in own for e in side)
    near = sum((v >= found["a"][1][2][0]) & (v <= found["a"][1][2][1]) for v in x["a"])
    assert 0 < near < 0.02 * len(x["a"])  # a bracket holds few of the values
    for given in (found, found | {"a": (30_000, [(5.0, 6.0)] * len(shares)), "b": (30_000, [(0.0, 0.0)] * len(shares))}):
        got = {r.feature: list(r.q) for r in ranks.column_percentiles(df, [*x, "d"], shares, given).collect()}
        assert got.keys() == want.keys()
        for k, q in want.items():
            assert got[k] == pytest.approx(q.tolist(), rel=1e-12, abs=1e-12), k


def test_values_meet_splitters_without_a_shuffle_by_group(spark):
    """The join with a group's splitters doesn't send all values of the group to one task."""
    values = spark.range(1000).selectExpr("'x' as feature", "cast(id as double) as value")
    plan = ranks.ranged(values, ["feature"], "value")._jdf.queryExecution().optimizedPlan().toString()
    assert "strategy=broadcast" in plan
