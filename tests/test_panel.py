"""Golden vectors, fixed names, the fitted contract and its edge cases."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import contract, domain, encoding, importance, isotonic, learning, metrics, models, profiling, serving
from tideline.operators import series as series_ops
from tideline.plans import panel, schema
from tideline.sources import tables
from tideline.streaming.panel import cells

SF = "/root/testdata/sf0.001"
#: mean, std, slope, momentum, acceleration, cv, volatility ratio, consistency, active, switches, streak, recency, peak.
GOLDEN = {
    (6, 5, 4, 3, 2, 1): (3.5, 1.707825, 1.0, 1.0, 0.0, 0.487950, 0.999999, 2.049389, 6, 0, 0, 2.499999, 1.714285),
    (0, 0, 3, 0, 1, 0): (0.666667, 1.105542, 0.0, 0.0, 3.0, 1.658310, 2.999994, 0.603022, 2, 4, 2, 2.999991, 4.499993),
    (0, 0, 0, 0, 0, 0): (0, 0, 0, 0, 0, 0, 0, 0, 0, 0, 6, 0, 0),
    (100, 0, 0, 0, 0, 0): (16.666667, 37.267800, 14.285713, 100, 100, 2.236068, 47140452.079103, 0.447214, 1, 1, 0, 33333333.333333, 6.0),
    (5, 5, 5, 5, 5, 5): (5, 0, 0, 0, 0, 0, 0, 5000000, 6, 0, 0, 1.0, 1.0),
}


def test_golden_vectors(spark):
    df = spark.createDataFrame([(i, "g", [float(x) for x in d]) for i, d in enumerate(GOLDEN)], "id long, grp string, val array<double>")
    out = df.select("id", "grp")
    for name in series_ops.BLOCKS:
        out = out.join(series_ops.block(df, name), ["id", "grp"])
    names = ("mean", "std", "trend_slope", "momentum", "acceleration", "cv", "volatility_ratio", "consistency", "active_months", "activity_switch", "zero_streak", "recency_ratio", "peak_to_mean")
    for r in out.collect():
        assert np.allclose([r[n] for n in names], [*GOLDEN.values()][r.id], rtol=1e-6, atol=1e-6)


def test_names():
    """Emitted and distinct feature names, and the one name that two layers write."""
    assert len(schema.wide().fields) == 183 and len(schema.wide(True).fields) == 184 and len(schema.transactions()) == 168
    raw, log = series_ops.raw_names(), series_ops.log_names()
    assert set(raw) & set(log) == {f"{s}_recency_ratio_log" for s, _, _ in schema.series_names()}
    static = [c for b in domain.BLOCKS.values() for c in b(domain.SPARK)]
    assert len(raw) + len(log) + len(static) + 4 == 640 and len({*raw, *log, *static}) + 4 == 619
    contract.no_leak([*raw, *log, *static], schema.TARGET)
    with pytest.raises(AssertionError):
        contract.no_leak([f"x_{schema.TARGET}"], schema.TARGET)


def test_two_pass_bounds(spark):
    """The second bound is taken on values that the first has clipped."""
    df = spark.createDataFrame([(i, float(x)) for i, x in enumerate([*range(98), 200, 1000])], "id long, a_ratio double")
    spec = contract.FeatureSpec.fit(df, ["a_ratio"], ("a_ratio",))
    assert spec.ratios == {"a_ratio": pytest.approx(208.0)} and spec.winsor == {"a_ratio": pytest.approx(200.08)}
    assert df.agg(F.max("a_ratio")).first()[0] == 1000 and spec.transform(df).agg(F.max("a_ratio")).first()[0] == pytest.approx(200.08)


def test_contract(spark, tmp_path):
    rows = [(i, float(i), float(i % 3), 7.0, None if i % 2 else float("inf")) for i in range(1000)]
    df = spark.createDataFrame(rows, "id long, many double, few double, same double, odd double")
    spec = contract.Preprocessing.fit(df, ["many", "few", "same", "odd"], scaled=True)
    assert spec.columns == ["many", "few"] and [*spec.clip] == ["many"]
    whole = {r.id: (r.many, r.few) for r in spec.transform(df).collect()}
    one = spec.transform(df.where("id = 500")).first()
    assert (one.many, one.few) == whole[500]
    low, high = spec.clip["many"]
    mean, std = spec.scale["many"]
    assert min(v[0] for v in whole.values()) == pytest.approx((low - mean) / std) and max(v[0] for v in whole.values()) == pytest.approx((high - mean) / std)
    assert spec.transform(df.select("id", "few", F.lit(1).alias("extra"))).columns == ["id", "many", "few"]
    spec.save(spark, str(tmp_path / "spec"))
    assert contract.Preprocessing.load(spark, str(tmp_path / "spec")) == spec
    for bad in (lambda: contract.Preprocessing().transform(df), lambda: contract.Preprocessing.fit(df.limit(0), ["many"]), lambda: contract.align(df, ["none"], strict=True)):
        with pytest.raises(ValueError):
            bad()


def test_encodings(spark):
    df = spark.createDataFrame([(0, None, None, " m ", None), (1, "hvc", " YES ", "MALE", "b"), (2, " HVC ", "1", "F", "a"), (3, "xyz", "no", None, "new")], "id long, segment string, smartphone string, gender string, earning_pattern string")
    codes = encoding.fit_codes(df.where("id < 3"), "earning_pattern")
    out = df.select("id", encoding.segment(), encoding.smartphone(), encoding.is_male(), encoding.apply_codes("earning_pattern", codes)).orderBy("id").collect()
    assert [tuple(r)[1:] for r in out] == [(1, 0, 1, 2), (2, 1, 0, 1), (1, 1, 0, 0), (1, 0, 0, 0)]


def test_metrics(spark):
    df = spark.createDataFrame([(i, y, p) for i, (y, p) in enumerate(zip([0, 0, 1, 1, 0], [0.1, 0.4, 0.35, 0.8, 0.4], strict=True))], "id long, y int, p double")
    r = metrics.evaluate(df, digits=8).first()
    assert (r.logloss, r.auc, r.brier, r.composite) == pytest.approx((0.47999549, 0.66666667, 0.1585, 0.42133063), abs=1e-7)
    assert metrics.evaluate(df.where("y = 0")).first().auc is None
    ps = [r.x for r in spark.createDataFrame([(0.1,), (0.3874,), (0.9,)], "p double").select(learning.apply_platt("p", 5.4697, -4.4251).alias("x")).collect()]
    assert ps == pytest.approx([0.02027010, 0.09061587, 0.62190221], abs=1e-7)
    with pytest.raises(ValueError):
        learning.apply_platt("p", 0.0, None)
    tiers = spark.createDataFrame([(0.249999,), (0.25,), (0.599999,), (0.60,)], "p double").select(serving.risk_tier().alias("t")).collect()
    assert [r.t for r in tiers] == ["low", "medium", "medium", "high"]


def test_learning(spark):
    rng = np.random.default_rng(0)
    z = rng.normal(size=600)
    y = (rng.random(600) < 1 / (1 + np.exp(-(3 * z - 1)))).astype(int)
    p = 1 / (1 + np.exp(-z))
    df = spark.createDataFrame([(i, int(a), float(b), float(b), float(c)) for i, (a, b, c) in enumerate(zip(y, p, rng.random(600), strict=True))], "id long, y int, p double, a double, b double")
    dealt = learning.folds(df)
    sizes = {(r.y, r.fold): r["count"] for r in dealt.groupBy("y", "fold").count().collect()}
    assert len(sizes) == 10 and all(abs(sizes[c, k] - sizes[c, 0]) <= 1 for c in (0, 1) for k in range(5))
    out, (slope, intercept) = learning.cross_platt(dealt)
    before, after = metrics.evaluate(df).first(), metrics.evaluate(out.drop("p").withColumnRenamed("calibrated", "p")).first()
    assert slope > 0 and after.logloss < before.logloss
    whole = df.withColumn("p", learning.apply_platt("p", slope, intercept))
    assert metrics.evaluate(whole).first().auc == before.auc
    mean = whole.agg(F.avg("p"), F.avg("y")).first()
    assert mean[0] == pytest.approx(mean[1], abs=1e-6)
    weights = learning.optimise_weights(df, ["a", "b"])
    assert sum(weights.values()) == pytest.approx(1) and weights["a"] > 0.9
    monotone = isotonic.apply(df, isotonic.fit(df)).select("p", "calibrated").orderBy("p").collect()
    assert len(monotone) == 600 and all(a.calibrated <= b.calibrated for a, b in zip(monotone, monotone[1:], strict=False))
    with pytest.raises(ValueError):
        learning.blend({"a": 1.0, "gone": 1.0}, ["a", "b"])
    best = learning.pick(spark.createDataFrame([(0, "x", 0.2), (1, "y", 0.1), (2, "z", 0.1)], "seq int, name string, score double")).first()
    assert best.name == "y"


def test_models(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(size=(300, 2))
    rows = [(i, int(a + 0.3 * b > 0), float(a), float(b)) for i, (a, b) in enumerate(x.tolist())]
    data = spark.createDataFrame(rows, "id long, y int, f double, g double")
    fine = models.Experiment("fine", "logistic", {"regParam": 0.001, "maxIter": 20}, scaled=True, n_folds=2)
    bad = models.Experiment("bad", "logistic", scaled=False)
    found = models.run_experiments(data, ["f", "g"], [bad, fine])
    assert "scaled" in found["bad"] and found["fine"].oof.count() == 300
    assert metrics.evaluate(found["fine"].oof).first().auc > 0.95
    assert models.score_folds(found["fine"].models, data.drop("y"), ["f", "g"]).count() == 300
    by = importance.mean_importance(spark.createDataFrame(found["fine"].importance, "feature string, importance double, fold int")).collect()
    assert by[0].feature == "f"
    score = lambda df: models.probability(found["fine"].models[0], models._vectors(df, ["f", "g"], 1.0))
    lost = dict(importance.permutation_importance(data, ["f", "g"], score, lambda df: metrics.evaluate(df).first().auc))
    assert lost["f"] > lost["g"]
    trials = models.tune(data, ["f", "g"], fine, trials=2)
    assert [t["trial"] for t in models.tune(data, ["f", "g"], fine, trials=2, earlier=trials)] == [0, 1] and json.loads(trials[1]["params"])


def test_sources(spark, tmp_path):
    path = tmp_path / "in.csv"
    path.write_text("ID , age,segment,y\n1, 30 ,HVC,1\n2,none,nan,0\n3,abc, x ,\n")
    from pyspark.sql import types as T

    kinds = T.StructType([T.StructField("ID", T.StringType()), T.StructField("age", T.DoubleType()), T.StructField("segment", T.StringType()), T.StructField("y", T.IntegerType())])
    df = tables.read_csv(spark, str(path), kinds)
    assert [tuple(r) for r in df.orderBy("ID").collect()] == [("1", 30.0, "HVC", 1), ("2", None, None, 0), ("3", None, "x", None)]
    assert tables.validate(df, "ID", "y")["rows"] == 3
    for wrong in (df.unionAll(df), df.withColumn("y", F.lit(2)), df.limit(0)):
        with pytest.raises(ValueError):
            tables.validate(wrong, "ID", "y")
    tables.write_csv(df, str(tmp_path / "out"), dry_run=True)
    assert not (tmp_path / "out").exists()
    tables.write_csv(df, str(tmp_path / "out"))
    assert spark.read.option("header", True).csv(str(tmp_path / "out")).count() == 3
    tables.write_run(df, str(tmp_path / "runs"), "stage_1", "m", "run_1")
    assert spark.read.parquet(str(tmp_path / "runs")).where("stage = 'stage_1' and model = 'm'").count() == 3


def test_requests(spark):
    tables_of = lambda n: spark.range(n)
    serving.check_batch(tables_of(500))
    for n in (0, 501):
        with pytest.raises(ValueError):
            serving.check_batch(tables_of(n))
    weights = spark.createDataFrame([("a", 0.5), ("b", 0.5)], "model string, weight double")
    folds = spark.createDataFrame([(m, k) for m in "ab" for k in range(5 if m == "a" else 4)], "model string, fold int")
    assert tuple(serving.ensemble_integrity(weights, folds).first()) == (True, False)


def test_stream(spark, tmp_path):
    """The panel's cells over a stream equal those over the table, but for the last, still open windows."""
    events = spark.read.parquet(f"{SF}/events.parquet")
    events.repartition(1).sortWithinPartitions("ts").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = cells(stream).writeStream.outputMode("append").format("memory").queryName("cells").option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    got = {tuple(r) for r in spark.table("cells").collect()}
    want = {tuple(r) for r in cells(events).collect()}
    assert got and got <= want
    missing = {r[2] for r in want - got}
    assert len(missing) <= 2


def test_profiles_of_edge_cases(spark):
    df = spark.createDataFrame([(1, None), (2, None)], "id long, x double")
    assert profiling.missing_rates(df, ["x"]).first().missing_rate == 1.0
    assert panel.long_panel(spark, SF).where("m not between 1 and 6").count() == 0
