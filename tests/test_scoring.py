"""Feature frame against plain NumPy formulas, ranks, scoring, ensembles and artifacts."""

import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.ml.classification import LogisticRegressionModel
from pyspark.sql import functions as F

from tideline import queries
from tideline.operators import blends, contract, features, importance, learning, metrics, models, ranks, scoring
from tideline.operators import series as series_ops
from tideline.plans import panel
from tideline.plans.schema import ENTITIES, GROUPS, INFLOW, OUTFLOW
from tideline.sources import tables

SF = "/root/testdata/sf0.001"
EPS = 1e-6


def slope(d):
    x = np.arange(6)[::-1] - 2.5
    return ((d - d.mean()) * x).sum() / ((x**2).sum() + EPS)


def blocks(c):
    """The features of a customer across groups, from the definitions in SURVEY's Appendix A."""
    val, vol, ent = ({g: np.array(c[g][a], float) for g in GROUPS} for a in ("val", "vol", "ent"))
    b, arpu = np.array(c["bal"], float), c["arpu"]
    both = lambda groups, of: sum(of[g] for g in groups)
    r = lambda d: d[:3].mean() / (d[3:].mean() + EPS)
    i, o, n_i, n_o = both(INFLOW, val), both(OUTFLOW, val), both(INFLOW, vol), both(OUTFLOW, vol)
    net, n_net, w, d = i - o, n_i - n_o, val["withdraw"], val["deposit"]
    rec, snd, bank = val["received"], val["mm_send"], val["transfer_from_bank"]
    acc = lambda x: (x[0] - x[1]) - (x[1] - x[2])
    fall, cv = (b.max() - b[0]) / (b.max() + EPS), b.std() / (b.mean() + EPS)
    out = {
        "balance_trend": b[0] - b[5], "balance_slope": slope(b), "balance_volatility": b.std(), "balance_cv": cv, "balance_range": b.max() - b.min(), "balance_min": b.min(), "balance_max": b.max(), "balance_m1": b[0], "balance_recovery": b[0] - b[1:].min(), "balance_trend_3m": b[0] - b[2],
        "balance_drawdown": fall, "balance_drawdown_abs": b.max() - b[0], "balance_to_spend_pressure": b[0] / (w.sum() + EPS), "m1_withdraw_balance_ratio": w[0] / (b[0] + EPS), "balance_to_outflow_ratio": b[0] / (o.sum() + EPS),
        "total_inflow_6m": i.sum(), "total_outflow_6m": o.sum(), "net_cashflow_6m": net.sum(), "net_flow_ratio": net.sum() / (i.sum() + o.sum() + EPS), "spend_to_inflow": o.sum() / (i.sum() + EPS), "withdraw_deposit_ratio": w.sum() / (d.sum() + EPS), "m1_withdraw_deposit_ratio": w[0] / (d[0] + EPS),
        "net_cashflow_slope": slope(net), "inflow_slope": slope(i), "outflow_slope": slope(o), "inflow_outflow_slope_divergence": slope(i) - slope(o), "net_cashflow_m1": net[0], "cashflow_volatility": net.std(), "cashflow_volatility_cv": net.std() / (abs(net.mean()) + EPS),
        "net_txn_volume_slope": slope(n_net), "inflow_volume_slope": slope(n_i), "outflow_volume_slope": slope(n_o), "volume_slope_divergence": slope(n_i) - slope(n_o), "net_txn_volume_m1": n_net[0], "total_txn_volume_6m": n_i.sum() + n_o.sum(), "net_txn_volume_momentum": n_net[0] - n_net[1], "inflow_volume_recency_ratio": r(n_i), "outflow_volume_recency_ratio": r(n_o),
        "p2p_net_flow": rec.sum() - snd.sum(), "p2p_receive_send_ratio": rec.sum() / (snd.sum() + EPS), "p2p_m1_ratio": rec[0] / (snd[0] + EPS), "p2p_inflow_share": rec.sum() / (i.sum() + EPS),
        "bank_transfer_slope": slope(bank), "bank_transfer_trend": bank[0] - bank[5], "bank_transfer_m1": bank[0], "bank_has_bank_inflow": float(bank.sum() > 0), "deposit_intensity": d.sum() / (arpu + EPS), "bank_transfer_vs_arpu": bank.sum() / (6 * arpu + EPS),
        "balance_trend_x_balance_level": (b[0] - b[5]) * b[1], "deposit_recency_x_balance": r(d) * b[0], "withdraw_recency_x_spend_ratio": r(w) * o.sum() / (i.sum() + EPS), "balance_cv_x_drawdown": cv * fall, "cashflow_slope_x_balance": slope(net) * b[0],
        "deposit_value_x_volume_recency": r(d) * r(vol["deposit"]), "withdraw_value_x_volume_acceleration": acc(w) * acc(vol["withdraw"]),
    }
    for g in GROUPS:
        v, n, e, name = val[g], vol[g], ent[g], f"{g}_unique_{ENTITIES[g]}"
        past = v[3:].mean() / (n[3:].mean() + EPS)
        out |= {f"avg_txn_size_{g}": v.mean() / (n.mean() + EPS), f"avg_txn_size_{g}_trend": v[0] / (n[0] + EPS) - v[5] / (n[5] + EPS), f"avg_txn_size_{g}_recency_ratio": v[:3].mean() / (n[:3].mean() + EPS) / (past + EPS)}
        out |= {f"{name}_mean": e.mean(), f"{name}_trend": e[0] - e[5], f"{name}_m1": e[0], f"{name}_recency_ratio": r(e), f"{name}_slope": slope(e)}
    return out


def close(a, b):
    return math.isclose(a, b, rel_tol=1e-6, abs_tol=1e-4)


def test_feature_frame(spark, tmp_path):
    """Blocks by plain formulas; bounds by NumPy's percentiles; one customer alone has the row that it has in the frame."""
    parts = queries.QUERIES["features_full"] and (panel.series(spark, SF), panel.customers(spark, SF), panel.wide_panel(spark, SF))
    spec = features.fit_features(*parts)
    raw = {r.id: r.asDict() for r in features.raw_features(*parts, spec.codes, spec.flags).collect()}
    want = {c.id: blocks(c.asDict(recursive=True)) for c in parts[1].collect()}
    assert len(raw) == len(want)
    for i, w in want.items():
        assert not [c for c, v in w.items() if not close(float(raw[i][c]), v)]
    frame = {int(r.ID): r.asDict() for r in features.build_features(*parts, spec).collect()}
    for c in ("net_flow_ratio", "avg_txn_size_withdraw"):  # a ratio, and a feature of the second list alone
        top = np.percentile([w[c] for w in want.values()], 99)
        bound = np.percentile(np.minimum([w[c] for w in want.values()], top), 99) if "ratio" in c else top
        assert all(close(frame[i][c], min(w[c], bound)) for i, w in want.items())
    assert spec.flags and set(spec.clean.winsor) <= set(contract.WINSORISED) and len(spec.clean.columns) > 600
    spec.save(spark, f"{tmp_path}/spec")
    again = features.FrameSpec.load(spark, f"{tmp_path}/spec")
    alone = features.build_features(parts[0].where("id = 7"), parts[1].where("id = 7"), parts[2].where("ID = '7'"), again).collect()
    assert [r.asDict() for r in alone] == [frame[7]]
    x, y = features.split_target(parts[2].withColumn("liquidity_stress_next_30d", F.lit(1)))
    assert y.columns == ["ID", "liquidity_stress_next_30d"] and x.columns == parts[2].columns and features.split_target(x)[1] is None


def test_ranks(spark):
    rng = np.random.default_rng(1)
    given = {"a": rng.normal(0, 1e3, 700), "b": np.repeat([0.0, -1.0, 5.0], [500, 3, 4]), "c": np.array([2.5]), "d": rng.random(400) * 1e-9}
    rows = spark.createDataFrame([(k, float(v)) for k, x in given.items() for v in x] + [("a", None), ("a", float("nan")), ("e", None)], "feature string, value double").repartition(3)
    shares = (0.0, 0.001, 0.25, 0.5, 0.999, 1.0)
    found = {r.feature: r.q for r in ranks.exact_percentiles(rows, shares).collect()}
    assert found.keys() == given.keys()
    for k, x in given.items():
        assert np.allclose(found[k], np.percentile(x, [100 * s for s in shares]), rtol=1e-12, atol=0)


def test_auc(spark):
    rng = np.random.default_rng(2)
    p, y = np.round(rng.random(300), 2), rng.integers(0, 2, 300)
    won = np.mean([(a > b) + (a == b) / 2 for a in p[y == 1] for b in p[y == 0]])
    df = spark.createDataFrame([(int(a), float(b)) for a, b in zip(y, p, strict=True)], "y int, p double").repartition(3)
    assert metrics.auc(df).first().auc == pytest.approx(won)


def test_weights(spark):
    """The search finds weights as good as those of a fine grid."""
    rng = np.random.default_rng(3)
    y = rng.integers(0, 2, 400)
    near = lambda noise: np.clip(0.5 + 0.3 * (y - 0.5) + rng.normal(0, noise, 400), 0.01, 0.99)
    a, b, c = near(0.2), near(0.2), rng.random(400)
    df = spark.createDataFrame([(int(w), float(x), float(u), float(v)) for w, x, u, v in zip(y, a, b, c, strict=True)], "y int, a double, b double, c double").persist()
    found = learning.optimise_weights(df, ["a", "b", "c"])
    grid = [(i / 10, j / 10, 1 - (i + j) / 10) for i in range(11) for j in range(11 - i)]
    assert sum(found.values()) == pytest.approx(1) and min(found.values()) >= 0
    assert learning.composites(df, ["a", "b", "c"], [tuple(found.values())])[0] <= min(learning.composites(df, ["a", "b", "c"], grid)) + 1e-4
    assert found["c"] < 0.15


def test_models_and_artifacts(spark, tmp_path):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(240, 2))
    rows = [(i, int(a + b + rng.normal(0, 0.5) > 0), float(a), float(b)) for i, (a, b) in enumerate(x.tolist())]
    data = spark.createDataFrame(rows, "id long, y int, f1 double, f2 double")
    plain = models.Experiment("plain", "logistic", {"maxIter": 50}, scaled=True, balanced=True)
    result = models.cross_validate(data, ["f1", "f2"], plain)
    assert result.by_fold.agg(F.min("auc")).first()[0] > 0.7
    models.save_models(result.models, f"{tmp_path}/models")
    again = models.load_models(LogisticRegressionModel.load, f"{tmp_path}/models")
    assert len(again) == 5
    with pytest.raises(FileNotFoundError):
        models.load_models(LogisticRegressionModel.load, f"{tmp_path}/models", 6)
    # the column expression scores as the models do
    folds = [scoring.Linear.of(m, ["f1", "f2"]) for m in again]
    e = scoring.Ensemble(["f1", "f2"], {"m": folds}, {"m": (1.0, 0.0)}, {"m": 1.0})
    by_model = {r.id: r.p for r in models.score_folds(again, data, ["f1", "f2"]).collect()}
    for r in scoring.score(data, e).collect():
        assert r.m == pytest.approx(1 / (1 + math.exp(-by_model[r.id])))
    assert scoring.submission(scoring.score(data, e)).columns == ["ID", "Target", "TargetLogLoss", "TargetRAUC"]
    with pytest.raises(ValueError):
        scoring.score(data.drop("f2"), e)
    with pytest.raises(ValueError):
        scoring.score(data, scoring.Ensemble(["f1"], {"m": folds[:4]}, {"m": (1.0, 0.0)}, {"m": 1.0}))
    trees = models.Experiment("trees", "trees_symmetric", {"trees": 12, "depth": 3, "rate": 0.9}, n_folds=2, patience=2)
    stopped = models.cross_validate(data, ["f1", "f2"], trees)
    for m in stopped.models:  # two trees without a gain, or all twelve
        assert len(m.trees) == m.best and len(m.losses) in (m.best + 2, 12)
    assert any(len(m.losses) < 12 for m in stopped.models)
    models.save_models(stopped.models, f"{tmp_path}/trees")
    assert models.load_models(models.load_trees, f"{tmp_path}/trees", 2) == stopped.models
    p = {r.id: r.p for r in models.score_folds(stopped.models, data, ["f1", "f2"]).collect()}
    assert len(p) == 240 and {r[0] for r in stopped.importance} == {"f1", "f2"}
    stopped.release()
    tables.write_artifacts(spark, f"{tmp_path}/runs", "baseline", "m", "run_1", {"oof": result.oof}, {"n": 240})
    tables.write_artifacts(spark, f"{tmp_path}/runs", "baseline", "m", "run_2", {"oof": result.oof.limit(3)}, {"n": 3})
    assert tables.read_artifacts(spark, f"{tmp_path}/runs", "oof", ("stage_2", "baseline")).count() == 3
    trials = [{"trial": 0, "score": 0.4, "params": "{}"}, {"trial": 1, "score": 0.3, "params": '{"regParam": 0.2}'}]
    assert models.next_trial(spark, f"{tmp_path}/trials") == 0
    models.append_trials(spark.createDataFrame(trials), f"{tmp_path}/trials")
    assert models.next_trial(spark, f"{tmp_path}/trials") == 2 and models.tuned(plain, trials).params == {"maxIter": 50, "regParam": 0.2}


def test_pruning(spark):
    """The median rule by hand, and a search in which only a trial that is not behind gets a score."""
    done = [[0.3, 0.3, 0.2], [0.3, 0.3, 0.4], [0.3, 0.3, 0.6]]
    assert models.behind([0.9, 0.9, 0.5], done, startup=3) and not models.behind([0.9, 0.9, 0.4], done, startup=3)
    assert not models.behind([0.1, 0.9, 0.9], done, startup=3)  # its best fold counts
    assert not models.behind([0.9, 0.9], done, startup=3) and not models.behind([0.9, 0.9, 0.9], done, startup=4)
    rng = np.random.default_rng(6)
    x = rng.normal(size=(200, 2))
    data = spark.createDataFrame([(i, int(a + rng.normal(0, 0.5) > 0), float(a), float(b)) for i, (a, b) in enumerate(x.tolist())], "id long, y int, f double, g double")
    e = models.Experiment("m", "logistic", {"maxIter": 20}, scaled=True, n_folds=3)
    best = {"trial": 0, "score": 0.1, "params": "{}", "steps": [0.0, 0.0]}
    worst = best | {"steps": [9.0, 9.0]}
    stopped, went_on = (models.tune(data, ["f", "g"], e, trials=2, earlier=[t], startup=1, warm=1)[1] for t in (best, worst))
    assert stopped["score"] is None and len(stopped["steps"]) == 2 and models.tuned(e, [best, stopped]).params == e.params
    assert went_on["score"] < 0.6 and went_on["params"] == stopped["params"] and went_on["steps"] == pytest.approx(stopped["steps"])
    ranked = models.rank_trials(spark.createDataFrame([(0, 0.4), (1, None), (2, 0.3)], "trial int, score double")).collect()
    assert [r.trial for r in ranked] == [2, 0, 1]


def test_small_steps(spark, tmp_path):
    (tmp_path / "a.json").write_text('{"x": 1}')
    assert tables.read_json(tmp_path / "a.json") == {"x": 1} and tables.read_json(tmp_path / "b.json") == {}
    assert features.first_seen(["a", "b", "a"]) == ["a", "b"]
    themes = spark.createDataFrame([("balance_trend",), ("withdraw_std",), ("deposit_recency_ratio",), ("m1_daily_avg_bal",), ("arpu",)], "feature string")
    assert [r.t for r in themes.select(importance.theme().alias("t")).collect()] == ["Balance Deterioration", "Spending Stress", "Income Stability", "Balance Deterioration", "Other"]
    from tideline.operators.encoding import code_table
    from tideline.plans.schema import wide

    codes = {r.value: r.code for r in code_table(spark.createDataFrame([("b",), ("a",), (None,), ("ab",), ("b",)], "c string"), "c").collect()}
    assert codes == {"a": 0, "ab": 1, "b": 2, "nan": 3}
    row = tables.request_frame(spark, {"ID": "x", "age": "41", "gender": "nan", "arpu": "bad"}, wide()).first()
    assert (row.ID, row.age, row.gender, row.arpu) == ("x", 41.0, None, None)


def test_blends_are_scored_exactly_and_by_one_plan(spark):
    rng = np.random.default_rng(5)
    rows = [(int(rng.random() < 0.4), *(float(x) for x in np.round(rng.random(3), 2))) for _ in range(700)]  # many ties
    df = spark.createDataFrame([*rows, (1, None, 0.5, 0.5), (None, 0.1, 0.2, 0.3), (0, float("nan"), 0.5, 0.5)], "y int, a double, b double, c double").repartition(3)
    candidates = [(1.0, 0.0, 0.0), (0.2, 0.3, 0.5), (0.0, 0.0, 0.0)]
    y, x = np.array([r[0] for r in rows]), np.array([r[1:] for r in rows])
    with blends.scores(df, ["a", "b", "c"]) as held:
        for w, found in zip(candidates, held.composites(candidates), strict=True):
            p = np.clip(x[:, 0] * w[0] + x[:, 1] * w[1] + x[:, 2] * w[2], 1e-15, 1 - 1e-15)
            won = (p[y == 1][:, None] > p[y == 0]).mean() + (p[y == 1][:, None] == p[y == 0]).mean() / 2
            loss = -np.where(y == 1, np.log(p), np.log1p(-p)).mean()
            assert abs(found - (0.6 * loss + 0.4 * (1 - won))) < 1e-10
        assert held.table.count() == len(rows)
    alone = spark.createDataFrame([(1, 0.5, 0.5)], "y int, a double, b double")
    assert learning.composites(alone, ["a", "b"], [(0.5, 0.5)]) == [None]
    with pytest.raises(ValueError, match="both classes"):
        learning.optimise_weights(alone, ["a", "b"])


def test_series_of_a_group_that_lacks_are_null(spark):
    one = [1.0, 2.0, 0.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(k, "deposit", one, one, one) for k in range(2000)], "id long, grp string, val array<double>, vol array<double>, hi array<double>").repartition(3)
    rows = series_ops.features_wide(df).collect()
    assert sorted(r.id for r in rows) == list(range(2000))
    assert {(r.deposit_mean, r.deposit_zero_streak, r.withdraw_mean, r.withdraw_zero_streak, r.withdraw_mean_log) for r in rows} == {(3.0, 0.0, None, None, None)}


def test_tasks_that_make_features_have_a_bounded_number_of_customers(spark, monkeypatch):
    """However few bytes customers have and however many tasks the session would take."""
    monkeypatch.setattr(series_ops, "CUSTOMERS", 100)
    one = [1.0, 2.0, 0.0, 4.0, 5.0, 6.0]
    df = spark.createDataFrame([(k, g, one, one, one) for k in range(2000) for g in ("deposit", "withdraw")], "id long, grp string, val array<double>, vol array<double>, hi array<double>")
    tasks = series_ops.features_wide(df).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == 2000 and max(r["count"] for r in tasks) < 200
    x = df.where("grp = 'deposit'").selectExpr("id", "struct(val, vol, hi) as deposit").coalesce(1)
    assert series_ops.spread(x).rdd.getNumPartitions() in range(18, 23)  # keys are counted to 5 %
    assert series_ops.spread(x.limit(0)).count() == 0


def test_frames_are_made_in_tasks_of_bounded_size(spark, monkeypatch):
    monkeypatch.setattr(series_ops, "CUSTOMERS", 5)
    rows = features.Rows(panel.customers(spark, SF).persist(), panel.wide_columns())
    tasks = rows.frame({}, [], False).groupBy(F.spark_partition_id()).count().collect()
    assert sum(r["count"] for r in tasks) == rows.customers.count() and max(r["count"] for r in tasks) < 20


def test_series_without_numbers_are_folded_without_a_column_for_them():
    batch = pa.RecordBatch.from_pydict({"k0": [1, 1, 2, 2], "f0": [1.0, 2.0, 3.0, None]})
    (out,) = series_ops._folded(1, 0, [(0, 0), (0, 1)], 2)(iter([batch]))
    assert out.to_pydict() == {"k0": [1, 2], "v0": [1.0, 3.0], "v1": [2.0, None]}
