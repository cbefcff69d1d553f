"""Proposals, importances of settings, published runs and shared searches."""

import json
import math
import threading

import numpy as np
import pytest

from tideline.operators import contract, models, search
from tideline.operators.search import Dim
from tideline.sources import runs, tables

SPACE = {"x": Dim("float", -5, 5), "n": Dim("log_int", 1, 1000), "rate": Dim("log", 1e-4, 1.0), "kind": Dim("choice", choices=("a", "b", "c")), "extra": Dim("int", 0, 100, step=10, when=("kind", "b"))}


def cost(p):
    """Least at x = 2, n = 30, rate = 0.01, kind b, extra 40."""
    return (p["x"] - 2) ** 2 / 10 + math.log(p["n"] / 30) ** 2 + (math.log10(p["rate"]) + 2) ** 2 + {"a": 2, "b": 0, "c": 4}[p["kind"]] + abs(p.get("extra", 100) - 40) / 50


def searched(seed, n, startup):
    trials = []
    for k in range(n):
        p = search.propose(SPACE, trials, k, seed, startup)
        trials.append({"trial": k, "params": p, "score": cost(p)})
    return trials


def test_proposals_beat_random_ones():
    seeds = range(8)
    parzen, rand = ([min(t["score"] for t in searched(s, 60, startup)) for s in seeds] for startup in (10, 1000))
    assert np.mean(parzen) < np.mean(rand)
    assert np.median(parzen) < np.median(rand)


def test_proposals_are_in_the_space_and_the_same_after_a_break():
    trials = searched(3, 40, 10)
    for t in trials:
        p = t["params"]
        assert -5 <= p["x"] <= 5
        assert isinstance(p["n"], int)
        assert 1 <= p["n"] <= 1000
        assert 1e-4 <= p["rate"] <= 1
        assert ("extra" in p) == (p["kind"] == "b")
        assert p.get("extra", 0) % 10 == 0
    for k in (5, 17, 39):
        assert search.propose(SPACE, trials, k, 3) == trials[k]["params"]  # later trials teach it nothing
    pruned = [{**t, "score": None} for t in trials]
    assert search.propose(SPACE, pruned, 40, 3) == search.sample(SPACE, np.random.default_rng([3, 40]))


def test_all_dimensions_are_proposed():
    for kind, n in (("trees_leafwise", 12), ("trees_depthwise", 13)):
        space = models.SPACES[kind]
        assert len(space) == n
        trials = []
        for k in range(30):
            p = search.propose(space, trials, k)
            models.Experiment("m", kind, p).check()
            trials.append({"trial": k, "params": p, "score": abs(p["rate"] - 0.05)})
        late = [abs(t["params"]["rate"] - 0.05) for t in trials[15:]]
        assert np.median(late) < np.median([abs(t["params"]["rate"] - 0.05) for t in trials[:10]])


def test_importances_are_those_of_a_grid():
    """Marginals by volume equal averages over a fine grid of the tree's own function."""
    rng = np.random.default_rng(0)
    x = rng.random((80, 3))
    y = np.sin(5 * x[:, 0]) + 0.3 * x[:, 1]
    boxes = search._boxes(x, y, rng)
    assert sum(float((b.high - b.low).prod()) for b in boxes) == pytest.approx(1)
    whole, own = search.variance_shares(boxes, 3)
    cuts = [np.unique([end for b in boxes for end in (b.low[f], b.high[f])]) for f in range(3)]
    middle, width = [(c[1:] + c[:-1]) / 2 for c in cuts], [np.diff(c) for c in cuts]
    cube = np.zeros([len(m) for m in middle])
    for b in boxes:
        cube[np.ix_(*((m > b.low[f]) & (m < b.high[f]) for f, m in enumerate(middle)))] = b.value
    mean = np.einsum("ijk,i,j,k", cube, *width)
    assert whole == pytest.approx(np.einsum("ijk,i,j,k", (cube - mean) ** 2, *width))
    for f in range(3):
        marginal = np.einsum("ijk,j,k->i", np.moveaxis(cube, f, 0), *(w for a, w in enumerate(width) if a != f))
        assert own[f] == pytest.approx(((marginal - mean) ** 2) @ width[f])
    trials = [{"trial": k, "params": {"x": 10 * a - 5, "rate": 10 ** (4 * b - 4)}, "score": v} for k, ((a, b, _), v) in enumerate(zip(x.tolist(), y.tolist(), strict=True))]
    found = search.importances({"x": SPACE["x"], "rate": SPACE["rate"]}, trials)
    assert list(found) == ["x", "rate"]
    assert found["x"] > 0.6 > 0.2 > found["rate"]
    assert search.importances({"x": SPACE["x"]}, trials[:2]) == {"x": 0.0}


# published runs


def test_a_run_is_read_as_a_whole_or_not_at_all(spark, tmp_path):
    root = f"file://{tmp_path}/runs"
    oof, weights = spark.range(10), spark.createDataFrame([("a", 0.5)], "model string, weight double")
    assert runs.latest(spark, root, ("stage_2", "baseline")) == {}
    runs.publish(spark, root, "baseline", "m", "run_1", {"oof": oof, "weights": weights}, {"score": 0.4})

    class Killed(Exception):
        pass

    class Broken:
        """A table whose write is never reached again: the driver dies between two tables."""

        @property
        def write(self):
            raise Killed

    with pytest.raises(Killed):
        runs.publish(spark, root, "stage_2", "m", "run_2", {"oof": oof.limit(3), "weights": Broken()}, {})
    last = runs.latest(spark, root, ("stage_2", "baseline"))
    assert last["m"]["run"] == "run_1"
    assert last["m"]["facts"] == {"score": 0.4}
    assert runs.read(spark, last["m"], "oof").count() == 10
    with pytest.raises(FileExistsError):
        runs.publish(spark, root, "baseline", "m", "run_1", {"oof": oof.limit(1)}, {})
    assert runs.read(spark, runs.latest(spark, root, ("baseline",))["m"], "oof").count() == 10
    runs.publish(spark, root, "stage_2", "m", "run_3", {"oof": oof.limit(4)}, {})
    assert runs.latest(spark, root, ("stage_2", "baseline"))["m"]["run"] == "run_3"
    spark.range(1).write.mode("append").parquet(last["m"]["tables"]["oof"]["path"])
    with pytest.raises(ValueError, match="isn't what was published"):
        runs.read(spark, last["m"], "oof")


def test_a_manifest_is_put_once(spark, tmp_path):
    path, wins = f"file://{tmp_path}/a/m.json", []

    def one(k):
        try:
            runs.put(spark, path, str(k))
            wins.append(k)
        except FileExistsError:
            pass

    threads = [threading.Thread(target=one, args=(k,)) for k in range(8)]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert len(wins) == 1
    assert runs.read_text(spark, path) == str(wins[0])


def test_each_trial_goes_to_one_driver(spark, tmp_path):
    got, root = [[], []], f"file://{tmp_path}/study"

    def work(mine):
        study = runs.Study(spark, root)
        while (k := study.claim(12)) is not None:
            mine.append(k)
            study.finish(k, k / 10, {"x": k})

    threads = [threading.Thread(target=work, args=(mine,)) for mine in got]
    for t in threads:
        t.start()
    for t in threads:
        t.join()
    assert sorted(got[0] + got[1]) == list(range(12))
    assert [t["trial"] for t in runs.Study(spark, root).results()] == list(range(12))


def test_a_lease_expires(spark, tmp_path):
    now = [1000.0]
    a, b = (runs.Study(spark, f"file://{tmp_path}/study", 60, lambda: now[0]) for _ in range(2))
    assert a.claim(2) == 0
    assert b.claim(2) == 1
    assert b.claim(2) is None
    assert b.finish(1, 0.5, {})
    now[0] += 61  # a has died
    assert b.claim(2) == 0
    assert b.claim(2) is None
    assert b.finish(0, 0.1, {"by": "b"})
    assert not a.finish(0, 0.2, {"by": "a"})  # it was late
    assert [(t["trial"], t["params"]) for t in a.results()] == [(0, {"by": "b"}), (1, {})]


def test_stored_trials(spark, tmp_path):
    path = str(tmp_path / "trials")
    assert models.next_trial(spark, path) == 0
    (tmp_path / "trials").mkdir()
    (tmp_path / "trials" / "part-0.parquet").write_text("no parquet")
    with pytest.raises(Exception, match="(?i)parquet"):
        models.next_trial(spark, path)
    with pytest.raises(FileNotFoundError):
        models.load_models(models.load_trees, path, 1)


def test_a_shared_search(spark, tmp_path):
    rng = np.random.default_rng(6)
    x = rng.normal(size=(90, 2))
    data = spark.createDataFrame([(i, int(a + rng.normal(0, 0.5) > 0), float(a), float(b)) for i, (a, b) in enumerate(x.tolist())], "id long, y int, f double, g double")
    e = models.Experiment("m", "trees_leafwise", {"trees": 2, "min_rows": 5, "bins": 8}, n_folds=2)
    space = {"rate": Dim("log", 0.05, 0.5), "leaves": Dim("int", 2, 4)}
    study = runs.Study(spark, f"file://{tmp_path}/study")
    found = models.tune_shared(data, ["f", "g"], e, study, 2, space=space)
    alone = models.tune(data, ["f", "g"], e, 2, space=space)
    assert found == alone
    assert set(json.loads(found[1]["params"])) == {"rate", "leaves"}
    assert models.tuned(e, found).params.keys() >= {"trees", "bins"}


def test_preflight(spark):
    data = spark.createDataFrame([(i, i % 2, float(i)) for i in range(6)], "id long, y int, f double")
    es = [models.Experiment("a", "trees_leafwise", n_folds=2), models.Experiment("a", "logistic", scaled=True, n_folds=2), models.Experiment("b", "trees_leafwise", {"maxDepth": 3}), models.Experiment("c", "trees_leafwise"), models.Experiment("d", "other")]
    wrong = models.preflight(data, ["f"], es)
    assert wrong.keys() == {"a", "b", "c", "d"}
    assert "name" in wrong["a"]
    assert "maxDepth" in wrong["b"]
    assert "folds" in wrong["c"]
    rows = models.summary({"c": wrong["c"]})
    assert [(r["name"], r["ok"], r["folds"]) for r in rows] == [("c", False, 0)]


def test_rows_to_score_keep_their_order(spark, tmp_path):
    from pyspark.sql import types as T

    kinds = T.StructType([T.StructField("ID", T.StringType()), T.StructField("age", T.DoubleType())])
    path = tmp_path / "in.csv"
    path.write_text("ID,age\n" + "".join(f"c{k * 7919 % 1000},{k}\n" for k in range(300)))
    with pytest.warns(UserWarning, match="300 rows, not 30000"):
        df = tables.load_test(spark, str(path), kinds, "ID", 30_000)
    assert [r.age for r in df.repartition(5).orderBy("row").collect()] == list(range(300))
    path.write_text("ID,age\nc1,1\nc1,2\n")
    with pytest.raises(ValueError, match="repeat"):
        tables.load_test(spark, str(path), kinds, "ID")


def test_out_of_fold_scores_are_required(spark):
    good = [(i, m, int(i % 7 == 0), 0.1 + i / 1000) for i in range(140) for m in ("a", "b")]
    frame = lambda rows: spark.createDataFrame(rows, "id long, model string, y int, p double")
    tables.require_oof(frame(good), ["a", "b"], 140)
    for rows, wrong in ((good[1:], "139 rows, not 140"), ([*good[2:], (0, "a", 1, None), (0, "b", 1, 0.2)], "missing"), ([*good[2:], (0, "a", 1, 1.5), (0, "b", 1, 0.2)], "outside"), ([(i, m, 1, p) for i, m, _, p in good], "base rate")):
        with pytest.raises(ValueError, match=wrong):
            tables.require_oof(frame(rows), ["a", "b"], 140)
    with pytest.raises(ValueError, match="c: no scores"):
        tables.require_oof(frame(good), ["a", "c"])


def test_settings_go_in_order(spark):
    assert contract.options() == {"clip_quantiles": (0.001, 0.999), "enable_clipping": True, "scale_features": False}
    config = {"preprocessing": {"clip_quantiles": [0.1, 0.9], "other": 1}}
    assert contract.options(config, clip_quantiles=(0.2, 0.8), scale_features=True) == {"clip_quantiles": (0.1, 0.9), "enable_clipping": True, "scale_features": True}
    with pytest.raises(ValueError, match="in order"):
        contract.options(clip_quantiles=(0.9, 0.1))
    with pytest.raises(ValueError, match="no settings"):
        contract.options(clip=1)
    df = spark.createDataFrame([(i, float(i)) for i in range(101)], "id long, x double")
    assert contract.Preprocessing.fit(df, ["x"], config=config).clip == {"x": (10.0, 90.0)}
    off = contract.Preprocessing.fit(df, ["x"], scaled=False, config={"preprocessing": {"enable_clipping": False, "scale_features": True}})
    assert off.clip == {}
    assert off.scale["x"][0] == 50.0


def test_tracked_rows(spark):
    rows = tables.tracked("tuning", "run_1", {"best": {"score": 0.2, "params": {"rate": 0.1, "grow": "leaf"}}, "ok": True, "none": None}, [{"fold": 0, "auc": 0.8}, {"fold": 1, "auc": 0.6}], "cv_")
    found = {(r[2], r[3], r[4]): r[5] if r[2] == "metric" else r[6] for r in rows}
    assert found == {
        ("metric", "cv_best.score", None): 0.2, ("metric", "cv_best.params.rate", None): 0.1, ("param", "cv_best.params.grow", None): "leaf", ("param", "cv_ok", None): "true",
        ("metric", "cv_auc_fold", 0): 0.8, ("metric", "cv_auc_fold", 1): 0.6, ("metric", "cv_auc_mean", None): pytest.approx(0.7), ("metric", "cv_auc_std", None): pytest.approx(0.1),
    }
    assert spark.createDataFrame(rows, tables.TRACKED).count() == len(rows)
