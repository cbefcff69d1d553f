"""Boosted trees against a plain NumPy version that opens one leaf at a time."""

import heapq
import math

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tideline.operators import boosting
from tideline.operators.boosting import Boosting


def table(n=700, seed=3):
    rng = np.random.default_rng(seed)
    x = rng.normal(size=(n, 4))
    x[:, 3] = rng.integers(0, 4, n)
    y = (x[:, 0] * x[:, 1] + 0.5 * x[:, 2] + (x[:, 3] == 2) + rng.normal(size=n) > 0.5).astype(int)
    x[rng.random((n, 4)) < 0.03] = math.nan
    return x, y, np.arange(n) % 3


NAMES = ["a", "b", "c.d", "e"]


@pytest.fixture(scope="module")
def data(spark):
    x, y, fold = table()
    rows = [(i, int(y[i]), int(fold[i]), *map(float, x[i])) for i in range(len(y))]
    return spark.createDataFrame(rows, ["id", "y", "fold", *NAMES]).withColumns({c: F.when(~F.isnan(f"`{c}`"), F.col(f"`{c}`")) if c == "a" else F.col(f"`{c}`") for c in ("a",)}).repartition(3)


def bins_of(x, edges):
    return np.stack([np.where(np.isnan(c), 0, 1 + np.searchsorted(e, c)) for c, e in zip(x.T, edges, strict=True)], 1)


def best(x, g, h, rows, s):
    """The best split of a node by trying each."""
    score = lambda r: max(abs(g[r].sum() / boosting.UNIT) - s.l1, 0) ** 2 / (h[r].sum() / boosting.UNIT + s.l2)
    out = (1e-9, None, None)
    for f in range(x.shape[1]):
        for b in range(s.bins - 1):
            left = rows & (x[:, f] <= b)
            right = rows & ~left
            if not s.symmetric and (min(left.sum(), right.sum()) < s.min_rows or min(h[left].sum(), h[right].sum()) < s.min_weight * boosting.UNIT):
                continue
            gain = score(left) + score(right) - score(rows)
            if gain > out[0] + 1e-12:
                out = (gain, f, b)
    return out


def value(g, h, rows, s):
    a = g[rows].sum() / boosting.UNIT
    return -math.copysign(max(abs(a) - s.l1, 0), a) / (h[rows].sum() / boosting.UNIT + s.l2) * s.rate if rows.any() else 0.0


def plain(x, y, s, trees, hold=None):
    """Margins of all rows after each tree, and each tree's leaves as sets of rows."""
    train = np.ones(len(y), bool) if hold is None else ~hold
    m = np.full(len(y), math.log(s.positive_weight * y[train].sum() / (1 - y[train]).sum()))
    out, parts = [], []
    for _ in range(trees):
        p = 1 / (1 + np.exp(-m))
        w = np.where(y == 1, s.positive_weight, 1.0)
        g, h = np.rint(w * (p - y) * boosting.UNIT) * train, np.rint(w * p * (1 - p) * boosting.UNIT) * train
        every = np.ones(len(y), bool)
        if s.symmetric:
            leaves = [every]
            for _ in range(s.depth):
                gains = np.zeros((x.shape[1], s.bins - 1))
                score = lambda r: max(abs(g[r].sum() / boosting.UNIT) - s.l1, 0) ** 2 / (h[r].sum() / boosting.UNIT + s.l2)
                for f in range(x.shape[1]):
                    for b in range(s.bins - 1):
                        gains[f, b] = sum(score(r & (x[:, f] <= b)) + score(r & (x[:, f] > b)) - score(r) for r in leaves)
                f, b = divmod(int(gains.argmax()), s.bins - 1)
                if gains[f, b] <= 1e-9:
                    break
                leaves = [part for r in leaves for part in (r & (x[:, f] <= b), r & (x[:, f] > b))]
        else:
            queue, closed = [], []

            def push(rows, path, queue=queue, closed=closed, g=g, h=h):
                gain, f, b = best(x, g, h, rows & train, s) if len(path) < s.depth else (0, None, None)
                heapq.heappush(queue, (-gain, path, len(queue) + len(closed), rows, f, b)) if f is not None else closed.append(rows)

            push(every, "")
            while queue and len(queue) + len(closed) < s.leaves:
                _, path, _, rows, f, b = heapq.heappop(queue)
                push(rows & (x[:, f] <= b), path + "L")
                push(rows & (x[:, f] > b), path + "R")
            leaves = closed + [q[3] for q in queue]
        for rows in leaves:
            m = m + rows * value(g, h, rows & train, s)
        out.append(m.copy())
        parts.append({frozenset(np.nonzero(r)[0].tolist()) for r in leaves if r.any()})
    return out, parts


@pytest.mark.parametrize("s", [
    Boosting(trees=4, leaves=7, bins=12, min_rows=15, l1=0.2, rate=0.3),
    Boosting(trees=3, leaves=32, depth=3, bins=12, min_rows=5, rate=0.3, positive_weight=2.0),
    Boosting(trees=3, symmetric=True, depth=3, bins=12, rate=0.3, l2=2.0),
], ids=["leafwise", "depthwise", "symmetric"])
def test_same_trees_as_plain(data, s):
    x, y, _ = table()
    model = boosting.fit(data, NAMES, s)[0]
    b = bins_of(x, model.edges)
    margins, parts = plain(b, y, s, s.trees)
    got = np.full(len(y), model.base)
    for t, want, leaves in zip(model.trees, margins, parts, strict=True):
        at = t.leaf(b)
        assert {frozenset(np.nonzero(at == k)[0].tolist()) for k in set(at.tolist())} == leaves
        got += np.array(t.value)[at]
        assert np.allclose(got, want, rtol=0, atol=1e-12)
    assert sum(model.importances()) == pytest.approx(1)
    assert boosting.Model.loads(model.dumps()) == model
    p = {r.id: r.p0 for r in boosting.predict(data, [model]).collect()}
    assert np.allclose([p[i] for i in range(len(y))], 1 / (1 + np.exp(-margins[-1])), rtol=0, atol=1e-12)


def test_folds_and_patience(data, monkeypatch):
    """Each fold's model is that of the other folds' rows, and stops where a plain loop stops."""
    monkeypatch.setattr(boosting, "WRITE", 3)
    x, y, fold = table()
    s = Boosting(trees=14, leaves=12, bins=10, min_rows=5, rate=0.9, patience=2)
    models = boosting.fit(data, NAMES, s, 3)
    stopped = []
    for k, model in enumerate(models):
        hold = fold == k
        margins, _ = plain(bins_of(x, model.edges), y, s, s.trees, hold)
        loss = [boosting.losses(m[hold], y[hold]).sum() / boosting.UNIT / hold.sum() for m in margins]
        end = next((t for t in range(1, s.trees + 1) if t - 1 - int(np.argmin(loss[:t])) >= s.patience), s.trees)
        assert model.losses == pytest.approx(loss[:end], abs=1e-12)
        assert len(model.trees) == model.best == int(np.argmin(loss[:end])) + 1
        stopped.append(end)
    assert min(stopped) < s.trees  # overfits at this rate, so it does stop
    oof = {r.id: r.p for r in boosting.out_of_fold(data, models).collect()}
    m = models[1].margins(bins_of(x, models[1].edges))
    assert all(oof[i] == pytest.approx(1 / (1 + math.exp(-m[i])), abs=1e-12) for i in range(len(y)) if fold[i] == 1)


def test_samples(data):
    """Samples of rows and columns are the same on other partitions, and about as large as asked for."""
    s = Boosting(trees=3, leaves=5, bins=10, subsample=0.6, sample_every=2, colsample=0.5, colsample_level=0.5)
    edges = boosting.fit_edges(data, NAMES, s.bins)
    a, b = boosting.fit(data, NAMES, s, edges=edges)[0], boosting.fit(data.repartition(7), NAMES, s, edges=edges)[0]
    assert a == b
    assert all(300 < t.cover[0] < 540 for t in a.trees)
    assert a.trees[0].cover[0] == a.trees[1].cover[0] != a.trees[2].cover[0]
    assert all(len({f for f in t.feature if f >= 0}) <= 2 for t in a.trees)


def test_leafwise_beats_depthwise_at_equal_leaves(spark):
    """A target with one deep corner: the same leaves buy a lower loss where they are spent on it."""
    rng = np.random.default_rng(9)
    x = rng.random((4000, 6))
    p = np.where(x[:, 0] < 0.5, 0.1, np.where(x[:, 1] < 0.5, 0.3, np.where(x[:, 2] < 0.5, 0.5, np.where(x[:, 3] < 0.5, 0.8, 0.97))))
    y = (rng.random(4000) < p).astype(int)
    columns = [f"f{k}" for k in range(6)]
    df = spark.createDataFrame([(i, int(y[i]), i % 2, *map(float, x[i])) for i in range(4000)], ["id", "y", "fold", *columns])
    loss = {}
    for name, s in (("leaf", Boosting(trees=3, leaves=8, depth=12, bins=32, rate=0.5)), ("depth", Boosting(trees=3, leaves=8, depth=3, bins=32, rate=0.5))):
        loss[name] = np.mean([m.losses[-1] for m in boosting.fit(df, columns, s, 2)])
    assert loss["leaf"] < loss["depth"]


def test_bad_input(spark, data):
    with pytest.raises(ValueError, match="one class"):
        boosting.fit(data.where("y = 1"), NAMES, Boosting(trees=1))
    with pytest.raises(ValueError, match="bins"):
        boosting.fit(data, NAMES, Boosting(bins=600))
    only = boosting.fit(data.select("id", "y", F.lit(1.0).alias("same")), ["same"], Boosting(trees=2))[0]
    assert [len(t.value) for t in only.trees] == [1, 1]


def test_out_of_fold_scores_need_no_join(spark):
    """Fold and label travel with the row through the models: nothing is shuffled or sent to the driver for a join."""
    rows = spark.range(200).selectExpr("id", "cast(id % 2 as int) as y", "cast(id % 5 as int) as fold", "cast(id % 7 + id % 2 as double) as a")
    found = boosting.fit(rows, ["a"], boosting.Boosting(trees=1, min_rows=1), 5)
    scored = boosting.out_of_fold(rows, found)
    assert "Join" not in scored._jdf.queryExecution().optimizedPlan().toString()
    got = {r.id: (r.fold, r.y) for r in scored.collect()}
    assert got == {k: (k % 5, k % 2) for k in range(200)}


def test_rows_meet_their_leaves():
    """Masks lead to the leaf that a walk from the root finds: repeated features, bins beyond all splits, over 62 leaves, a lone leaf."""
    rng = np.random.default_rng(7)
    for leaves in (1, 2, 15, 62, 63, 200):
        tree, ends = boosting.Tree(), [0]
        tree.add(0.0, 0)
        while len(ends) < leaves:
            node = ends.pop(rng.integers(len(ends)))
            ends += (a := tree.add(rng.normal(), 1)), (b := tree.add(rng.normal(), 1))
            tree.split(node, int(rng.integers(4)), int(rng.integers(20)), a, b, 1.0)
        x = rng.integers(0, 64, (300, 4)).astype("u1")
        want = []
        for row in x:
            at = 0
            while tree.feature[at] >= 0:
                at = (tree.left if row[tree.feature[at]] <= tree.bin[at] else tree.right)[at]
            want.append(at)
        for given in (x, np.asfortranarray(x).astype("<u2")):
            assert tree.leaf(given).tolist() == want
        assert boosting.Routes(tree).values(x).tolist() == [tree.value[k] for k in want]


def test_stored_rows_are_read_in_place():
    """Bins and margins of a slice of a batch are views of its columns, from its own first row on."""
    x, m = np.arange(35, dtype="u1").reshape(7, 5), np.linspace(0, 1, 14).reshape(7, 2)
    batch = pa.RecordBatch.from_arrays([pa.array(range(7)), pa.array([0] * 7, pa.int32()), pa.array([1] * 7, pa.int32()), boosting._as_bytes(x), boosting._as_bytes(m)], names=["h", "y", "fold", "x", "margins"])
    h, _, _, bins, margins = boosting._read(batch.slice(2, 4), 5, 2, "u1")
    assert h.tolist() == [2, 3, 4, 5] and bins.tolist() == x[2:6].tolist() and margins.tolist() == m[2:6].tolist()
    assert np.shares_memory(boosting._from_bytes(batch.column("x"), "u1", 5), np.frombuffer(batch.column("x").buffers()[2], "u1"))
    assert [b.num_rows for b in boosting._slices([batch, batch.slice(0, 0)])] == [7]
