"""Attributions against all subsets of features, and ordered target statistics against a plain loop."""

import math
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline.operators import attributions, boosting, target_codes
from tideline.operators.boosting import Boosting, Tree


def value_of(tree, row, known, node=0):
    """A tree's value where only some features are known: the others go both ways by cover."""
    f = tree.feature[node]
    if f < 0:
        return tree.value[node]
    a, b = tree.left[node], tree.right[node]
    if f in known:
        return value_of(tree, row, known, a if row[f] <= tree.bin[node] else b)
    return sum(tree.cover[c] * value_of(tree, row, known, c) for c in (a, b)) / tree.cover[node]


def fair(trees, row, n):
    """Shapley values from their definition."""
    out = []
    for k in range(n):
        others = [j for j in range(n) if j != k]
        total = 0.0
        for size in range(n):
            for s in combinations(others, size):
                gain = sum(value_of(t, row, {*s, k}) - value_of(t, row, {*s}) for t in trees)
                total += gain * math.factorial(size) * math.factorial(n - size - 1) / math.factorial(n)
        out.append(total)
    return out


def random_tree(rng, n_features, depth):
    tree = Tree()

    def grow(cover, deep):
        node = tree.add(float(rng.normal()), cover)
        if deep and cover > 3:
            left = int(rng.integers(0, cover + 1)) if rng.random() < 0.2 else int(rng.integers(1, cover))
            a, b = grow(left, deep - 1), grow(cover - left, deep - 1)
            tree.split(node, int(rng.integers(n_features)), int(rng.integers(1, 6)), a, b, 1.0)
        return node

    grow(200, depth)
    return tree


@pytest.mark.parametrize("seed", range(6))
def test_random_trees(seed):
    """Features that come again on a path, leaves without rows, a single leaf."""
    rng = np.random.default_rng(seed)
    trees = [random_tree(rng, 5, depth) for depth in (0, 3, 6)]
    trees = [t for t in trees if all(t.cover[k] or t.feature[k] < 0 for k in range(len(t.cover)))]
    x = rng.integers(0, 8, (25, 5)).astype("u1")
    got = attributions.attribute(x, [attributions.paths(t) for t in trees], 5)
    for row, phi in zip(x, got, strict=True):
        assert phi == pytest.approx(fair(trees, row, 5), abs=1e-12)


def frame(spark, n=400):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(n, 3))
    y = (x[:, 0] * x[:, 1] + x[:, 2] > 0).astype(int)
    return spark.createDataFrame([(i, int(y[i]), i % 3, *map(float, x[i])) for i in range(n)], "id long, y int, fold int, base double, `a b` double, c double"), ["base", "a b", "c"]


def test_sums_are_margins(spark):
    df, columns = frame(spark)
    models = boosting.fit(df, columns, Boosting(trees=5, leaves=9, min_rows=5, bins=16), 3)
    rows = attributions.attributions(df.withColumnRenamed("base", "base"), models)
    out = rows.toDF("id", "base_value", "margin", *columns).collect()
    assert len(out) == 400
    for r in out:
        assert r.base_value + sum(r[c] for c in columns) == pytest.approx(r.margin, abs=1e-9)
    p = {r.id: (r.p0, r.p1, r.p2) for r in boosting.predict(df, models).collect()}
    for r in out[:50]:
        assert r.margin == pytest.approx(np.mean([math.log(q / (1 - q)) for q in p[r.id]]), abs=1e-9)


# ordered target statistics


def rows_of(n=500, seed=5):
    rng = np.random.default_rng(seed)
    values = np.array(["hot", "b", "c", None, "rare"])[rng.choice(5, n, p=[0.5, 0.2, 0.2, 0.09, 0.01])]
    return [(i, None if rng.random() < 0.02 else int(rng.integers(0, 2)), i % 3, v) for i, v in enumerate(values.tolist())]


CODES = "id long, y int, fold int, c string"


@pytest.mark.parametrize("n_models", [1, 3])
def test_codes(spark, n_models):
    rows = rows_of()
    df = spark.createDataFrame(rows, CODES).repartition(4)
    order = [r.id for r in df.orderBy(F.xxhash64("id", F.lit(42)), "id").collect()]
    by = {r[0]: r for r in rows}
    prior = target_codes.priors(df, n_models)
    own = lambda r, k: n_models == 1 or r[2] != k
    for k in range(n_models):
        known = [r[1] for r in rows if r[1] is not None and (n_models == 1 or r[2] != k)]
        assert prior[k] == pytest.approx(sum(known) / len(known))
    found = target_codes.ordered_codes(df, "c", n_models, prior, 2.0, rows_a_range=40)
    got = {r.id: r for r in found.collect()}
    assert len(got) == len(rows)
    for k in range(n_models):
        seen, total = {}, {}
        for r in rows:
            if r[1] is not None and own(r, k):
                s, n = total.get(r[3], (0, 0))
                total[r[3]] = s + r[1], n + 1
        for i in order:
            r = by[i]
            s, n = (seen if own(r, k) else total).get(r[3], (0, 0))
            assert got[i][f"c|{k}"] == pytest.approx((s + 2 * prior[k]) / (n + 2))
            if r[1] is not None and own(r, k):
                s, n = seen.get(r[3], (0, 0))
                seen[r[3]] = s + r[1], n + 1


def test_codes_never_see_their_own_target(spark):
    rows = rows_of(200)
    codes = lambda x: {r.id: r["c|0"] for r in target_codes.ordered_codes(spark.createDataFrame(x, CODES), "c", 1, [0.5], rows_a_range=20).collect()}
    before = codes(rows)
    for i in (3, 50, 120):
        flipped = [(*r[:1], 1 - (r[1] or 0), *r[2:]) if r[0] == i else r for r in rows]
        after = codes(flipped)
        assert after[i] == before[i]
        assert after != before


def test_new_rows(spark):
    df = spark.createDataFrame(rows_of(), CODES)
    table = target_codes.totals(df, "c", 3)
    new = spark.createDataFrame([(1, "hot", 7.0), (2, "never", 8.0), (3, None, 9.0)], "id long, c string, s0 double")
    out = {r.id: r for r in target_codes.coded(new.drop("s0"), "c", table, [0.1, 0.2, 0.3], 5.0).collect()}
    assert [out[2][f"c|{k}"] for k in range(3)] == [0.1, 0.2, 0.3]
    assert out[1]["c|0"] != out[1]["c|1"]
    assert 0 < out[3]["c|0"] < 1


def test_symmetric_models_learn_from_categories(spark):
    rng = np.random.default_rng(1)
    rows = [(i, int(rng.random() < (0.1, 0.5, 0.9)[i % 7 % 3]), i % 2, f"v{i % 7}", float(rng.normal())) for i in range(900)]
    df = spark.createDataFrame(rows, "id long, y int, fold int, c string, x double")
    models, full = target_codes.fit_symmetric(df, ["x"], ["c"], Boosting(trees=6, symmetric=True, depth=3, rate=0.3, patience=3), 2)
    assert all(m.columns == ["x", "c|0", "c|1"] for m in models)
    assert all(f != 2 - k for k, m in enumerate(models) for t in m.trees for f in t.feature)  # a model sees its own codes alone
    oof = boosting.out_of_fold(full, models).agg(F.avg(F.when(F.col("y") == 1, F.col("p"))).alias("a"), F.avg(F.when(F.col("y") == 0, F.col("p"))).alias("b")).first()
    assert oof.a > oof.b + 0.2


def test_patterns_weighed_beforehand_and_by_batch(monkeypatch):
    """Paths whose patterns are all weighed once in a task give what those weighed by batch do, to the last bit."""
    rng = np.random.default_rng(3)
    tables = [[attributions.Path(float(rng.normal()), list(range(m)), [-1, *rng.integers(0, 4, m - 1).tolist()], [5, *rng.integers(4, 9, m - 1).tolist()], rng.uniform(0.1, 0.9, m).tolist()) for m in (1, 2, 5, 8)]]
    x = rng.integers(0, 12, (500, 8))
    assert [known is not None for *_, known in attributions.prepared(tables)] == [True, True, True, False]
    got = attributions.attribute(x, tables, 8)
    monkeypatch.setattr(attributions, "PATTERNS", 0)
    assert np.array_equal(got, attributions.attribute(x, tables, 8))
