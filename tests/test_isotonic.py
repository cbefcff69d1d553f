"""Isotonic fits against a plain pooling of adjacent violators."""

import math

import numpy as np
import pytest

from tideline.operators import isotonic

ROWS = "id long, y int, p double"


def plain(y, p):
    """Fitted values by score, pooling from the left until nothing falls."""
    out = []
    for v in sorted(set(p)):
        own = [a for a, b in zip(y, p, strict=True) if b == v]
        out.append([[v], sum(own), len(own)])
        while len(out) > 1 and out[-2][1] / out[-2][2] >= out[-1][1] / out[-1][2]:
            last = out.pop()
            out[-1] = [out[-1][0] + last[0], out[-1][1] + last[1], out[-1][2] + last[2]]
    return out


@pytest.mark.parametrize("kind", ["rising", "falling", "tied", "noise"])
def test_pools(spark, kind):
    rng = np.random.default_rng(3)
    p = rng.random(3000) if kind != "tied" else rng.integers(0, 7, 3000) / 7
    rate = {"rising": p**2, "falling": 1 - p, "tied": p, "noise": np.full(3000, 0.3)}[kind]
    y = (rng.random(3000) < rate).astype(int)
    df = spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], ROWS).repartition(5)
    got = [(r.lo, r.hi, r.n, r.rate) for r in isotonic.fit(df).orderBy("lo").collect()]
    want = [(v[0], v[-1], n, s / n) for v, s, n in plain(y.tolist(), p.tolist())]
    assert got == [pytest.approx(w) for w in want]


def test_apply(spark):
    rng = np.random.default_rng(5)
    p = rng.random(900)
    y = (rng.random(900) < p).astype(int)
    pools = isotonic.fit(spark.createDataFrame([(i, int(a), float(b)) for i, (a, b) in enumerate(zip(y, p, strict=True))], ROWS)).persist()
    x, v = zip(*((z, s / n) for values, s, n in plain(y.tolist(), p.tolist()) for z in (values[0], values[-1])), strict=True)
    new = [-0.5, 0.0, 1.0, 2.0, *rng.random(300).tolist(), *p[:50].tolist(), 0.25, 0.25]
    df = spark.createDataFrame([(i, 0, float(b)) for i, b in enumerate(new)] + [(9000, 0, None), (9001, 0, math.nan)], ROWS)
    got = {r.id: r.calibrated for r in isotonic.apply(df, pools).collect()}
    assert len(got) == len(new) + 2
    assert got[9000] is None
    assert got[9001] is None
    assert [got[i] for i in range(len(new))] == pytest.approx(np.interp(new, x, v).tolist(), abs=1e-12)


def test_odd_tables(spark):
    assert isotonic.fit(spark.createDataFrame([], ROWS)).collect() == []
    one = isotonic.fit(spark.createDataFrame([(1, 1, 0.5), (2, None, 0.7), (3, 0, None), (4, 1, math.nan)], ROWS)).collect()
    assert [(r.lo, r.hi, r.n, r.rate, r.next) for r in one] == [(0.5, 0.5, 1, 1.0, None)]
    ends = isotonic.fit(spark.createDataFrame([(1, 0, -math.inf), (2, 1, math.inf)], ROWS))
    assert [r.calibrated for r in isotonic.apply(spark.createDataFrame([(1, 0, math.inf)], ROWS), ends).collect()] == [1.0]
