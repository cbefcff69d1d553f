"""Isotonic calibration without a driver: adjacent violators are pooled by score range first, then by ranges of pools.

Pools that are merged within a range stay merged in the whole, so each step only sees what the one before has left. With
labels of 0 and 1 a monotone chain over N rows has at most about 3 * N ** (2/3) pools of distinct rates (lattice points on
a convex chain), so the last step, in one task, holds some three million pools for 1e9 rows and usually a few hundred.

Sums are integers and means are compared by cross-multiplication, so the pools don't depend on partitions. Rows without a
label or a score (null, NaN) are left out; equal scores are one point; no rows give no pools.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.operators.metrics import known
from tideline.operators.ranks import RANGES, between, ranged, sampled

_POOLS = "lo double, hi double, n long, s long"
_SEGMENTS = "lo double, hi double, n long, rate double, next double, next_rate double"


def _pooled(table: pa.Table) -> list[list]:
    """Pools (lo, hi, n, s) of rising rates from those of a table, which don't overlap."""
    out: list[list] = []
    for lo, hi, n, s in sorted(zip(*(table.column(c).to_pylist() for c in ("lo", "hi", "n", "s")), strict=True)):
        out.append([lo, hi, n, s])
        while len(out) > 1 and out[-2][3] * out[-1][2] >= out[-1][3] * out[-2][2]:
            _, hi, n, s = out.pop()
            out[-1][1:] = [hi, out[-1][2] + n, out[-1][3] + s]
    return out


def _pool(table: pa.Table) -> pa.Table:
    return pa.table([*map(list, zip(*_pooled(table), strict=True))], pa.schema([("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("s", pa.int64())]))


def _segments(table: pa.Table) -> pa.Table:
    pools = _pooled(table)
    rows = [(lo, hi, n, s / n, *((after[0], after[3] / after[2]) if after else (None, None))) for (lo, hi, n, s), after in zip(pools, [*pools[1:], None], strict=True)]
    kinds = ("lo", pa.float64()), ("hi", pa.float64()), ("n", pa.int64()), ("rate", pa.float64()), ("next", pa.float64()), ("next_rate", pa.float64())
    return pa.table([*map(list, zip(*rows, strict=True))], pa.schema(kinds))


def fit(scored: DataFrame) -> DataFrame:
    """``lo, hi, n, rate`` of pools of scores (y, p), with the next pool's ``next`` (its lo) and ``next_rate``."""
    points = known(scored).groupBy(F.col("p").cast("double").alias("p")).agg(F.count("*").alias("n"), F.sum(F.col("y").cast("long")).alias("s"))
    rows = ranged(points, [], "p").select("range", F.col("p").alias("lo"), F.col("p").alias("hi"), "n", "s")
    schema = f"range int, {_POOLS}"

    def of_range(key, table):
        found = _pool(table)
        return found.add_column(0, "range", pa.array([key[0].as_py() // 32] * len(found), pa.int32()))

    some = rows.groupBy("range").applyInArrow(of_range, schema)
    return some.groupBy("range").applyInArrow(of_range, schema).groupBy().applyInArrow(_segments, _SEGMENTS)


def apply(scored: DataFrame, pools: DataFrame) -> DataFrame:
    """``scored`` with ``calibrated``: a pool's rate, linear between two pools, the ends' rates beyond them; null without a score.

    Scores and pools meet by ranges between sampled pools, so neither side is in one task and no pool meets all scores.
    """
    splitters = sampled(pools.select("lo").distinct(), "lo")
    at = lambda df, c: between(df, c, splitters)
    ends = at(at(pools, "lo").withColumnRenamed("range", "a").withColumn("__n", F.coalesce("next", F.lit(float("inf")))), "__n").withColumnRenamed("range", "b")
    first = pools.agg(F.min("lo").alias("lo")).withColumn("first", F.lit(True))
    ends = ends.join(first, "lo", "left")
    ends = ends.withColumn("a", F.when(F.col("first"), 0).otherwise(F.col("a"))).withColumn("from", F.when(F.col("first"), float("-inf")).otherwise(F.col("lo")))
    placed = ends.select(F.explode(F.sequence("a", F.least("b", F.lit(RANGES)))).alias("range"), "from", "hi", "rate", "next", "next_rate")
    values = scored.where(F.col("p").isNotNull() & ~F.isnan("p")).select("p").distinct()
    met = at(values, "p").join(placed, "range").where((F.col("p") >= F.col("from")) & (F.col("next").isNull() | (F.col("p") < F.col("next"))))
    share = (F.col("p") - F.col("hi")) / (F.col("next") - F.col("hi"))
    value = F.when((F.col("p") <= F.col("hi")) | F.col("next").isNull(), F.col("rate")).otherwise(F.col("rate") + share * (F.col("next_rate") - F.col("rate")))
    return scored.join(met.select("p", value.alias("calibrated")), "p", "left")
