"""Exact ranks over many tasks: distinct values fall into ranges between splitters that are taken from the values.

Equal values become one row with a count first, so ties cost nothing. The splitters are quantiles of a group's distinct
values from a bounded sketch (KLL, whose partial states merge at the cost of one of them), so a range holds about
``1 / RANGES`` of them however narrow, skewed or far apart they are; the ranks are exact with any splitters. A range's rows
are sorted in one task, all values of a group never are.

Percentiles of a table's columns (``column_percentiles``) shuffle no more than the values near them: a sketch of every
column gives a bracket around each percentile, a second pass counts what lies below it and ranks what lies inside. The
counts tell whether the bracket holds the wanted ranks; where it doesn't, all values of the column are ranked.

NaN and null count as missing. Infinities are values like others, at the ends: a percentile
between one and a finite value is the infinity, between both it is NaN.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.plans.settled import kept, settled

#: Ranges of a group (a square: they are found in two steps), and the sketch's accuracy: 2 / SKETCH of a group's values.
SIDE, SKETCH = 32, 8192
#: States of the sketches of splitters and of brackets, a bracket's half width in ranks (some eight deviations of its
#: sketch), and the values up to which a column is its own bracket.
STATE, COARSE, REACH, FEW = 16384, 4096, 0.004, 2048
RANGES = SIDE * SIDE


def present(c: str) -> Column:
    return F.col(c).isNotNull() & ~F.isnan(F.col(c).cast("double"))


def _under(splitters: Column, v: str) -> Column:
    return F.size(F.filter(splitters, lambda s: s < F.col(v)))


def ranged(values: DataFrame, by: list[str], c: str, of: DataFrame | None = None) -> DataFrame:
    """Adds ``range``, from 0, to rows of distinct values: those of a lower range are lower.

    What is joined is an array of ``RANGES`` - 1 splitters for each group. It is broadcast: a join by group would first send
    all values of a group to one task. Splitters are found once and stored, as another run of the sketch gives others;
    ``of`` are the rows to take them from, where these are at hand without a shuffle (with repeats a range then holds
    about ``1 / RANGES`` of the rows, or one value).
    """
    shares = F.expr(f"array({', '.join(f'{k / RANGES!r}D' for k in range(1, RANGES))})")
    found = (values if of is None else of).groupBy(*by).agg(F.count("*").alias("__n"), F.kll_sketch_agg_double(F.col(c).cast("double"), STATE).alias("__k"))
    found = found.select(*by, F.when(F.col("__n") > 0, F.kll_sketch_get_quantile_double("__k", shares)).alias("__s"))
    rows = F.transform(F.sequence(F.lit(0), F.lit(SIDE - 1)), lambda i: F.slice("__s", i * SIDE + 1, F.lit(SIDE - 1)))
    heads = F.transform(F.sequence(F.lit(1), F.lit(SIDE - 1)), lambda i: F.element_at("__s", (i * SIDE).cast("int")))
    found = kept(found.select(*by, heads.alias("__heads"), rows.alias("__rows")))
    met = values.join(F.broadcast(found), by) if by else values.crossJoin(F.broadcast(found))  # without groups it is one row
    met = met.withColumn("__row", _under(F.col("__heads"), c))
    return met.withColumn("range", F.col("__row") * SIDE + _under(F.col("__rows")[F.col("__row")], c)).drop("__heads", "__rows", "__row")


def sampled(values: DataFrame, c: str) -> list:
    """Splitters between distinct values of any type that sorts: ``RANGES`` - 1 of them by the order of their hashes, sorted."""
    rows = values.select(c).orderBy(F.xxhash64(c), c).limit(RANGES - 1).collect()
    return sorted(r[0] for r in rows)


def between(values: DataFrame, c: str, splitters: list) -> DataFrame:
    """Adds ``range``, from 0, by ``splitters`` that are stated in the plan."""
    if not splitters:
        return values.withColumn("range", F.lit(0))
    heads = F.array(*map(F.lit, splitters[SIDE - 1 :: SIDE])) if len(splitters) >= SIDE else F.slice(F.array(F.lit(splitters[0])), 1, 0)
    rows = F.array(*(F.array(*map(F.lit, splitters[k : k + SIDE - 1])) if splitters[k : k + SIDE - 1] else F.slice(F.array(F.lit(splitters[0])), 1, 0) for k in range(0, len(splitters) + 1, SIDE)))
    met = values.withColumn("__row", _under(heads, c))
    return met.withColumn("range", F.col("__row") * SIDE + _under(rows[F.col("__row")], c)).drop("__row")


def before(counts: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Adds ``before_x`` for each of ``columns``: its sum over lower ranges of the group; a group has ``RANGES`` rows at most."""
    w = Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    return counts.select(*by, "range", *(F.coalesce(F.sum(c).over(w), F.lit(0)).alias(f"before_{c}") for c in columns))


def exact_percentiles(rows: DataFrame, shares: tuple[float, ...]) -> DataFrame:
    """``feature, q``: percentiles (linear between values) of rows (feature, value), at each of ``shares``."""
    values = rows.where(present("value")).groupBy("feature", "value").agg(F.count("*").alias("n"))
    values = ranged(values, ["feature"], "value")
    ranges = values.groupBy("feature", "range").agg(F.sum("n").alias("n"))
    group = Window.partitionBy("feature")  # RANGES rows at most
    lower = F.coalesce(F.sum("n").over(group.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    placed = ranges.select("feature", "range", "n", lower.alias("before_n"), F.sum("n").over(group).alias("total"))
    # the two ranks beside each percentile, and the range that holds each of them
    at = F.expr("inline(array(" + ", ".join(f"named_struct('share', {k}, 'at', {s!r}D * (total - 1))" for k, s in enumerate(shares)) + "))")
    return _interpolated(_at_ranks(values, placed.select("feature", "range", "n", "before_n", at), ["feature"]))


def _at_ranks(values: DataFrame, placed: DataFrame, by: list[str]) -> DataFrame:
    """``feature, share, at, lo, hi``: the values (with range and n) at the ranks beside ``at``, from each group's ranges with ``before_n``."""
    held = placed.withColumn("rank", F.explode(F.array_distinct(F.array(F.floor("at"), F.ceil("at"))))).where("rank >= before_n and rank < before_n + n")
    wanted = held.groupBy(*by, "range", "before_n").agg(F.collect_list(F.struct(F.col("share").alias("of"), "at", "rank")).alias("wanted"))
    inside = Window.partitionBy(*by, "range").orderBy("value").rowsBetween(Window.unboundedPreceding, -1)
    near = values.join(F.broadcast(wanted), [*by, "range"])  # two rows for each percentile
    near = near.select(*by, "value", "n", "wanted", (F.col("before_n") + F.coalesce(F.sum("n").over(inside), F.lit(0))).alias("first"))
    found = near.select("feature", "value", "n", "first", F.inline("wanted")).where("rank >= first and rank < first + n")
    return found.groupBy("feature", F.col("of").alias("share"), "at").agg(F.min_by("value", "rank").alias("lo"), F.max_by("value", "rank").alias("hi"))


def _interpolated(ends: DataFrame) -> DataFrame:
    part = F.col("at") - F.floor("at")
    stays = (part == 0) | (F.col("lo") == F.col("hi")) | (F.col("lo") == float("-inf")) & (F.col("hi") != float("inf"))
    between = F.when(stays, F.col("lo")).otherwise(F.col("lo") + part * (F.col("hi") - F.col("lo")))
    return ends.groupBy("feature").agg(F.transform(F.array_sort(F.collect_list(F.struct("share", between.alias("v")))), lambda s: s["v"]).alias("q"))


def brackets(df: DataFrame, columns: list[str], shares: tuple[float, ...]) -> dict[str, tuple[int, list[tuple[float, float]]]]:
    """By column with values: how many it has, and for each of ``shares`` an interval around the percentile."""
    at = [min(1.0, max(0.0, s + side)) for s in shares for side in (-REACH, REACH)]
    number = lambda c: F.when(present(c), F.col(c).cast("double"))
    row = df.select(*(number(c).alias(f"c{k}") for k, c in enumerate(columns)))
    row = row.agg(*(f(f"c{k}").alias(f"{name}{k}") for k in range(len(columns)) for name, f in (("n", F.count), ("k", lambda c: F.kll_sketch_agg_double(c, COARSE)))))
    quantiles = F.array(*map(F.lit, at))
    row = row.select(*(c for k in range(len(columns)) for c in (f"n{k}", F.when(F.col(f"n{k}") > 0, F.kll_sketch_get_quantile_double(f"k{k}", quantiles)).alias(f"q{k}")))).first()
    every = [(float("-inf"), float("inf"))] * len(shares)
    return {c: (row[f"n{k}"], every if row[f"n{k}"] <= FEW else [*zip(row[f"q{k}"][::2], row[f"q{k}"][1::2], strict=True)]) for k, c in enumerate(columns) if row[f"n{k}"]}


def column_percentiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], found: dict | None = None) -> DataFrame:
    """``exact_percentiles`` of columns. ``df`` is read twice, so it should be a table or cheap; ``found`` are its ``brackets``."""
    spark = df.sparkSession
    found = brackets(df, columns, shares) if found is None else found
    ends = [(c, k, s * (n - 1), float(lo), float(hi)) for c, (n, own) in found.items() for k, (s, (lo, hi)) in enumerate(zip(shares, own, strict=True))]
    sides = F.broadcast(spark.createDataFrame(ends, "feature string, share int, at double, lo double, hi double"))  # columns x shares rows
    near = as_rows(df, columns).where(present("value")).join(sides, "feature").where("value <= hi")
    counts = near.groupBy("feature", "share", "at", F.when(F.col("value") >= F.col("lo"), F.col("value")).alias("value")).agg(F.count("*").alias("n"))
    with settled(counts) as counts:
        sums = counts.groupBy("feature", "share", "at").agg(F.coalesce(F.sum(F.when(F.col("value").isNull(), F.col("n"))), F.lit(0)).alias("below"), F.coalesce(F.sum(F.when(F.col("value").isNotNull(), F.col("n"))), F.lit(0)).alias("inside")).collect()
        missed = {r.feature for r in sums if not (r.below <= math.floor(r.at) and math.ceil(r.at) < r.below + r.inside)}
        missed |= {c for c in found if sum(r.feature == c for r in sums) < len(shares)}
        by = ["feature", "share"]
        values = ranged(counts.where(F.col("value").isNotNull() & ~F.col("feature").isin([*missed])), by, "value")
        ranges = values.groupBy(*by, "range").agg(F.sum("n").alias("n"))
        starts = F.broadcast(spark.createDataFrame([(r.feature, r.share, r.at, r.below) for r in sums], "feature string, share int, at double, below long"))
        lower = F.coalesce(F.sum("n").over(Window.partitionBy(*by).orderBy("range").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # RANGES rows at most
        placed = ranges.join(starts, by).select(*by, "range", "n", "at", (F.col("below") + lower).alias("before_n"))
        rows = _interpolated(_at_ranks(values, placed, by)).collect() if len(missed) < len(found) else []  # a row for each column
    if missed:
        rows += exact_percentiles(as_rows(df, sorted(missed)), shares).collect()
    return spark.createDataFrame([(r.feature, list(r.q)) for r in rows], "feature string, q array<double>")


def as_rows(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, value`` rows of many columns."""
    return df.select(*(F.col(c).cast("double").alias(c) for c in columns)).unpivot([], columns, "feature", "value")
