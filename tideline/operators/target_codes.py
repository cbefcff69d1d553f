"""Ordered target statistics: a category's code is the mean target of earlier rows, so no row's code sees its own target.

Rows are ordered by a hash of their id. The order is cut into hash ranges: counts by category and range come first, their
running sums over the ranges give what lies before a range, and only the rows of one category and range are counted
through one by one. So a category that holds a third of all rows is spread over all ranges.

With folds there is a code for each model: it counts the rows of the folds that the model is trained on, and a held-out
row gets the statistic of all of these. A null category is the category 'nan'; rows without a target count for nothing.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators import boosting


def _value(c: str) -> Column:
    return F.coalesce(F.col("`" + c.replace("`", "``") + "`").cast("string"), F.lit("nan"))


def code_names(c: str, n_models: int) -> list[str]:
    return [f"{c}|{k}" for k in range(n_models)]


def priors(df: DataFrame, n_models: int) -> list[float]:
    """The mean target of the rows that each model is trained on: of the other folds, or of all rows for a single model."""
    found = {r.fold: (r.s, r.n) for r in df.where("y is not null").groupBy("fold").agg(F.sum("y").alias("s"), F.count("*").alias("n")).collect()}
    sums = [[sum(v[i] for of, v in found.items() if of != k or n_models == 1) for i in (0, 1)] for k in range(n_models)]
    return [s / n if n else 0.0 for s, n in sums]


def _codes(sums: list[Column], counts: list[Column], prior: Sequence[float], weight: float) -> list[Column]:
    """Codes from sums and counts by fold: those of the other folds."""
    others = lambda x, k: sum((c for j, c in enumerate(x) if j != k or len(x) == 1), F.lit(0))
    return [(others(sums, k) + weight * p) / (others(counts, k) + weight) for k, p in enumerate(prior)]


def _of_folds(n_models: int) -> list[tuple[Column, Column]]:
    """For each fold its targets and whether a row counts; without folds all rows are one."""
    own = lambda j: F.col("y").isNotNull() & ((F.col("fold") == j) if n_models > 1 else F.lit(True))
    return [(F.when(own(j), F.col("y")).otherwise(0).cast("long"), own(j).cast("long")) for j in range(n_models)]


def totals(df: DataFrame, c: str, n_models: int) -> DataFrame:
    """``value`` and the sums ``s0, n0, ...`` of its targets and rows by fold: what codes new rows."""
    parts = _of_folds(n_models)
    return df.withColumn("value", _value(c)).groupBy("value").agg(*(x for j, (s, n) in enumerate(parts) for x in (F.sum(s).alias(f"s{j}"), F.sum(n).alias(f"n{j}"))))


def ordered_codes(df: DataFrame, c: str, n_models: int, prior: Sequence[float], weight: float = 1.0, seed: int = 42, rows_a_range: int = 50_000) -> DataFrame:
    """``id`` and a code for each model (``code_names``) of rows (id, y, fold, c); ``weight`` rows count as the prior."""
    bits = max(2, min(20, (df.count() // rows_a_range).bit_length()))
    parts = _of_folds(n_models)
    names = [f"{x}{j}" for j in range(n_models) for x in ("s", "n")]
    rows = df.select("id", "y", "fold", _value(c).alias("value"), F.xxhash64("id", F.lit(seed)).alias("h"))
    rows = rows.withColumns(dict(zip(names, (x for part in parts for x in part), strict=True))).withColumn("range", F.shiftright("h", 64 - bits))
    counts = rows.groupBy("value", "range").agg(*(F.sum(x).alias(x) for x in names))
    category = Window.partitionBy("value")  # a row for each range
    lower = category.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("value", "range", *(F.coalesce(F.sum(x).over(lower), F.lit(0)).alias(f"before_{x}") for x in names), *(F.sum(x).over(category).alias(f"all_{x}") for x in names))
    inside = Window.partitionBy("value", "range").orderBy("h", "id").rowsBetween(Window.unboundedPreceding, -1)
    met = rows.select("id", "fold", "value", "range", *(F.coalesce(F.sum(x).over(inside), F.lit(0)).alias(x) for x in names)).join(counts, ["value", "range"])
    running = [[F.col(f"{x}{j}") + F.col(f"before_{x}{j}") for j in range(n_models)] for x in ("s", "n")]
    whole = [[F.col(f"all_{x}{j}") for j in range(n_models)] for x in ("s", "n")]
    seen, out = _codes(*running, prior, weight), _codes(*whole, prior, weight)
    return met.select("id", *((F.when(F.col("fold") == k, out[k]).otherwise(seen[k]) if n_models > 1 else seen[k]).alias(name) for k, name in enumerate(code_names(c, n_models))))


def coded(df: DataFrame, c: str, table: DataFrame, prior: Sequence[float], weight: float = 1.0) -> DataFrame:
    """New rows with each model's code by ``totals``; a category that wasn't there has the prior."""
    n = len(prior)
    sums, counts = ([F.coalesce(F.col(f"{x}{j}"), F.lit(0)) for j in range(n)] for x in ("s", "n"))
    met = df.withColumn("value", _value(c)).join(table, "value", "left")
    return met.select(*(F.col("`" + x.replace("`", "``") + "`") for x in df.columns), *(x.alias(name) for x, name in zip(_codes(sums, counts, prior, weight), code_names(c, n), strict=True)))


def fit_symmetric(data: DataFrame, numeric: Sequence[str], categories: Sequence[str], s: boosting.Boosting, n_folds: int, weight: float = 1.0) -> tuple[list[boosting.Model], DataFrame]:
    """Models over numbers and ordered codes, each with its own folds' codes, and ``data`` with the codes.

    ``data`` has id, y and fold.
    """
    prior = priors(data, n_folds)
    full = data
    for c in categories:
        full = full.join(ordered_codes(data, c, n_folds, prior, weight, s.seed), "id")
    codes = [name for c in categories for name in code_names(c, n_folds)]
    uses = [[*numeric, *(code_names(c, n_folds)[k] for c in categories)] for k in range(n_folds)]
    return boosting.fit(full, [*numeric, *codes], s, n_folds, uses=uses), full
