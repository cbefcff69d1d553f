"""Importances of features: means over folds, themes, segments, subsets, and permutation importance of a fitted model."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

#: A feature's theme is the first one with a word that its name holds.
THEMES = (
    ("Balance Deterioration", ("balance", "drawdown", "reserve", "cash")),
    ("Spending Stress", ("withdraw", "spend", "payment")),
    ("Income Stability", ("deposit", "income", "inflow")),
    ("Behavioral Instability", ("volatility", "std", "variance")),
    ("Temporal Deterioration", ("trend", "slope", "delta", "change")),
    ("Engagement Dynamics", ("activity", "engagement", "frequency", "recency")),
    ("Balance Deterioration", ("daily_avg_bal",)),
)


def theme(c: str = "feature") -> Column:
    out, name = F.lit("Other"), F.lower(c)
    for label, words in reversed(THEMES):
        out = F.when(name.rlike("|".join(words)), label).otherwise(out)
    return out


def mean_importance(by_fold: DataFrame) -> DataFrame:
    """``feature, mean_importance`` of rows (feature, importance, fold), the largest first."""
    return by_fold.groupBy("feature").agg(F.avg("importance").alias("mean_importance")).orderBy(F.desc("mean_importance"), "feature")


def theme_summary(importances: DataFrame, digits: int = 6) -> DataFrame:
    total = importances.agg(F.sum("mean_importance").alias("total"))
    by = importances.groupBy(theme().alias("theme")).agg(F.count("*").alias("n_features"), F.sum("mean_importance").alias("s"))
    return by.crossJoin(total).select("theme", "n_features", F.round("s", digits).alias("importance"), F.round(F.try_divide("s", "total"), digits).alias("share"))  # total: one row


def segment_summary(values: DataFrame, columns: list[str], by: str, digits: int = 6) -> DataFrame:
    """``by, feature, importance``: mean absolute values of columns within each segment."""
    row = values.groupBy(by).agg(*(F.round(F.avg(F.abs(c)), digits).alias(c) for c in columns))
    return row.unpivot([by], columns, "feature", "importance")


def top_features(importances: DataFrame, k: int) -> DataFrame:
    return importances.orderBy(F.desc("mean_importance"), "feature").limit(k)


def subsets(importances: DataFrame, sizes: tuple[int, ...]) -> DataFrame:
    """``k, rank, feature, theme, mean_importance``: the ``k`` strongest features for each size."""
    most = top_features(importances, max(sizes))
    first = most.select(F.row_number().over(Window.orderBy(F.desc("mean_importance"), "feature")).alias("rank"), "feature", theme().alias("theme"), "mean_importance")  # as many rows as the largest size
    return first.withColumn("k", F.explode(F.array(*map(F.lit, sizes)))).where("rank <= k").select("k", "rank", "feature", "theme", "mean_importance")


def mean_absolute(values: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``feature, mean_importance``: mean absolute values of columns (such as attributions)."""
    row = values.agg(*(F.round(F.avg(F.abs(c)), digits).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "mean_importance")


def permutation_importance(data: DataFrame, columns: list[str], score: Callable[[DataFrame], DataFrame], metric: Callable[[DataFrame], float], key: str = "id", seed: int = 42, rows_a_range: int = 100_000) -> list[tuple[str, float]]:
    """What a metric loses when a column's values are dealt anew among the rows.

    Values go to other rows by rank: both sides are numbered in hash ranges and joined by range and rank, so nothing is
    sorted in one task. Rows of a range without a counterpart keep their value.
    """
    base, out = metric(score(data)), []
    ranges = max(64, data.count() // rows_a_range)
    for i, c in enumerate(columns):
        number = lambda df, salt: df.withColumn("__b", F.pmod(F.xxhash64(key, F.lit(salt)), F.lit(ranges))).withColumn("__k", F.row_number().over(Window.partitionBy("__b").orderBy(F.xxhash64(key, F.lit(salt + 1)), key)))
        given = number(data.select(key, F.col(c).alias("__v")), 2 * i + 1000 * seed).select("__b", "__k", "__v")
        mixed = number(data, 2 * i + 1000 * seed + 500).join(given, ["__b", "__k"], "left").withColumn(c, F.coalesce("__v", F.col(c))).drop("__b", "__k", "__v")
        out.append((c, base - metric(score(mixed))))
    return out
