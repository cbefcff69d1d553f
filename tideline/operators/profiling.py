"""Profiles of a table's columns. Many columns are summed up in one pass and then turned into rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranks import as_rows as long
from tideline.operators.ranks import column_percentiles


def missing_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    row = df.agg(*(F.avg(F.col(c).isNull().cast("int")).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "missing_rate")


def duplicate_keys(df: DataFrame, *keys: str) -> DataFrame:
    """Rows, distinct keys, and rows that repeat a key."""
    by_key = df.groupBy(*keys).agg(F.count("*").alias("n"))
    return by_key.agg(F.sum("n").alias("n_rows"), F.count("*").alias("n_keys"), (F.sum("n") - F.count("*")).alias("n_repeats"))


def describe(df: DataFrame, columns: list[str], digits: int = 4, shares: tuple[float, ...] = (0.25, 0.5, 0.75)) -> DataFrame:
    """count, mean, sample deviation, extremes and percentiles (linear between values; quartiles as given) by feature."""
    rows = long(df, columns)
    out = rows.groupBy("feature").agg(F.count("value").alias("n"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"), F.min("value").alias("min"), F.max("value").alias("max"))
    names = [f"p{100 * s:g}".replace(".", "_") for s in shares]
    out = out.join(F.broadcast(column_percentiles(df, columns, shares)), "feature", "left")
    return out.select("feature", "n", *(F.round(c, digits).alias(c) for c in ("mean", "std", "min", "max")), *(F.round(F.col("q")[i], digits).alias(n) for i, n in enumerate(names)))


def sample_skewness(c: str) -> Column:
    """Bias-corrected skewness, from the population one; null for fewer than three values."""
    n = F.count(c).cast("double")
    return F.try_divide(F.skewness(c) * F.sqrt(n * (n - 1)), n - 2)


def summary(df: DataFrame, columns: list[str], digits: int = 4) -> DataFrame:
    """Missing and zero shares, moments, extremes and both skewnesses by feature."""
    x = long(df, columns)
    out = x.groupBy("feature").agg(
        F.avg(F.col("value").isNull().cast("int")).alias("missing_rate"), F.avg((F.col("value") == 0).cast("int")).alias("zero_rate"), F.avg("value").alias("mean"), F.stddev_samp("value").alias("std"),
        F.min("value").alias("min"), F.max("value").alias("max"), sample_skewness("value").alias("skew"), F.skewness("value").alias("skew_pop"),
    )
    return out.select("feature", *(F.round(c, digits).alias(c) for c in out.columns[1:]))


def iqr_outliers(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of values beyond 1.5 interquartile ranges from the quartiles: bounds first, then one pass."""
    x = long(df, columns).where("value is not null")
    q = column_percentiles(df, columns, (0.25, 0.75)).select("feature", F.col("q")[0].alias("q1"), F.col("q")[1].alias("q3"))
    reach = 1.5 * (F.col("q3") - F.col("q1"))
    outside = (F.col("value") < F.col("q1") - reach) | (F.col("value") > F.col("q3") + reach)
    return x.join(F.broadcast(q), "feature").groupBy("feature").agg(F.round(F.avg(outside.cast("int")), 6).alias("outlier_rate"))


def value_shares(df: DataFrame, c: str) -> DataFrame:
    counts = df.groupBy(c).agg(F.count("*").alias("n"))
    total = df.agg(F.count("*").alias("total"))
    return counts.crossJoin(total).select(c, "n", F.round(F.col("n") / F.col("total"), 6).alias("share"))  # total: one row


def prefix_counts(columns: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(c,) for c in columns], "feature string").groupBy(F.split("feature", "_")[0].alias("prefix")).agg(F.count("*").alias("n"))


def correlations(df: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """Pearson correlation of all pairs of columns (not of rows), in one pass."""
    pairs = [(a, b) for i, a in enumerate(columns) for b in columns[i + 1 :]]
    row = df.agg(*(F.corr(a, b).alias(f"{a}|{b}") for a, b in pairs))
    parts = F.array(*(F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.round(F.col(f"`{a}|{b}`"), digits).alias("r")) for a, b in pairs))
    return row.select(F.explode(parts).alias("x")).select("x.*")


def correlation_range(pairs: DataFrame, clusters: dict[str, str], digits: int = 6) -> DataFrame:
    """``cluster, n_pairs, least, most`` of correlations (a, b, r): pairs within a cluster, and those across as 'across'."""
    of = F.create_map(*(F.lit(x) for kv in clusters.items() for x in kv))
    cluster = F.when(of[F.col("a")] == of[F.col("b")], of[F.col("a")]).otherwise("across")
    return pairs.groupBy(cluster.alias("cluster")).agg(F.count("*").alias("n_pairs"), F.round(F.min("r"), digits).alias("least"), F.round(F.max("r"), digits).alias("most"))
