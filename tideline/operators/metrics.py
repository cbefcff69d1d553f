"""Metrics of scored rows ``y`` (0 or 1) and ``p``, calibration bins and threshold sweeps.

``evaluate`` and ``auc`` leave out rows without a label or a score (null or NaN).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.ranks import as_rows, before, column_percentiles, exact_percentiles, present, ranged

#: The clip of probabilities in the log loss and the weights of the composite score.
TINY, LOSS, RANK = 1e-15, 0.6, 0.4


def clipped(p: str = "p", eps: float = TINY) -> Column:
    return F.least(F.greatest(F.col(p), F.lit(eps)), F.lit(1 - eps))


def log_loss(p: str = "p") -> Column:
    x = clipped(p)
    return -F.avg(F.when(F.col("y") == 1, F.ln(x)).otherwise(F.log1p(-x)))


def brier(p: str = "p") -> Column:
    return F.avg((F.col(p) - F.col("y")) * (F.col(p) - F.col("y")))


def known(scored: DataFrame) -> DataFrame:
    """The rows that have a label and a score."""
    return scored.where(F.col("y").isNotNull() & present("p"))


def auc(scored: DataFrame, *by: str) -> DataFrame:
    """``by, auc``: ties count half; null where a class is absent.

    Rows are summed up by score, then by range of scores; a running count is kept inside a range alone.
    """
    n1, n0 = F.sum("y").cast("double"), F.sum(1 - F.col("y")).cast("double")
    scores = ranged(known(scored).groupBy(*by, "p").agg(n1.alias("n1"), n0.alias("n0")), [*by], "p", known(scored))
    below = before(scores.groupBy(*by, "range").agg(F.sum("n0").alias("n0")), [*by], ["n0"])
    inside = Window.partitionBy(*by, "range").orderBy("p").rowsBetween(Window.unboundedPreceding, -1)
    ahead = F.coalesce(F.sum("n0").over(inside), F.lit(0.0)) + F.col("n0") / 2
    pairs = scores.withColumn("ahead", ahead).join(F.broadcast(below), [*by, "range"]).select(*by, "n1", "n0", (F.col("n1") * (F.col("before_n0") + F.col("ahead"))).alias("won"))
    return pairs.groupBy(*by).agg(F.try_divide(F.sum("won"), F.sum("n1") * F.sum("n0")).alias("auc"))


def composite(loss: Column, area: Column) -> Column:
    return LOSS * loss + RANK * (1 - area)


def evaluate(scored: DataFrame, *by: str, digits: int = 6) -> DataFrame:
    """Log loss, AUC, Brier score and composite, by group."""
    scored = known(scored)
    sums = scored.groupBy(*by).agg(F.count("*").alias("n"), log_loss().alias("logloss"), brier().alias("brier"))
    area = auc(scored, *by)
    both = sums.join(area, list(by)) if by else sums.crossJoin(area)  # one row each
    return both.select(*by, "n", *(F.round(c, digits).alias(n) for n, c in (("logloss", F.col("logloss")), ("auc", F.col("auc")), ("brier", F.col("brier")), ("composite", composite(F.col("logloss"), F.col("auc"))))))


def calibration_bins(scored: DataFrame, n: int = 10, digits: int = 6) -> DataFrame:
    """Uniform bins, closed on the right: mean score and observed rate; empty bins have no row."""
    b = F.least(F.greatest(F.ceil(F.col("p") * n) - 1, F.lit(0)), F.lit(n - 1)).cast("int")
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("p"), digits).alias("mean_p"), F.round(F.avg("y"), digits).alias("rate"))


def confusion(scored: DataFrame, steps: int = 50, digits: int = 6) -> DataFrame:
    """Counts at thresholds 0 to 1 and precision and recall with a guard of 1e-6.

    Scores are counted by the last threshold that they reach first; a running sum over the thresholds does the rest.
    """
    spark = scored.sparkSession
    reach = F.least(F.greatest(F.floor(F.col("p") * (steps - 1)), F.lit(-1)), F.lit(steps - 1)).cast("int")
    up = F.when((reach + 1).cast("double") / (steps - 1) <= F.col("p"), reach + 1).when(reach.cast("double") / (steps - 1) > F.col("p"), reach - 1).otherwise(reach)
    counts = scored.groupBy(F.least(up, F.lit(steps - 1)).alias("i")).agg(F.sum("y").alias("n1"), F.sum(1 - F.col("y")).alias("n0"))
    every = spark.range(-1, steps).select(F.col("id").cast("int").alias("i")).join(counts, "i", "left").fillna(0, ["n1", "n0"])
    w = Window.orderBy(F.col("i").desc())  # over the thresholds
    run = every.select("i", F.sum("n1").over(w).alias("tp"), F.sum("n0").over(w).alias("fp"), F.sum("n1").over(Window.partitionBy()).alias("pos"), F.sum("n0").over(Window.partitionBy()).alias("neg")).where("i >= 0")
    return run.select("i", F.round(F.col("i") / (steps - 1), digits).alias("threshold"), "tp", "fp", (F.col("pos") - F.col("tp")).alias("fn"), (F.col("neg") - F.col("fp")).alias("tn"), F.round(F.col("tp") / (F.col("tp") + F.col("fp") + 1e-6), digits).alias("precision"), F.round(F.col("tp") / (F.col("pos") + 1e-6), digits).alias("recall"))


def quantile_bins(scored: DataFrame, n: int = 5, digits: int = 6) -> DataFrame:
    """Bins between exact quantiles, closed on the right, the least value in the first: size and observed rate."""
    found = column_percentiles(scored, ["p"], tuple(k / n for k in range(1, n))).first()
    edges = found.q if found else []
    b = sum((F.when(F.col("p") > F.lit(float(e)), 1).otherwise(0) for e in edges), F.lit(0))
    return scored.groupBy(b.alias("bin")).agg(F.count("*").alias("n"), F.round(F.avg("y"), digits).alias("rate"))


def over_folds(by_fold: DataFrame, columns: list[str], digits: int = 6) -> DataFrame:
    """``metric, mean, std`` (population) of scores by fold."""
    rows = as_rows(by_fold, columns).withColumnRenamed("feature", "metric")
    return rows.groupBy("metric").agg(F.round(F.avg("value"), digits).alias("mean"), F.round(F.stddev_pop("value"), digits).alias("std"))


def misjudged(scored: DataFrame, kind: str, threshold: float = 0.5) -> DataFrame:
    """Rows that a threshold gets wrong: ``fn`` (positives below it) or ``fp`` (negatives above it)."""
    wrong = {"fn": (F.col("y") == 1) & (F.col("p") < threshold), "fp": (F.col("y") == 0) & (F.col("p") > threshold)}
    return scored.where(wrong[kind])


def running_median(steps: DataFrame) -> DataFrame:
    """``step, median`` of rows (step, score): what a trial must beat at a step, or it is pruned."""
    found = exact_percentiles(steps.select(F.col("step").cast("string").alias("feature"), F.col("score").cast("double").alias("value")), (0.5,))
    return found.select(F.col("feature").cast("int").alias("step"), F.col("q")[0].alias("median"))
