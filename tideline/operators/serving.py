"""Rules of requests and scores: tiers, row checks, summaries and checks of a scored file."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.functions.series import SPARK, shown
from tideline.operators.ranks import column_percentiles
from tideline.plans.schema import GROUPS, INFLOW, OUTFLOW

#: Bounds of the tiers, the slack of amounts, and the parameters of the balance-lag flag and of directions.
MEDIUM, HIGH, SLACK, LAG, DIRECTION = 0.25, 0.60, 0.01, 1000, 500
MAX_BATCH, STRESSED, BASE_RATE, MAX_SHIFT = 500, 0.5, 0.15, 0.10


def risk_tier(p: str = "p") -> Column:
    return F.when(F.col(p) < MEDIUM, "low").when(F.col(p) < HIGH, "medium").otherwise("high")


def batch_summary(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Tier counts, the stressed share and whether it has shifted from the base rate."""
    tier = risk_tier()
    rate = F.avg((F.col("p") > STRESSED).cast("int"))
    return scored.agg(F.count("*").alias("n"), *(F.count_if(tier == t).alias(f"n_{t}") for t in ("low", "medium", "high")), F.round(rate, digits).alias("stress_rate"), (F.abs(rate - BASE_RATE) > MAX_SHIFT).alias("shifted"))


def check_batch(requests: DataFrame) -> None:
    """A batch holds 1 to 500 requests."""
    if not 1 <= (n := requests.limit(MAX_BATCH + 1).count()) <= MAX_BATCH:
        raise ValueError(f"a batch holds 1 to {MAX_BATCH} requests, not {n if n <= MAX_BATCH else f'over {MAX_BATCH}'}")


def violations(customers: DataFrame) -> DataFrame:
    """``id, n_amount`` (months whose highest amount exceeds the total) and ``n_entities`` (more entities than events)."""
    amount = [f"cast({g}.hi[{i}] > {g}.val[{i}] + {SLACK} and {g}.hi[{i}] > 0 and {g}.val[{i}] > 0 as int)" for g in GROUPS for i in range(6)]
    more = [f"cast({g}.ent[{i}] > {g}.vol[{i}] as int)" for g in GROUPS for i in range(6)]
    return customers.selectExpr("id", " + ".join(amount) + " as n_amount", " + ".join(more) + " as n_entities")


def balance_lag(customers: DataFrame) -> DataFrame:
    """Balances that hold while the inflow has fallen to less than half."""
    first, last = (" + ".join(f"{g}.val[{i}]" for g in INFLOW) for i in (0, 5))
    return customers.selectExpr("id", f"bal[0] >= bal[5] - {LAG} and {last} > 0 and ({first}) < 0.5 * ({last}) as balance_lag")


def input_summary(customers: DataFrame) -> DataFrame:
    """What an answer says about its input: balances, six-month sums, recency of deposits, last month's volumes."""
    x = SPARK
    last = lambda groups, a: " + ".join(x.at(f"{g}.{a}", 0) for g in groups)
    recency = x.ratio(x.mean("deposit.val", 0, 3), x.mean("deposit.val", 3, 6))
    change = f"({x.at('bal', 0)} - {x.at('bal', 5)})"
    return customers.selectExpr(
        "id", f"round({x.at('bal', 0)}, 4) as m1_daily_avg_bal", f"round({x.at('bal', 5)}, 4) as m6_daily_avg_bal", f"round({x.total('deposit.val')}, 2) as total_deposit_6m", f"round({x.total('withdraw.val')}, 2) as total_withdraw_6m",
        f"{shown(recency)} as deposit_m1_vs_m46_ratio", f"{last(INFLOW, 'vol')} as recent_inflow_volume", f"{last(OUTFLOW, 'vol')} as recent_outflow_volume", f"{last(GROUPS, 'ent')} as network_breadth_m1",
        f"case when {change} > {DIRECTION} then 'improving' when {change} < -{DIRECTION} then 'deteriorating' when {change} is not null then 'stable' end as balance_trend_direction",
    )


def out_of_bounds(requests: DataFrame, numbers: list[str], texts: dict[str, int]) -> DataFrame:
    """Rows with what is wrong in them: negative numbers, and texts beyond their length."""
    wrong = [F.when(F.col(c) < 0, F.lit(f"{c}: negative")) for c in numbers] + [F.when(F.length(c) > n, F.lit(f"{c}: over {n} characters")) for c, n in texts.items()]
    return requests.withColumn("errors", F.array_compact(F.array(*wrong))).where(F.size("errors") > 0)


def submission_checks(scored: DataFrame, expected: int) -> DataFrame:
    """Six checks of a file ``ID, Target, TargetLogLoss, TargetRAUC`` in one pass."""
    columns = ("Target", "TargetLogLoss", "TargetRAUC")
    some = lambda f: F.coalesce(F.max(sum(f(F.col(c)).cast("int") for c in columns)), F.lit(0)) == 0
    return scored.agg(
        (F.count("*") == expected).alias("rows_as_expected"), (F.count_distinct("ID") == F.count("*")).alias("ids_unique"), some(lambda c: c.isNull() | F.isnan(c)).alias("no_missing"), some(lambda c: F.coalesce(F.abs(c) == float("inf"), F.lit(False))).alias("no_infinite"),
        some(lambda c: F.coalesce((c < 0) | (c > 1), F.lit(False))).alias("in_range"), (F.count_if((F.col("Target") != F.col("TargetLogLoss")) | (F.col("Target") != F.col("TargetRAUC"))) == 0).alias("columns_equal"),
    )


def score_report(scored: DataFrame, digits: int = 6) -> DataFrame:
    """Provenance figures of a scored file."""
    q = (0.1, 0.25, 0.5, 0.75, 0.9)
    out = scored.agg(F.count("*").alias("n"), F.avg("p").alias("mean"), F.stddev_pop("p").alias("std"), F.min("p").alias("min"), F.max("p").alias("max"), F.avg((F.col("p") > 0.3).cast("int")).alias("over_30"), F.avg((F.col("p") > 0.5).cast("int")).alias("over_50"))
    out = out.join(column_percentiles(scored, ["p"], q).select("q"), F.lit(True), "left")  # one row each, or none where no score is a number
    return out.select("n", *(F.round(c, digits).alias(c) for c in ("mean", "std", "min", "max")), *(F.round(F.col("q")[i], digits).alias(f"p{int(100 * s)}") for i, s in enumerate(q)), F.round("over_30", digits).alias("over_30"), F.round("over_50", digits).alias("over_50"))


def ensemble_integrity(weights: DataFrame, fold_models: DataFrame, n_folds: int = 5) -> DataFrame:
    """Weights (model, weight) that sum to 1 and as many fold models (model, fold) of each as there are folds."""
    folds = fold_models.groupBy("model").agg(F.count_distinct("fold").alias("n"))
    joined = weights.join(folds, "model", "left")
    return joined.agg((F.abs(F.sum("weight") - 1) <= 1e-4).alias("weights_sum"), (F.count_if(F.coalesce("n", F.lit(0)) != n_folds) == 0).alias("folds_complete"))
