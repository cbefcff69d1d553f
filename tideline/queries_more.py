"""Registered queries over scoring, ensembles, small relational steps and the whole feature frame."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline import frame_sql
from tideline.operators import features, importance, learning, metrics, models, profiling, scoring, serving
from tideline.operators.series import raw_names
from tideline.plans.panel import customers, table, wide_columns, wide_panel
from tideline.plans.panel import zero_rates as zero_rate_rows
from tideline.plans.schema import ENTITIES, GROUPS
from tideline.plans.settled import kept
from tideline.queries import _AUC, _FOLD, _LINES, _LL, _NAMES, _SCORED, _over, _rows_of, _wide, dealt, query, scored
from tideline.sources import tables

_ABC = ["a", "b", "c"]


# ---------------------------------------------------------------- rows and columns


@query(f"with {_SCORED} select id, y, round(p, 6) as p, case when y = 1 then 'fn' else 'fp' end as kind from e where (y = 1 and p < 0.5) or (y = 0 and p > 0.5)")
def misjudged_rows(spark, sf_dir):
    e = scored(spark, sf_dir).select("id", "y", "p")
    both = metrics.misjudged(e, "fn").withColumn("kind", F.lit("fn")).unionAll(metrics.misjudged(e, "fp").withColumn("kind", F.lit("fp")))
    return both.withColumn("p", F.round("p", 6))


_FEATURES = sorted(raw_names())


@query("select feature from (select unnest([{}]) as feature) where regexp_matches(feature, 'vol|avg_txn|unique')".format(", ".join(f"'{c}'" for c in _FEATURES)))
def names_matching(spark, sf_dir):
    return spark.createDataFrame([(c,) for c in _FEATURES], "feature string").where(F.col("feature").rlike("vol|avg_txn|unique"))


_RATE = _over(_rows_of(_NAMES, "avg(cast({c} = 0 as int)) as zero_rate"), _wide(_NAMES))


@query(f"select feature, round(zero_rate, 6) as zero_rate from ({_RATE}) where regexp_matches(feature, 'vol|unique|senders')")
def zero_rates_matching(spark, sf_dir):
    """Zero rates of the panel's columns whose names match a pattern."""
    rates = zero_rate_rows(spark, sf_dir).where(F.col("feature").rlike("vol|unique|senders"))
    return rates.withColumn("zero_rate", F.round("zero_rate", 6))


@query(f"select split_part(feature, '_', 1) as prefix, count(*) as n, round(avg(zero_rate), 6) as zero_rate from ({_RATE}) group by 1")
def zero_rates_by_prefix(spark, sf_dir):
    """The panel's columns by what their names begin with: how many, and their mean zero rate."""
    by = zero_rate_rows(spark, sf_dir).groupBy(F.split("feature", "_")[0].alias("prefix"))
    return by.agg(F.count("*").alias("n"), F.round(F.avg("zero_rate"), 6).alias("zero_rate"))


_BUSY = f"""used as (select id % 2 as half, m, g, unnest([{{'x': 'total_value', 'n': count_if(total_value > 0)}}, {{'x': 'volume', 'n': count_if(volume > 0)}}, {{'x': 'highest_amount', 'n': count_if(highest_amount > 0)}}, {{'x': {[*ENTITIES.values()]!r}[list_position({[*ENTITIES]!r}, {[*GROUPS]!r}[g + 1])], 'n': count_if(entities > 0)}}], recursive := true) from long group by 1, 2, 3),
  busy as (select half, 'm' || m || '_' || {[*GROUPS]!r}[g + 1] || '_' || x as feature from used join (select c_custkey % 2 as half, count(*) as customers from customer group by 1) using (half) where n > 0.21 * customers)"""


@query(_over("select case any_value(half) when 0 then 'even' else 'odd' end as side, feature from busy group by feature having count(*) = 1", _BUSY))
def busy_columns_difference(spark, sf_dir):
    """Transaction columns that over 21 % of one half of the customers use (even or odd ids), and no such share of the other."""
    names = [*_NAMES]
    used = wide_panel(spark, sf_dir).groupBy((F.col("ID").cast("long") % 2).alias("half")).agg(F.count("*").alias("customers"), *(F.count_if(F.col(c) > 0).alias(c) for c in names))
    busy = used.unpivot(["half", "customers"], names, "feature", "n").where("n > 0.21 * customers")
    sides = busy.groupBy("feature").agg(F.collect_set("half").alias("halves")).where("size(halves) = 1")
    return sides.select(F.when(F.col("halves")[0] == 0, "even").otherwise("odd").alias("side"), "feature")


@query("select event_id as id, event_type from events order by md5('42:' || event_id), event_id limit 100")
def seeded_sample(spark, sf_dir):
    """A sample of exactly 100 rows, the same for a seed on any cluster."""
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("id"), "event_type")
    return e.orderBy(F.md5(F.concat(F.lit("42:"), F.col("id").cast("string"))), "id").limit(100)


@query("(select 'head' as part, o_orderkey as id, o_totalprice as value from orders order by o_orderkey limit 5) union all (select 'tail', o_orderkey, o_totalprice from orders order by o_orderkey desc limit 5)")
def head_tail(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_totalprice").alias("value"))
    return o.orderBy("id").limit(5).select(F.lit("head").alias("part"), "*").unionAll(o.orderBy(F.desc("id")).limit(5).select(F.lit("tail").alias("part"), "*"))


_HEAVY = ("l_quantity", "l_extendedprice")


@query(" union all ".join(f"select '{c}' as feature, round(avg({c}), 4) as mean, " + (f"round(quantile_cont({c}, 0.95), 4) as p95, round(quantile_cont({c}, 0.99), 4) as p99, round(quantile_cont({c}, 0.999), 4) as p99_9" if c in _HEAVY else "null as p95, null as p99, null as p99_9") + " from lineitem" for c in _LINES))
def summaries_joined(spark, sf_dir):
    """Upper percentiles of some columns beside the summary of all."""
    lines = table(spark, sf_dir, "lineitem")
    high = profiling.describe(lines, [*_HEAVY], shares=(0.95, 0.99, 0.999)).select("feature", "p95", "p99", "p99_9")
    return profiling.summary(lines, [*_LINES]).select("feature", "mean").join(high, "feature", "left")


@query(_over(f"select upper(trim(coalesce(segment, 'none'))) as segment, feature, round(avg(abs(v)), 6) as importance from (select segment, unnest(['a', 'b']) as feature, unnest([a, b]) as v from e join (select event_id, user_id from events) on event_id = e.id join c on c.id = user_id) group by 1, 2", _SCORED))
def segment_importance(spark, sf_dir):
    """Each scored row's customer is looked up by id; mean absolute values by segment."""
    who = table(spark, sf_dir, "events").selectExpr("event_id as id", "user_id")
    of = customers(spark, sf_dir).select(F.col("id").alias("user_id"), F.upper(F.trim(F.coalesce("segment", F.lit("none")))).alias("segment"))
    return importance.segment_summary(scored(spark, sf_dir).join(who, "id").join(of, "user_id"), ["a", "b"], "segment")


@query("select 'customer' as side, count(*) as n from (select c_custkey from customer except select o_custkey from orders) union all select 'orders', count(*) from (select o_custkey from orders except select c_custkey from customer)")
def key_difference(spark, sf_dir):
    return tables.key_difference(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k")), table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("k")), "k", ("customer", "orders"))


@query(f"with {_SCORED}, {_FOLD} select count(*) filter (k.y is distinct from e.y) as n_unaligned from e full join k using (id)")
def alignment(spark, sf_dir):
    e = scored(spark, sf_dir)
    return tables.unaligned(e.select("id", "y"), learning.folds(e).select("id", "y"), "id", "y")


@query(f"with {_SCORED} select case when c1 = c2 then c1 else 'across' end as cluster, count(*) as n_pairs, round(min(r), 6) as least, round(max(r), 6) as most from (select 'x' as c1, 'y' as c2, corr(a, b) as r from e union all select 'x', 'x', corr(a, c) from e union all select 'y', 'x', corr(b, c) from e) group by 1")
def correlation_range(spark, sf_dir):
    return profiling.correlation_range(profiling.correlations(scored(spark, sf_dir), _ABC, 12), {"a": "x", "b": "y", "c": "x"})


@query(f"with {_SCORED} select x.a, x.b, round(x.r, 6) as r, case when x.r > 0.97 then 'too alike' when x.r > 0.95 then 'alike' else 'diverse' end as verdict from (select 'a' as a, 'b' as b, corr(a, b) as r from e union all select 'a', 'c', corr(a, c) from e union all select 'b', 'c', corr(b, c) from e) x")
def diversity(spark, sf_dir):
    return models.diversity(scored(spark, sf_dir), _ABC)


@query("select cast(o_orderkey % 5 as int) as step, round(quantile_cont(o_totalprice, 0.5), 4) as median from orders group by 1")
def running_median(spark, sf_dir):
    steps = table(spark, sf_dir, "orders").selectExpr("o_orderkey % 5 as step", "o_totalprice as score")
    return metrics.running_median(steps).withColumn("median", F.round("median", 4))


@query("select o_orderpriority as model, arg_min(o_orderkey, (o_totalprice, o_orderkey)) as best, arg_max(o_orderkey, (o_totalprice, o_orderkey)) as worst from orders group by 1")
def extreme_rows(spark, sf_dir):
    at = F.struct("o_totalprice", "o_orderkey")
    return table(spark, sf_dir, "orders").groupBy(F.col("o_orderpriority").alias("model")).agg(F.min_by("o_orderkey", at).alias("best"), F.max_by("o_orderkey", at).alias("worst"))


@query("select a, b, round(r, 6) as r from (" + " union all ".join(f"select '{a}' as a, '{b}' as b, corr({a}, {b}) as r from lineitem" for i, a in enumerate(_LINES) for b in _LINES[i + 1 :]) + ") order by abs(r) desc, a, b limit 3")
def strongest_pairs(spark, sf_dir):
    """The three pairs of columns with the largest absolute correlation."""
    return profiling.correlations(table(spark, sf_dir, "lineitem"), [*_LINES], 12).orderBy(F.abs("r").desc(), "a", "b").limit(3).withColumn("r", F.round("r", 6))


@query("with l as (select unnest(['o_orderkey', 'o_custkey', 'o_totalprice']) as name), r as (select unnest(['o_orderkey', 'o_totalprice', 'l_tax']) as name) select 'left' as side, name from (select name from l except select name from r) union all select 'right', name from (select name from r except select name from l)")
def column_difference(spark, sf_dir):
    found = features.column_difference(["o_orderkey", "o_custkey", "o_totalprice"], ["o_orderkey", "o_totalprice", "l_tax"])
    return spark.createDataFrame([(side, c) for side, names in found.items() for c in names], "side string, name string")


@query("select c_custkey as id, concat_ws('; ', case when c_acctbal < 0 then 'c_acctbal: negative' end, case when length(c_name) > 17 then 'c_name: over 17 characters' end) as errors from customer where c_acctbal < 0 or length(c_name) > 17")
def out_of_bounds(spark, sf_dir):
    found = serving.out_of_bounds(table(spark, sf_dir, "customer"), ["c_acctbal"], {"c_name": 17})
    return found.select(F.col("c_custkey").alias("id"), F.array_join("errors", "; ").alias("errors"))


# ---------------------------------------------------------------- ensembles and scoring


@query(f"with {_SCORED}, {_FOLD}, t as (select *, rank() over (partition by fold order by p) + (count(*) over (partition by fold, p) - 1) / 2.0 as r from k), m as (select fold, {_LL} as l, {_AUC} as u from t group by fold), f as (select round(l, 6) as logloss, round(u, 6) as auc, round(0.6 * l + 0.4 * (1 - u), 6) as composite from m) "
       + " union all ".join(f"select '{c}' as metric, round(avg({c}), 6) as mean, round(stddev_pop({c}), 6) as std from f" for c in ("logloss", "auc", "composite")))
def fold_mean_std(spark, sf_dir):
    return metrics.over_folds(metrics.evaluate(learning.folds(scored(spark, sf_dir)), "fold"), ["logloss", "auc", "composite"])


_SUBSETS = {"a+b": "(a + b) / 2", "a+c": "(a + c) / 2", "b+c": "(b + c) / 2", "a+b+c": "(a + b + c) / 3"}


@query(f"with {_SCORED}, x as (" + " union all ".join(f"select '{s}' as subset, y, least(greatest(round({f}, 12), 1e-6), 1 - 1e-6) as p from e" for s, f in _SUBSETS.items()) + f"), t as (select *, rank() over (partition by subset order by p) + (count(*) over (partition by subset, p) - 1) / 2.0 as r from x), m as (select subset, count(*) as n, {_LL} as l, {_AUC} as u, avg((p - y) * (p - y)) as s from t group by subset) select subset, n, round(l, 5) as logloss, round(u, 5) as auc, round(s, 5) as brier, round(0.6 * l + 0.4 * (1 - u), 5) as composite from m")
def ensemble_ablation(spark, sf_dir):
    return scoring.ablation(scored(spark, sf_dir), _ABC, digits=5)


@query()
def ensemble_strategies(spark, sf_dir):
    return scoring.strategies(dealt(spark, sf_dir, *_ABC), _ABC)


@query()
def stacking_by_c(spark, sf_dir):
    return scoring.stacking_by_c(dealt(spark, sf_dir, *_ABC), _ABC)


_SCORE_COLUMNS = ("m1_deposit_total_value", "m1_withdraw_total_value", "m6_paybill_volume", "m3_mm_send_highest_amount")


def _ensemble() -> scoring.Ensemble:
    """Two models of five folds with stated coefficients; the second one's folds lean on volumes."""
    first = [scoring.Linear({_SCORE_COLUMNS[0]: -1e-6 * (k + 1), _SCORE_COLUMNS[1]: 2e-6}, 0.1 * k) for k in range(5)]
    second = [scoring.Linear({_SCORE_COLUMNS[2]: 0.05 * (k - 2), _SCORE_COLUMNS[3]: 1e-6}, -0.5) for k in range(5)]
    return scoring.Ensemble(_SCORE_COLUMNS, {"first": first, "second": second}, {"first": (5.0, -3.0), "second": (4.0, -2.5)}, {"first": 0.6, "second": 0.5})


_RAW = {
    "first": " + ".join(f"1 / (1 + exp(-({-(k + 1)}e-6 * m1_deposit_total_value + 2e-6 * m1_withdraw_total_value + {k / 10})))" for k in range(5)),
    "second": " + ".join(f"1 / (1 + exp(-({(k - 2) * 5}e-2 * m6_paybill_volume + 1e-6 * m3_mm_send_highest_amount - 0.5)))" for k in range(5)),
}


@query(_over(f"select id, round(a, 6) as first, round(b, 6) as second, round(p, 6) as p, case when p < 0.25 then 'low' when p < 0.60 then 'medium' else 'high' end as tier from (select *, least(greatest((0.6 * a + 0.5 * b) / 1.1, 1e-6), 1 - 1e-6) as p from (select id, least(greatest(1 / (1 + exp(-(5 * f - 3))), 1e-6), 1 - 1e-6) as a, least(greatest(1 / (1 + exp(-(4 * s - 2.5))), 1e-6), 1 - 1e-6) as b from (select id, ({_RAW['first']}) / 5 as f, ({_RAW['second']}) / 5 as s from w)))", _wide(_SCORE_COLUMNS)))
def scoring_path(spark, sf_dir):
    """From the wide panel to tiers: contract, fold means, calibration, weights that are rescaled, clip."""
    wide = wide_panel(spark, sf_dir).select(F.col("ID").cast("long").alias("id"), *_SCORE_COLUMNS)
    return scoring.score(wide, _ensemble()).select("id", *(F.round(c, 6).alias(c) for c in ("first", "second", "p")), "tier")


@query(f"with {_SCORED}, t as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from e), m as (select {_LL} as l, {_AUC} as u from t) select 'baseline' as experiment, 'run_1' as run, 'logloss' as key, round(l, 6) as value from m union all select 'baseline', 'run_1', 'auc', round(u, 6) from m")
def experiment_rows(spark, sf_dir):
    row = metrics.evaluate(scored(spark, sf_dir)).first()
    return tables.metric_rows("baseline", "run_1", {c: row[c] for c in ("logloss", "auc")}, spark)


# ---------------------------------------------------------------- the feature frame


def _frame(spark, sf_dir) -> features.Rows:
    """The panel's customers as a table, as the frame's fit reads them several times."""
    return features.Rows(kept(customers(spark, sf_dir)), wide_columns())


@query()
def features_full(spark, sf_dir):
    """All features of every customer behind the raw columns, cleaned by a specification that is fitted first."""
    rows = _frame(spark, sf_dir)
    return rows.build(rows.fit())


def _rounded(c: Column, digits: int) -> Column:
    """A double rounded as DuckDB does, by way of the product; Spark's ``round`` goes by the shortest decimal and makes 0.5005 0.501, not 0.5."""
    return F.round(c * float(10**digits)) / float(10**digits)


def _shown(mean: Column) -> Column:
    return F.when(F.abs(mean) < 1_000_000, _rounded(mean, 3)).otherwise(F.signum(mean) * _rounded(F.log10(F.abs(mean)), 6))


@query(frame_sql.SQL)
def features_profile(spark, sf_dir):
    """``feature, n, mean`` of every column that the frame adds to the panel: values and mean (from 1e6 on its decimal logarithm, with its sign)."""
    frame = features_full(spark, sf_dir)
    old = set(wide_columns())
    rows = profiling.long(frame, [c for c in frame.columns if c not in old])
    return rows.groupBy("feature").agg(F.count("value").alias("n"), _shown(F.avg("value")).alias("mean"))


@query(_over("select 'rows' as fact, count(*) as n from customer union all select 'least_features', 600"))
def features_full_size(spark, sf_dir):
    """Rows of the feature frame, and whether it has the 600 features that it must have at least."""
    frame = features_full(spark, sf_dir)
    made = len(frame.columns) - len(wide_columns())
    return frame.agg(F.count("*").alias("n")).select(F.lit("rows").alias("fact"), "n").unionAll(spark.range(1).select(F.lit("least_features"), F.lit(min(made, 600)).cast("long")))
