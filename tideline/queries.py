"""The registered queries over the panel and over scored rows, each with the DuckDB SQL that returns the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.functions.series import BLOCKS, LOG_BLOCK, ORACLE, shown
from tideline.operators import contract, domain, encoding, importance, learning, metrics, models, profiling, serving
from tideline.operators import series as series_ops
from tideline.plans import panel
from tideline.plans.panel import customers, series, table, wide_panel
from tideline.plans.schema import ENTITIES, GROUPS, INFLOW, MONTHS
from tideline.plans.settled import kept
from tideline.sources import tables
from tideline.streaming.panel import cells

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[name or f.__name__] = f
        if sql:
            ORACLES[name or f.__name__] = sql
        return f

    return add


def _over(select: str, ctes: str = "") -> str:
    return f"with {panel.SQL}{', ' + ctes if ctes else ''} {select}"


# ---------------------------------------------------------------- panel and profiles


@query(_over("select id, m, cast(g as int) as grp, total_value, volume, highest_amount, entities from long"))
def scan_panel(spark, sf_dir):
    return panel.long_panel(spark, sf_dir)


_NAMES = {f"{m}_{g}_{ENTITIES[g] if x == 'entities' else x}": f"{g}.{a}[{i + 1}]" for g in GROUPS for x, a in (("total_value", "val"), ("volume", "vol"), ("highest_amount", "hi"), ("entities", "ent")) for i, m in enumerate(MONTHS)}
_SOME = ("m1_deposit_total_value", "m1_withdraw_total_value", "m6_paybill_volume", "m3_mm_send_highest_amount")


def _wide(columns) -> str:
    return "w as (select id, " + ", ".join(f"{_NAMES[c]} as {c}" for c in columns) + " from c)"


def _rows_of(columns, formula: str) -> str:
    return " union all ".join(f"select '{c}' as feature, {formula.format(c=c)} from w" for c in columns)


@query(_over(_rows_of(_NAMES, "round(avg(cast({c} = 0 as int)), 6) as zero_rate"), _wide(_NAMES)))
def zero_rates(spark, sf_dir):
    return panel.zero_rates(spark, sf_dir).withColumn("zero_rate", F.round("zero_rate", 6))


@query(_over("select 'segment' as feature, round(avg(cast(segment is null as int)), 6) as missing_rate from c union all select 'earning_pattern', round(avg(cast(earning_pattern is null as int)), 6) from c union all select 'smartphone', round(avg(cast(smartphone is null as int)), 6) from c"))
def missing_rates(spark, sf_dir):
    return profiling.missing_rates(customers(spark, sf_dir), ["segment", "earning_pattern", "smartphone"]).withColumn("missing_rate", F.round("missing_rate", 6))


@query("select count(*) as n_rows, (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as n_keys, count(*) - (select count(*) from (select distinct l_orderkey, l_linenumber from lineitem)) as n_repeats from lineitem")
def dup_keys(spark, sf_dir):
    return profiling.duplicate_keys(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_linenumber")


_LINES = ("l_quantity", "l_extendedprice", "l_discount", "l_tax")


@query(" union all ".join(f"select '{c}' as feature, count({c}) as n, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min, max({c}) as max, round(quantile_cont({c}, 0.25), 4) as p25, round(quantile_cont({c}, 0.5), 4) as p50, round(quantile_cont({c}, 0.75), 4) as p75 from lineitem" for c in _LINES))
def describe(spark, sf_dir):
    return profiling.describe(table(spark, sf_dir, "lineitem"), [*_LINES])


@query(" union all ".join(f"select '{c}' as feature, 0.0::double as missing_rate, round(avg(cast({c} = 0 as int)), 4) as zero_rate, round(avg({c}), 4) as mean, round(stddev_samp({c}), 4) as std, min({c}) as min, max({c}) as max, round(skewness({c}), 4) as skew, round(skewness({c}) * (count(*) - 2) / sqrt(count(*)::double * (count(*) - 1)), 4) as skew_pop from lineitem" for c in _LINES))
def feature_summary(spark, sf_dir):
    return profiling.summary(table(spark, sf_dir, "lineitem"), [*_LINES])


@query(" union all ".join(f"select '{c}' as feature, (select round(avg(cast({c} < q1 - 1.5 * (q3 - q1) or {c} > q3 + 1.5 * (q3 - q1) as int)), 6) from {t}, (select quantile_cont({c}, 0.25) as q1, quantile_cont({c}, 0.75) as q3 from {t})) as outlier_rate" for c, t in (("o_totalprice", "orders"),)))
def iqr_outliers(spark, sf_dir):
    return profiling.iqr_outliers(table(spark, sf_dir, "orders"), ["o_totalprice"])


@query("select event_type, count(*) as n, round(count(*) / (select count(*) from events)::double, 6) as share from events group by event_type")
def value_shares(spark, sf_dir):
    return profiling.value_shares(table(spark, sf_dir, "events"), "event_type")


@query("with p as (select unnest([{}]) as feature) select split_part(feature, '_', 1) as prefix, count(*) as n from p group by 1".format(", ".join(f"'{c}'" for c in _NAMES)))
def prefix_counts(spark, sf_dir):
    return profiling.prefix_counts([*_NAMES], spark)


@query(" union all ".join(f"select '{a}' as a, '{b}' as b, round(corr({a}, {b}), 6) as r from lineitem" for i, a in enumerate(_LINES) for b in _LINES[i + 1 :]))
def corr_matrix(spark, sf_dir):
    return profiling.correlations(table(spark, sf_dir, "lineitem"), [*_LINES])


_OUT_OF_RULE = (" + ".join(f"cast({g}.hi[{i}] > {g}.val[{i}] + 0.01 and {g}.hi[{i}] > 0 and {g}.val[{i}] > 0 as int)" for g in GROUPS for i in range(1, 7)), " + ".join(f"cast({g}.ent[{i}] > {g}.vol[{i}] as int)" for g in GROUPS for i in range(1, 7)))


@query(_over(f"select id, {_OUT_OF_RULE[0]} as n_amount, {_OUT_OF_RULE[1]} as n_entities from c"))
def rule_violations(spark, sf_dir):
    return serving.violations(customers(spark, sf_dir))


# ---------------------------------------------------------------- features


def _series_sql(name: str) -> str:
    return _over("select id, grp, " + ", ".join(f"{shown(f(ORACLE, 'val'))} as {c}" for c, f in BLOCKS[name].items()) + " from s")


def _series_query(name: str) -> None:
    def run(spark, sf_dir):
        return series_ops.block(series(spark, sf_dir), name, show=shown)

    query(_series_sql(name), f"series_{name}")(run)


for _name in BLOCKS:
    _series_query(_name)


@query(_over("select id, grp, " + ", ".join(f"{shown(f(ORACLE, 'd'))} as {c}_log" for c, f in LOG_BLOCK.items()) + " from logged", f"logged as (select id, grp, {ORACLE.logged('val')} as d from s)"))
def series_log(spark, sf_dir):
    return series_ops.log_block(series(spark, sf_dir), show=shown)


@query(_over("select id, grp, round(d[1] - d[2], 4) as momentum, round((d[1] - d[2]) - (d[2] - d[3]), 4) as acceleration, round(d[1] - d[6], 4) as trend, " + ORACLE.streak("d") + " as zero_streak, len(list_filter(d, lambda x: x > 0)) as active_months from (select id, grp, val as d from s)"))
def series_window(spark, sf_dir):
    rows = series(spark, sf_dir).select("id", "grp", F.posexplode("val").alias("i", "v")).select("id", "grp", (F.col("i") + 1).alias("m"), "v")
    return series_ops.by_window(rows).withColumns({c: F.round(c, 4) for c in ("momentum", "acceleration", "trend")})


def _domain_query(name: str) -> None:
    def run(spark, sf_dir):
        return domain.block(customers(spark, sf_dir), name, shown)

    staged = "staged as (select *, " + ", ".join(f"{f} as {c}" for c, f in domain.flows(ORACLE).items()) + " from c)"
    query(_over("select id, " + ", ".join(f"{shown(f)} as {c}" for c, f in domain.BLOCKS[name](ORACLE).items()) + " from staged", staged), f"{name}_block")(run)


for _name in domain.BLOCKS:
    _domain_query(_name)


@query(_over("""select id, case upper(segment) when 'LVC' then 0 when 'MVC' then 1 when 'HVC' then 2 else 1 end as segment_encoded,
  (select count(distinct coalesce(b.earning_pattern, 'nan')) from c b where coalesce(b.earning_pattern, 'nan') < coalesce(c.earning_pattern, 'nan'))::int as earning_pattern_encoded,
  coalesce(lower(trim(smartphone)) in ('yes', '1', 'true'), false)::int as has_smartphone, coalesce(upper(trim(gender)) = 'M', false)::int as is_male,
  case upper(trim(gender)) when 'MALE' then 'M' when 'FEMALE' then 'F' else upper(trim(gender)) end as gender from c"""))
def encode_block(spark, sf_dir):
    c = customers(spark, sf_dir)
    codes = encoding.fit_codes(c, "earning_pattern")
    return c.select("id", encoding.segment().alias("segment_encoded"), encoding.apply_codes("earning_pattern", codes).alias("earning_pattern_encoded"), encoding.smartphone().alias("has_smartphone"), encoding.is_male().alias("is_male"), encoding.normal_gender().alias("gender"))


@query(_over("select feature, n_zero from (" + " union all ".join(f"select '{c}_is_zero' as feature, sum(cast({c} = 0 as int))::bigint as n_zero, avg(cast({c} = 0 as int)) as rate from w" for c in _NAMES) + ") where rate between 0.60 and 0.98", _wide(_NAMES)))
def zero_flags(spark, sf_dir):
    """The band is found in the long panel; the flags read the columns in it alone."""
    names = encoding.in_band(panel.zero_rates(spark, sf_dir), [*_NAMES])
    flags = wide_panel(spark, sf_dir).select(encoding.zero_flags(names))
    return flags.agg(*(F.sum(c).alias(c) for c in flags.columns)).unpivot([], flags.columns, "feature", "n_zero")


# ---------------------------------------------------------------- contract

_RATIOS = ("net_flow_ratio", "withdraw_deposit_ratio", "m1_withdraw_deposit_ratio", "spend_to_inflow", "total_inflow_6m")
_CASHFLOW = "staged as (select *, " + ", ".join(f"{f} as {c}" for c, f in domain.flows(ORACLE).items()) + " from c), f as (select id, " + ", ".join(f"{domain.cashflow(ORACLE)[c]} as {c}" for c in _RATIOS) + " from staged)"
_BOUND = ", ".join(f"case when quantile_cont({c}, 0.99) > 0 then quantile_cont({c}, 0.99) end as b_{c}" for c in _RATIOS if "ratio" in c)


@query(_over("select id, " + ", ".join(f"{shown(f'least({c}, coalesce(b_{c}, {c}))' if 'ratio' in c else c)} as {c}" for c in _RATIOS) + " from f, b", f"{_CASHFLOW}, b as (select {_BOUND} from f)"))
def ratio_clip_p99(spark, sf_dir):
    f = kept(domain.block(customers(spark, sf_dir), "cashflow").select("id", *_RATIOS))
    clipped = contract.upper(f, contract.fit_ratio_clip(f, [c for c in _RATIOS if contract.RATIO in c]))
    return clipped.selectExpr("id", *(f"{shown(c)} as {c}" for c in _RATIOS))


_WINSOR = ("withdraw_deposit_ratio", "spend_to_inflow")


@query(_over("select id, " + ", ".join(f"{shown(f'least({c}, w_{c})' if c in _WINSOR else c)} as {c}" for c in _RATIOS) + " from g, v", f"{_CASHFLOW}, b as (select {_BOUND} from f), g as (select id, " + ", ".join(f"{f'least({c}, coalesce(b_{c}, {c}))' if 'ratio' in c else c} as {c}" for c in _RATIOS) + " from f, b), v as (select " + ", ".join(f"quantile_cont({c}, 0.99) as w_{c}" for c in _WINSOR) + " from g)"))
def winsor_two_pass(spark, sf_dir):
    f = kept(domain.block(customers(spark, sf_dir), "cashflow").select("id", *_RATIOS))
    spec = contract.FeatureSpec.fit(f, [*_RATIOS], _WINSOR)
    return spec.transform(f).selectExpr("id", *(f"{shown(c)} as {c}" for c in _RATIOS))


_PRE = ("m1_deposit_total_value", "m1_withdraw_total_value", "m2_received_total_value", "m1_paybill_volume")
_WIDE = _wide(_PRE)


@query(_over(" union all ".join(f"select '{c}' as feature, round(quantile_cont({c}, 0.001), 4) as lo, round(quantile_cont({c}, 0.999), 4) as hi from w having count(distinct {c}) > 10 and quantile_cont({c}, 0.001) < quantile_cont({c}, 0.999)" for c in _PRE), _WIDE))
def clip_fit_bounds(spark, sf_dir):
    spec = contract.Preprocessing.fit(wide_panel(spark, sf_dir).select("ID", *_PRE), [*_PRE])
    return spark.createDataFrame([(c, float(lo), float(hi)) for c, (lo, hi) in spec.clip.items()], "feature string, lo double, hi double").select("feature", F.round("lo", 4).alias("lo"), F.round("hi", 4).alias("hi"))


_CLIPPED = "k as (select id, " + ", ".join(f"case when b.n_{c} > 10 and b.lo_{c} < b.hi_{c} then least(greatest(w.{c}, b.lo_{c}), b.hi_{c}) else w.{c} end as {c}" for c in _PRE) + " from w, (select " + ", ".join(f"count(distinct {c}) as n_{c}, quantile_cont({c}, 0.001) as lo_{c}, quantile_cont({c}, 0.999) as hi_{c}" for c in _PRE) + " from w) b)"


@query(_over("select cast(id as varchar) as ID, " + ", ".join(f"round((k.{c} - m_{c}) / s_{c}, 4) as {c}" for c in _PRE) + " from k, (select " + ", ".join(f"avg({c}) as m_{c}, stddev_pop({c}) as s_{c}" for c in _PRE) + " from k)", f"{_WIDE}, {_CLIPPED}"))
def standardise(spark, sf_dir):
    wide = kept(wide_panel(spark, sf_dir).select("ID", *_PRE))
    spec = contract.Preprocessing.fit(wide, [*_PRE], scaled=True)
    return spec.transform(wide, ("ID",)).select("ID", *(F.round(c, 4).alias(c) for c in spec.columns))


@query(_over("select cast(id as varchar) as ID, m1_withdraw_total_value, 0.0::double as not_there, m1_deposit_total_value from w", _wide(_SOME)))
def align_contract(spark, sf_dir):
    return contract.align(wide_panel(spark, sf_dir).select("ID", *_SOME), ["m1_withdraw_total_value", "not_there", "m1_deposit_total_value"], ("ID",))


# ---------------------------------------------------------------- scored rows


def scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events as scored rows: id, y, p and three models' scores a, b, c."""
    return table(spark, sf_dir, "events").selectExpr("event_id as id", "cast(event_type = 'error' as int) as y", "least(value / 500, 1D) as p", "least(value / 500, 1D) as a", "(1 + (event_id * 7919) % 1000) / 1002D as b", "(least(value / 500, 1D) + (1 + (event_id * 104729) % 997) / 999D) / 2 as c")


_SCORED = "e as (select event_id as id, cast(event_type = 'error' as int) as y, least(value / 500, 1) as p, least(value / 500, 1) as a, (1 + (event_id * 7919) % 1000) / 1002::double as b, (least(value / 500, 1) + (1 + (event_id * 104729) % 997) / 999::double) / 2 as c from events)"
_LL = "-avg(case when y = 1 then ln(least(greatest(p, 1e-15), 1 - 1e-15)) else ln(1 - least(greatest(p, 1e-15), 1 - 1e-15)) end)"
_AUC = "(sum(case when y = 1 then r end) - sum(y) * (sum(y) + 1) / 2.0) / (sum(y)::double * sum(1 - y))"


@query(f"with {_SCORED}, t as (select *, rank() over (order by p) + (count(*) over (partition by p) - 1) / 2.0 as r from e), m as (select count(*) as n, {_LL} as l, {_AUC} as u, avg((p - y) * (p - y)) as s from t) select n, round(l, 6) as logloss, round(u, 6) as auc, round(s, 6) as brier, round(0.6 * l + 0.4 * (1 - u), 6) as composite from m")
def metric_logloss_auc_brier(spark, sf_dir):
    return metrics.evaluate(scored(spark, sf_dir))


_FOLD = "k as (select *, cast((row_number() over (partition by y order by md5('42:' || id), id) - 1) % 5 as int) as fold from e)"


@query(f"with {_SCORED}, {_FOLD} select id, y, fold from k")
def folds(spark, sf_dir):
    return learning.folds(scored(spark, sf_dir)).select("id", "y", "fold")


@query(f"with {_SCORED}, {_FOLD}, t as (select *, rank() over (partition by fold order by p) + (count(*) over (partition by fold, p) - 1) / 2.0 as r from k), m as (select fold, count(*) as n, {_LL} as l, {_AUC} as u, avg((p - y) * (p - y)) as s from t group by fold) select fold, n, round(l, 6) as logloss, round(u, 6) as auc, round(s, 6) as brier, round(0.6 * l + 0.4 * (1 - u), 6) as composite from m")
def fold_stats(spark, sf_dir):
    return metrics.evaluate(learning.folds(scored(spark, sf_dir)), "fold")


@query(f"with {_SCORED} select cast(least(greatest(ceil(p * 10) - 1, 0), 9) as int) as bin, count(*) as n, round(avg(p), 6) as mean_p, round(avg(y), 6) as rate from e group by 1")
def calibration_bins(spark, sf_dir):
    return metrics.calibration_bins(scored(spark, sf_dir))


@query(f"with {_SCORED}, h as (select i::int as i, i / 49::double as t from range(50) r(i)), m as (select i, t, sum(cast(p >= t and y = 1 as int)) as tp, sum(cast(p >= t and y = 0 as int)) as fp, sum(cast(p < t and y = 1 as int)) as fn, sum(cast(p < t and y = 0 as int)) as tn from h, e group by i, t) select i, round(t, 6) as threshold, tp::bigint as tp, fp::bigint as fp, fn::bigint as fn, tn::bigint as tn, round(tp / (tp + fp + 1e-6), 6) as precision, round(tp / (tp + fn + 1e-6), 6) as recall from m")
def threshold_sweep(spark, sf_dir):
    return metrics.confusion(scored(spark, sf_dir))


@query(f"with {_SCORED}, q as (select quantile_cont(p, [0.2, 0.4, 0.6, 0.8]) as q from e), b as (select y, (p > q[1])::int + (p > q[2])::int + (p > q[3])::int + (p > q[4])::int as bin from e, q) select bin, count(*) as n, round(avg(y), 6) as rate from b group by bin")
def quantile_bins(spark, sf_dir):
    return metrics.quantile_bins(scored(spark, sf_dir))


@query(f"with {_SCORED}, z as (select y, ln(least(greatest(p, 1e-6), 1 - 1e-6) / (1 - least(greatest(p, 1e-6), 1 - 1e-6))) as z from e), g as (select i::int as i, 0.5 + 2.5 * i / 49::double as t from range(50) r(i)) select i, round(t, 6) as t, round(-avg(case when y = 1 then ln(1 / (1 + exp(-z / t))) else ln(1 - 1 / (1 + exp(-z / t))) end), 6) as logloss from g, z group by i, t")
def temperature_grid(spark, sf_dir):
    return learning.temperature_grid(scored(spark, sf_dir))


@query(f"with {_SCORED} select id, round(least(greatest(1 / (1 + exp(-(5.4697 * p - 4.4251))), 1e-6), 1 - 1e-6), 6) as calibrated from e")
def platt_apply(spark, sf_dir):
    return scored(spark, sf_dir).select("id", F.round(learning.apply_platt("p", 5.4697, -4.4251), 6).alias("calibrated"))


@query(f"with {_SCORED} select id, round(least(greatest((a * 0.4 + b * 0.8 + c * 0.8) / 2.0, 1e-6), 1 - 1e-6), 6) as weighted, round(least(greatest((a + b + c) / 3, 1e-6), 1 - 1e-6), 6) as simple, round(list_aggregate([a, b, c], 'stddev_pop'), 6) as spread from e")
def blend_weighted(spark, sf_dir):
    e, abc = scored(spark, sf_dir), ["a", "b", "c"]
    return e.select("id", F.round(learning.blend({"a": 0.4, "b": 0.8, "c": 0.8}, abc), 6).alias("weighted"), F.round(learning.blend(dict.fromkeys(abc, 1 / 3), abc), 6).alias("simple"), F.round(learning.spread(abc), 6).alias("spread"))


@query(f"with {_SCORED}, d as (select abs(a - b) as v from e) select 'a_b' as feature, count(v) as n, round(avg(v), 4) as mean, round(stddev_samp(v), 4) as std, round(min(v), 4) as min, round(max(v), 4) as max, round(quantile_cont(v, 0.25), 4) as p25, round(quantile_cont(v, 0.5), 4) as p50, round(quantile_cont(v, 0.75), 4) as p75 from d")
def disagreement(spark, sf_dir):
    return profiling.describe(scored(spark, sf_dir).select(F.abs(F.col("a") - F.col("b")).alias("a_b")), ["a_b"])


@query(f"with {_SCORED} select round(avg(p), 6) as mean_p, round(avg(b), 6) as mean_oof, round(abs(avg(p) - avg(b)), 6) as shift, case when abs(avg(p) - avg(b)) > 0.10 then 'fail' when abs(avg(p) - avg(b)) > 0.05 then 'warn' else 'ok' end as status, avg(b) between 0.13 and 0.17 as oof_in_range from e")
def drift_check(spark, sf_dir):
    e = scored(spark, sf_dir)
    return learning.prediction_drift(e, e.select(F.col("b").alias("p")))


# ---------------------------------------------------------------- serving and reports


@query(f"with {_SCORED} select id, case when p < 0.25 then 'low' when p < 0.60 then 'medium' else 'high' end as tier from e")
def risk_tier(spark, sf_dir):
    return scored(spark, sf_dir).select("id", serving.risk_tier().alias("tier"))


@query(f"with {_SCORED} select count(*) as n, count(*) filter (p < 0.25) as n_low, count(*) filter (p >= 0.25 and p < 0.6) as n_medium, count(*) filter (p >= 0.6) as n_high, round(avg(cast(p > 0.5 as int)), 6) as stress_rate, abs(avg(cast(p > 0.5 as int)) - 0.15) > 0.10 as shifted from e")
def batch_summary(spark, sf_dir):
    return serving.batch_summary(scored(spark, sf_dir))


_FIRST, _LAST = (" + ".join(f"{g}.val[{i}]" for g in INFLOW) for i in (1, 6))


@query(_over(f"select id, bal[1] >= bal[6] - 1000 and {_LAST} > 0 and ({_FIRST}) < 0.5 * ({_LAST}) as balance_lag from c"))
def balance_lag(spark, sf_dir):
    return serving.balance_lag(customers(spark, sf_dir))


@query(_over("""select id, round(bal[1], 4) as m1_daily_avg_bal, round(bal[6], 4) as m6_daily_avg_bal, round(list_sum(deposit.val), 2) as total_deposit_6m, round(list_sum(withdraw.val), 2) as total_withdraw_6m,
  case when abs(r) < 1000000 then round(r, 4) else round(r / 1000000, 1) * 1000000 end as deposit_m1_vs_m46_ratio,
  deposit.vol[1] + received.vol[1] + transfer_from_bank.vol[1] as recent_inflow_volume, withdraw.vol[1] + merchantpay.vol[1] + paybill.vol[1] + mm_send.vol[1] as recent_outflow_volume,
  deposit.ent[1] + received.ent[1] + transfer_from_bank.ent[1] + withdraw.ent[1] + merchantpay.ent[1] + paybill.ent[1] + mm_send.ent[1] as network_breadth_m1,
  case when bal[1] - bal[6] > 500 then 'improving' when bal[1] - bal[6] < -500 then 'deteriorating' else 'stable' end as balance_trend_direction
  from (select *, ((deposit.val[1] + deposit.val[2] + deposit.val[3]) / 3) / ((deposit.val[4] + deposit.val[5] + deposit.val[6]) / 3 + 0.000001::double) as r from c)"""))
def input_summary(spark, sf_dir):
    return serving.input_summary(customers(spark, sf_dir))


@query("select count(*) = 30000 as rows_as_expected, count(distinct event_id) = count(*) as ids_unique, true as no_missing, true as no_infinite, count(*) filter (value / 400 > 1 or value < 0) = 0 as in_range, true as columns_equal from events")
def submission_checks(spark, sf_dir):
    file = table(spark, sf_dir, "events").selectExpr("event_id as ID", "value / 400 as Target", "value / 400 as TargetLogLoss", "value / 400 as TargetRAUC")
    return serving.submission_checks(file, 30_000)


@query(f"with {_SCORED} select count(*) as n, round(avg(p), 6) as mean, round(stddev_pop(p), 6) as std, round(min(p), 6) as min, round(max(p), 6) as max, " + ", ".join(f"round(quantile_cont(p, {q}), 6) as p{int(100 * q)}" for q in (0.1, 0.25, 0.5, 0.75, 0.9)) + ", round(avg(cast(p > 0.3 as int)), 6) as over_30, round(avg(cast(p > 0.5 as int)), 6) as over_50 from e")
def percentile_report(spark, sf_dir):
    return serving.score_report(scored(spark, sf_dir))


_IMPORTANCE = "i as (select feature, mean_importance from (" + " union all ".join(f"select '{c}' as feature, round(avg(abs({f})), 6) as mean_importance from staged" for b in ("balance", "cashflow", "p2p", "volume_cashflow") for c, f in domain.BLOCKS[b](ORACLE).items()) + "))"
_STAGED = "staged as (select *, " + ", ".join(f"{f} as {c}" for c, f in domain.flows(ORACLE).items()) + " from c)"


def _importances(spark, sf_dir) -> DataFrame:
    staged = domain.stage(customers(spark, sf_dir))
    formulas = {c: f for b in ("balance", "cashflow", "p2p", "volume_cashflow") for c, f in domain.BLOCKS[b](domain.SPARK).items()}
    return importance.mean_absolute(staged.selectExpr(*(f"{f} as {c}" for c, f in formulas.items())), [*formulas])


_THEME = """case when regexp_matches(feature, 'balance|drawdown|reserve|cash') then 'Balance Deterioration' when regexp_matches(feature, 'withdraw|spend|payment') then 'Spending Stress'
  when regexp_matches(feature, 'deposit|income|inflow') then 'Income Stability' when regexp_matches(feature, 'volatility|std|variance') then 'Behavioral Instability'
  when regexp_matches(feature, 'trend|slope|delta|change') then 'Temporal Deterioration' when regexp_matches(feature, 'activity|engagement|frequency|recency') then 'Engagement Dynamics'
  when regexp_matches(feature, 'daily_avg_bal') then 'Balance Deterioration' else 'Other' end"""


@query(_over(f"select {_THEME} as theme, count(*) as n_features, round(sum(mean_importance), 2) as importance from i group by 1", f"{_STAGED}, {_IMPORTANCE}"))
def theme_summary(spark, sf_dir):
    return importance.theme_summary(_importances(spark, sf_dir), 2).drop("share")


@query(_over("select feature, round(mean_importance, 2) as mean_importance from i order by i.mean_importance desc, feature limit 10", f"{_STAGED}, {_IMPORTANCE}"))
def topk_features(spark, sf_dir):
    return importance.top_features(_importances(spark, sf_dir), 10).withColumn("mean_importance", F.round("mean_importance", 2))


@query("with r as (select 'model_' || (o_custkey % 7) as model, case when o_orderkey % 3 = 0 then 'stage_2' when o_orderkey % 3 = 1 then 'baseline' else 'other' end as stage, 'run_' || strftime(o_orderdate, '%Y%m%d') as run from orders where o_custkey % 7 < 6 or o_orderkey % 3 = 1) select model, stage, run from (select *, row_number() over (partition by model order by stage desc, run desc) as k from r where stage in ('stage_2', 'baseline')) where k = 1")
def latest_run(spark, sf_dir):
    return tables.latest_runs(_runs(spark, sf_dir), ("stage_2", "baseline"))


def _runs(spark, sf_dir) -> DataFrame:
    """A run for every order; model_6 has none of stage_2, so it falls back to its baseline."""
    return table(spark, sf_dir, "orders").selectExpr("concat('model_', o_custkey % 7) as model", "case when o_orderkey % 3 = 0 and o_custkey % 7 < 6 then 'stage_2' when o_orderkey % 3 = 1 then 'baseline' else 'other' end as stage", "concat('run_', date_format(o_orderdate, 'yyyyMMdd')) as run")


@query(f"with {_SCORED}, o as (select id, 'a' as model, y, a as p from e union all select id, 'b', y, b from e) select model, count(*) as n, 0::bigint as n_missing, 0::bigint as n_infinite, count(*) filter (p < 0 or p > 1) as n_outside, round(avg(y), 6) as base_rate from o group by model")
def oof_checks(spark, sf_dir):
    return tables.check_oof(scored(spark, sf_dir).select("id", "y", "a", "b").unpivot(["id", "y"], ["a", "b"], "model", "p"))


@query("select user_id as id, event_type as grp, time_bucket(interval '5 days', ts, timestamp '1970-01-01') as start, cast(sum(cast(value as decimal(18,2))) as double) as total_value, count(*) as volume, cast(max(cast(value as decimal(18,2))) as double) as highest_amount from events group by 1, 2, 3")
def stream_cells(spark, sf_dir):
    return cells(table(spark, sf_dir, "events"))


@query("with r as (select o_orderkey as trial, o_totalprice as score from orders) select trial, score, round((b.base - score) / b.base * 100, 4) as gain from r, (select min(o_totalprice) as base from orders where o_orderkey = 0) b")
def trial_ranking(spark, sf_dir):
    return models.rank_trials(table(spark, sf_dir, "orders").selectExpr("o_orderkey as trial", "o_totalprice as score"))


# ---------------------------------------------------------------- learning (rows only)


def dealt(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    """The scored rows' id, y, ``columns`` and fold as a table: folds are dealt once, not by every pass."""
    return kept(learning.folds(scored(spark, sf_dir).select("id", "y", *columns)))


@query()
def platt_cross_validated(spark, sf_dir):
    return learning.cross_platt(dealt(spark, sf_dir, "p"))[0].select("id", "fold", "y", F.round("calibrated", 6).alias("calibrated"))


@query()
def stacked_scores(spark, sf_dir):
    return learning.stack(dealt(spark, sf_dir, "a", "b", "c"), ["a", "b", "c"]).select("id", "fold", "y", F.round("stacked", 6).alias("stacked"))


@query()
def optimised_weights(spark, sf_dir):
    found = learning.optimise_weights(scored(spark, sf_dir), ["a", "b", "c"])
    return spark.createDataFrame([*found.items()], "model string, weight double")


def _training(spark, sf_dir) -> tuple[DataFrame, list[str]]:
    staged, made = domain.stage(customers(spark, sf_dir)), {c: f for b in ("cashflow", "balance") for c, f in domain.BLOCKS[b](domain.SPARK).items()}
    f = kept(staged.selectExpr("id", *(f"{f} as {c}" for c, f in made.items())))
    columns = [c for c in f.columns if c != "id"]
    spec = contract.Preprocessing.fit(f, columns, scaled=True)
    y = table(spark, sf_dir, "customer").selectExpr("c_custkey as id", "cast(c_acctbal < 1000 as int) as y")
    return spec.transform(f).join(y, "id"), spec.columns


@query()
def cross_validated_model(spark, sf_dir):
    data, columns = _training(spark, sf_dir)
    return models.cross_validate(kept(data), columns, models.Experiment("plain", "logistic", {"maxIter": 2000}, scaled=True, balanced=True)).by_fold


@query()
def series_features_wide(spark, sf_dir):
    return series_ops.features_wide(series(spark, sf_dir))


import tideline.queries_more  # noqa: E402,F401  (registers its queries here)
import tideline.queries_models  # noqa: E402,F401
