"""The whole feature frame in DuckDB SQL, written from the definitions: long rows of feature and value, cleaned there.

It shares nothing with the formulas that Spark runs but the panel's names and the panel itself.
"""

from __future__ import annotations

from tideline.plans.panel import SQL as PANEL
from tideline.plans.schema import ENTITIES, GROUPS, INFLOW, OUTFLOW

_E = "1e-6"
#: The features that are bounded a second time.
_WINSOR = ("withdraw_recency_ratio", "withdraw_recency_ratio_log", "net_flow_ratio", "balance_to_spend_pressure", "deposit_vol_recency_ratio", "withdraw_vol_recency_ratio", "mm_send_vol_recency_ratio", "avg_txn_size_withdraw", "avg_txn_size_withdraw_trend", "avg_txn_size_mm_send")


def _sd(d: str) -> str:
    return f"list_aggregate({d}, 'stddev_pop')"


def _slope(d: str) -> str:
    """Newest month first, so its abscissa is the largest."""
    return "((" + " + ".join(f"({2.5 - i}) * {d}[{i + 1}]" for i in range(6)) + f") / (17.5 + {_E}))"


def _recency(d: str) -> str:
    return f"(list_avg({d}[1:3]) / (list_avg({d}[4:6]) + {_E}))"


def _of_series(d: str) -> dict[str, str]:
    m = f"list_avg({d})"
    return {
        "mean": m, "std": _sd(d), "min": f"list_min({d})", "max": f"list_max({d})", "trend": f"{d}[1] - {d}[6]", "trend_slope": _slope(d), "momentum": f"{d}[1] - {d}[2]", "acceleration": f"{d}[1] - 2 * {d}[2] + {d}[3]",
        "cv": f"{_sd(d)} / ({m} + {_E})", "volatility_ratio": f"{_sd(f'{d}[1:3]')} / ({_sd(f'{d}[4:6]')} + {_E})", "consistency": f"{m} / ({_sd(d)} + {_E})", "recency_ratio": _recency(d), "peak_to_mean": f"list_max({d}) / ({m} + {_E})",
    }


_ACTIVITY = {
    "active_months": "len(list_filter(d, lambda x: x > 0))",
    "activity_switch": "(" + " + ".join(f"abs((d[{i}] > 0)::int - (d[{i + 1}] > 0)::int)" for i in range(1, 6)) + ")",
    "zero_streak": "(coalesce(list_position(list_transform(d, lambda x: x > 0), true), 7) - 1)",
}
_LOG = ("mean", "std", "min", "max", "trend", "trend_slope", "cv", "volatility_ratio", "momentum", "recency_ratio")


def _unnested(pairs: dict[str, str], prefix: str = "''") -> str:
    return "unnest([" + ", ".join(f"{{'f': {prefix} || '{f}', 'v': ({v})::double}}" for f, v in pairs.items()) + "], recursive := true)"


def _sum(groups, field: str) -> str:
    return "(" + " + ".join(f"list_sum({g}.{field})" for g in groups) + ")"


def _flow(groups, field: str) -> str:
    return "[" + ", ".join(" + ".join(f"{g}.{field}[{i}]" for g in groups) for i in range(1, 7)) + "]"


def _domain() -> dict[str, str]:
    """The features across groups, block by block."""
    top = "list_max(bal)"
    out = {
        "balance_trend": "bal[1] - bal[6]", "balance_slope": _slope("bal"), "balance_volatility": _sd("bal"), "balance_cv": f"{_sd('bal')} / (list_avg(bal) + {_E})", "balance_range": f"{top} - list_min(bal)", "balance_min": "list_min(bal)", "balance_max": top,
        "balance_m1": "bal[1]", "balance_recovery": "bal[1] - list_min(bal[2:6])", "balance_trend_3m": "bal[1] - bal[3]",
        "balance_drawdown": f"({top} - bal[1]) / ({top} + {_E})", "balance_drawdown_abs": f"{top} - bal[1]",
        "balance_to_spend_pressure": f"bal[1] / (list_sum(withdraw.val) + {_E})", "m1_withdraw_balance_ratio": f"withdraw.val[1] / (bal[1] + {_E})", "balance_to_outflow_ratio": f"bal[1] / (o + {_E})",
        "total_inflow_6m": "i", "total_outflow_6m": "o", "net_cashflow_6m": "i - o", "net_flow_ratio": f"(i - o) / (i + o + {_E})", "spend_to_inflow": f"o / (i + {_E})",
        "withdraw_deposit_ratio": f"list_sum(withdraw.val) / (list_sum(deposit.val) + {_E})", "m1_withdraw_deposit_ratio": f"withdraw.val[1] / (deposit.val[1] + {_E})",
        "net_cashflow_slope": _slope("net"), "inflow_slope": _slope("inv"), "outflow_slope": _slope("outv"), "inflow_outflow_slope_divergence": f"{_slope('inv')} - {_slope('outv')}", "net_cashflow_m1": "net[1]",
        "cashflow_volatility": _sd("net"), "cashflow_volatility_cv": f"{_sd('net')} / (abs(list_avg(net)) + {_E})",
        "p2p_net_flow": "list_sum(received.val) - list_sum(mm_send.val)", "p2p_receive_send_ratio": f"list_sum(received.val) / (list_sum(mm_send.val) + {_E})", "p2p_m1_ratio": f"received.val[1] / (mm_send.val[1] + {_E})", "p2p_inflow_share": f"list_sum(received.val) / (i + {_E})",
        "bank_transfer_slope": _slope("transfer_from_bank.val"), "bank_transfer_trend": "transfer_from_bank.val[1] - transfer_from_bank.val[6]", "bank_transfer_m1": "transfer_from_bank.val[1]", "bank_has_bank_inflow": "(list_sum(transfer_from_bank.val) > 0)::int",
        "deposit_intensity": f"list_sum(deposit.val) / (arpu + {_E})", "bank_transfer_vs_arpu": f"list_sum(transfer_from_bank.val) / (6 * arpu + {_E})",
        "balance_trend_x_balance_level": "(bal[1] - bal[6]) * bal[2]", "deposit_recency_x_balance": f"{_recency('deposit.val')} * bal[1]", "withdraw_recency_x_spend_ratio": f"{_recency('withdraw.val')} * o / (i + {_E})",
        "balance_cv_x_drawdown": f"{_sd('bal')} / (list_avg(bal) + {_E}) * ({top} - bal[1]) / ({top} + {_E})", "cashflow_slope_x_balance": f"{_slope('net')} * bal[1]", "deposit_value_x_volume_recency": f"{_recency('deposit.val')} * {_recency('deposit.vol')}",
        "withdraw_value_x_volume_acceleration": "(withdraw.val[1] - 2 * withdraw.val[2] + withdraw.val[3]) * (withdraw.vol[1] - 2 * withdraw.vol[2] + withdraw.vol[3])",
        "net_txn_volume_slope": _slope("netn"), "inflow_volume_slope": _slope("inn"), "outflow_volume_slope": _slope("outn"), "volume_slope_divergence": f"{_slope('inn')} - {_slope('outn')}", "net_txn_volume_m1": "netn[1]", "total_txn_volume_6m": "list_sum(inn) + list_sum(outn)",
        "net_txn_volume_momentum": "netn[1] - netn[2]", "inflow_volume_recency_ratio": _recency("inn"), "outflow_volume_recency_ratio": _recency("outn"),
        "segment_encoded": "case upper(segment) when 'LVC' then 0 when 'HVC' then 2 else 1 end", "earning_pattern_encoded": "pattern", "has_smartphone": "coalesce(lower(trim(smartphone)) in ('yes', '1', 'true'), false)::int", "is_male": "coalesce(upper(trim(gender)) = 'M', false)::int",
    }
    for g in GROUPS:
        v, n, e, name = f"{g}.val", f"{g}.vol", f"{g}.ent", f"{g}_unique_{ENTITIES[g]}"
        size = lambda part, v=v, n=n: f"list_avg({v}{part}) / (list_avg({n}{part}) + {_E})"
        out |= {f"avg_txn_size_{g}": size(""), f"avg_txn_size_{g}_trend": f"{v}[1] / ({n}[1] + {_E}) - {v}[6] / ({n}[6] + {_E})", f"avg_txn_size_{g}_recency_ratio": f"({size('[1:3]')}) / ({size('[4:6]')} + {_E})"}
        out |= {f"{name}_mean": f"list_avg({e})", f"{name}_trend": f"{e}[1] - {e}[6]", f"{name}_m1": f"{e}[1]", f"{name}_recency_ratio": _recency(e), f"{name}_slope": _slope(e)}
    return out


_CELLS = " union all ".join(f"select id, 'm' || k || '_{g}_{ENTITIES[g] if a == 'ent' else m}' as f, {a}[k] as v from s, range(1, 7) r(k) where grp = '{g}'" for g in GROUPS for a, m in (("val", "total_value"), ("vol", "volume"), ("hi", "highest_amount"), ("ent", "")))
_OTHER = "select id, 'm' || k || '_daily_avg_bal' as f, bal[k] as v from c, range(1, 7) r(k) union all select id, 'age', age from c union all select id, 'arpu', arpu from c"

#: ``feature, n, mean`` of every column that the frame adds to the panel.
SQL = f"""
with {PANEL},
d as (select id, grp as name, val as d, true as value from s union all select id, grp || '_vol', vol, false from s union all select id, grp || '_highest', hi, false from s),
l as (select *, list_transform(d, lambda x: ln(1 + greatest(x, 0))) as g from d),
raw_series as (select id, {_unnested(_of_series("d"), "name || '_'")} from l union all select id, {_unnested(_ACTIVITY, "name || '_'")} from l where value
  union all select id, {_unnested({f"{k}_log": v for k, v in _of_series("g").items() if k in _LOG}, "name || '_'")} from l),
patterns as (select p, row_number() over (order by p) - 1 as pattern from (select distinct coalesce(earning_pattern, 'nan') as p from c)),
flows as (select c.*, pattern, {_sum(INFLOW, "val")} as i, {_sum(OUTFLOW, "val")} as o, {_flow(INFLOW, "val")} as inv, {_flow(OUTFLOW, "val")} as outv, {_flow(INFLOW, "vol")} as inn, {_flow(OUTFLOW, "vol")} as outn
  from c join patterns on p = coalesce(earning_pattern, 'nan')),
nets as (select *, list_transform(list_zip(inv, outv), lambda x: x[1] - x[2]) as net, list_transform(list_zip(inn, outn), lambda x: x[1] - x[2]) as netn from flows),
raw_domain as (select id, {_unnested(_domain())} from nets),
cells_long as ({_CELLS} union all {_OTHER}),
band as (select f from cells_long group by f having avg((v = 0)::int) between 0.60 and 0.98),
raw as (select * from raw_series union all select * from raw_domain union all select id, f || '_is_zero', (v = 0)::int::double from cells_long semi join band using (f)),
first as (select f, case when contains(f, 'ratio') and quantile_cont(v, 0.99) > 0 then quantile_cont(v, 0.99) else 'inf'::double end as b from raw group by f),
once as (select id, f, least(v, b) as v from raw join first using (f)),
second as (select f, case when f in ({", ".join(f"'{w}'" for w in _WINSOR)}) and quantile_cont(v, 0.99) > 0 then quantile_cont(v, 0.99) else 'inf'::double end as b from once group by f having min(v) < max(v)),
twice as (select f, least(v, b) as v from once join second using (f))
select f as feature, count(*) as n, case when abs(avg(v)) < 1000000 then round(avg(v), 3) else sign(avg(v)) * round(log10(abs(avg(v))), 6) end as mean from twice group by f
"""
