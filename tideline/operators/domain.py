"""Features of a customer across groups: balance, cash flow, counterparties, interactions.

``stage`` adds the monthly flows once; every block is then a dictionary of SQL formulas over them, for one ``select``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame

from tideline.functions.series import PERIODS, SPARK, Series
from tideline.plans.schema import ENTITIES, GROUPS, INFLOW, OUTFLOW


def flows(x: Series) -> dict[str, str]:
    """Arrays of a month's inflow and outflow by value (v) and by count (n), and what is left."""
    array = ("array(", ")") if x.base == 0 else ("[", "]")
    plus = lambda groups, a, i: "(" + " + ".join(x.at(f"{g}.{a}", i) for g in groups) + ")"
    out = {}
    for a, name in (("val", "v"), ("vol", "n")):
        sums = {"in": [plus(INFLOW, a, i) for i in range(PERIODS)], "out": [plus(OUTFLOW, a, i) for i in range(PERIODS)]}
        sums["net"] = [f"({p} - {q})" for p, q in zip(sums["in"], sums["out"], strict=True)]
        out |= {f"{k}_{name}": array[0] + ", ".join(s) + array[1] for k, s in sums.items()}
    return out


def stage(customers: DataFrame) -> DataFrame:
    """Customers with the arrays of ``flows``."""
    return customers.selectExpr("*", *(f"{f} as {name}" for name, f in flows(SPARK).items()))


def balance(x: Series) -> dict[str, str]:
    b = "bal"
    return {
        "balance_trend": x.trend(b), "balance_slope": x.slope(b), "balance_volatility": x.std(b), "balance_cv": x.cv(b), "balance_range": f"({x.greatest(b)} - {x.least(b)})", "balance_min": x.least(b), "balance_max": x.greatest(b),
        "balance_m1": x.at(b, 0), "balance_recovery": f"({x.at(b, 0)} - {x.least(b, 1)})", "balance_trend_3m": f"({x.at(b, 0)} - {x.at(b, 2)})",
    }


def drawdown(x: Series) -> dict[str, str]:
    fall = f"({x.greatest('bal')} - {x.at('bal', 0)})"
    return {"balance_drawdown": x.ratio(fall, x.greatest("bal")), "balance_drawdown_abs": fall}


def pressure(x: Series) -> dict[str, str]:
    now = x.at("bal", 0)
    return {"balance_to_spend_pressure": x.ratio(now, x.total("withdraw.val")), "m1_withdraw_balance_ratio": x.ratio(x.at("withdraw.val", 0), now), "balance_to_outflow_ratio": x.ratio(now, x.total("out_v"))}


def cashflow(x: Series) -> dict[str, str]:
    i, o, w, d = x.total("in_v"), x.total("out_v"), "withdraw.val", "deposit.val"
    return {
        "total_inflow_6m": i, "total_outflow_6m": o, "net_cashflow_6m": f"({i} - {o})", "net_flow_ratio": x.ratio(f"({i} - {o})", f"{i} + {o}"), "spend_to_inflow": x.ratio(o, i),
        "withdraw_deposit_ratio": x.ratio(x.total(w), x.total(d)), "m1_withdraw_deposit_ratio": x.ratio(x.at(w, 0), x.at(d, 0)),
    }


def cashflow_slopes(x: Series) -> dict[str, str]:
    return {"net_cashflow_slope": x.slope("net_v"), "inflow_slope": x.slope("in_v"), "outflow_slope": x.slope("out_v"), "inflow_outflow_slope_divergence": f"({x.slope('in_v')} - {x.slope('out_v')})", "net_cashflow_m1": x.at("net_v", 0)}


def cashflow_volatility(x: Series) -> dict[str, str]:
    return {"cashflow_volatility": x.std("net_v"), "cashflow_volatility_cv": x.ratio(x.std("net_v"), f"abs({x.mean('net_v')})")}


def p2p(x: Series) -> dict[str, str]:
    r, s = "received.val", "mm_send.val"
    return {"p2p_net_flow": f"({x.total(r)} - {x.total(s)})", "p2p_receive_send_ratio": x.ratio(x.total(r), x.total(s)), "p2p_m1_ratio": x.ratio(x.at(r, 0), x.at(s, 0)), "p2p_inflow_share": x.ratio(x.total(r), x.total("in_v"))}


def bank(x: Series) -> dict[str, str]:
    b = "transfer_from_bank.val"
    return {
        "bank_transfer_slope": x.slope(b), "bank_transfer_trend": x.trend(b), "bank_transfer_m1": x.at(b, 0), "bank_has_bank_inflow": f"cast({x.total(b)} > 0 as int)",
        "deposit_intensity": x.ratio(x.total("deposit.val"), "arpu"), "bank_transfer_vs_arpu": x.ratio(x.total(b), "6 * arpu"),
    }


def interactions(x: Series) -> dict[str, str]:
    """Products of ratios that no bound has clipped; the first one takes the balance of the second month."""
    recency = {g: x.recency_ratio(f"{g}.val") for g in ("deposit", "withdraw")}
    return {
        "balance_trend_x_balance_level": f"({x.trend('bal')} * {x.at('bal', 1)})", "deposit_recency_x_balance": f"({recency['deposit']} * {x.at('bal', 0)})", "withdraw_recency_x_spend_ratio": f"({recency['withdraw']} * {cashflow(x)['spend_to_inflow']})",
        "balance_cv_x_drawdown": f"({x.cv('bal')} * {drawdown(x)['balance_drawdown']})", "cashflow_slope_x_balance": f"({x.slope('net_v')} * {x.at('bal', 0)})",
        "deposit_value_x_volume_recency": f"({recency['deposit']} * {x.recency_ratio('deposit.vol')})", "withdraw_value_x_volume_acceleration": f"({x.acceleration('withdraw.val')} * {x.acceleration('withdraw.vol')})",
    }


def txn_size(x: Series) -> dict[str, str]:
    out = {}
    for g in GROUPS:
        v, n = f"{g}.val", f"{g}.vol"
        size = lambda i, v=v, n=n: x.ratio(x.at(v, i), x.at(n, i))
        recent, past = x.ratio(x.mean(v, 0, 3), x.mean(n, 0, 3)), x.ratio(x.mean(v, 3, 6), x.mean(n, 3, 6))
        out |= {f"avg_txn_size_{g}": x.ratio(x.mean(v), x.mean(n)), f"avg_txn_size_{g}_trend": f"({size(0)} - {size(5)})", f"avg_txn_size_{g}_recency_ratio": x.ratio(recent, past)}
    return out


def entities(x: Series) -> dict[str, str]:
    out = {}
    for g in GROUPS:
        e, name = f"{g}.ent", f"{g}_unique_{ENTITIES[g]}"
        out |= {f"{name}_mean": x.mean(e), f"{name}_trend": x.trend(e), f"{name}_m1": x.at(e, 0), f"{name}_recency_ratio": x.recency_ratio(e), f"{name}_slope": x.slope(e)}
    return out


def volume_cashflow(x: Series) -> dict[str, str]:
    return {
        "net_txn_volume_slope": x.slope("net_n"), "inflow_volume_slope": x.slope("in_n"), "outflow_volume_slope": x.slope("out_n"), "volume_slope_divergence": f"({x.slope('in_n')} - {x.slope('out_n')})", "net_txn_volume_m1": x.at("net_n", 0),
        "total_txn_volume_6m": f"({x.total('in_n')} + {x.total('out_n')})", "net_txn_volume_momentum": x.momentum("net_n"), "inflow_volume_recency_ratio": x.recency_ratio("in_n"), "outflow_volume_recency_ratio": x.recency_ratio("out_n"),
    }


#: The blocks in the order of their columns.
BLOCKS = {
    "balance": balance, "drawdown": drawdown, "pressure": pressure, "cashflow": cashflow, "cashflow_slopes": cashflow_slopes, "cashflow_volatility": cashflow_volatility, "volume_cashflow": volume_cashflow,
    "p2p": p2p, "bank": bank, "interactions": interactions, "txn_size": txn_size, "entities": entities,
}


def block(customers: DataFrame, name: str, show: Callable[[str], str] = str) -> DataFrame:
    """``id`` and one block's features; ``show`` wraps each formula (say, in a rounding)."""
    return stage(customers).selectExpr("id", *(f"{show(f)} as {c}" for c, f in BLOCKS[name](SPARK).items()))
