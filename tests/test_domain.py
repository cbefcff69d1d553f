"""The cross-group blocks against their definitions in NumPy, customer by customer; nothing of the library's formulas is used."""

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from tideline import queries  # noqa: F401  before its parts
from tideline import queries_more
from tideline.operators import domain, encoding
from tideline.plans.panel import customers, wide_panel, zero_rates

SF, EPS = "/root/testdata/sf0.001", 1e-6
IN, OUT = ("deposit", "received", "transfer_from_bank"), ("withdraw", "merchantpay", "paybill", "mm_send")


def slope(d):
    x = np.arange(len(d))[::-1]
    return ((d - d.mean()) * (x - x.mean())).sum() / (((x - x.mean()) ** 2).sum() + EPS)


def recency(d):
    return d[:3].mean() / (d[3:].mean() + EPS)


def cv(d):
    return d.std() / (d.mean() + EPS)


def bend(d):
    return (d[0] - d[1]) - (d[1] - d[2])


def expected(c):
    """Features of one customer by block; arrays start with the newest month."""
    bal, arpu = np.array(c.bal), c.arpu
    val, vol, ent = ({g: np.array(c[g][a]) for g in IN + OUT} for a in ("val", "vol", "ent"))
    inflow, outflow = sum(val[g] for g in IN), sum(val[g] for g in OUT)
    vol_in, vol_out = sum(vol[g] for g in IN), sum(vol[g] for g in OUT)
    net, vol_net = inflow - outflow, vol_in - vol_out
    total_in, total_out, peak = inflow.sum(), outflow.sum(), bal.max()
    withdraw, deposit, bank = val["withdraw"], val["deposit"], val["transfer_from_bank"]
    out = {
        "balance": {
            "balance_trend": bal[0] - bal[5], "balance_slope": slope(bal), "balance_volatility": bal.std(), "balance_cv": cv(bal), "balance_range": peak - bal.min(), "balance_min": bal.min(), "balance_max": peak,
            "balance_m1": bal[0], "balance_recovery": bal[0] - bal[1:].min(), "balance_trend_3m": bal[0] - bal[2],
        },
        "drawdown": {"balance_drawdown": (peak - bal[0]) / (peak + EPS), "balance_drawdown_abs": peak - bal[0]},
        "pressure": {"balance_to_spend_pressure": bal[0] / (withdraw.sum() + EPS), "m1_withdraw_balance_ratio": withdraw[0] / (bal[0] + EPS), "balance_to_outflow_ratio": bal[0] / (total_out + EPS)},
        "cashflow": {
            "total_inflow_6m": total_in, "total_outflow_6m": total_out, "net_cashflow_6m": total_in - total_out, "net_flow_ratio": (total_in - total_out) / (total_in + total_out + EPS), "spend_to_inflow": total_out / (total_in + EPS),
            "withdraw_deposit_ratio": withdraw.sum() / (deposit.sum() + EPS), "m1_withdraw_deposit_ratio": withdraw[0] / (deposit[0] + EPS),
        },
        "cashflow_slopes": {"net_cashflow_slope": slope(net), "inflow_slope": slope(inflow), "outflow_slope": slope(outflow), "inflow_outflow_slope_divergence": slope(inflow) - slope(outflow), "net_cashflow_m1": net[0]},
        "cashflow_volatility": {"cashflow_volatility": net.std(), "cashflow_volatility_cv": net.std() / (abs(net.mean()) + EPS)},
        "volume_cashflow": {
            "net_txn_volume_slope": slope(vol_net), "inflow_volume_slope": slope(vol_in), "outflow_volume_slope": slope(vol_out), "volume_slope_divergence": slope(vol_in) - slope(vol_out), "net_txn_volume_m1": vol_net[0],
            "total_txn_volume_6m": vol_in.sum() + vol_out.sum(), "net_txn_volume_momentum": vol_net[0] - vol_net[1], "inflow_volume_recency_ratio": recency(vol_in), "outflow_volume_recency_ratio": recency(vol_out),
        },
        "p2p": {
            "p2p_net_flow": val["received"].sum() - val["mm_send"].sum(), "p2p_receive_send_ratio": val["received"].sum() / (val["mm_send"].sum() + EPS),
            "p2p_m1_ratio": val["received"][0] / (val["mm_send"][0] + EPS), "p2p_inflow_share": val["received"].sum() / (total_in + EPS),
        },
        "bank": {
            "bank_transfer_slope": slope(bank), "bank_transfer_trend": bank[0] - bank[5], "bank_transfer_m1": bank[0], "bank_has_bank_inflow": int(bank.sum() > 0),
            "deposit_intensity": deposit.sum() / (arpu + EPS), "bank_transfer_vs_arpu": bank.sum() / (6 * arpu + EPS),
        },
        "interactions": {
            "balance_trend_x_balance_level": (bal[0] - bal[5]) * bal[1], "deposit_recency_x_balance": recency(deposit) * bal[0], "withdraw_recency_x_spend_ratio": recency(withdraw) * total_out / (total_in + EPS),
            "balance_cv_x_drawdown": cv(bal) * (peak - bal[0]) / (peak + EPS), "cashflow_slope_x_balance": slope(net) * bal[0], "deposit_value_x_volume_recency": recency(deposit) * recency(vol["deposit"]),
            "withdraw_value_x_volume_acceleration": bend(withdraw) * bend(vol["withdraw"]),
        },
        "txn_size": {}, "entities": {},
    }
    for g in IN + OUT:
        v, n, e = val[g], vol[g], ent[g]
        size = f"avg_txn_size_{g}"
        out["txn_size"] |= {
            size: v.mean() / (n.mean() + EPS), f"{size}_trend": v[0] / (n[0] + EPS) - v[5] / (n[5] + EPS),
            f"{size}_recency_ratio": (v[:3].mean() / (n[:3].mean() + EPS)) / (v[3:].mean() / (n[3:].mean() + EPS) + EPS),
        }
        name = f"{g}_unique_" + {"deposit": "agents", "received": "senders", "transfer_from_bank": "banks", "withdraw": "agents", "merchantpay": "merchants", "paybill": "companies", "mm_send": "recipients"}[g]
        out["entities"] |= {f"{name}_mean": e.mean(), f"{name}_trend": e[0] - e[5], f"{name}_m1": e[0], f"{name}_recency_ratio": recency(e), f"{name}_slope": slope(e)}
    return out


@pytest.fixture(scope="module")
def panel(spark):
    return customers(spark, SF).persist()


@pytest.fixture(scope="module")
def wanted(panel):
    return {c.id: expected(c) for c in panel.collect()}


@pytest.mark.parametrize("name", [*domain.BLOCKS])
def test_block(panel, wanted, name):
    rows = domain.block(panel, name).collect()
    assert {r.id for r in rows} == wanted.keys() and len(rows) == len(wanted) > 100
    for r in rows:
        want = wanted[r.id][name]
        found = r.asDict()
        assert found.keys() - {"id"} == want.keys()
        for c, v in want.items():
            assert found[c] == pytest.approx(v, rel=1e-7, abs=1e-7), (r.id, c)


def test_zero_band(spark):
    """The band's columns by counts of the long panel are those that the wide rows show."""
    wide = wide_panel(spark, SF)
    columns = [c for c in wide.columns if "deposit" in c or "paybill" in c]
    found = encoding.in_band(zero_rates(spark, SF), columns)
    assert found == encoding.fit_zero_flags(wide, columns) and 0 < len(found) <= len(columns)


def test_means_on_rounding_ties(spark):
    """Means that lie on a tie of their third place are rounded as in the profile's SQL."""
    values = [s * (k + 0.5) / 1000 for k in range(3000) for s in (1, -1)] + [0.0, 2.5e6, -1.2345675e9]
    got = [r.mean for r in spark.createDataFrame([(i, x) for i, x in enumerate(values)], "i long, x double").select("i", queries_more._shown(F.col("x")).alias("mean")).orderBy("i").collect()]
    con = duckdb.connect()
    con.execute("create table t (i bigint, x double)")
    con.executemany("insert into t values (?, ?)", [*enumerate(values)])
    want = [r[0] for r in con.execute("select case when abs(x) < 1000000 then round(x, 3) else sign(x) * round(log10(abs(x)), 6) end from t order by i").fetchall()]
    assert got == want
