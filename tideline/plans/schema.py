"""The customer panel's columns: fixed names, which other data and saved specifications rely on."""

from __future__ import annotations

from pyspark.sql import types as T

#: Groups of transactions, whom each counts, and the measures of a group's month.
INFLOW = ("deposit", "received", "transfer_from_bank")
OUTFLOW = ("withdraw", "merchantpay", "paybill", "mm_send")
GROUPS = (*INFLOW, *OUTFLOW)
ENTITIES = {
    "deposit": "agents",
    "withdraw": "agents",
    "mm_send": "recipients",
    "received": "senders",
    "merchantpay": "merchants",
    "paybill": "companies",
    "transfer_from_bank": "banks",
}
MONTHS = ("m1", "m2", "m3", "m4", "m5", "m6")
MEASURES = ("total_value", "volume", "highest_amount")
PROFILE = ("gender", "region", "segment", "earning_pattern", "smartphone")
NUMBERS = ("age", "x_90_d_activity_rate", "arpu")
ID, TARGET = "ID", "liquidity_stress_next_30d"


def measures(group: str) -> tuple[str, ...]:
    """The four measures of a group's month."""
    return (*MEASURES, ENTITIES[group])


def balances() -> list[str]:
    return [f"{m}_daily_avg_bal" for m in MONTHS]


def transactions() -> list[str]:
    return [f"{m}_{g}_{x}" for g in GROUPS for x in measures(g) for m in MONTHS]


def wide(target: bool = False) -> T.StructType:
    """One row a customer: 183 fields, 184 with the target."""
    fields = [T.StructField(ID, T.StringType(), False)]
    fields += [T.StructField(c, T.StringType()) for c in PROFILE]
    fields += [T.StructField(c, T.DoubleType()) for c in (*NUMBERS, *balances(), *transactions())]
    return T.StructType(fields + [T.StructField(TARGET, T.IntegerType())] * target)


def series_names() -> list[tuple[str, str, str]]:
    """Name, group and measure of the 21 series of the raw layer."""
    suffix = {"total_value": "", "volume": "_vol", "highest_amount": "_highest"}
    return [(g + suffix[x], g, x) for x in MEASURES for g in GROUPS]
