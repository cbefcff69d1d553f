"""From order lines to the six-period customer panel.

Lines and orders meet by order; the joined lines are then summed up by customer, group and month, and the months become
conditional aggregates, without a pivot. Amounts are summed as decimals, so totals don't depend on order.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tideline.plans.schema import ENTITIES, GROUPS, INFLOW, MEASURES, MONTHS

#: Periods of 401 days back from the end of the orders.
END, DAYS = "2001-08-01 00:00:00", 401


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def long_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, m, grp`` (its number) and the month's measures, where a customer has any."""
    orders = table(spark, sf_dir, "orders").select(
        "o_orderkey", F.col("o_custkey").alias("id"), F.expr(f"cast(1 + floor(datediff(timestamp '{END}', o_orderdate) / {DAYS}.0) as int)").alias("m"), F.expr("cast(o_orderkey % 7 as int)").alias("grp")
    )
    lines = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_extendedprice").cast("decimal(18,2)").alias("amount"), "l_suppkey")
    joined = orders.where("m between 1 and 6").join(lines, F.col("o_orderkey") == F.col("l_orderkey"))
    return joined.groupBy("id", "m", "grp").agg(
        F.sum("amount").cast("double").alias("total_value"), F.count("*").cast("double").alias("volume"), F.max("amount").cast("double").alias("highest_amount"), F.count_distinct("l_suppkey").cast("double").alias("entities")
    )


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id, grp`` (its name) and the arrays val, vol, hi, ent: every customer has every group, with 0 where empty."""
    cells = {"val": "total_value", "vol": "volume", "hi": "highest_amount", "ent": "entities"}
    found = long_panel(spark, sf_dir).groupBy("id", "grp").agg(*(F.expr(f"array({', '.join(f'coalesce(max(case when m = {k} then {c} end), 0D)' for k in range(1, 7))})").alias(a) for a, c in cells.items()))
    names = F.array(*map(F.lit, GROUPS))
    every = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("id"), F.explode(F.sequence(F.lit(0), F.lit(6))).alias("grp"))
    zeros = F.array(*[F.lit(0.0)] * 6)
    return every.join(found, ["id", "grp"], "left").select("id", names[F.col("grp")].alias("grp"), *(F.coalesce(a, zeros).alias(a) for a in cells))


def customers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``id``, attributes and the array bal, with one struct of arrays a group: ``deposit.val`` and so on."""
    by = series(spark, sf_dir).groupBy("id").agg(*(F.first(F.when(F.col("grp") == g, F.struct("val", "vol", "hi", "ent")), ignorenulls=True).alias(g) for g in GROUPS))
    attributes = table(spark, sf_dir, "customer").selectExpr(
        "c_custkey as id", "c_acctbal", "abs(c_acctbal) / 10 as arpu", "cast(18 + c_custkey % 60 as double) as age",
        "case when c_custkey % 50 = 0 then null when c_custkey % 50 = 1 then ' HVC ' when c_custkey % 50 = 2 then 'mvc' when c_acctbal < 2500 then 'LVC' when c_acctbal < 6500 then 'MVC' else 'HVC' end as segment",
        "case when c_custkey % 37 = 0 then null else c_mktsegment end as earning_pattern",
        "case c_custkey % 4 when 0 then ' YES ' when 1 then 'no' when 2 then '1' end as smartphone",
        "case c_custkey % 3 when 0 then 'M' when 1 then 'f' else 'Male' end as gender",
    )
    net = [" + ".join(f"{g}.val[{i}]" for g in INFLOW) + " - (" + " + ".join(f"{g}.val[{i}]" for g in GROUPS if g not in INFLOW) + ")" for i in range(6)]
    return attributes.join(by, "id").withColumn("bal", F.expr("array(" + ", ".join(f"c_acctbal + ({x}) / 401D" for x in net) + ")"))


def zero_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``feature, zero_rate`` of the 168 transaction columns, counted in the long panel: no wide row is made; null without customers."""
    cells = (*MEASURES, "entities")
    filled = long_panel(spark, sf_dir).groupBy("m", "grp").agg(*(F.count_if(F.col(c) != 0).alias(c) for c in cells))
    every = spark.range(6).select((F.col("id") + 1).cast("int").alias("m")).join(spark.range(len(GROUPS)).select(F.col("id").cast("int").alias("grp")), how="cross")  # 42 rows
    n = table(spark, sf_dir, "customer").agg(F.count("*").alias("customers"))
    rows = every.join(filled, ["m", "grp"], "left").fillna(0, [*cells]).unpivot(["m", "grp"], [*cells], "cell", "filled").crossJoin(n)  # one row
    names, entity = F.array(*map(F.lit, GROUPS)), F.array(*(F.lit(ENTITIES[g]) for g in GROUPS))
    cell = F.when(F.col("cell") == "entities", entity[F.col("grp")]).otherwise(F.col("cell"))
    return rows.select(F.concat(F.lit("m"), "m", F.lit("_"), names[F.col("grp")], F.lit("_"), cell).alias("feature"), F.try_divide(F.col("customers") - F.col("filled"), "customers").alias("zero_rate"))


def wide_columns() -> dict[str, str]:
    """The panel's full names and their formulas over ``customers``."""
    arrays = dict(zip((*MEASURES, "entities"), ("val", "vol", "hi", "ent"), strict=True))
    out = {"ID": "cast(id as string)"} | {c: c for c in ("gender", "segment", "earning_pattern", "smartphone", "age", "arpu")} | {f"{m}_daily_avg_bal": f"bal[{i}]" for i, m in enumerate(MONTHS)}
    return out | {f"{m}_{g}_{ENTITIES[g] if x == 'entities' else x}": f"{g}.{arrays[x]}[{i}]" for g in GROUPS for x in arrays for i, m in enumerate(MONTHS)}


def wide_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel under its full names: attributes, balances and 168 transaction columns."""
    return customers(spark, sf_dir).selectExpr(*(f"{f} as {c}" for c, f in wide_columns().items()))


_CELLS = ", ".join(f"[{', '.join(f'coalesce(max({c}) filter (m = {k}), 0)' for k in range(1, 7))}] as {a}" for a, c in (("val", "total_value"), ("vol", "volume"), ("hi", "highest_amount"), ("ent", "entities")))
#: The same panel for the oracles: long, s (series) and c (customers with structs of lists).
SQL = f"""
long as (select o_custkey as id, 1 + cast(floor(datediff('day', o_orderdate, timestamp '{END}') / 401.0) as int) as m, cast(o_orderkey % 7 as int) as g,
  cast(sum(cast(l_extendedprice as decimal(18,2))) as double) as total_value, cast(count(*) as double) as volume,
  cast(max(cast(l_extendedprice as decimal(18,2))) as double) as highest_amount, cast(count(distinct l_suppkey) as double) as entities
  from orders join lineitem on l_orderkey = o_orderkey group by 1, 2, 3 having m between 1 and 6),
cells as (select id, g, {_CELLS} from long group by id, g),
s as (select c_custkey as id, {list(GROUPS)}[k + 1] as grp, coalesce(val, [0, 0, 0, 0, 0, 0]::double[]) as val, coalesce(vol, [0, 0, 0, 0, 0, 0]::double[]) as vol,
  coalesce(hi, [0, 0, 0, 0, 0, 0]::double[]) as hi, coalesce(ent, [0, 0, 0, 0, 0, 0]::double[]) as ent
  from customer cross join range(7) r(k) left join cells on cells.id = c_custkey and cells.g = k),
by_id as (select id, {", ".join(f"any_value({{'val': val, 'vol': vol, 'hi': hi, 'ent': ent}}) filter (grp = '{g}') as {g}" for g in GROUPS)} from s group by id),
c as (select b.*, c_acctbal, abs(c_acctbal) / 10 as arpu, cast(18 + c_custkey % 60 as double) as age,
  case when c_custkey % 50 = 0 then null when c_custkey % 50 = 1 then ' HVC ' when c_custkey % 50 = 2 then 'mvc' when c_acctbal < 2500 then 'LVC' when c_acctbal < 6500 then 'MVC' else 'HVC' end as segment,
  case when c_custkey % 37 = 0 then null else c_mktsegment end as earning_pattern, case c_custkey % 4 when 0 then ' YES ' when 1 then 'no' when 2 then '1' end as smartphone,
  case c_custkey % 3 when 0 then 'M' when 1 then 'f' else 'Male' end as gender,
  [{", ".join("c_acctbal + (" + " + ".join(f"{g}.val[{i}]" for g in INFLOW) + " - (" + " + ".join(f"{g}.val[{i}]" for g in GROUPS if g not in INFLOW) + ")) / 401::double" for i in range(1, 7))}] as bal
  from by_id b join customer on c_custkey = b.id)
"""
