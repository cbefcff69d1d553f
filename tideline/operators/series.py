"""Features of each series of the panel, in long rows: one row a customer, group and measure.

Long rows keep plans small: 21 series share one set of formulas. ``features_wide`` turns them into one row a customer
under the full names. A customer's series are held in one row that is unfolded, so its long rows are neighbours and are
put together again in the task that made them: no feature is shuffled.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Mapping, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tideline.functions.series import BLOCKS, LOG_BLOCK, SPARK
from tideline.plans.schema import GROUPS, series_names

#: Fixed value: about as many customers share a task that makes features. Who writes these holds a dictionary for each of
#: hundreds of columns, which grows with the task's rows and isn't counted in the size of what waits to be written.
CUSTOMERS = 10_000
#: Array of each measure in the panel's series.
ARRAYS = {"total_value": "val", "volume": "vol", "highest_amount": "hi"}


def block(series: DataFrame, name: str, array: str = "val", show: Callable[[str], str] = str) -> DataFrame:
    """``id, grp`` and a block's features of one measure; ``show`` wraps each formula (say, in a rounding)."""
    return series.selectExpr("id", "grp", *(f"{show(f(SPARK, array))} as {c}" for c, f in BLOCKS[name].items()))


def log_block(series: DataFrame, array: str = "val", show: Callable[[str], str] = str) -> DataFrame:
    """``id, grp`` and the features of the logged series, named with ``_log``."""
    staged = series.selectExpr("id", "grp", f"{SPARK.logged(array)} as d")
    return staged.selectExpr("id", "grp", *(f"{show(f(SPARK, 'd'))} as {c}_log" for c, f in LOG_BLOCK.items()))


def by_window(long_rows: DataFrame) -> DataFrame:
    """The window form over rows ``id, grp, m, v`` (all six months present): the same values as the array form."""
    w = Window.partitionBy("id", "grp").orderBy("m")
    whole = w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    out = long_rows.select(
        "id", "grp", "m", (F.col("v") - F.lead("v", 1).over(w)).alias("momentum"), ((F.col("v") - F.lead("v", 1).over(w)) - (F.lead("v", 1).over(w) - F.lead("v", 2).over(w))).alias("acceleration"),
        (F.first("v").over(whole) - F.last("v").over(whole)).alias("trend"), F.coalesce(F.min(F.when(F.col("v") > 0, F.col("m"))).over(whole) - 1, F.lit(6)).alias("zero_streak"), F.count_if(F.col("v") > 0).over(whole).alias("active_months"),
    )
    return out.where("m = 1").drop("m")


def raw_names() -> dict[str, tuple[str, str, str]]:
    """Name -> (array, group, formula's name) of the raw layer; activity belongs to value series alone."""
    out = {}
    for series, group, measure in series_names():
        for block_name, formulas in BLOCKS.items():
            if block_name == "activity" and measure != "total_value":
                continue
            out |= {f"{series}_{c}": (ARRAYS[measure], group, c) for c in formulas}
        out[f"{series}_recency_ratio_log"] = (ARRAYS[measure], group, "recency_ratio_log")
    return out


def log_names() -> dict[str, tuple[str, str, str]]:
    """The same of the log layer; its ``recency_ratio_log`` takes the place of the raw layer's."""
    return {f"{series}_{c}_log": (ARRAYS[measure], group, c) for series, group, measure in series_names() for c in LOG_BLOCK}


def features_wide(series: DataFrame) -> DataFrame:
    """One row a customer with all raw and log features of the 21 series; those of a group that it lacks are null."""
    return features_of(by_id(spread(series)))


def spread(rows: DataFrame, key: str = "id") -> DataFrame:
    """``rows`` dealt by ``key`` over tasks of about ``CUSTOMERS`` keys each, however few bytes these have; small tables over
    the cores. The keys are counted first, in a job that reads no other column."""
    n = rows.agg(F.approx_count_distinct(key)).first()[0]
    return rows.repartition(max(1, math.ceil(n / CUSTOMERS), min(n // 500, rows.sparkSession.sparkContext.defaultParallelism)), key)


def by_id(series: DataFrame) -> DataFrame:
    """``id`` and a struct of arrays for each group, null where the customer has no such row."""
    return series.groupBy("id").agg(*(F.first(F.when(F.col("grp") == g, F.struct(*ARRAYS.values())), ignorenulls=True).alias(g) for g in GROUPS))


def features_of(rows: DataFrame, numbers: Mapping[str, str] | None = None, keep: Sequence[str] = ("id",)) -> DataFrame:
    """The columns ``keep``, then ``numbers`` (formulas by name, as doubles) and the features of the 21 series, from rows with
    a struct of arrays for each group; the first of ``keep`` is the key."""
    numbers = numbers or {}
    series = [(a, g) for g in GROUPS for a in ARRAYS.values()]
    # lists that are null in row after row cost Arrow's writer the square of a batch's rows: no numbers, no such column
    carried = [f", 'n', array({', '.join(f'n{k}' for k in range(len(numbers)))})", *[", 'n', cast(null as array<double>)"] * (len(series) - 1)] if numbers else [""] * len(series)
    unfolded = ", ".join(f"named_struct('d', {g}.{a}, 'l', if({g}.{a} is null, null, {SPARK.logged(f'{g}.{a}')}){n})" for (a, g), n in zip(series, carried, strict=True))
    kept = [f"k{k}" for k in range(len(keep))]
    # numbers are columns before they are an array: Spark then compiles them in parts
    x = rows.select(*(F.col(f"`{c}`").alias(k) for c, k in zip(keep, kept, strict=True)), *GROUPS, *(F.expr(f"cast({f} as double)").alias(f"n{k}") for k, f in enumerate(numbers.values())))
    x = x.selectExpr(*kept, f"inline(array({unfolded}))")
    made = {c: f(SPARK, "d") for b in BLOCKS.values() for c, f in b.items()} | {f"{c}_log": f(SPARK, "l") for c, f in LOG_BLOCK.items()}
    x = x.selectExpr(*kept, *["n"] * bool(numbers), *(f"if(d is null, null, cast({f} as double)) as f{k}" for k, f in enumerate(made.values())))
    names = {n: of for n, of in raw_names().items() if of[2] != "recency_ratio_log"} | {n: (a, g, f"{c}_log") for n, (a, g, c) in log_names().items()}
    places, of = {c: k for k, c in enumerate(made)}, {s: k for k, s in enumerate(series)}
    found = [(places[c], of[a, g]) for a, g, c in names.values()]
    schema = T.StructType([*x.schema.fields[: len(keep)], *(T.StructField(f"v{k}", T.DoubleType()) for k in range(len(numbers) + len(found)))])
    return x.mapInArrow(_folded(len(keep), len(numbers), found, len(series)), schema).toDF(*keep, *numbers, *names)


def _folded(n_kept: int, n_numbers: int, found: list[tuple[int, int]], n: int):
    """Every ``n`` neighbouring rows become one: the features ``found`` by column and row, behind the first row's numbers."""

    def run(batches):
        left = None
        for batch in batches:
            rows = pa.Table.from_batches([left, batch] if left else [batch]).combine_chunks()
            whole = rows.num_rows // n
            left = next(iter(rows.slice(whole * n).to_batches()), None)
            if not whole:
                continue
            rows = rows.slice(0, whole * n)
            columns = [c.chunk(0) for c in rows.columns]
            first = pa.array(np.arange(whole) * n)
            if columns[0].take(first) != columns[0].take(pa.array(np.arange(whole) * n + n - 1)):
                raise ValueError("a customer's series aren't neighbours")
            out = [c.take(first) for c in columns[:n_kept]]
            if n_numbers:
                values = columns[n_kept].take(first).flatten()
                out += [values.take(pa.array(np.arange(whole) * n_numbers + k)) for k in range(n_numbers)]
            at = [pa.array(np.arange(whole) * n + k) for k in range(n)]
            out += [columns[n_kept + bool(n_numbers) + c].take(at[k]) for c, k in found]
            yield pa.RecordBatch.from_arrays(out, names=[*batch.schema.names[:n_kept], *(f"v{k}" for k in range(n_numbers + len(found)))])
        if left:
            raise ValueError("a customer's series aren't whole")

    return run
