"""Encodings of attributes, and flags of columns that are mostly zero."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tideline.operators.ranks import before, between, sampled

#: The order of segments, what counts as a smartphone, and the band of zero rates that makes a flag.
SEGMENTS = {"LVC": 0, "MVC": 1, "HVC": 2}
SMARTPHONE = ("yes", "1", "true")
ZERO_BAND = (0.60, 0.98)


def segment(c: str = "segment") -> Column:
    """Upper-cased but not trimmed; what is unknown or null is 1."""
    return F.coalesce(F.create_map(*(F.lit(x) for kv in SEGMENTS.items() for x in kv))[F.upper(c)], F.lit(1))


def smartphone(c: str = "smartphone") -> Column:
    return F.coalesce(F.lower(F.trim(c)).isin(*SMARTPHONE), F.lit(False)).cast("int")


def is_male(c: str = "gender") -> Column:
    return F.coalesce(F.upper(F.trim(c)) == "M", F.lit(False)).cast("int")


def normal_gender(c: str = "gender") -> Column:
    """MALE and FEMALE as M and F, as requests are normalised before they are encoded."""
    g = F.upper(F.trim(c))
    return F.when(g == "MALE", "M").when(g == "FEMALE", "F").otherwise(g)


def fit_codes(df: DataFrame, c: str) -> dict[str, int]:
    """Dense codes of a column's sorted values, null as 'nan', as literals for ``apply_codes``.

    For columns of few values, such as attributes; ``code_table`` has those of any column as a table to join.
    """
    rows = df.select(F.coalesce(c, F.lit("nan")).alias("v")).distinct().orderBy("v").collect()
    return {r.v: i for i, r in enumerate(rows)}


def code_table(df: DataFrame, c: str) -> DataFrame:
    """``value, code`` of a column of any number of values: ranked within ranges between sampled ones."""
    values = df.select(F.coalesce(c, F.lit("nan")).alias("value")).distinct()
    values = between(values, "value", sampled(values, "value"))
    counts = values.groupBy("range").agg(F.count("*").alias("n"))
    rank = F.row_number().over(Window.partitionBy("range").orderBy("value")) - 1
    return values.withColumn("rank", rank).join(before(counts, [], ["n"]), "range").select("value", (F.col("rank") + F.col("before_n")).cast("int").alias("code"))


def apply_codes(c: str, codes: Mapping[str, int]) -> Column:
    """Fitted codes; values that weren't there at the fit are 0."""
    pairs = [F.lit(x) for kv in codes.items() for x in kv]
    return F.coalesce(F.create_map(*pairs)[F.coalesce(c, F.lit("nan"))], F.lit(0)) if pairs else F.lit(0)


def zero_rates(df: DataFrame, columns: list[str]) -> DataFrame:
    """``feature, zero_rate`` of many columns in one pass."""
    row = df.agg(*(F.avg((F.coalesce(c, F.lit(0.0)) == 0).cast("int")).alias(c) for c in columns))
    return row.unpivot([], columns, "feature", "zero_rate")


def in_band(rates: DataFrame, columns: list[str]) -> list[str]:
    """Those of ``columns`` whose zero rate (a row of ``rates``) lies in the band."""
    found = {r.feature for r in rates.where(F.col("zero_rate").between(*ZERO_BAND)).collect()}
    return [c for c in columns if c in found]


def fit_zero_flags(df: DataFrame, columns: list[str]) -> list[str]:
    """Columns of ``df`` whose zero rate lies in the band."""
    return in_band(zero_rates(df, columns), columns)


def zero_flags(columns: list[str]) -> list[Column]:
    return [(F.coalesce(c, F.lit(0.0)) == 0).cast("tinyint").alias(f"{c}_is_zero") for c in columns]
