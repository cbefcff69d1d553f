"""Sources: CSV tables with typed columns, request rows, and the artifacts of earlier runs."""

from __future__ import annotations

import json
import warnings
from collections.abc import Iterable, Mapping
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: What stands for a missing value in a text column.
MISSING = ("", "nan", "NaN", "None", "null")


def _numeric(t: T.DataType) -> bool:
    return isinstance(t, T.NumericType)


def number(c: str, kind: str = "double") -> Column:
    """Text as a number; bad and missing values are null."""
    return F.when(F.trim(c).isin(*MISSING), None).otherwise(F.expr(f"try_cast(trim(`{c}`) as {kind})"))


def text(c: str) -> Column:
    return F.when(F.trim(c).isin(*MISSING), None).otherwise(F.trim(c))


def typed(df: DataFrame, schema: T.StructType) -> DataFrame:
    """Text columns (names trimmed) as those of a schema; columns that ``df`` lacks are left out, others stay text."""
    df = df.toDF(*(c.strip() for c in df.columns))
    kinds = {f.name: f.dataType for f in schema}
    return df.select(*((number(c, kinds[c].simpleString()) if _numeric(kinds[c]) else text(c)).alias(c) if c in kinds else F.col(c) for c in df.columns))


def read_csv(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A CSV file with a header. A missing file is an error of the reader."""
    return typed(spark.read.option("header", True).csv(path), schema)


def validate(df: DataFrame, key: str, target: str | None = None) -> dict[str, int]:
    """Rows, repeated and missing keys, and targets besides 0 and 1, in one pass; raises on what may not be."""
    bad = F.count_if(~F.col(target).isin(0, 1) & F.col(target).isNotNull()) if target else F.lit(0)
    row = df.agg(F.count("*").alias("rows"), F.count_distinct(key).alias("keys"), F.count_if(F.col(key).isNull()).alias("no_key"), bad.alias("bad_target")).first()
    if not row.rows:
        raise ValueError("the table is empty")
    if row.no_key or row.keys != row.rows:
        raise ValueError(f"{row.no_key} rows have no {key}, {row.rows - row.no_key - row.keys} repeat one")
    if row.bad_target:
        raise ValueError(f"{row.bad_target} rows have another {target} than 0 and 1")
    return row.asDict()


def load_pair(spark: SparkSession, train: str, test: str, schema: T.StructType, key: str, target: str) -> tuple[DataFrame, DataFrame]:
    """Training and test table, validated."""
    both = read_csv(spark, train, schema), read_csv(spark, test, T.StructType([f for f in schema if f.name != target]))
    validate(both[0], key, target)
    validate(both[1], key)
    return both


def load_test(spark: SparkSession, path: str, schema: T.StructType, key: str, expected: int | None = None) -> DataFrame:
    """Rows to be scored, validated, with their place in the file as ``row`` (rising, with gaps), so that a scored file
    can keep their order. Another number of rows than ``expected`` is a warning: the data may have been renewed.
    """
    df = read_csv(spark, path, schema)
    n = validate(df, key)["rows"]
    if expected is not None and n != expected:
        warnings.warn(f"{path} has {n} rows, not {expected}", stacklevel=2)
    return df.withColumn("row", F.monotonically_increasing_id())


def write_csv(df: DataFrame, path: str, dry_run: bool = False) -> None:
    """A scored file: one part, as it is handed in; a dry run writes nothing."""
    if not dry_run:
        df.coalesce(1).write.mode("overwrite").option("header", True).csv(path)


def write_run(df: DataFrame, path: str, stage: str, model: str, run: str) -> None:
    """Rows of a run, in folders by stage, model and run."""
    df.withColumns({"stage": F.lit(stage), "model": F.lit(model), "run": F.lit(run)}).write.mode("append").partitionBy("stage", "model", "run").parquet(path)


def latest_runs(runs: DataFrame, stages: tuple[str, ...]) -> DataFrame:
    """``model, stage, run``: each model's last run of the first of ``stages`` that has one."""
    order = F.array_position(F.array(*map(F.lit, stages)), F.col("stage"))
    best = runs.where(F.col("stage").isin(*stages)).groupBy("model").agg(F.max(F.struct((-order).alias("o"), "run", "stage")).alias("b"))
    return best.select("model", F.col("b.stage").alias("stage"), F.col("b.run").alias("run"))


def check_oof(oof: DataFrame) -> DataFrame:
    """Out-of-fold rows (id, model, y, p) by model: what may not be in them, and the base rate."""
    p = F.col("p")
    return oof.groupBy("model").agg(
        F.count("*").alias("n"), F.count_if(p.isNull() | F.isnan("p")).alias("n_missing"), F.count_if(F.abs(p) == float("inf")).alias("n_infinite"), F.count_if((p < 0) | (p > 1)).alias("n_outside"), F.round(F.avg("y"), 6).alias("base_rate")
    )


#: The band of the base rate of out-of-fold labels.
BASE_RATE = (0.13, 0.17)


def require_oof(oof: DataFrame, models: Iterable[str], expected: int | None = None, band: tuple[float, float] = BASE_RATE) -> None:
    """Raises unless each model has a valid score for as many rows (``expected``, or those of the model with most), and
    the base rate of the labels lies in the band."""
    found = {r.model: r for r in check_oof(oof).collect()}  # a row for each model
    n = expected if expected is not None else max((r.n for r in found.values()), default=0)
    wrong = [f"{m}: no scores" for m in models if m not in found]
    for m, r in sorted(found.items()):
        wrong += [f"{m}: {r.n} rows, not {n}"] if r.n != n else []
        wrong += [f"{m}: {r[c]} scores {what}" for c, what in (("n_missing", "missing"), ("n_infinite", "infinite"), ("n_outside", "outside 0 to 1")) if r[c]]
        wrong += [f"{m}: a base rate of {r.base_rate}"] if r.base_rate is None or not band[0] <= r.base_rate <= band[1] else []
    if wrong:
        raise ValueError("; ".join(wrong))


def key_difference(left: DataFrame, right: DataFrame, key: str, names: tuple[str, str] = ("left", "right")) -> DataFrame:
    """``side, n``: distinct keys that only one table has."""
    only = lambda a, b, name: a.select(key).distinct().join(b.select(key).distinct(), key, "left_anti").agg(F.count("*").alias("n")).select(F.lit(name).alias("side"), "n")
    return only(left, right, names[0]).unionAll(only(right, left, names[1]))


def unaligned(left: DataFrame, right: DataFrame, key: str, value: str) -> DataFrame:
    """``n_unaligned``: keys whose values differ between two tables, or that one of them lacks."""
    both = left.select(key, F.col(value).alias("__l")).join(right.select(key, F.col(value).alias("__r")), key, "full")
    return both.agg(F.count_if(~F.col("__l").eqNullSafe(F.col("__r"))).alias("n_unaligned"))


def metric_rows(experiment: str, run: str, values: dict[str, float], spark: SparkSession) -> DataFrame:
    """Tracked figures as long rows."""
    return spark.createDataFrame([(experiment, run, k, float(v)) for k, v in values.items()], "experiment string, run string, key string, value double")


def tracked(experiment: str, run: str, values: Mapping[str, Any], folds: Iterable[Mapping[str, Any]] = (), prefix: str = "") -> list[tuple]:
    """Rows (experiment, run, kind, key, step, value, text) of what a run has to tell: numbers are metrics, other values are
    parameters, nested ones have dotted keys; ``folds`` give a metric's value by step, its mean and its deviation."""
    out: list[tuple] = []

    def add(key: str, value: Any) -> None:
        if isinstance(value, Mapping):
            for k, v in value.items():
                add(f"{key}.{k}" if key else str(k), v)
        elif isinstance(value, (int, float)) and not isinstance(value, bool):
            out.append((experiment, run, "metric", prefix + key, None, float(value), None))
        elif value is not None:
            out.append((experiment, run, "param", prefix + key, None, None, value if isinstance(value, str) else json.dumps(value)))

    add("", values)
    folds = list(folds)
    for key in dict.fromkeys(k for f in folds for k in f if k != "fold"):
        by = {f["fold"]: float(f[key]) for f in folds if f.get(key) is not None}
        out += [(experiment, run, "metric", f"{prefix}{key}_fold", step, v, None) for step, v in sorted(by.items())]
        if by:
            mean = sum(by.values()) / len(by)
            out += [(experiment, run, "metric", f"{prefix}{key}_mean", None, mean, None), (experiment, run, "metric", f"{prefix}{key}_std", None, (sum((v - mean) ** 2 for v in by.values()) / len(by)) ** 0.5, None)]
    return out


TRACKED = "experiment string, run string, kind string, key string, step int, value double, text string"


def read_json(path: str) -> dict:
    """A small JSON file of a driver's run; nothing where there is none or it isn't JSON."""
    try:
        with open(path, encoding="utf-8") as f:
            found = json.load(f)
    except (OSError, ValueError):
        return {}
    return found if isinstance(found, dict) else {}


def request_frame(spark: SparkSession, request: dict, schema: T.StructType) -> DataFrame:
    """One request as a row of a schema: missing values are null, text is made a number where the schema has one."""
    row = {c.strip(): None if v is None else str(v) for c, v in request.items()}
    return typed(spark.createDataFrame([tuple(row.get(f.name) for f in schema)], T.StructType([T.StructField(f.name, T.StringType()) for f in schema])), schema)


def write_artifacts(spark: SparkSession, path: str, stage: str, model: str, run: str, tables: dict[str, DataFrame], facts: dict) -> None:
    """A run's tables (scores, importances, trials, weights), each in its folder, and its facts as one JSON row."""
    for name, df in tables.items():
        write_run(df, f"{path}/{name}", stage, model, run)
    write_run(spark.createDataFrame([(json.dumps(facts, sort_keys=True),)], "facts string"), f"{path}/facts", stage, model, run)


def read_artifacts(spark: SparkSession, path: str, name: str, stages: tuple[str, ...]) -> DataFrame:
    """One table of each model's last run of the first stage that has one."""
    rows = spark.read.parquet(f"{path}/{name}")
    last = latest_runs(rows.select("model", "stage", F.col("run").cast("string").alias("run")).distinct(), stages)
    return rows.withColumn("run", F.col("run").cast("string")).join(last, ["model", "stage", "run"], "left_semi")
