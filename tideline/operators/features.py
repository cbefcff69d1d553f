"""The customer's whole feature frame: series, blocks, codes and flags, cleaned by one fitted specification."""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tideline.functions.series import SPARK
from tideline.operators import domain, encoding, series
from tideline.operators.contract import WINSORISED, FeatureSpec, no_leak
from tideline.plans.schema import TARGET


@dataclass
class FrameSpec:
    """What the frame learns from the training customers: codes, the columns with a flag, and the cleaning."""

    codes: dict[str, int]
    flags: list[str]
    clean: FeatureSpec

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> FrameSpec:
        found = json.loads(text)
        return cls(found["codes"], found["flags"], FeatureSpec(**found["clean"]))

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.dumps(),)], "spec string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> FrameSpec:
        return cls.loads(spark.read.parquet(path).first().spec)


def raw_features(by_series: DataFrame, customers: DataFrame, wide: DataFrame, codes: dict[str, int], flags: list[str]) -> DataFrame:
    """``id`` and all features before cleaning: three narrow tables that meet by id."""
    formulas = {c: f for name in domain.BLOCKS for c, f in domain.BLOCKS[name](SPARK).items()}
    blocks = domain.stage(customers).select("id", *(F.expr(f).alias(c) for c, f in formulas.items()), *_encoded(codes))
    out = series.features_wide(by_series).join(blocks, "id")
    if flags:
        out = out.join(wide.select(F.col("ID").cast("long").alias("id"), *encoding.zero_flags(flags)), "id")
    return out


ENCODED = ("segment_encoded", "earning_pattern_encoded", "has_smartphone", "is_male")


def _encoded(codes: dict[str, int]):
    return tuple(x.alias(c) for x, c in zip((encoding.segment(), encoding.apply_codes("earning_pattern", codes), encoding.smartphone(), encoding.is_male()), ENCODED, strict=True))


def fit_features(by_series: DataFrame, customers: DataFrame, wide: DataFrame, approximate: bool = False) -> FrameSpec:
    """Learns codes, flags, the ratios' bounds, the columns that vary and the winsorised features' bounds."""
    numbers = [c for c, kind in wide.dtypes if kind == "double"]
    codes, flags = encoding.fit_codes(customers, "earning_pattern"), encoding.fit_zero_flags(wide, numbers)
    return _fitted(raw_features(by_series, customers, wide, codes, flags), codes, flags, approximate)


def _fitted(raw: DataFrame, codes: dict[str, int], flags: list[str], approximate: bool) -> FrameSpec:
    names = [c for c in raw.columns if c != "id"]
    no_leak(names, TARGET)
    return FrameSpec(codes, flags, FeatureSpec.fit(raw, names, WINSORISED, approximate))


def build_features(by_series: DataFrame, customers: DataFrame, wide: DataFrame, spec: FrameSpec) -> DataFrame:
    """The wide panel's own columns and the features behind them; a name that is there already isn't made again."""
    features = spec.clean.transform(raw_features(by_series, customers, wide, spec.codes, spec.flags))
    new = first_seen([*wide.columns, *spec.clean.columns])[len(wide.columns) :]
    return wide.join(features.select(F.col("id").cast("string").alias("__id"), *new), F.col("ID") == F.col("__id")).drop("__id")


@dataclass
class Rows:
    """Customers in one row each, with a struct of arrays for each group and what the blocks read, and the formulas of the wide
    panel's columns over them. The frame is a projection of these rows: nothing is joined for it, and no feature is shuffled."""

    customers: DataFrame
    columns: dict[str, str]

    def wide(self) -> DataFrame:
        return self.customers.selectExpr(*(f"{f} as {c}" for c, f in self.columns.items()))

    def frame(self, codes: dict[str, int], flags: list[str], own: bool) -> DataFrame:
        """``id``, with ``own`` the wide panel's columns under ``own|`` and their names, and all features before cleaning."""
        x, kinds = domain.stage(series.spread(self.customers)), dict(self.wide().dtypes)
        x = x.withColumns({f"__{k}": c for k, c in enumerate(_encoded(codes))})
        numbers = {c: f for name in domain.BLOCKS for c, f in domain.BLOCKS[name](SPARK).items()}
        numbers |= {c: f"__{k}" for k, c in enumerate(ENCODED)} | {f"{c}_is_zero": f"cast(coalesce({self.columns[c]}, 0D) = 0 as tinyint)" for c in flags}
        keep, mine = ["id"], {}
        if own:
            texts = {c: f for c, f in self.columns.items() if kinds[c] != "double"}
            x = x.withColumns({f"own|{c}": F.expr(f) for c, f in texts.items()})
            keep += [f"own|{c}" for c in texts]
            mine = {f"own|{c}": f for c, f in self.columns.items() if c not in texts}
        made = series.features_of(x, mine | numbers, keep)
        names = [*keep, *mine]
        return made.select(*(F.col(f"`{c}`") for c in (*names, *made.columns[len(names) + len(numbers) :], *numbers)))  # series first

    def fit(self, approximate: bool = False) -> FrameSpec:
        wide = self.wide()
        codes, flags = encoding.fit_codes(self.customers, "earning_pattern"), encoding.fit_zero_flags(wide, [c for c, kind in wide.dtypes if kind == "double"])
        return _fitted(self.frame(codes, flags, False), codes, flags, approximate)

    def build(self, spec: FrameSpec) -> DataFrame:
        own = tuple(f"own|{c}" for c in self.columns)
        x = spec.clean.transform(self.frame(spec.codes, spec.flags, True), tuple(f"`{c}`" for c in own))
        new = first_seen([*self.columns, *spec.clean.columns])[len(self.columns) :]
        return x.select(*(F.col(f"`own|{c}`").alias(c) for c in self.columns), *new)


def first_seen(names: list[str]) -> list[str]:
    """Names without repeats, in the order in which they first come."""
    return list(dict.fromkeys(names))


def split_target(df: DataFrame, key: str = "ID", target: str = TARGET) -> tuple[DataFrame, DataFrame | None]:
    """Features by key, and the targets by key where there are any."""
    features = df.drop(target)
    return features, df.select(key, target) if target in df.columns else None


def column_difference(a: list[str], b: list[str]) -> dict[str, list[str]]:
    """Names that only one side has."""
    return {"left": sorted({*a} - {*b}), "right": sorted({*b} - {*a})}
