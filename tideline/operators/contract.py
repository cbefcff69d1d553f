"""Fit once, apply everywhere: clip bounds, dropped columns, code maps and scaling as one specification.

``fit`` reads the training frame in a few wide aggregations (metadata rows, one a column) and ``transform`` is a single
projection with literals, so any later frame, even of one row, gets the same columns by the same rules.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import asdict, dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tideline.operators.ranks import as_rows, column_percentiles
from tideline.plans.settled import settled

#: Features that are winsorised besides the clip of all ratios, and the cardinality up to which nothing is clipped.
RATIO, UPPER, CLIP, FEW = "ratio", 0.99, (0.001, 0.999), 10
WINSORISED = (
    "withdraw_recency_ratio",
    "withdraw_recency_ratio_log",
    "net_flow_ratio",
    "balance_to_spend_pressure",
    "deposit_vol_recency_ratio",
    "withdraw_vol_recency_ratio",
    "mm_send_vol_recency_ratio",
    "avg_txn_size_withdraw",
    "avg_txn_size_withdraw_trend",
    "avg_txn_size_mm_send",
)


def clean(c: str) -> Column:
    """Null, NaN and infinities as 0. One string, as frames have hundreds of columns."""
    name = "`" + c.replace("`", "``") + "`"
    x = f"cast({name} as double)"
    return F.expr(f"if(isnan({x}) or abs({x}) = double('Infinity'), 0D, coalesce({x}, 0D)) as {name}")


def _percentiles(df: DataFrame, columns: list[str], shares: tuple[float, ...], approximate: bool) -> dict[str, list[float]]:
    """Percentiles of many columns at once; exact ones interpolate linearly."""
    if not columns:
        return {}
    if approximate:
        row = df.agg(*(F.percentile_approx(c, F.array(*map(F.lit, shares)), 100_000).alias(c) for c in columns)).first()
        return {c: list(row[c] or []) for c in columns}
    found = {r.feature: list(r.q) for r in column_percentiles(df, columns, shares).collect()}  # a row for each column
    return {c: found.get(c, []) for c in columns}


def _ranges(df: DataFrame, columns: list[str]) -> dict[str, tuple]:
    row = df.agg(*(f(c).alias(f"{c}|{k}") for c in columns for k, f in enumerate((F.min, F.max)))).first() if columns else {}
    return {c: (row[f"{c}|0"], row[f"{c}|1"]) for c in columns}


def fit_ratio_clip(df: DataFrame, columns: list[str], share: float = UPPER, approximate: bool = False) -> dict[str, float]:
    """Upper bounds at a percentile, where they are above 0."""
    return {c: p[0] for c, p in _percentiles(df, columns, (share,), approximate).items() if p and p[0] is not None and p[0] > 0}


def upper(df: DataFrame, bounds: dict[str, float]) -> DataFrame:
    return df.withColumns({c: F.least(F.col(c), F.lit(float(hi))) for c, hi in bounds.items()}) if bounds else df


@dataclass
class FeatureSpec:
    """Fitted state of feature cleaning: two passes of upper bounds and the columns that vary."""

    ratios: dict[str, float] = field(default_factory=dict)
    winsor: dict[str, float] = field(default_factory=dict)
    columns: list[str] = field(default_factory=list)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], winsorised: tuple[str, ...] = (), approximate: bool = False) -> FeatureSpec:
        """Bounds of ratios first; then constant columns go; then the winsor list is bounded, on already clipped data."""
        if not columns:
            return cls()
        with settled(df.select(*map(clean, columns))) as x:
            ratios = fit_ratio_clip(x, [c for c in columns if RATIO in c], approximate=approximate)
            x = upper(x, ratios)
            kept = [c for c, (lo, hi) in _ranges(x, columns).items() if lo != hi]
            return cls(ratios, fit_ratio_clip(x, [c for c in winsorised if c in kept], approximate=approximate), kept)

    def transform(self, df: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
        present = set(df.columns)
        x = df.select(*keys, *(clean(c) if c in present else F.lit(0.0).alias(c) for c in self.columns))
        return upper(upper(x, {c: b for c, b in self.ratios.items() if c in self.columns}), self.winsor)

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(json.dumps(asdict(self)),)], "spec string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> FeatureSpec:
        return cls(**json.loads(spark.read.parquet(path).first().spec))


#: What the fit of preprocessing takes where neither a configuration nor the caller says otherwise.
DEFAULTS = {"clip_quantiles": CLIP, "enable_clipping": True, "scale_features": False}


def options(config: Mapping[str, Any] | None = None, **given: Any) -> dict[str, Any]:
    """Settings of the fit: a configuration's section ``preprocessing`` goes before the caller's arguments, these before
    the defaults. What isn't a setting there is left out; as an argument it is an error."""
    if unknown := given.keys() - DEFAULTS.keys():
        raise ValueError(f"no settings {sorted(unknown)}")
    section = (config or {}).get("preprocessing") or {}
    out = DEFAULTS | given | {k: v for k, v in section.items() if k in DEFAULTS}
    lo, hi = map(float, out["clip_quantiles"])
    if not 0 <= lo < hi <= 1:
        raise ValueError(f"clip_quantiles {lo}, {hi} aren't shares in order")
    return out | {"clip_quantiles": (lo, hi)}


@dataclass
class Preprocessing:
    """Fitted state of preprocessing: the contract of columns, clip bounds and scale."""

    columns: list[str] = field(default_factory=list)
    clip: dict[str, tuple[float, float]] = field(default_factory=dict)
    scale: dict[str, tuple[float, float]] = field(default_factory=dict)

    @classmethod
    def fit(cls, df: DataFrame, columns: list[str], scaled: bool = False, approximate: bool = False, config: Mapping[str, Any] | None = None) -> Preprocessing:
        """``config`` may hold a section ``preprocessing`` whose settings go before the arguments (``options``)."""
        chosen = options(config, scale_features=scaled)
        if not columns:
            if df.isEmpty():
                raise ValueError("an empty frame can't be fitted")
            return cls()
        with settled(df.select(*map(clean, columns))) as x:
            return cls._fit(x, columns, chosen, approximate)

    @classmethod
    def _fit(cls, x: DataFrame, columns: list[str], chosen: Mapping[str, Any], approximate: bool) -> Preprocessing:
        row = x.agg(F.count("*").alias("|n"), *(f(c).alias(f"{c}|{k}") for c in columns for k, f in enumerate((F.min, F.max, F.approx_count_distinct)))).first()
        if not row["|n"]:
            raise ValueError("an empty frame can't be fitted")
        kept = [c for c in columns if row[f"{c}|0"] != row[f"{c}|1"]]
        few = {c: row[f"{c}|2"] for c in kept}
        near = [c for c in kept if few[c] <= 3 * FEW]  # only near the gate are values counted exactly
        distinct = as_rows(x, near).distinct().groupBy("feature").agg(F.count("value").alias("n")).collect() if near else []
        exact = {r.feature: r.n for r in distinct}  # a row for each column
        many = [c for c in kept if c not in near or exact[c] > FEW]
        bounds = _percentiles(x, many if chosen["enable_clipping"] else [], chosen["clip_quantiles"], approximate)
        self = cls(kept, {c: (p[0], p[1]) for c, p in bounds.items() if p[0] < p[1]})
        if chosen["scale_features"]:
            row = self._clipped(x).agg(*(f(c).alias(f"{c}|{k}") for c in kept for k, f in enumerate((F.avg, F.stddev_pop)))).first()
            self.scale = {c: (row[f"{c}|0"], row[f"{c}|1"] or 1.0) for c in kept}
        return self

    def _clipped(self, df: DataFrame) -> DataFrame:
        return df.withColumns({c: F.least(F.greatest(F.col(c), F.lit(float(lo))), F.lit(float(hi))) for c, (lo, hi) in self.clip.items()}) if self.clip else df

    def transform(self, df: DataFrame, keys: tuple[str, ...] = ("id",)) -> DataFrame:
        """Missing columns are 0, extra ones go, and the order is that of the contract."""
        if not self.columns:
            raise ValueError("transform before fit")
        out = self._clipped(align(df, self.columns, keys).select(*keys, *map(clean, self.columns)))
        if self.scale:
            out = out.withColumns({c: (F.col(c) - m) / s for c, (m, s) in self.scale.items()})
        if out.columns != [*keys, *self.columns]:
            raise AssertionError("columns differ from the contract")
        return out

    def dumps(self) -> str:
        return json.dumps(asdict(self))

    @classmethod
    def loads(cls, text: str) -> Preprocessing:
        found = json.loads(text)
        return cls(found["columns"], {c: tuple(b) for c, b in found["clip"].items()}, {c: tuple(b) for c, b in found["scale"].items()})

    def save(self, spark, path: str) -> None:
        spark.createDataFrame([(self.dumps(),)], "spec string").write.mode("overwrite").parquet(path)

    @classmethod
    def load(cls, spark, path: str) -> Preprocessing:
        return cls.loads(spark.read.parquet(path).first().spec)


def align(df: DataFrame, columns: list[str], keys: tuple[str, ...] = (), strict: bool = False) -> DataFrame:
    """``keys`` and ``columns`` in this order; a missing one is 0, or an error if ``strict``."""
    if strict and (missing := [c for c in columns if c not in df.columns]):
        raise ValueError(f"missing columns: {missing}")
    return df.select(*keys, *(F.col(c) if c in df.columns else F.lit(0.0).alias(c) for c in columns))


def no_leak(columns: list[str], target: str) -> None:
    """No column's name holds the target's."""
    if found := [c for c in columns if target in c]:
        raise AssertionError(f"columns of the target: {found}")
