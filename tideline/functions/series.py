"""Formulas over a six-period series, newest period first, as SQL text.

Every formula is plain arithmetic on array elements, which Spark compiles with the rest of its stage. ``base`` is the
index of an array's first element: 0 in Spark SQL, 1 in the SQL of the oracles.
"""

from __future__ import annotations

from dataclasses import dataclass

#: The guard of all denominators, the periods, and the abscissae of the least-squares slope.
EPS, PERIODS, ABSCISSAE = "0.000001", 6, (5, 4, 3, 2, 1, 0)


@dataclass(frozen=True)
class Series:
    """Formulas for one SQL dialect."""

    base: int = 0
    double: str = "double"

    def at(self, d: str, i: int) -> str:
        return f"{d}[{i + self.base}]"

    def total(self, d: str, lo: int = 0, hi: int = PERIODS) -> str:
        return "(" + " + ".join(self.at(d, i) for i in range(lo, hi)) + ")"

    def mean(self, d: str, lo: int = 0, hi: int = PERIODS) -> str:
        return f"({self.total(d, lo, hi)} / cast({hi - lo} as {self.double}))"

    def std(self, d: str, lo: int = 0, hi: int = PERIODS) -> str:
        """Population standard deviation."""
        m = self.mean(d, lo, hi)
        return "sqrt((" + " + ".join(f"({self.at(d, i)} - {m}) * ({self.at(d, i)} - {m})" for i in range(lo, hi)) + f") / cast({hi - lo} as {self.double}))"

    def least(self, d: str, lo: int = 0, hi: int = PERIODS) -> str:
        return "least(" + ", ".join(self.at(d, i) for i in range(lo, hi)) + ")"

    def greatest(self, d: str) -> str:
        return "greatest(" + ", ".join(self.at(d, i) for i in range(PERIODS)) + ")"

    def ratio(self, a: str, b: str) -> str:
        return f"({a} / ({b} + cast({EPS} as {self.double})))"

    def trend(self, d: str) -> str:
        return f"({self.at(d, 0)} - {self.at(d, PERIODS - 1)})"

    def slope(self, d: str) -> str:
        """Least squares against periods in time order; the divisor has the guard added."""
        middle = sum(ABSCISSAE) / PERIODS
        m = self.mean(d)
        dot = " + ".join(f"({self.at(d, i)} - {m}) * cast({x - middle} as {self.double})" for i, x in enumerate(ABSCISSAE))
        return f"(({dot}) / cast({sum((x - middle) ** 2 for x in ABSCISSAE)} + {EPS} as {self.double}))"

    def momentum(self, d: str) -> str:
        return f"({self.at(d, 0)} - {self.at(d, 1)})"

    def acceleration(self, d: str) -> str:
        return f"(({self.at(d, 0)} - {self.at(d, 1)}) - ({self.at(d, 1)} - {self.at(d, 2)}))"

    def cv(self, d: str) -> str:
        return self.ratio(self.std(d), self.mean(d))

    def volatility_ratio(self, d: str) -> str:
        return self.ratio(self.std(d, 0, 3), self.std(d, 3, 6))

    def consistency(self, d: str) -> str:
        return self.ratio(self.mean(d), self.std(d))

    def recency_ratio(self, d: str) -> str:
        return self.ratio(self.mean(d, 0, 3), self.mean(d, 3, 6))

    def peak_to_mean(self, d: str) -> str:
        return self.ratio(self.greatest(d), self.mean(d))

    def _active(self, d: str, i: int) -> str:
        return f"cast({self.at(d, i)} > 0 as int)"

    def active(self, d: str) -> str:
        return "(" + " + ".join(self._active(d, i) for i in range(PERIODS)) + ")"

    def switches(self, d: str) -> str:
        return "(" + " + ".join(f"abs({self._active(d, i)} - {self._active(d, i + 1)})" for i in range(PERIODS - 1)) + ")"

    def streak(self, d: str) -> str:
        """Inactive periods before the newest active one."""
        return "(case " + " ".join(f"when {self.at(d, i)} > 0 then {i}" for i in range(PERIODS)) + f" else {PERIODS} end)"

    def logged(self, d: str) -> str:
        """The series of log1p of its values, negative ones as 0."""
        return "array(" + ", ".join(f"log1p(greatest({self.at(d, i)}, cast(0 as double)))" for i in range(PERIODS)) + ")" if self.base == 0 else "[" + ", ".join(f"ln(1 + greatest({self.at(d, i)}, 0::double))" for i in range(PERIODS)) + "]"


SPARK, ORACLE = Series(), Series(1)


def shown(x: str) -> str:
    """Rounded to four places, or from a million on to the nearest hundred thousand: guarded ratios can be huge."""
    return f"case when abs({x}) < 1000000 then round({x}, 4) else round({x} / 1000000, 1) * 1000000 end"


#: Blocks of features that every series has, by name.
BLOCKS = {
    "stats": {"mean": Series.mean, "std": Series.std, "min": Series.least, "max": Series.greatest},
    "trend": {"trend": Series.trend, "trend_slope": Series.slope},
    "momentum": {"momentum": Series.momentum, "acceleration": Series.acceleration},
    "volatility": {"cv": Series.cv, "volatility_ratio": Series.volatility_ratio, "consistency": Series.consistency},
    "activity": {"active_months": Series.active, "activity_switch": Series.switches, "zero_streak": Series.streak},
    "recency": {"recency_ratio": Series.recency_ratio, "peak_to_mean": Series.peak_to_mean},
}
#: Features of the logged series.
LOG_BLOCK = {"mean": Series.mean, "std": Series.std, "min": Series.least, "max": Series.greatest, "trend": Series.trend, "trend_slope": Series.slope, "cv": Series.cv, "volatility_ratio": Series.volatility_ratio, "momentum": Series.momentum, "recency_ratio": Series.recency_ratio}
