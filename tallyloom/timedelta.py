"""Spans of time: absolute, calendar, or a number of observations."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Units and their seconds; months and years follow the calendar.
SECONDS = {"ms": 0.001, "s": 1, "m": 60, "h": 3600, "d": 86400, "w": 604800}
ALIASES = {
    "milliseconds": "ms", "millisecond": "ms", "seconds": "s", "second": "s", "sec": "s", "minutes": "m", "minute": "m", "min": "m", "t": "m",
    "hours": "h", "hour": "h", "days": "d", "day": "d", "weeks": "w", "week": "w", "months": "mo", "month": "mo", "mo": "mo",
    "years": "Y", "year": "Y", "y": "Y", "observations": "o", "observation": "o", "o": "o",
}
WORDS = {
    "ms": "Milliseconds", "s": "Seconds", "m": "Minutes", "h": "Hours", "d": "Days", "w": "Weeks", "mo": "Months", "Y": "Years", "o": "Observations",
}


@dataclass(frozen=True)
class Timedelta:
    value: float
    unit: str = "s"

    def __post_init__(self):
        unit = self.unit if self.unit in SECONDS or self.unit in ("mo", "Y", "o") else ALIASES.get(self.unit.lower())
        if unit is None:
            raise ValueError(f"unknown unit {self.unit}")
        object.__setattr__(self, "unit", unit)

    @staticmethod
    def parse(x) -> Timedelta:
        if isinstance(x, Timedelta):
            return x
        if isinstance(x, (int, float)):
            return Timedelta(x)
        m = re.fullmatch(r"\s*(\d*\.?\d*)\s*([A-Za-z]+)\s*", x)
        if not m:
            raise ValueError(f"cannot read {x!r} as a span of time")
        return Timedelta(float(m[1]) if "." in m[1] else int(m[1] or 1), m[2])

    @property
    def is_observations(self) -> bool:
        return self.unit == "o"

    @property
    def seconds(self) -> float:
        if self.unit not in SECONDS:
            raise ValueError(f"{self} has no fixed length")
        return self.value * SECONDS[self.unit]

    def at_most(self) -> float:
        """Seconds (or numbers) that the span never exceeds; months and years count with their longest."""
        return self.value * {"mo": 31 * 86400, "Y": 366 * 86400}.get(self.unit, SECONDS.get(self.unit, 1))

    def before(self, t: Column, numeric: bool = False) -> Column:
        """``t`` minus this span."""
        if numeric:
            return t - F.lit(self.value)
        if self.unit in ("mo", "Y"):
            months = int(self.value * (12 if self.unit == "Y" else 1))
            return t - F.expr(f"interval '{months}' month")
        return t - F.expr(f"make_dt_interval(0, 0, 0, {self.seconds})")

    def get_name(self) -> str:
        v = int(self.value) if float(self.value).is_integer() else self.value
        word = WORDS[self.unit]
        return f"{v} {word[:-1] if v == 1 else word}"

    def to_dict(self) -> dict:
        return {"value": self.value, "unit": self.unit}
