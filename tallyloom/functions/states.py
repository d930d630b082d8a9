"""Aggregations by mergeable states: what lets one grouping serve many conditions and a running window many cutoffs.

A state is a column per part and how parts merge (sum, min or max). A condition is
put into the parts, so rows that fail it add nothing, and the parts of later rows
merge with those of earlier ones without the rows.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.base import Ctx, Primitive, in_unit, micros, seconds_between

MERGES = {"sum": F.sum, "min": F.min, "max": F.max}
Parts = dict[str, tuple[Column, str]]


def _flag(c: Column) -> Column:
    return F.when(c, 1).otherwise(0).cast("long")


def _number(v: list[Column]) -> Parts:
    return {"n": (_flag(v[0].isNotNull()), "sum")}


def _mean(v: list[Column]) -> Parts:
    return {"s": (v[0].cast("double"), "sum"), **_number(v)}


def _ends(v: list[Column]) -> Parts:
    return {"lo": (v[0], "min"), "hi": (v[0], "max")}


def _span(s: dict) -> Column:
    return seconds_between(s["hi"], s["lo"])


def _counted(condition: Callable) -> tuple[Callable, Callable]:
    return lambda p, v, x: {"n": (_flag(condition(p, v)), "sum")}, lambda p, s, x: s["n"]


def _edge(which: str) -> tuple[Callable, Callable]:
    return lambda p, v, x: {"e": (F.struct(x.position.alias("at"), v[0].alias("v")), which)}, lambda p, s, x: s["e"].getField("v")


def _since_flag(wanted: bool) -> tuple[Callable, Callable]:
    return lambda p, v, x: {"t": (F.when(v[1] == F.lit(wanted), v[0]), "max")}, lambda p, s, x: seconds_between(x.cutoff, s["t"])


#: name: (parts of (primitive, inputs, context), result of (primitive, merged parts, context)); results are for groups that have rows
STATES: dict[str, tuple[Callable, Callable]] = {
    "count": (lambda p, v, x: _number(v), lambda p, s, x: s["n"]),
    "sum": (lambda p, v, x: {"s": (v[0], "sum")}, lambda p, s, x: s["s"]),
    "mean": (lambda p, v, x: _mean(v), lambda p, s, x: F.try_divide(s["s"], s["n"])),
    "min": (lambda p, v, x: {"lo": (v[0], "min")}, lambda p, s, x: s["lo"]),
    "max": (lambda p, v, x: {"hi": (v[0], "max")}, lambda p, s, x: s["hi"]),
    "max_min_delta": (lambda p, v, x: _ends(v), lambda p, s, x: s["hi"] - s["lo"]),
    "num_true": _counted(lambda p, v: v[0]),
    "percent_true": (lambda p, v, x: {"t": (_flag(v[0]), "sum"), "n": (F.lit(1).cast("long"), "sum")}, lambda p, s, x: s["t"] / s["n"]),
    "all": (lambda p, v, x: {"lo": (v[0].cast("int"), "min")}, lambda p, s, x: F.coalesce(s["lo"] == 1, F.lit(True))),
    "any": (lambda p, v, x: {"hi": (v[0].cast("int"), "max")}, lambda p, s, x: F.coalesce(s["hi"] == 1, F.lit(False))),
    "count_greater_than": _counted(lambda p, v: v[0] > p.threshold),
    "count_less_than": _counted(lambda p, v: v[0] < p.threshold),
    "count_inside_range": _counted(lambda p, v: v[0].between(p.lower, p.upper)),
    "count_outside_range": _counted(lambda p, v: (v[0] < p.lower) | (v[0] > p.upper)),
    "first": _edge("min"),
    "last": _edge("max"),
    "date_first_event": (lambda p, v, x: {"lo": (v[0], "min")}, lambda p, s, x: s["lo"]),
    "first_last_time_delta": (lambda p, v, x: _ends(v), lambda p, s, x: _span(s)),
    "avg_time_between": (lambda p, v, x: {**_ends(v), **_number(v)}, lambda p, s, x: F.when(s["n"] >= 2, in_unit(_span(s), p.unit) / (s["n"] - 1))),
    "time_since_first": (lambda p, v, x: {"lo": (v[0], "min")}, lambda p, s, x: in_unit(seconds_between(x.cutoff, s["lo"]), p.unit)),
    "time_since_last": (lambda p, v, x: {"hi": (v[0], "max")}, lambda p, s, x: in_unit(seconds_between(x.cutoff, s["hi"]), p.unit)),
    "time_since_last_true": _since_flag(True),
    "time_since_last_false": _since_flag(False),
    "time_since_last_max": (lambda p, v, x: {"e": (_timed(v, -1), "max")}, lambda p, s, x: seconds_between(x.cutoff, s["e"].getField("t"))),
    "time_since_last_min": (lambda p, v, x: {"e": (_timed(v, 1), "min")}, lambda p, s, x: seconds_between(x.cutoff, s["e"].getField("t"))),
}


def _timed(v: list[Column], sign: int) -> Column:
    """The value with its time, the earliest first among equals."""
    return F.when(v[0].isNotNull() & v[1].isNotNull(), F.struct(v[1].alias("v"), (micros(v[0]) * sign).alias("o"), v[0].alias("t")))


def has_states(p: Primitive) -> bool:
    return p.name in STATES and getattr(p, "skipna", True)


def parts_of(p: Primitive, v: list[Column], x: Ctx, condition: Column | None) -> Parts:
    """The parts of a row, null where the condition fails; ``rows`` counts the rows that pass."""
    parts = {**STATES[p.name][0](p, v, x), "rows": (F.lit(1).cast("long"), "sum")}
    return parts if condition is None else {k: (F.when(condition, c), how) for k, (c, how) in parts.items()}


def result_of(p: Primitive, merged: dict[str, Column], x: Ctx) -> Column:
    """The value of merged parts; null for groups without rows."""
    return F.when(merged["rows"] > 0, STATES[p.name][1](p, merged, x))
