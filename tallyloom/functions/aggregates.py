"""The aggregation primitives."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from tallyloom.functions.base import (
    ANY, BOOL, CAT, INDEX, NUM, R_BOOL, R_CAT, R_DOUBLE, R_INT, R_NUM, R_TIME, T_INDEX, TIME, aggregation, in_unit, micros, safe_div, seconds_between,
)

no_self = {"stack_on_self": False}


def d(c: Column) -> Column:
    return c.cast("double")


def unless_null(v: Column, skipna: bool, value: Column) -> Column:
    """``value``, or null if nulls count and there are any."""
    return value if skipna else F.when(F.count(v) == F.count(F.lit(1)), value)


# plain
aggregation("Count", [INDEX], R_INT, lambda p, v, x: F.count(v[0]), default=0, **no_self)
aggregation("Sum", [NUM], R_NUM, lambda p, v, x: F.sum(v[0]), default=0, **no_self)
aggregation("Mean", [NUM], R_NUM, lambda p, v, x: unless_null(v[0], p.skipna, F.avg(v[0])), params={"skipna": True})
aggregation("Min", [NUM], R_NUM, lambda p, v, x: F.min(v[0]), **no_self)
aggregation("Max", [NUM], R_NUM, lambda p, v, x: F.max(v[0]), **no_self)
aggregation("MaxMinDelta", [NUM], R_NUM, lambda p, v, x: unless_null(v[0], p.skipna, F.max(v[0]) - F.min(v[0])), params={"skipna": True}, default=0, **no_self)
aggregation("Std", [NUM], R_NUM, lambda p, v, x: F.stddev_samp(v[0]), **no_self)
aggregation("Variance", [NUM], R_DOUBLE, lambda p, v, x: F.var_samp(v[0]), **no_self)
aggregation("Median", [NUM], R_NUM, lambda p, v, x: F.median(v[0]))


def _moments(v: Column):
    v, n = d(v), d(F.count(v))
    m = F.avg(v)
    m2 = F.var_pop(v)
    return v, n, m, m2


def _skew(p, v, x):
    n = d(F.count(v[0]))
    g1 = F.skewness(d(v[0])) * F.sqrt(n * (n - 1)) / F.nullif(n - 2, F.lit(0.0))
    return F.when(n < 3, F.lit(None)).when(F.var_pop(d(v[0])) == 0, F.lit(0.0)).otherwise(g1)


aggregation("Skew", [NUM], R_NUM, _skew, **no_self)


def _kurtosis(p, v, x):
    if p.nan_policy not in ("propagate", "raise", "omit"):
        raise ValueError("Invalid nan_policy")
    n = d(F.count(v[0]))
    excess = F.kurtosis(d(v[0]))
    if not p.bias:
        fixed = (n - 1) / F.nullif((n - 2) * (n - 3), F.lit(0.0)) * ((n + 1) * excess + 6)
        excess = F.when(n > 3, fixed).otherwise(excess)
    out = excess if p.fisher else excess + 3
    return out if p.nan_policy == "omit" else unless_null(v[0], False, out)


aggregation("Kurtosis", [[NUM]], R_DOUBLE, _kurtosis, params={"fisher": True, "bias": True, "nan_policy": "propagate"}, default=0, **no_self)

# booleans
aggregation("All", [BOOL], R_BOOL, lambda p, v, x: F.coalesce(F.bool_and(v[0]), F.lit(True)), **no_self)
aggregation("Any", [BOOL], R_BOOL, lambda p, v, x: F.coalesce(F.bool_or(v[0]), F.lit(False)), **no_self)
aggregation("NumTrue", [BOOL], R_INT, lambda p, v, x: F.count_if(v[0]), default=0)
aggregation("PercentTrue", [BOOL], R_DOUBLE, lambda p, v, x: F.avg(d(F.coalesce(v[0], F.lit(False)).cast("int"))), default=0)

# counts by value
aggregation("CountGreaterThan", [NUM], R_INT, lambda p, v, x: F.count_if(v[0] > p.threshold), params={"threshold": 10}, default=0, **no_self)
aggregation("CountLessThan", [NUM], R_INT, lambda p, v, x: F.count_if(v[0] < p.threshold), params={"threshold": 10}, default=0, **no_self)
_range = {"params": {"lower": 0, "upper": 1, "skipna": True}, "default": 0, **no_self}
aggregation("CountInsideRange", [NUM], R_INT, lambda p, v, x: unless_null(v[0], p.skipna, F.count_if(v[0].between(p.lower, p.upper))), **_range)
aggregation("CountOutsideRange", [NUM], R_INT, lambda p, v, x: unless_null(v[0], p.skipna, F.count_if((v[0] < p.lower) | (v[0] > p.upper))), **_range)

# distinct values
aggregation("NumUnique", [CAT], R_INT, lambda p, v, x: F.count_distinct(v[0]), params={"use_string_for_pd_calc": True}, **no_self)


def _null_is_value(v: Column) -> Column:
    return F.coalesce(F.max(v.isNull().cast("int")), F.lit(0))


aggregation(
    "PercentUnique", [CAT], R_DOUBLE,
    lambda p, v, x: d(F.count_distinct(v[0]) + (F.lit(0) if p.skipna else _null_is_value(v[0]))) / F.count(F.lit(1)),
    params={"skipna": True}, default=0,
)
aggregation(
    "AverageCountPerUnique", [CAT], R_DOUBLE,
    lambda p, v, x: F.try_divide(d(F.count(v[0])), F.count_distinct(v[0])) if p.skipna
    else F.try_divide(d(F.count(F.lit(1))), F.count_distinct(v[0]) + _null_is_value(v[0])),
    params={"skipna": True}, default=0,
)
aggregation(
    "HasNoDuplicates", [[CAT], [NUM]], R_BOOL,
    lambda p, v, x: F.count(v[0]) == F.count_distinct(v[0]) if p.skipna
    else F.count(F.lit(1)) == F.count_distinct(v[0]) + _null_is_value(v[0]),
    params={"skipna": True}, default=True, **no_self,
)
aggregation("IsUnique", [CAT], R_BOOL, lambda p, v, x: F.count(F.lit(1)) == F.count_distinct(v[0]) + _null_is_value(v[0]), default=False, **no_self)
aggregation("Mode", [CAT], None, lambda p, v, x: F.mode(v[0], True))

# distinct parts of dates: sets of at most the calendar's days, which merge within one grouping; a distinct count each would multiply the rows
for _name, _part in {
    "NUniqueDays": lambda v: F.date_trunc("day", v), "NUniqueDaysOfCalendarYear": lambda v: F.month(v) * 100 + F.dayofmonth(v),
    "NUniqueDaysOfMonth": F.dayofmonth, "NUniqueMonths": lambda v: F.date_trunc("month", v), "NUniqueWeeks": lambda v: F.date_trunc("week", v),
}.items():
    aggregation(_name, [TIME], R_INT, lambda p, v, x, part=_part: F.size(F.collect_set(part(v[0]))).cast("long"), default=0, name={
        "NUniqueDays": "n_unique_days", "NUniqueDaysOfCalendarYear": "n_unique_days_of_calendar_year", "NUniqueDaysOfMonth": "n_unique_days_of_month",
        "NUniqueMonths": "n_unique_months", "NUniqueWeeks": "n_unique_weeks"}[_name], **no_self)

# order and time
aggregation("First", [ANY], None, lambda p, v, x: F.min_by(v[0], x.position), **no_self)
aggregation("Last", [ANY], None, lambda p, v, x: F.max_by(v[0], x.position), **no_self)
aggregation("DateFirstEvent", [T_INDEX], R_TIME, lambda p, v, x: F.min(v[0]), **no_self)
aggregation("FirstLastTimeDelta", [T_INDEX], R_DOUBLE, lambda p, v, x: seconds_between(F.max(v[0]), F.min(v[0])), default=0, **no_self)
aggregation(
    "AvgTimeBetween", [T_INDEX], R_DOUBLE,
    lambda p, v, x: F.when(F.count(v[0]) >= 2, in_unit(seconds_between(F.max(v[0]), F.min(v[0])), p.unit) / F.nullif(F.count(v[0]) - 1, F.lit(0))),
    params={"unit": "seconds"},
)
_unit = {"params": {"unit": "seconds"}, "uses_calc_time": True}
aggregation("TimeSinceFirst", [T_INDEX], R_DOUBLE, lambda p, v, x: in_unit(seconds_between(F.max(x.cutoff), F.min(v[0])), p.unit), **_unit)
aggregation("TimeSinceLast", [T_INDEX], R_DOUBLE, lambda p, v, x: in_unit(seconds_between(F.max(x.cutoff), F.max(v[0])), p.unit), **_unit)
_since = {"uses_calc_time": True, "default": 0, **no_self}
aggregation("TimeSinceLastTrue", [T_INDEX, BOOL], R_DOUBLE, lambda p, v, x: seconds_between(F.max(x.cutoff), F.max(F.when(v[1], v[0]))), **_since)
aggregation("TimeSinceLastFalse", [T_INDEX, BOOL], R_DOUBLE, lambda p, v, x: seconds_between(F.max(x.cutoff), F.max(F.when(~v[1], v[0]))), **_since)
# the first row of the extreme value: the earliest among equals
aggregation("TimeSinceLastMax", [T_INDEX, NUM], R_DOUBLE, lambda p, v, x: seconds_between(F.max(x.cutoff), F.max_by(v[0], F.when(v[0].isNotNull() & v[1].isNotNull(), F.struct(v[1], -micros(v[0]))))), **_since)
aggregation("TimeSinceLastMin", [T_INDEX, NUM], R_DOUBLE, lambda p, v, x: seconds_between(F.max(x.cutoff), F.min_by(v[0], F.when(v[0].isNotNull() & v[1].isNotNull(), F.struct(v[1], micros(v[0]))))), **_since)


def trend_unit(first_micros: Column) -> Column:
    """Seconds of the coarsest of day, hour, minute, second that the first time is whole in."""
    at = lambda s: first_micros % F.lit(s * 1_000_000) == 0
    return F.when(at(86400), 86400.0).when(at(3600), 3600.0).when(at(60), 60.0).otherwise(1.0)


def _trend(p, v, x):
    ok = v[0].isNotNull() & v[1].isNotNull()
    t = F.when(ok, d(micros(v[1])) / 1e6)
    y = F.when(ok, d(v[0]))
    first = F.min_by(micros(v[1]), F.when(ok, x.position))
    n = F.count(y)
    slope = F.when(F.var_pop(t) == 0, F.lit(0.0)).otherwise(F.regr_slope(y, t))
    return F.when(n > 2, slope * trend_unit(first))


aggregation("Trend", [NUM, T_INDEX], R_NUM, _trend)

# values compared with a statistic of their group: the statistic is aggregated first and joined back
_skip = {"params": {"skipna": True}}
aggregation("CountAboveMean", [NUM], R_INT, lambda p, v, x: F.when(F.max(x.col("m")).isNotNull(), F.count_if(v[0] > x.col("m"))),
            stats=lambda p, v: {"m": unless_null(v[0], p.skipna, F.avg(v[0]))}, **_skip, **no_self)
aggregation("CountBelowMean", [NUM], R_INT, lambda p, v, x: F.when(F.max(x.col("m")).isNotNull(), F.count_if(v[0] < x.col("m"))),
            stats=lambda p, v: {"m": unless_null(v[0], p.skipna, F.avg(v[0]))}, **_skip, **no_self)
# the deviation is that from the mean as it was rounded, so a value on the edge is as far from it as the deviation says
_spread = {
    "stats": lambda p, v: {"m": F.avg(v[0])},
    "more_stats": lambda p, v, x: {"s": F.sqrt(F.avg((v[0] - x.col("m")) * (v[0] - x.col("m"))))},
    "params": {"n": 1}, "default": 0, **no_self,
}
aggregation("CountInsideNthSTD", [NUM], R_INT, lambda p, v, x: F.count_if(F.abs(v[0] - x.col("m")) <= x.col("s") * p.n), name="count_inside_nth_std", **_spread)
aggregation("CountOutsideNthSTD", [NUM], R_INT, lambda p, v, x: F.count_if(F.abs(v[0] - x.col("m")) > x.col("s") * p.n), name="count_outside_nth_std", **_spread)
aggregation("MaxCount", [NUM], R_NUM, lambda p, v, x: F.when(F.max(x.col("m")).isNotNull(), F.count_if(v[0] == x.col("m"))),
            stats=lambda p, v: {"m": unless_null(v[0], p.skipna, F.max(v[0]))}, **_skip)
aggregation("MinCount", [NUM], R_INT, lambda p, v, x: F.when(F.max(x.col("m")).isNotNull(), F.count_if(v[0] == x.col("m"))),
            stats=lambda p, v: {"m": unless_null(v[0], p.skipna, F.min(v[0]))}, **_skip)
aggregation("MedianCount", [NUM], R_INT, lambda p, v, x: F.when(F.max(x.col("m")).isNotNull(), F.count_if(v[0] == x.col("m"))),
            stats=lambda p, v: {"m": unless_null(v[0], p.skipna, F.median(v[0]))}, default=0, **_skip, **no_self)

# order within the group: one column each, whose segments' states merge in order; its rows that do not count are null
_run = {"default": 0, **no_self}


def _flag(f: Column, kept: Column) -> Column:
    return F.when(kept, F.coalesce(f, F.lit(False)).cast("int"))


def _known(p, v):
    return v[0].isNotNull() if p.skipna else F.lit(True)


def _longest(state: Column) -> Column:
    return F.get(state, F.lit(3)).cast("long")


for _name, _in, _test in [
    ("MaxConsecutiveTrue", BOOL, lambda v: v), ("MaxConsecutiveFalse", BOOL, lambda v: ~v), ("MaxConsecutiveNegatives", NUM, lambda v: v < 0),
    ("MaxConsecutivePositives", NUM, lambda v: v > 0), ("MaxConsecutiveZeros", NUM, lambda v: v == 0),
]:
    aggregation(_name, [_in], R_INT, segments=("runs", lambda p, v, x, t=_test: _flag(t(v[0]), F.lit(True) if p.inputs[0][0] is BOOL else _known(p, v)), _longest),
                **({} if _in is BOOL else _skip), **_run)
for _name, _test in [("NumConsecutiveGreaterMean", lambda v, m: v > m), ("NumConsecutiveLessMean", lambda v, m: v < m)]:
    aggregation(_name, [NUM], R_INT, stats=lambda p, v: {"m": unless_null(v[0], p.skipna, F.avg(v[0]))},
                segments=("runs", lambda p, v, x, t=_test: _flag(t(v[0], x.col("m")), _known(p, v) & x.col("m").isNotNull()), lambda s: F.when(F.get(s, F.lit(0)) > 0, _longest(s))), **_skip, **no_self)
_count = lambda s: F.get(s, F.lit(3))
aggregation("IsMonotonicallyIncreasing", [NUM], R_BOOL, default=False, segments=("falls", lambda p, v, x: d(v[0]), lambda s: _count(s) == 0), **no_self)
aggregation("IsMonotonicallyDecreasing", [NUM], R_BOOL, default=False, segments=("rises", lambda p, v, x: d(v[0]), lambda s: _count(s) == 0), **no_self)
aggregation("NumZeroCrossings", [NUM], R_INT, segments=("changes", lambda p, v, x: F.when(v[0] != 0, F.signum(d(v[0]))), lambda s: _count(s).cast("long")))
for _name, _test in [("NumFalseSinceLastTrue", lambda v: v), ("NumTrueSinceLastFalse", lambda v: ~v)]:
    aggregation(_name, [BOOL], R_INT, default=0, segments=("since", lambda p, v, x, t=_test: t(v[0]).cast("int"), lambda s: F.when(F.get(s, F.lit(1)) > 0, F.get(s, F.lit(2)).cast("long"))), **no_self)

# layers of windows that share one sort


def _peak_layers(p, v, x):
    """A row begins a plateau if it differs from the row before; a plateau is a peak if both its neighbours are lower."""
    prev = F.lag(v[0]).over(x.w)
    return [
        {"prev": prev, "new": F.when(prev.isNull() | (prev != v[0]), v[0])},
        {"next": F.first(x.col("new"), ignorenulls=True).over(x.w.rowsBetween(1, 2**31 - 1))},
    ]


aggregation("NumPeaks", [NUM], R_INT, lambda p, v, x: F.count_if(x.col("new").isNotNull() & (v[0] > x.col("prev")) & (v[0] > x.col("next"))),
            layers=_peak_layers, default=0, **no_self)


# histograms: the inputs are value, count, and first position of each (key, value)


def _entropy(p, v, x):
    c = F.when(v[0].isNotNull(), d(x.col("c"))) if p.dropna else d(x.col("c"))
    h = F.ln(F.sum(c)) - F.sum(c * F.ln(c)) / F.sum(c)
    h = F.greatest(h, F.lit(0.0))
    if p.base is None:
        return h
    import math

    return h / F.lit(math.log(p.base))


aggregation("Entropy", [CAT], R_DOUBLE, histogram=_entropy, params={"dropna": False, "base": None}, **no_self)


def _top(what):
    """An array of the ``n`` most frequent, first seen first among equals; the executor keeps only the first n per key."""

    def agg(p, v, x):
        known = v[0].isNotNull() if what == "v" or p.skipna else F.lit(True)
        item = F.when(known & (x.col("rank") <= p.n), F.struct(x.col("rank").alias("r"), v[0].alias("v"), x.col("c").cast("long").alias("c")))
        top = F.sort_array(F.collect_list(item))
        return F.transform(F.sequence(F.lit(0), F.lit(p.n - 1)), lambda i: F.get(top, i).getField(what))

    return agg


aggregation("NMostCommon", [CAT], None, histogram=_top("v"), params={"n": 3}, outputs="n", ranked=True, skip_nulls=True)
aggregation("NMostCommonFrequency", [CAT], R_CAT, histogram=_top("c"), params={"n": 3, "skipna": True}, outputs="n", ranked=True)

DEFAULT_AGGREGATIONS = ["sum", "std", "max", "skew", "min", "mean", "count", "percent_true", "num_unique", "mode"]
__all__ = ["DEFAULT_AGGREGATIONS", "safe_div"]
