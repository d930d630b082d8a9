"""Transforms that depend on the order of rows: cumulative, lag, rolling, expanding, weighted."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tallyloom.functions.aggregates import d, trend_unit
from tallyloom.functions.base import (
    ANY_T_INDEX, BOOL, CAT, FOREIGN, NUM, R_BOOL, R_DOUBLE, R_INT, R_NUM, T_INDEX, TIME, Ctx, in_unit, micros, safe_div, seconds_between, transform,
)
from tallyloom.timedelta import SECONDS, Timedelta
from tallyloom.types import column_schema

full = {"full": True, "looks_back": True}
ordered = {"ordered": True}


def kept(v: Column, value: Column) -> Column:
    return F.when(v.isNotNull(), value)


# cumulative
transform("CumCount", [[FOREIGN], [CAT]], R_INT, lambda p, v, x: F.row_number().over(x.w), **full)
transform("CumSum", [NUM], R_NUM, lambda p, v, x: kept(v[0], F.sum(v[0]).over(x.up_to)), **full)
transform("CumMax", [NUM], R_NUM, lambda p, v, x: kept(v[0], F.max(v[0]).over(x.up_to)), **full)
transform("CumMin", [NUM], R_NUM, lambda p, v, x: kept(v[0], F.min(v[0]).over(x.up_to)), **full)
transform("CumMean", [NUM], R_NUM, lambda p, v, x: kept(v[0], F.sum(d(v[0])).over(x.up_to) / F.row_number().over(x.w)), **full)
transform("CumulativeTimeSinceLastTrue", [T_INDEX, BOOL], R_DOUBLE,
          lambda p, v, x: seconds_between(v[0], F.last(F.when(v[1], v[0]), ignorenulls=True).over(x.up_to)), **ordered)
transform("CumulativeTimeSinceLastFalse", [T_INDEX, BOOL], R_DOUBLE,
          lambda p, v, x: seconds_between(v[0], F.last(F.when(~v[1], v[0]), ignorenulls=True).over(x.up_to)), **ordered)

# lag and difference
transform("Lag", [[CAT, ANY_T_INDEX], [NUM, ANY_T_INDEX], [BOOL, ANY_T_INDEX]], None, lambda p, v, x: F.lag(v[0], p.periods).over(x.w), params={"periods": 1}, **full)
transform("NumericLag", [ANY_T_INDEX, NUM], R_NUM, lambda p, v, x: F.lag(v[1], p.periods, p.fill_value).over(x.w), params={"periods": 1, "fill_value": None}, **full)
transform("Diff", [NUM], R_NUM, lambda p, v, x: F.lag(v[0], p.periods).over(x.w) - F.lag(v[0], p.periods + 1).over(x.w), params={"periods": 0}, **full)
transform("DiffDatetime", [TIME], column_schema("Timedelta"), lambda p, v, x: F.lag(v[0], p.periods).over(x.w) - F.lag(v[0], p.periods + 1).over(x.w), params={"periods": 0}, **full)
transform("RateOfChange", [NUM, T_INDEX], R_DOUBLE,
          lambda p, v, x: safe_div(v[0] - F.lag(v[0]).over(x.w), seconds_between(v[1], F.lag(v[1]).over(x.w))), **full)
transform("TimeSincePrevious", [T_INDEX], R_NUM, lambda p, v, x: in_unit(seconds_between(v[0], F.lag(v[0]).over(x.w)), p.unit), params={"unit": "seconds"}, **ordered)


def filled(v: Column, method: str, limit: int | None, x: Ctx) -> Column:
    """Nulls take the nearest value before (or after), at most ``limit`` rows away."""
    if method not in ("ffill", "pad", "bfill", "backfill"):
        raise ValueError("Invalid method")
    back = method in ("bfill", "backfill")
    far = 2**31 - 1 if limit is None else limit
    w = x.w.rowsBetween(0, far) if back else x.w.rowsBetween(-far, 0)
    pick = F.first if back else F.last
    return F.coalesce(v, pick(v, ignorenulls=True).over(w))


transform("AbsoluteDiff", [NUM], R_NUM, lambda p, v, x: F.abs(x.col("f") - F.lag(x.col("f")).over(x.w)), params={"method": "ffill", "limit": None},
          before=lambda p, v, x: {"f": filled(v[0], p.method, p.limit, x)}, **ordered)
transform("SameAsPrevious", [NUM], R_BOOL, lambda p, v, x: F.coalesce(x.col("f") == F.lag(x.col("f")).over(x.w), F.lit(False)), params={"fill_method": "pad", "limit": None},
          before=lambda p, v, x: {"f": filled(v[0], p.fill_method, p.limit, x)}, **ordered)


def _percent_change(p, v, x):
    if p.freq is not None:
        raise ValueError("freq needs an index of times, which rows of a table do not have")
    return safe_div(x.col("f"), F.lag(x.col("f"), p.periods).over(x.w)) - 1


transform("PercentChange", [NUM], R_DOUBLE, _percent_change, params={"periods": 1, "fill_method": "pad", "limit": None, "freq": None},
          before=lambda p, v, x: {"f": filled(v[0], p.fill_method, p.limit, x)}, **ordered)


def _percentile(p, v, x):
    """Average rank among equals over the number of known values; a running count by value needs one sort."""
    by = Window.partitionBy(*x.keys).orderBy(v[0].asc_nulls_last())
    same = Window.partitionBy(*x.keys, v[0])
    n = F.count(v[0]).over(x.group)
    return kept(v[0], (F.rank().over(by) + (F.count(F.lit(1)).over(same) - 1) / 2) / n)


transform("Percentile", [NUM], R_NUM, _percentile, full=True)


# rolling: windows of rows, or of time with open left end
def _offset(text: str) -> int:
    t = Timedelta.parse(text)
    return int(t.value * SECONDS[t.unit] * 1_000_000)


def rolling_frame(p, t: Column, x: Ctx):
    """The frame ``window_length`` long that ends ``gap`` before the row."""
    length, gap = p.window_length, p.gap
    if isinstance(gap, str) and not isinstance(length, str):
        raise TypeError("Cannot roll series with offset gap and integer window length")
    if isinstance(length, int) and (length <= 0 or isinstance(gap, int) and gap < 0):
        raise ValueError("Window length must be greater than zero.")
    if isinstance(length, int):
        return x.w.rowsBetween(-(gap + length - 1), -gap)
    if isinstance(gap, int) and gap:
        return None  # rows shifted first, then a span of time: see _rolled
    away = _offset(gap) if isinstance(gap, str) else 0
    return Window.partitionBy(*x.keys).orderBy(micros(t)).rangeBetween(-(_offset(length) + away) + 1, -away)


def _rolled(agg, on_time: bool = False, least: int = 1, skip_nulls: bool = True):
    """Aggregate over the frame, null unless it has min_periods values (0 counts as 1)."""

    def column(p, v, x):
        t = v[0]
        y = F.lit(1) if on_time else v[1]
        if isinstance(p.window_length, str) and isinstance(p.gap, int) and p.gap:
            y = x.col("shifted")
            w = Window.partitionBy(*x.keys).orderBy(micros(t)).rangeBetween(-_offset(p.window_length) + 1, 0)
        else:
            w = rolling_frame(p, t, x)
        n = F.count(y).over(w)
        enough = n >= max(1, p.min_periods or 0)
        return F.when(enough, agg(y, t, w, x))

    def before(p, v, x):
        if isinstance(p.window_length, str) and isinstance(p.gap, int) and p.gap:
            return {"shifted": F.lag(F.lit(1) if on_time else v[1], p.gap).over(x.w)}
        return {}

    return {"column": column, "before": before}


def _slope(y: Column, t: Column, w, x: Ctx) -> Column:
    """Least-squares slope over the frame, in the unit of its first time; 0 if all times are equal."""
    ok = y.isNotNull() & t.isNotNull()
    s = F.when(ok, d(micros(t)) / 1e6)
    first = F.min(F.when(ok, micros(t))).over(w)
    flat = F.var_pop(s).over(w) == 0
    slope = F.when(flat, F.lit(0.0)).otherwise(F.regr_slope(F.when(ok, d(y)), s).over(w))
    return F.when(F.count(F.when(ok, 1)).over(w) > 2, slope * trend_unit(first))


def _outliers(y: Column, t: Column, w, x: Ctx) -> Column:
    """Values beyond 1.5 interquartile ranges of the box; quartiles interpolate."""
    values = F.collect_list(y).over(w)
    q1, q3 = F.percentile(y, F.lit(0.25)).over(w), F.percentile(y, F.lit(0.75)).over(w)
    low, high = q1 - 1.5 * (q3 - q1), q3 + 1.5 * (q3 - q1)
    return d(F.aggregate(values, F.lit(0), lambda n, e: n + F.when((e < low) | (e > high), 1).otherwise(0)))


_p0 = {"window_length": 3, "gap": 1, "min_periods": 0}
_p1 = {"window_length": 3, "gap": 1, "min_periods": 1}
for _name, _agg, _params in [
    ("RollingMax", lambda y, t, w, x: d(F.max(y).over(w)), _p1), ("RollingMin", lambda y, t, w, x: d(F.min(y).over(w)), _p1),
    ("RollingMean", lambda y, t, w, x: F.avg(y).over(w), _p0), ("RollingSTD", lambda y, t, w, x: F.stddev_samp(y).over(w), _p1),
    ("RollingTrend", _slope, _p0), ("RollingOutlierCount", _outliers, _p0),
]:
    transform(_name, [T_INDEX, NUM], R_DOUBLE, params=_params, name="rolling_std" if _name == "RollingSTD" else None, **full, **_rolled(_agg))


def _rolling_count(p, v, x):
    if isinstance(p.window_length, int):
        w = x.w.rowsBetween(-(p.gap + p.window_length - 1), -p.gap)
        n = d(F.count(F.lit(1)).over(w))
        least = max(1, p.min_periods or 0)
        return F.when(F.row_number().over(x.w) >= least + p.gap, n)
    return _rolled(lambda y, t, w, x: d(F.count(y).over(w)), on_time=True)["column"](p, v, x)


transform("RollingCount", [T_INDEX], R_DOUBLE, _rolling_count, params=_p0, before=_rolled(None, on_time=True)["before"], **full)


# expanding: from the first row to ``gap`` rows before this one
def _expanding(agg):
    def column(p, v, x):
        if not isinstance(p.gap, int):
            raise TypeError("String offsets are not supported for the gap parameter in Expanding primitives")
        y = v[-1]
        w = x.w.rowsBetween(Window.unboundedPreceding, -p.gap)
        return F.when(F.count(y).over(w) >= max(1, p.min_periods or 0), agg(y, v[0], w, x))

    return column


_e = {"params": {"gap": 1, "min_periods": 1}, **full}
transform("ExpandingCount", [T_INDEX], R_INT, _expanding(lambda y, t, w, x: F.count(y).over(w)), **_e)
transform("ExpandingMax", [T_INDEX, NUM], R_NUM, _expanding(lambda y, t, w, x: F.max(y).over(w)), **_e)
transform("ExpandingMin", [T_INDEX, NUM], R_NUM, _expanding(lambda y, t, w, x: F.min(y).over(w)), **_e)
transform("ExpandingMean", [T_INDEX, NUM], R_DOUBLE, _expanding(lambda y, t, w, x: F.avg(y).over(w)), **_e)
transform("ExpandingSTD", [T_INDEX, NUM], R_DOUBLE, _expanding(lambda y, t, w, x: F.stddev_samp(y).over(w)), name="expanding_std", **_e)
transform("ExpandingTrend", [T_INDEX, NUM], R_DOUBLE, _expanding(_slope), **_e)


# exponentially weighted: linear recursions that carry over from batch to batch of a sorted column
def scan(a: np.ndarray, b: np.ndarray, before: float) -> np.ndarray:
    """y with y[t] = a[t] * y[t - 1] + b[t], in as many vector steps as the length has binary digits."""
    a, b = a.copy(), b.copy()
    b[:1] += a[:1] * before
    step = 1
    while step < len(b):
        b[step:] = b[step:] + a[step:] * b[:-step]
        a[step:] = a[step:] * a[:-step]
        step *= 2
    return b


class Weighted:
    """Exponentially weighted moments of a stream of groups, one after another; rows of null values repeat the last result."""

    def __init__(self, beta: float, ignore_na: bool, what: str):
        self.beta, self.ignore, self.what = beta, ignore_na, what
        self.base, self.sums = 0.0, [0.0] * 4

    def feed(self, x: np.ndarray, new: np.ndarray) -> np.ndarray:
        """Results of the next rows; ``new`` marks rows that begin a group."""
        known = ~np.isnan(x)
        value = np.where(known, x, 0.0)
        # values count from their group's first one, which keeps the squares small
        starts = np.flatnonzero(new)
        base = np.r_[self.base, value[starts]][np.searchsorted(starts, np.arange(len(x)), "right")]
        y = np.where(known, x - base, 0.0)
        keep = np.where(known, self.beta, 1.0) if self.ignore else np.full(len(x), self.beta)
        keep[new] = 0.0
        one = known.astype(float)
        parts = [scan(k, v, c) for k, v, c in zip((keep, keep, keep * keep, keep), (one, y, one, y * y), self.sums)]
        if len(x):
            self.base, self.sums = float(base[-1]), [float(p[-1]) for p in parts]
        w, wy, w2, wyy = parts
        with np.errstate(all="ignore"):
            mean = wy / w
            if self.what == "mean":
                return np.where(w > 0, base + mean, np.nan)
            free = w * w - w2
            var = np.where(free > 1e-12 * w * w, w * w / free * np.maximum(wyy / w - mean * mean, 0.0), np.nan)
            return var if self.what == "var" else np.sqrt(var)


def _ewm(what):
    def stream(p) -> Weighted:
        given = [k for k in ("com", "span", "halflife", "alpha") if getattr(p, k) is not None]
        if len(given) > 1:
            raise ValueError("com, span, halflife and alpha are mutually exclusive")
        kind = given[0] if given else "com"
        x = getattr(p, kind) if given else 0.5
        beta = {"com": lambda: x / (1 + x), "span": lambda: (x - 1) / (x + 1), "halflife": lambda: 0.5 ** (1 / x), "alpha": lambda: 1 - x}[kind]()
        if not 0 <= beta < 1:
            raise ValueError(f"{kind} {x} gives no weights")
        return Weighted(beta, p.ignore_na, what)

    return stream


_w = {"params": {"com": None, "span": None, "halflife": None, "alpha": None, "ignore_na": False}, **full}
transform("ExponentialWeightedAverage", [NUM], R_DOUBLE, stream=_ewm("mean"), **_w)
transform("ExponentialWeightedSTD", [NUM], R_DOUBLE, stream=_ewm("std"), name="exponential_weighted_std", **_w)
transform("ExponentialWeightedVariance", [NUM], R_DOUBLE, stream=_ewm("var"), **_w)


# smoothed: a window over the whole sorted column of a group
def savgol(y: np.ndarray, window: int, order: int, deriv: int = 0, delta: float = 1.0, mode: str = "interp", cval: float = 0.0) -> np.ndarray:
    """Least-squares polynomial smoothing over a sliding window; the ends take the fit of the first and last window."""
    from math import factorial

    if window % 2 != 1 or order >= window:
        raise ValueError("window_length must be odd and greater than polyorder")
    half = window // 2
    at = np.arange(-half, half + 1, dtype=float)
    fit = np.linalg.pinv(np.vander(at, order + 1, increasing=True))
    weights = fit[deriv] * factorial(deriv) / delta**deriv if deriv <= order else np.zeros(window)
    pads = {"mirror": "reflect", "nearest": "edge", "wrap": "wrap"}
    if mode == "interp":
        if window > len(y):
            raise ValueError("window_length is larger than the column")
        out = np.convolve(np.pad(y, half, "edge"), weights[::-1], "valid")
        for left in (True, False):
            part = y[:window] if left else y[-window:]
            coef = np.polynomial.polynomial.Polynomial(fit @ part).deriv(deriv) if deriv else np.polynomial.polynomial.Polynomial(fit @ part)
            where = at[:half] if left else at[-half:]
            if half:
                out[:half] = coef(where) / delta**deriv if left else out[:half]
                if not left:
                    out[-half:] = coef(where) / delta**deriv
        return out
    padded = np.pad(y, half, pads[mode]) if mode in pads else np.pad(y, half, constant_values=cval)
    return np.convolve(padded, weights[::-1], "valid")


def _smooth(p, cols):
    if (p.window_length is None) != (p.polyorder is None):
        raise ValueError("Both window_length and polyorder must be defined if you define one.")
    col = cols[0].astype("float64")
    if len(col) < 20 or col.isna().all():
        return col
    y = col.to_numpy(copy=True)
    gone = np.isnan(y)
    if gone.any():
        y[gone] = np.interp(np.flatnonzero(gone), np.flatnonzero(~gone), y[~gone])
    window, order = p.window_length, p.polyorder
    if window is None:
        window, order = len(y) // 10 * 2 + 1, 3
    import pandas as pd

    return pd.Series(savgol(y, window, order, p.deriv, p.delta, p.mode, p.cval), index=col.index)


transform("SavgolFilter", [NUM], R_DOUBLE, grouped=_smooth,
          params={"window_length": None, "polyorder": None, "deriv": 0, "delta": 1.0, "mode": "interp", "cval": 0.0})
