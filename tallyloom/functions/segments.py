"""Aggregations over the order of a group's rows, by states of segments that merge in order.

The rows are cut into ranges of (key, order), so a key that holds most rows lies in
many partitions. A partition turns its part of each key into a small state; the
states of a key, in order, merge into the result. Each aggregation looks at one
column, in which rows that do not count are null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


def _runs(v: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Length of the run of ones at the beginning, at the end, and the longest."""
    f, at = v > 0, np.arange(len(v))
    stop = np.where(f, -1, at)
    stop[start] = np.where(f[start], start - 1, start)
    run = at - np.maximum.accumulate(stop)
    first = np.minimum(np.minimum.reduceat(np.where(f, len(v), at), start), end)
    return [first - start, run[end - 1], np.maximum.reduceat(run, start)]


def _pairs(test: Callable) -> Callable:
    def state(v: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
        """First and last value, and how many neighbours pass the test."""
        hit = np.zeros(len(v))
        hit[1:] = test(v[:-1], v[1:])
        hit[start] = 0
        return [v[start], v[end - 1], np.add.reduceat(hit, start)]

    return state


def _since(v: np.ndarray, start: np.ndarray, end: np.ndarray) -> list[np.ndarray]:
    """Whether there is a one, zeros after the last one, all zeros."""
    ones = np.add.reduceat(v, start)
    last = np.maximum.reduceat(np.where(v > 0, np.arange(len(v)), -1), start)
    return [(ones > 0).astype(float), np.where(ones > 0, end - 1 - last, end - start), end - start - ones]


def _merge_runs(a: Column, s: Column) -> list[Column]:
    g = lambda c, i: F.get(c, F.lit(i))
    return [
        g(a, 0) + g(s, 0), F.when(g(a, 1) < g(a, 0), g(a, 1)).otherwise(g(a, 0) + g(s, 1)), F.when(g(s, 2) < g(s, 0), g(s, 2)).otherwise(g(s, 0) + g(a, 2)),
        F.greatest(g(a, 3), g(s, 3), g(a, 2) + g(s, 1)),
    ]


def _merge_pairs(test: Callable) -> Callable:
    def merge(a: Column, s: Column) -> list[Column]:
        g = lambda c, i: F.get(c, F.lit(i))
        both = (g(a, 0) > 0) & (g(s, 0) > 0)
        return [
            g(a, 0) + g(s, 0), F.when(g(a, 0) > 0, g(a, 1)).otherwise(g(s, 1)), F.when(g(s, 0) > 0, g(s, 2)).otherwise(g(a, 2)),
            g(a, 3) + g(s, 3) + F.when(both & test(g(a, 2), g(s, 1)), 1.0).otherwise(0.0),
        ]

    return merge


def _merge_since(a: Column, s: Column) -> list[Column]:
    g = lambda c, i: F.get(c, F.lit(i))
    return [g(a, 0) + g(s, 0), F.greatest(g(a, 1), g(s, 1)), F.when(g(s, 1) > 0, g(s, 2)).otherwise(g(a, 2) + g(s, 3)), g(a, 3) + g(s, 3)]


#: kind: (state of a segment after the number of its rows, merge of two states in order); a state has four numbers
KINDS: dict[str, tuple[Callable, Callable]] = {
    "runs": (_runs, _merge_runs),
    "falls": (_pairs(lambda a, b: b < a), _merge_pairs(lambda a, b: b < a)),
    "rises": (_pairs(lambda a, b: b > a), _merge_pairs(lambda a, b: b > a)),
    "changes": (_pairs(lambda a, b: b != a), _merge_pairs(lambda a, b: b != a)),
    "since": (_since, _merge_since),
}


def segment_states(keys: int, orders: int, kinds: list[str], most_rows: int = 500_000) -> Callable:
    """Arrow function over rows of (keys, orders, values) sorted by keys and orders: a row per key and segment with its first order and a state per value."""

    def states(t: pa.Table) -> pa.RecordBatch:
        new = np.zeros(t.num_rows, bool)
        new[0] = True
        for i in range(keys):
            c = t.column(i)
            new[1:] |= pc.fill_null(pc.not_equal(c.slice(1), c.slice(0, t.num_rows - 1)), True).to_numpy(zero_copy_only=False)
        first = np.flatnonzero(new)
        group = np.cumsum(new) - 1
        out = [t.column(i).combine_chunks().take(pa.array(first)) for i in range(keys + orders)]
        for i, kind in enumerate(kinds):
            col = t.column(keys + orders + i)
            known = np.flatnonzero(pc.is_valid(col).to_numpy(zero_copy_only=False))
            v = col.to_numpy(zero_copy_only=False)[known].astype(float)
            n = np.bincount(group[known], minlength=len(first))
            state = np.zeros((len(first), 4))
            state[:, 0] = n
            if len(v):
                has = n > 0
                end = np.cumsum(n[has])
                state[has, 1:] = np.column_stack(KINDS[kind][0](v, end - n[has], end))
            out.append(pa.FixedSizeListArray.from_arrays(pa.array(state.ravel()), 4).cast(pa.list_(pa.float64())))
        return pa.RecordBatch.from_arrays(out, [*(f"k{i}" for i in range(keys)), *(f"o{i}" for i in range(orders)), *(f"s{i}" for i in range(len(kinds)))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, rows = [], 0
        for batch in batches:
            if batch.num_rows:
                held.append(batch)
                rows += batch.num_rows
            if rows >= most_rows:
                yield states(pa.Table.from_batches(held))
                held, rows = [], 0
        if held:
            yield states(pa.Table.from_batches(held))

    return run


def merged(kind: str, ordered: Column, field: str) -> Column:
    """The state of a key from the array of its segments in order."""
    zero = F.array(*[F.lit(0.0)] * 4)
    return F.aggregate(ordered, zero, lambda a, s: F.array(*KINDS[kind][1](a, s.getField(field))))
