"""Totals over trailing periods for every entity and day, by two-stack queues."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from datetime import date

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.session import shuffle_width

#: Monoids: identity and combine; none needs an inverse.
MONOIDS = {
    "sum": (0, np.add),
    "min": (np.iinfo(np.int64).max, np.minimum),
    "max": (np.iinfo(np.int64).min, np.maximum),
}


class TwoStackWindow:
    """Sliding aggregate of a queue of vectors: one element per entity, one push per day.

    The back stack keeps a running aggregate of what was pushed, the front stack
    the aggregates of its suffixes. When the front is empty the back is turned
    over. Every push costs a constant number of combines per entity, and nothing
    is ever subtracted.
    """

    def __init__(self, width: int, identity: int, combine: Callable, entities: int):
        self.width, self.combine = width, combine
        self.identity = np.full(entities, identity, np.int64)
        self.front: list[np.ndarray] = []
        self.back: list[np.ndarray] = []
        self.back_total = self.identity

    def push(self, x: np.ndarray) -> np.ndarray:
        if len(self.front) + len(self.back) == self.width:
            if not self.front:
                total = self.identity
                while self.back:
                    total = self.combine(self.back.pop(), total)
                    self.front.append(total)
                self.back_total = self.identity
            self.front.pop()
        self.back.append(x)
        self.back_total = self.combine(self.back_total, x)
        return self.combine(self.front[-1], self.back_total) if self.front else self.back_total


def _daily(days: int, windows: tuple[int, ...], monoids: list[str], keep, block: int, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema(
            [("entity", pa.int64()), ("day", pa.int32())]
            + [(f"{n}_{w}", pa.int64()) for w in windows for n in names]
        )
        # what stands for no value at all, by column of the result; a sum of nothing is 0
        nothing = [None, None, *[None if m == "sum" else MONOIDS[m][0] for _ in windows for m in monoids]]
        unseen = [0, -1, *[MONOIDS[m][0] for m in monoids]]

        def packed(held: list) -> pa.RecordBatch:
            cols = [np.concatenate(c) for c in zip(*held)]
            return pa.RecordBatch.from_arrays([pa.array(c, mask=None if x is None else c == x) for c, x in zip(cols, nothing)], schema=schema)

        def emit(entity, day, values, member) -> Iterator[pa.RecordBatch]:
            """One block of whole entities; a row with day -1 marks a member."""
            ids, at = np.unique(entity, return_inverse=True)
            wanted = np.zeros(len(ids), bool)
            wanted[at[member]] = True
            use = wanted[at] & (day >= 0)
            at, day, values = at[use], day[use], [v[use] for v in values]
            first = np.full(len(ids), days)
            np.minimum.at(first, at, day)
            grids = []
            for v, m in zip(values, monoids):
                grid = np.full((days, len(ids)), MONOIDS[m][0], np.int64)
                grid[day, at] = v
                grids.append(grid)
            queues = {
                (w, i): TwoStackWindow(w, *MONOIDS[m], len(ids)) for w in windows for i, m in enumerate(monoids)
            }
            held, count = [], 0
            for d in range(days):
                cols = {f"{names[i]}_{w}": q.push(grids[i][d]) for (w, i), q in queues.items()}
                pick = wanted if keep is None else wanted & keep(d, first, cols)
                hit = np.flatnonzero(pick)
                if len(hit):
                    held.append([ids[hit], np.full(len(hit), d, np.int32), *[c[hit] for c in cols.values()]])
                    count += len(hit)
                if held and (count >= 200_000 or d == days - 1):
                    yield packed(held)
                    held, count = [], 0
            if held:
                yield packed(held)

        rest: list[np.ndarray] | None = None
        for batch in batches:
            cols = [batch.column(i).fill_null(x).to_numpy(zero_copy_only=False) for i, x in enumerate(unseen)]
            rest = cols if rest is None else [np.concatenate(x) for x in zip(rest, cols)]
            starts = np.flatnonzero(np.r_[True, rest[0][1:] != rest[0][:-1]])
            if len(starts) > block:
                cut = starts[-1]  # the last entity may go on in the next batch
                done, rest = [c[:cut] for c in rest], [c[cut:] for c in rest]
                yield from emit(done[0], done[1], done[2:], done[1] < 0)
        if rest is not None and len(rest[0]):
            yield from emit(rest[0], rest[1], rest[2:], rest[1] < 0)

    return run


def rolling_totals(
    daily: DataFrame,
    entities: DataFrame,
    start: date,
    end: date,
    windows: tuple[int, ...],
    states: dict[str, str],
    keep: Callable | None = None,
    block: int = 2_048,
    task_rows: int = 4_000_000,
) -> DataFrame:
    """For each entity of ``entities`` and day from start to end, aggregates of trailing windows.

    ``daily`` has entity (long), day (int, days since ``start``) and one long column
    per name of ``states`` (name -> monoid), at most one row per entity and day, so
    no entity has more rows than the calendar has days, however many events it
    holds. Entities are hashed over partitions and sorted by (entity, day) inside
    them; each block of entities runs through the same queues day by day, a day
    without activity pushing the identity.

    ``keep(day, first_day, columns)`` is a predicate over vectors, pushed into the
    operator so that only rows of interest leave it; in them a minimum or maximum of
    nothing is its monoid's identity. Result: entity, day (int) and
    ``<name>_<window>``. Days outside the calendar and null entities are left out. A
    null state adds nothing; the sum of nothing is 0, the minimum or maximum of
    nothing null. Entities not in ``entities`` have no rows.

    The partitions are as many as entities times days in pieces of ``task_rows`` ask
    for: the result outgrows its input, so the input's size says little.
    """
    days = (end - start).days + 1
    names = list(states)
    mine = daily.where(F.col("entity").isNotNull() & F.col("day").between(0, days - 1)).select("entity", "day", *names)
    marks = entities.where(F.col("entity").isNotNull()).select(
        F.col("entity").cast("long"), F.lit(-1).alias("day"), *[F.lit(None).cast("long").alias(n) for n in names]
    )
    parts = max(shuffle_width(daily.sparkSession), -(-entities.count() * days // task_rows))
    both = mine.unionByName(marks).repartition(parts, "entity").sortWithinPartitions("entity", "day")
    out = "entity long, day int, " + ", ".join(f"{n}_{w} long" for w in windows for n in names)
    return both.mapInArrow(_daily(days, windows, [states[n] for n in names], keep, block, names), out)
