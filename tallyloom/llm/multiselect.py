"""Exact percentiles per group by distributed multi-select over sorted runs.

A run is a sorted array of values of one group, of a fixed most length. Runs of
different files or days are combined by a union of their tables, and percentiles
of the union are exact: the rank error is zero.

Every group goes through the same selection: partitions propose medians of what is
left of their runs, the weighted median of the proposals is the pivot, values are
counted below, at and above it, the side that the rank cannot lie on is discarded,
and so on until the pivot is the value. Where all of a group is in one run, the next
proposal needs no other partition, so its rounds go on where the run lies. A group of
several runs takes one exchange for each round, until what is left of it fits one run.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from tallyloom.session import discard, materialize, shuffle_width

RUNS = "group_id long, n long, vals array<long>"
LOW, HIGH = np.iinfo(np.int64).min, np.iinfo(np.int64).max


def build_runs(values: DataFrame, group: str, value: str, row_key: str, run_rows: int = 65_536, partitions: int | None = None) -> DataFrame:
    """Sorted runs of at most ``run_rows`` values, whatever the number of rows or groups.

    The rows are spread by ranges of (group, hash of ``row_key``): a group of any size
    is cut over as many partitions as its share asks for, small groups keep together,
    and nothing about the groups reaches the driver. Each partition is sorted by
    (group, value), which spills, and its stream is cut into runs. Null groups and null
    values are left out; repeated rows count each; other columns are ignored.
    """
    rows = values.where(F.col(group).isNotNull() & F.col(value).isNotNull()).select(
        F.col(group).cast("long").alias("group_id"), F.col(value).cast("long").alias("v"), F.xxhash64(row_key).alias("r")
    )
    spread = rows.repartitionByRange(partitions or shuffle_width(values.sparkSession), "group_id", "r")
    return spread.select("group_id", "v").sortWithinPartitions("group_id", "v").mapInArrow(_cut(run_rows), RUNS)


def _cut(run_rows: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        group, value = np.zeros(0, np.int64), np.zeros(0, np.int64)

        def runs(group: np.ndarray, value: np.ndarray) -> pa.RecordBatch:
            """The sorted rows as runs, each group's last one perhaps short."""
            first = np.flatnonzero(np.r_[True, group[1:] != group[:-1]])
            place = np.arange(len(group)) - np.repeat(first, np.diff(np.r_[first, len(group)]))
            start = np.flatnonzero(place % run_rows == 0)
            cut = np.r_[start, len(group)]
            return pa.RecordBatch.from_arrays(
                [pa.array(group[start]), pa.array(np.diff(cut)), pa.ListArray.from_arrays(pa.array(cut.astype(np.int32)), pa.array(value))], ["group_id", "n", "vals"]
            )

        for batch in batches:
            if not batch.num_rows:
                continue
            group = np.r_[group, batch.column(0).to_numpy()]
            value = np.r_[value, batch.column(1).to_numpy()]
            if len(group) < run_rows:
                continue
            # the last group may go on: its whole runs leave, the rest of it waits
            last = int(np.searchsorted(group, group[-1]))
            end = last + (len(group) - last) // run_rows * run_rows
            if end:
                yield runs(group[:end], value[:end])
                group, value = group[end:], value[end:]
        if len(group):
            yield runs(group, value)

    return run


def weighted_medians(key: np.ndarray, value: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each key of positive weight, its lower weighted median, and its weight."""
    keep = weight > 0
    key, value, weight = key[keep], value[keep], weight[keep]
    order = np.lexsort((value, key))
    key, value, weight = key[order], value[order], weight[order]
    keys, start, at = np.unique(key, return_index=True, return_inverse=True)
    run = np.cumsum(weight)
    base = np.r_[0, run][start]
    total = np.add.reduceat(weight, start) if len(start) else weight
    pick = np.flatnonzero((run - base[at]) * 2 >= total[at])
    first = pick[np.unique(at[pick], return_index=True)[1]]
    return keys, value[first], total


def ranks(n: np.ndarray, percents: tuple[int, ...]) -> np.ndarray:
    """Rank ceil(p * n / 100) of each percent, a row for each n."""
    return -(-n[:, None] * np.array(percents, np.int64)[None, :] // 100)


def select_in_runs(flat: np.ndarray, cut: np.ndarray, rank: np.ndarray) -> np.ndarray:
    """Multi-select in sorted runs, all runs and the ``rank``s wanted of each (from 1) at once: propose, count three ways, discard."""
    k = rank.shape[1]
    starts = np.zeros(len(flat) + 1, bool)
    starts[cut[:-1]] = True
    starts[1:-1] |= flat[1:] != flat[:-1]
    starts[-1] = True
    edge = np.flatnonzero(starts)  # where equal values begin
    block = np.cumsum(starts[:-1]) - 1
    want = (rank + cut[:-1, None]).ravel()
    low, high = np.repeat(cut[:-1], k), np.repeat(cut[1:], k)
    out = np.zeros(len(want), np.int64)
    live = np.arange(len(want))
    while len(live):
        pivot = (low[live] + high[live] - 1) // 2
        below, upto = edge[block[pivot]], edge[block[pivot] + 1]
        left, right = want[live] <= below, want[live] > upto
        found = ~left & ~right
        out[live[found]] = flat[pivot[found]]
        high[live[left]] = below[left]
        low[live[right]] = upto[right]
        live = live[~found]
    return out.reshape(-1, k)


FIRST = "group_id long, n long, answer array<long>, median long, weight long"


def _first(percents: tuple[int, ...]):
    """Groups of one run are selected; runs of other groups propose their medians."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for total, group, n, cut, flat in _run_columns(batch, "total"):
                whole = n == total
                at, between = _picked(cut, np.flatnonzero(whole))
                answers = select_in_runs(flat[at], between, ranks(n[whole], percents))
                part = np.flatnonzero(~whole)
                empty = pa.nulls(len(part), pa.list_(pa.int64()))
                lists = pa.ListArray.from_arrays(pa.array(np.arange(len(answers) + 1, dtype=np.int32) * len(percents)), pa.array(answers.ravel()))
                nothing = pa.nulls(len(answers), pa.int64())
                medians = pa.array(flat[cut[part] + (n[part] - 1) // 2])
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.r_[group[whole], group[part]]), pa.array(np.r_[total[whole], total[part]]), pa.concat_arrays([lists, empty]),
                        pa.concat_arrays([nothing, medians]), pa.concat_arrays([nothing, pa.array(n[part])]),
                    ],
                    ["group_id", "n", "answer", "median", "weight"],
                )

    return run


def _run_columns(batch: pa.RecordBatch, extra: str):
    """(extra, group, length, cuts, values) of the runs of a batch that are not empty; none for an empty batch."""
    get = lambda c: batch.column(c).to_numpy(zero_copy_only=False)
    if batch.num_rows:
        vals = batch.column("vals")
        cut = vals.offsets.to_numpy().astype(np.int64)
        flat = vals.values.to_numpy(zero_copy_only=False)
        yield get(extra), get("group_id"), get("n"), cut, flat


def _picked(cut: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the values of some runs, and the cuts between these runs."""
    n = cut[rows + 1] - cut[rows]
    new = np.r_[0, np.cumsum(n)]
    return np.arange(new[-1]) + np.repeat(cut[rows] - new[:-1], n), new


# the state of a group of several runs: for each percent the open range (both ends in it), the values below it and in it, the pivot, and the answer once found
LISTS = ("low", "high", "below", "rest", "pivot", "answer", "live")
STATE = "group_id long, n long, low array<long>, high array<long>, below array<long>, rest array<long>, pivot array<long>, answer array<long>, live array<boolean>"
COUNTS = "group_id long, target int, less long, equal long, more long, left long, right long"


def _propose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts three ways around the pivots, and the partition's proposals for either remainder: the weighted medians of its runs' medians."""
    held: dict[tuple, list] = {}

    def flush():
        keys = list(held)
        owner = np.concatenate([np.full(len(held[k]), i) for i, k in enumerate(keys)])
        less, equal, more, left, right = np.concatenate([np.array(held[k], np.int64).reshape(-1, 5) for k in keys]).T
        sums = [np.bincount(owner, weights=x, minlength=len(keys)).astype(np.int64) for x in (less, equal, more)]
        sides = []
        for value, weight in ((left, less), (right, more)):
            side = np.zeros(len(keys), np.int64)
            at, median, _ = weighted_medians(owner, value, weight)
            side[at] = median
            sides.append(side)
        cols = [np.array([k[0] for k in keys], np.int64), np.array([k[1] for k in keys], np.int32), *sums, *sides]
        return pa.RecordBatch.from_arrays([pa.array(c) for c in cols], ["group_id", "target", "less", "equal", "more", "left", "right"])

    for batch in batches:
        states = [batch.column(c).to_pylist() for c in ("low", "high", "pivot", "live")]
        for (_, group, _, cut, flat) in _run_columns(batch, "group_id"):
            for r, g in enumerate(group.tolist()):
                v = flat[cut[r] : cut[r + 1]]
                for k, (low, high, pivot, live) in enumerate(zip(*(s[r] for s in states))):
                    if not live:
                        continue
                    part = v[np.searchsorted(v, low, "left") : np.searchsorted(v, high, "right")]
                    if not len(part):
                        continue
                    x, y, m = int(np.searchsorted(part, pivot, "left")), int(np.searchsorted(part, pivot, "right")), len(part)
                    held.setdefault((g, k), []).append((x, y - x, m - y, part[(x - 1) // 2] if x else 0, part[y + (m - y - 1) // 2] if m > y else 0))
        if len(held) > 50_000:
            yield flush()
            held = {}
    if held:
        yield flush()


def _by_group(work: Callable) -> Callable:
    """Streams whole groups of a partition sorted by group_id to ``work``, many groups at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("group_id").to_numpy()
            first = int(np.searchsorted(ids, ids[-1]))
            if first or rest and rest[-1].column("group_id")[-1].as_py() != ids[-1]:
                if whole := [*rest, *([batch.slice(0, first)] if first else [])]:
                    yield from work(pa.Table.from_batches(whole).combine_chunks())
                rest = []
            rest.append(batch.slice(first))
        if rest:
            yield from work(pa.Table.from_batches(rest).combine_chunks())

    return run


def _states(cols: dict) -> Iterator[pa.RecordBatch]:
    m, k = cols["low"].shape
    off = pa.array(np.arange(m + 1, dtype=np.int32) * k)
    lists = [pa.ListArray.from_arrays(off, pa.array(np.ascontiguousarray(cols[c]).ravel())) for c in LISTS]
    yield pa.RecordBatch.from_arrays([pa.array(cols["group_id"]), pa.array(cols["n"]), *lists], ["group_id", "n", *LISTS])


def _unpacked(t: pa.Table, k: int) -> tuple[dict, pa.Table]:
    """The states among the rows, as arrays, and the other rows."""
    is_state = pa.array(t.column("target").is_null().to_numpy())
    states = t.filter(is_state)
    s = {c: states.column(c).combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, k).copy() for c in LISTS}
    return s | {c: states.column(c).to_numpy() for c in ("group_id", "n")}, t.filter(pa.array(~is_state.to_numpy(zero_copy_only=False)))


def _begin(percents: tuple[int, ...]):
    """The state before the first count: everything is open, the pivot is the weighted median of the first proposals."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        col = lambda c: t.column(c).to_numpy()
        group, pivot, _ = weighted_medians(col("group_id"), col("median"), col("weight"))
        n = col("n")[np.searchsorted(col("group_id"), group)]
        full = lambda x, kind=np.int64: np.full((len(group), len(percents)), x, kind)
        yield from _states({
            "group_id": group, "n": n, "low": full(LOW), "high": full(HIGH), "below": full(0), "rest": np.repeat(n[:, None], len(percents), 1), "pivot": np.repeat(pivot[:, None], len(percents), 1),
            "answer": full(0), "live": full(True, bool),
        })

    return _by_group(work)


def _discard(percents: tuple[int, ...]):
    """Decide by the counts of all partitions on which side each rank lies; that side's proposals give the next pivot."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k = len(percents)
        s, counts = _unpacked(t, k)
        want = ranks(s["n"], percents)
        less, equal, more, left, right = (counts.column(c).to_numpy() for c in ("less", "equal", "more", "left", "right"))
        cell = np.searchsorted(s["group_id"], counts.column("group_id").to_numpy()) * k + counts.column("target").to_numpy()
        total = lambda w: np.bincount(cell, weights=w, minlength=want.size).astype(np.int64).reshape(-1, k)
        n_less, n_equal, n_more = total(less), total(equal), total(more)
        go_left = s["live"] & (want <= s["below"] + n_less)
        go_right = s["live"] & (want > s["below"] + n_less + n_equal)
        hit = s["live"] & ~go_left & ~go_right
        s["answer"][hit] = s["pivot"][hit]
        s["live"] &= ~hit
        s["high"][go_left] = s["pivot"][go_left] - 1
        s["low"][go_right] = s["pivot"][go_right] + 1
        s["below"][go_right] += (n_less + n_equal)[go_right]
        s["rest"][go_left], s["rest"][go_right] = n_less[go_left], n_more[go_right]
        for side, value, weight in ((go_left, left, less), (go_right, right, more)):
            use = side.ravel()[cell]
            at, median, _ = weighted_medians(cell[use], value[use], weight[use])
            s["pivot"].ravel()[at] = median
        yield from _states(s)

    return _by_group(work)


def _narrow(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Runs without the values that all of their group's open ranges have discarded."""
    for batch in batches:
        states = [batch.column(c).to_pylist() for c in ("low", "high", "live")]
        for (_, group, _, cut, flat) in _run_columns(batch, "group_id"):
            keep = np.zeros(len(flat) + 1, np.int32)
            for r in range(len(group)):
                v = flat[cut[r] : cut[r + 1]]
                for low, high, live in zip(*(s[r] for s in states)):
                    if live:
                        keep[cut[r] + np.searchsorted(v, low, "left")] += 1
                        keep[cut[r] + np.searchsorted(v, high, "right")] -= 1
            kept = np.cumsum(keep[:-1]) > 0
            at = np.r_[0, np.cumsum(kept)][cut]
            n = np.diff(at)
            full = np.flatnonzero(n)
            yield pa.RecordBatch.from_arrays(
                [pa.array(group[full]), pa.array(n[full]), pa.ListArray.from_arrays(pa.array(np.r_[at[full], at[-1:]].astype(np.int32)), pa.array(flat[kept]))],
                ["group_id", "n", "vals"],
            )


WINDOWS = "group_id long, target int, vals array<long>"


def _windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What is left of each run for each percent that is open."""
    for batch in batches:
        states = [batch.column(c).to_pylist() for c in ("low", "high", "live")]
        for (_, group, _, cut, flat) in _run_columns(batch, "group_id"):
            out = []
            for r in range(len(group)):
                v = flat[cut[r] : cut[r + 1]]
                for k, (low, high, live) in enumerate(zip(*(s[r] for s in states))):
                    if live:
                        out.append((group[r], k, v[np.searchsorted(v, low, "left") : np.searchsorted(v, high, "right")]))
            if out:
                new = np.cumsum([0, *(len(v) for *_, v in out)]).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(new), pa.array(np.concatenate([v for *_, v in out])))
                yield pa.RecordBatch.from_arrays([pa.array([g for g, *_ in out], pa.int64()), pa.array([k for _, k, _ in out], pa.int32()), lists], ["group_id", "target", "vals"])


def _finish(percents: tuple[int, ...]):
    """What is left of each group has become one run for each open percent: its rounds go on there."""

    def work(t: pa.Table) -> Iterator[pa.RecordBatch]:
        k = len(percents)
        s, windows = _unpacked(t, k)
        cell = np.searchsorted(s["group_id"], windows.column("group_id").to_numpy()) * k + windows.column("target").to_numpy()
        vals = windows.column("vals").combine_chunks()
        owner, flat = np.repeat(cell, vals.value_lengths().to_numpy()), vals.flatten().to_numpy()
        order = np.lexsort((flat, owner))
        cells, first = np.unique(owner[order], return_index=True)
        rank = (ranks(s["n"], percents) - s["below"]).ravel()[cells]
        s["answer"].ravel()[cells] = select_in_runs(flat[order], np.r_[first, len(flat)], rank[:, None])[:, 0]
        s["live"][:] = False
        yield from _states(s)

    return _by_group(work)


def select_percentiles(runs: DataFrame, percents: tuple[int, ...], run_rows: int = 65_536, most_rounds: int = 500, narrow_every: int = 4) -> DataFrame:
    """Value at rank ceil(p * n / 100) for each group and p: group_id, n, p50, ...

    ``runs`` should be materialised. All that a round knows of a group is a row of a
    table, joined to the runs by group, so nothing of the groups is held by the driver.
    A pivot leaves at least an eighth of what is left on either side (a median of
    partitions' medians of runs' medians; equal values count at the pivot), so the
    rounds with an exchange grow with the logarithm of the largest group over
    ``run_rows``. Every ``narrow_every`` rounds the runs are written again without
    what is discarded. Empty runs give no groups.
    """
    sizes = runs.groupBy("group_id").agg(F.sum("n").alias("total"))
    first = materialize(runs.where("n > 0").join(sizes, "group_id").mapInArrow(_first(percents), FIRST), "p4first")
    answers = [first.where("answer is not null").select("group_id", "n", "answer")]
    is_open = F.exists("live", lambda x: x)
    is_long = F.aggregate(F.arrays_zip("live", "rest"), F.lit(0).cast("long"), lambda a, x: a + F.when(x["live"], x["rest"]).otherwise(0)) > run_rows

    def grouped(df: DataFrame, work, label: str) -> tuple[DataFrame, dict]:
        seen = Observation()
        out = df.repartition("group_id").sortWithinPartitions("group_id").mapInArrow(work, STATE)
        out = materialize(out.observe(seen, F.count_if(is_open & is_long).alias("long"), F.count_if(is_open & ~is_long).alias("short")), label)
        return out, seen.get

    state, count = grouped(first.where("answer is null").select("group_id", "n", "median", "weight"), _begin(percents), "p4state")
    left, short, old = runs, [], None
    for turn in range(most_rounds):
        if count["short"]:
            short.append(state.where(is_open & ~is_long))
        if not count["long"]:
            break
        if turn % narrow_every == 0:
            ranges = ("group_id", "low", "high", "live")
            kept = state.where(is_open).select(*ranges)
            for x in short[: -1 if count["short"] else None]:
                kept = kept.unionByName(x.select(*ranges))
            old, left = left, materialize(left.join(kept, "group_id").mapInArrow(_narrow, RUNS), "p4runs")
            if old is not runs:
                discard(old)
        live = state.where(is_open & is_long)
        counts = left.join(live.select("group_id", "low", "high", "pivot", "live"), "group_id").mapInArrow(_propose, COUNTS)
        state, count = grouped(live.unionByName(counts, allowMissingColumns=True), _discard(percents), "p4state")
        answers.append(state.where(~is_open).select("group_id", "n", "answer"))
    else:
        raise RuntimeError("multi-select did not end")
    if short:
        rest = short[0]
        for x in short[1:]:
            rest = rest.unionByName(x)
        windows = left.join(rest.select("group_id", "low", "high", "live"), "group_id").mapInArrow(_windows, WINDOWS)
        done, _ = grouped(rest.unionByName(windows, allowMissingColumns=True), _finish(percents), "p4last")
        answers.append(done.select("group_id", "n", "answer"))
    out = answers[0]
    for a in answers[1:]:
        out = out.unionByName(a)
    return out.select("group_id", "n", *[F.get("answer", F.lit(i)).alias(f"p{p}") for i, p in enumerate(percents)])
