"""Per-entity feature tables from bit-sliced counters over compressed ordinal sets.

A cell is a pair (event type, entity ordinal). The ordinals are cut into blocks of
4,096 entities; inside a block each type has a container, the sorted 12-bit
ordinals of its entities that occur. Count and totals are numbers cut into bit
slices: slice k is a bitmap, aligned with the containers' ordinals, of bit k of
all cells at once. Two such numbers are added by carry addition, slice by slice
with AND and XOR over packed words. The latest time is an array aligned the same way.

Partial tables are built from batches of rows before the shuffle, so an entity
with a third of all rows ships at most one cell per type and batch.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import shuffle_width

BLOCK_BITS = 12
BLOCK = 1 << BLOCK_BITS
NEVER = np.iinfo(np.int64).min
NUMBERS = ("count", "plus", "minus")

PARTIAL = "block long, node long, types binary, sizes binary, ordinals binary, count binary, plus binary, minus binary, latest binary"
KINDS = pa.schema([("block", pa.int64()), ("node", pa.int64()), *[(n, pa.binary()) for n in ("types", "sizes", "ordinals", *NUMBERS, "latest")]])


def carry_add(a: list[np.ndarray], b: list[np.ndarray]) -> list[np.ndarray]:
    """Sum of two bit-sliced numbers; works on packed words and on 0/1 arrays."""
    if not a or not b:
        return a or b
    out, carry = [], None
    zero = np.zeros_like(a[0])
    for k in range(max(len(a), len(b))):
        x = a[k] if k < len(a) else zero
        y = b[k] if k < len(b) else zero
        half = x ^ y
        if carry is None:
            out.append(half)
            carry = x & y
        else:
            out.append(half ^ carry)
            carry = (x & y) | (half & carry)
        if not carry.any():
            carry = None
    if carry is not None:
        out.append(carry)
    return out


def slices_of(values: np.ndarray) -> list[np.ndarray]:
    """0/1 slices of non-negative integers."""
    top = int(values.max()).bit_length() if len(values) else 0
    return [((values >> k) & 1).astype(np.uint8) for k in range(top)]


def numbers_of(slices: list[np.ndarray], n: int) -> np.ndarray:
    out = np.zeros(n, np.int64)
    for k, s in enumerate(slices):
        out |= np.unpackbits(s, count=n).astype(np.int64) << k
    return out


class SlicedTable:
    """The cells of one block: containers per type, sliced numbers, latest times."""

    def __init__(self, types, sizes, ordinals, numbers, latest):
        self.types, self.sizes, self.ordinals, self.numbers, self.latest = types, sizes, ordinals, numbers, latest

    def keys(self, types: np.ndarray) -> np.ndarray:
        """Cell keys over the wider list of ``types``."""
        return np.repeat(np.searchsorted(types, self.types), self.sizes) * BLOCK + self.ordinals

    def merge(self, other: SlicedTable) -> SlicedTable:
        types = np.union1d(self.types, other.types)
        mine, theirs = self.keys(types), other.keys(types)
        cells = np.union1d(mine, theirs)
        n = len(cells)
        at = [np.searchsorted(cells, mine), np.searchsorted(cells, theirs)]

        def spread(packed, pos):
            bits = np.zeros(n, np.uint8)
            bits[pos] = np.unpackbits(packed, count=len(pos))
            return np.packbits(bits)

        numbers = {
            name: carry_add(
                [spread(s, at[0]) for s in self.numbers[name]],
                [spread(s, at[1]) for s in other.numbers[name]],
            )
            for name in NUMBERS
        }
        latest = np.full(n, NEVER)
        latest[at[0]] = self.latest
        latest[at[1]] = np.maximum(latest[at[1]], other.latest)
        return SlicedTable(
            types, np.bincount(cells >> BLOCK_BITS, minlength=len(types)), cells & (BLOCK - 1), numbers, latest
        )

    def pack(self, block: int, node: int) -> tuple:
        """A row of PARTIAL; the slices of a number stand one after another."""
        return (
            int(block), node, self.types.astype(np.int64).tobytes(), self.sizes.astype(np.int32).tobytes(), self.ordinals.astype(np.uint16).tobytes(),
            *(b"".join(x.tobytes() for x in self.numbers[name]) for name in NUMBERS), self.latest.astype(np.int64).tobytes(),
        )

    @staticmethod
    def unpack(batch: pa.RecordBatch, row: int) -> SlicedTable:
        blob = lambda name, kind: np.frombuffer(batch.column(name)[row].as_buffer(), kind)
        ordinals = blob("ordinals", np.uint16).astype(np.int64)
        wide = -(-len(ordinals) // 8)
        return SlicedTable(
            blob("types", np.int64), blob("sizes", np.int32), ordinals, {name: list(blob(name, np.uint8).reshape(-1, wide)) for name in NUMBERS},
            blob("latest", np.int64),
        )


def packed(rows: list[tuple]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(zip(*rows), KINDS)], schema=KINDS)


def batch_tables(entity, kind, cents, latest) -> Iterator[tuple[int, SlicedTable]]:
    """Sliced tables of one batch of rows, by block.

    Rows of one cell are added pairwise, in as many rounds as the binary length
    of the largest group.
    """
    block = entity >> BLOCK_BITS
    order = np.lexsort((entity, kind, block))
    entity, kind, cents, latest, block = (x[order] for x in (entity, kind, cents, latest, block))
    new = np.ones(len(entity), bool)
    new[1:] = (entity[1:] != entity[:-1]) | (kind[1:] != kind[:-1])
    first = np.flatnonzero(new)
    newest = np.maximum.reduceat(latest, first)
    numbers = {
        "count": [np.ones(len(entity), np.uint8)],
        "plus": slices_of(np.maximum(cents, 0)),
        "minus": slices_of(np.maximum(-cents, 0)),
    }
    cell = np.cumsum(new) - 1
    while True:
        rank = np.arange(len(cell)) - np.searchsorted(cell, cell)
        right = np.flatnonzero(rank % 2 == 1)
        if not len(right):
            break
        left = right - 1
        keep = np.flatnonzero(rank % 2 == 0)
        for name, slices in numbers.items():
            sums = carry_add([s[left] for s in slices], [s[right] for s in slices])
            slices = slices + [np.zeros(len(cell), np.uint8)] * (len(sums) - len(slices))
            slices = [s.copy() for s in slices]
            for s, x in zip(slices, sums):
                s[left] = x
            numbers[name] = [s[keep] for s in slices]
        cell = cell[keep]
    entity, kind, block = entity[first], kind[first], block[first]
    cuts = [*np.flatnonzero(np.r_[True, block[1:] != block[:-1]]), len(block)] if len(block) else [0]
    for a, b in zip(cuts, cuts[1:]):
        types, sizes = np.unique(kind[a:b], return_counts=True)
        yield (
            block[a],
            SlicedTable(
                types,
                sizes,
                entity[a:b] & (BLOCK - 1),
                {name: trimmed(slices, a, b) for name, slices in numbers.items()},
                newest[a:b],
            ),
        )


def trimmed(slices: list[np.ndarray], a: int, b: int) -> list[np.ndarray]:
    """Packed slices a:b without the empty ones at the top."""
    cut = [s[a:b] for s in slices]
    while cut and not cut[-1].any():
        cut.pop()
    return [np.packbits(s) for s in cut]


def _column(batch: pa.RecordBatch, i: int, default: int) -> np.ndarray:
    col = batch.column(i)
    if not pa.types.is_int64(col.type):
        col = col.cast(pa.int64())
    return col.fill_null(default).to_numpy(zero_copy_only=False)


def _build(batch_rows: int, block_rows: int, most_rows: int, nodes: int):
    """Partial tables of batches; a batch grows with the blocks it holds, and its node tells partials of a block apart."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        task = TaskContext.get()
        node = task.partitionId() if task else 0
        held, rows, due = [], 0, batch_rows

        def flush():
            cols = [np.concatenate(x) for x in zip(*held)]
            return packed([t.pack(b, node % nodes) for b, t in batch_tables(*cols)])

        for batch in batches:
            held.append([_column(batch, 0, 0), _column(batch, 1, 0), _column(batch, 2, 0), _column(batch, 3, NEVER)])
            rows += batch.num_rows
            if rows >= due:
                due = max(batch_rows, min(most_rows, block_rows * len(np.unique(np.concatenate([x[0] for x in held]) >> BLOCK_BITS))))
            if rows >= due:
                yield flush()
                held, rows, due, node = [], 0, batch_rows, node + 1
        if rows:
            yield flush()

    return run


def _decode(block: int, t: SlicedTable, names: list[str], stamp: pa.DataType) -> pa.RecordBatch:
    n = len(t.ordinals)
    kind = np.repeat(t.types, t.sizes)
    order = np.lexsort((kind, t.ordinals))
    ordinal = t.ordinals[order]
    entity, start = np.unique(ordinal, return_index=True)
    offsets = pa.array(np.r_[start, n].astype(np.int32))
    total = numbers_of(t.numbers["plus"], n) - numbers_of(t.numbers["minus"], n)
    latest = t.latest[order]
    lists = [
        pa.array(kind[order]),
        pa.array(numbers_of(t.numbers["count"], n)[order]),
        pa.array(total[order]),
        pa.array(latest, mask=latest == NEVER).cast(stamp),
    ]
    return pa.RecordBatch.from_arrays(
        [pa.array((block << BLOCK_BITS) + entity), *[pa.ListArray.from_arrays(offsets, x) for x in lists]], names
    )


def _merge(finish):
    """Merges the tables of each (block, node), sorted, in the order of a binary counter; ``finish(block, node, table)`` makes a batch of each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, stack = None, []

        def push(t):
            size = 1
            while stack and stack[-1][0] <= size:
                other_size, other = stack.pop()
                t, size = other.merge(t), size + other_size
            stack.append((size, t))

        def done():
            t = stack.pop()[1]
            while stack:
                t = stack.pop()[1].merge(t)
            return finish(*current, t)

        for batch in batches:
            for row, key in enumerate(zip(batch.column("block").to_pylist(), batch.column("node").to_pylist())):
                if key != current:
                    if stack:
                        yield done()
                    current = key
                push(SlicedTable.unpack(batch, row))
        if stack:
            yield done()

    return run


def entity_features(
    events: DataFrame,
    entity: Column,
    kind: Column,
    value: Column,
    time: Column,
    batch_rows: int = 131_072,
    rows: int | None = None,
    fan_in: int = 16,
    block_rows: int = 64,
    most_rows: int = 2_097_152,
) -> DataFrame:
    """One row per entity with count, total and latest time of each event type.

    ``entity`` and ``kind`` are integers of up to 64 bits and serve as their own
    ordinals: the bits above the lowest twelve name the block, as the high bits
    name a container in a compressed bitmap, so sparse ids cost nothing. ``value``
    is a whole number (cents); ``time`` a timestamp.

    Result: entity_id, then arrays types, counts, totals, latest, aligned and in
    ascending order of type, of the types the entity has. Rows with a null entity
    or type have no cell and are left out; a null value counts but adds 0; a null
    time is never the latest (null if there is no other). Empty input, no rows.

    A batch has ``batch_rows`` rows, or ``block_rows`` for each block it meets where
    that is more, up to ``most_rows``. The partial tables of a block merge in rounds
    of about ``fan_in``, keyed by (block, node), so a block that every batch meets is
    no single task's work. ``rows`` is an upper bound of the row count (counted if not
    given); it sets the number of rounds.
    """
    if rows is None:
        rows = events.count()
    stamp_type = events.select(time.alias("t")).schema["t"].dataType
    stamp = pa.timestamp("us") if stamp_type.simpleString() == "timestamp_ntz" else pa.timestamp("us", "UTC")
    cells = events.select(
        entity.cast("long").alias("e"), kind.cast("long").alias("k"), value.cast("long").alias("v"), time.alias("t")
    ).where("e is not null and k is not null")
    width = shuffle_width(events.sparkSession)
    nodes = max(width, -(-rows // batch_rows))  # at most about so many partials of a block
    partial = cells.mapInArrow(_build(batch_rows, block_rows, most_rows, nodes), PARTIAL)
    while nodes > fan_in:
        nodes = -(-nodes // fan_in)
        partial = (
            partial.withColumn("node", F.pmod("node", F.lit(nodes))).repartition("block", "node").sortWithinPartitions("block", "node")
            .mapInArrow(_merge(lambda block, node, t: packed([t.pack(block, node)])), PARTIAL)
        )
    names = ["entity_id", "types", "counts", "totals", "latest"]
    out = (
        f"entity_id long, types array<long>, counts array<long>, totals array<long>, "
        f"latest array<{stamp_type.simpleString()}>"
    )
    last = partial.withColumn("node", F.lit(0).cast("long")).repartition("block").sortWithinPartitions("block")
    return last.mapInArrow(_merge(lambda block, _, t: _decode(block, t, names, stamp)), out)
