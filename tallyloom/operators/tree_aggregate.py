"""Per-key aggregation through a fan-in tree, for inputs where few keys hold most rows."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tallyloom.session import shuffle_width

#: kind of state: its parts as (first aggregation of rows, merge of states), and the value of the merged parts
KINDS = {
    "sum": ([(F.sum, F.sum)], lambda p: p[0]),
    "min": ([(F.min, F.min)], lambda p: p[0]),
    "max": ([(F.max, F.max)], lambda p: p[0]),
    "count": ([(F.count, F.sum)], lambda p: p[0]),
    "mean": ([(F.sum, F.sum), (F.count, F.sum)], lambda p: F.try_divide(p[0], p[1])),
    "distinct": ([(F.hll_sketch_agg, F.hll_union_agg)], lambda p: F.hll_sketch_estimate(p[0])),
}
NODE = "__tree_node"


def tree_aggregate(
    df: DataFrame,
    keys: list[str],
    states: dict[str, tuple[Column, str]],
    row_key: list[str],
    rows: int | None = None,
    chunk_rows: int = 65_536,
    fan_in: int = 16,
) -> DataFrame:
    """Aggregate ``states`` per ``keys`` in logarithmic fan-in rounds.

    ``states`` maps an output name to (column, kind), kind being sum, min, max, count,
    mean or distinct (an estimate, by sketches): their partial states, of one or two
    parts, merge by themselves. ``row_key`` tells
    rows apart; a row's chunk is a hash of it, so it is the same when a task runs
    again. ``rows`` is an upper bound of the row count (counted if not given).

    The rows form chunks of about ``chunk_rows``. The number of chunks is a
    multiple of the shuffle width, so a chunk lies inside one partition of an
    input hashed by ``row_key``, and Spark's map-side combine turns it into one
    state per key before anything moves. Each round then merges the states of
    ``fan_in`` neighbouring nodes, keyed by (key, node), until one node is left.
    No reducer receives more than about ``fan_in`` states of a key.

    Null keys form a group of their own; null values add nothing, and a key with null
    values only has a null sum, least, greatest and mean, and counts of 0. An empty
    input gives no rows.
    Columns other than those used are ignored.
    """
    unknown = {m for _, m in states.values()} - set(KINDS)
    if unknown:
        raise ValueError(f"unknown merges: {sorted(unknown)}")
    if rows is None:
        rows = df.count()
    width = shuffle_width(df.sparkSession)
    nodes = width * max(1, math.ceil(rows / chunk_rows / width))
    parts = [(name, f"__state_{i}_{j}", fns) for i, (name, (_, kind)) in enumerate(states.items()) for j, fns in enumerate(KINDS[kind][0])]
    cur = df.select(
        *keys,
        *[c.alias(f"__value_{i}") for i, (c, _) in enumerate(states.values())],
        F.pmod(F.hash(*row_key), F.lit(nodes)).alias(NODE),
    )
    value = {name: f"__value_{i}" for i, name in enumerate(states)}
    first = True
    while True:
        nodes = math.ceil(nodes / fan_in)
        group = [*keys]
        if nodes > 1:
            cur = cur.withColumn(NODE, F.floor(F.col(NODE) / fan_in))
            group.append(NODE)
        cur = cur.groupBy(*group).agg(*[(start(value[name]) if first else merge(part)).alias(part) for name, part, (start, merge) in parts])
        first = False
        if nodes <= 1:
            of = {name: [F.col(p) for n, p, _ in parts if n == name] for name in states}
            return cur.select(*keys, *[KINDS[kind][1](of[name]).alias(name) for name, (_, kind) in states.items()])
