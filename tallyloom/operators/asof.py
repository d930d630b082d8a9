"""Point-in-time attributes: each event with the attributes known at its instant."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.window import Window

from tallyloom.operators.heavy import heavy_keys

E, AT, SLICE, PRIO, VER, EVENT = "__entity", "__at", "__slice", "__prio", "__version", "__event"


def _slice_bounds(profile: DataFrame, heavy, stamp: T.DataType) -> dict:
    """Time boundaries that cut each heavy entity into slices of about limit rows."""
    if not heavy.counts:
        return {}
    parts = {k: math.ceil(n / heavy.limit) for k, n in heavy.counts.items()}
    most = max(parts.values())
    steps = [i / most for i in range(1, most)]
    got = (
        profile.where(F.col(E).isin(list(parts)))
        .groupBy(E)
        .agg(F.percentile_approx(AT, F.array(*[F.lit(s) for s in steps]), F.lit(max(1000, 4 * most))).alias("b"))
        .collect()
    )
    out = {}
    for r in got:
        n = parts[r[0]]
        picks = {r["b"][max(0, round(i * most / n) - 1)] for i in range(1, n)}
        out[r[0]] = sorted(picks)
    return out


def _slice_of(at: Column) -> Column:
    """How many boundaries lie at or before ``at``, found in two steps of about a square root each."""
    coarse = F.size(F.filter("__coarse", lambda b: b <= at))
    fine = F.filter(F.element_at("__fine", F.greatest(coarse, F.lit(1))), lambda b: b <= at)
    return F.when(F.col("__coarse").isNull() | (coarse == 0), F.lit(0)).otherwise(
        (coarse - 1) * F.col("__run") + F.size(fine)
    )


def asof_attributes(
    events: DataFrame,
    versions: DataFrame,
    entity: str,
    time: str,
    version_entity: str,
    effective_from: str,
    known_at: str,
    version_id: str,
    attributes: tuple[str, ...] = (),
    profile: DataFrame | None = None,
    version_profile: DataFrame | None = None,
    into: str = "version",
    slice_rows: int = 50_000,
    most_heavy: int = 10_000,
) -> DataFrame:
    """Append to each event a struct of the version visible at its time.

    A version is visible from the later of ``effective_from`` and ``known_at`` on;
    of the visible ones that of greatest (effective_from, known_at, version_id)
    holds. Events and versions are united, sorted by (entity, availability time)
    with versions before events of the same instant, and the greatest version so
    far is carried forward: one sort, no pairs of events and versions.

    Entities with more than ``slice_rows`` events and versions (or rows /
    ``most_heavy``, which bounds their number) are cut into time slices of about that
    many rows; each slice gets the state that earlier slices leave as its first row,
    computed from the versions alone. ``profile`` and ``version_profile`` may give
    cheaper tables with the same columns to find those entities from; they only affect
    balance. Rows of one entity and instant stay in one slice.

    Events with a null entity or time, or without a visible version, get a null
    struct. Versions with a null entity or time are never visible. Repeated events
    stay, repeated versions change nothing. Event columns keep their names, the
    struct's name must not be one of them.
    """
    if into in events.columns:
        raise ValueError(f"events already have a column {into}")
    spark = events.sparkSession
    stamp = events.schema[time].dataType
    own = [F.col(f"`{c}`").alias(c) for c in events.columns]
    body = F.struct(*own)
    ready = F.col(f"`{entity}`").isNotNull() & F.col(f"`{time}`").isNotNull()
    kept = [effective_from, known_at, version_id, *attributes]
    carried = F.struct(*[F.col(f"`{c}`").alias(c) for c in kept])
    vers = versions.where(
        F.col(version_entity).isNotNull() & F.col(effective_from).isNotNull() & F.col(known_at).isNotNull()
    ).select(
        F.col(version_entity).cast(events.schema[entity].dataType).alias(E),
        F.greatest(effective_from, known_at).cast(stamp).alias(AT),
        F.lit(0).alias(PRIO),
        carried.alias(VER),
    )
    seen = (events if profile is None else profile).select(
        F.col(f"`{entity}`").alias(E), F.col(f"`{time}`").alias(AT)
    ).unionByName((vers if version_profile is None else version_profile.select(
        F.col(f"`{version_entity}`").cast(events.schema[entity].dataType).alias(E), F.greatest(effective_from, known_at).cast(stamp).alias(AT)
    )).select(E, AT)).where(f"{E} is not null and {AT} is not null")
    heavy = heavy_keys(seen, E, slice_rows, most_heavy)
    bounds = _slice_bounds(seen, heavy, stamp)

    rows = events.where(ready).select(
        F.col(f"`{entity}`").alias(E), F.col(f"`{time}`").alias(AT), F.lit(1).alias(PRIO), body.alias(EVENT)
    )
    if bounds:
        # at most most_heavy entities and rows / limit boundaries, whatever the data
        runs = []
        for k, b in bounds.items():
            run = max(1, math.isqrt(len(b)))
            fine = [b[i : i + run] for i in range(0, len(b), run)]
            runs.append((k, [f[0] for f in fine], fine, run))
        side = spark.createDataFrame(
            runs,
            T.StructType(
                [
                    T.StructField(E, events.schema[entity].dataType),
                    T.StructField("__coarse", T.ArrayType(stamp)),
                    T.StructField("__fine", T.ArrayType(T.ArrayType(stamp))),
                    T.StructField("__run", T.IntegerType()),
                ]
            ),
        )
        cut = lambda df: df.join(F.broadcast(side), E, "left").withColumn(SLICE, _slice_of(F.col(AT))).drop(
            "__coarse", "__fine", "__run"
        )
        rows, vers = cut(rows), cut(vers)
        slices = spark.createDataFrame(
            [(k, i) for k, b in bounds.items() for i in range(len(b) + 1)],
            T.StructType([T.StructField(E, events.schema[entity].dataType), T.StructField(SLICE, T.IntegerType())]),
        )
        per_slice = (
            vers.join(F.broadcast(slices.select(E).distinct()), E, "left_semi")
            .groupBy(E, SLICE)
            .agg(F.max(VER).alias(VER))
        )
        before = Window.partitionBy(E).orderBy(SLICE).rowsBetween(Window.unboundedPreceding, -1)
        left_by = (
            slices.join(per_slice, [E, SLICE], "left")
            .withColumn(VER, F.max(VER).over(before))
            .where(F.col(VER).isNotNull())
            .select(E, F.lit(None).cast(stamp).alias(AT), F.lit(0).alias(PRIO), VER, SLICE)
        )
        vers = vers.unionByName(left_by)
    else:
        rows, vers = rows.withColumn(SLICE, F.lit(0)), vers.withColumn(SLICE, F.lit(0))

    both = rows.unionByName(vers, allowMissingColumns=True)
    so_far = (
        Window.partitionBy(E, SLICE)
        .orderBy(F.col(AT).asc_nulls_first(), PRIO)
        .rowsBetween(Window.unboundedPreceding, Window.currentRow)
    )
    done = both.withColumn(VER, F.max(VER).over(so_far)).where(F.col(PRIO) == 1)
    out = done.select(*[F.col(f"{EVENT}.`{c}`").alias(c) for c in events.columns], F.col(VER).alias(into))
    bare = events.where(~ready).select(*own, F.lit(None).cast(out.schema[into].dataType).alias(into))
    return out.unionByName(bare)
