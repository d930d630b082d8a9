"""The general training-data operators against brute force, with nulls, ties, copies, empty tables and hot keys."""

import datetime as dt
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.operators.asof import asof_attributes
from tallyloom.operators.bitslice import batch_tables, carry_add, entity_features, numbers_of
from tallyloom.operators.heavy import heavy_keys
from tallyloom.operators.rolling import TwoStackWindow, rolling_totals
from tallyloom.operators.tree_aggregate import tree_aggregate
from tallyloom.sources.activity import cents, latest_rows

DAY0 = dt.datetime(2024, 1, 1)


def stamp(i):
    return DAY0 + dt.timedelta(minutes=i)


def test_latest_rows_ties_nulls_and_copies(spark):
    rows = [(1, "a", stamp(1)), (1, "b", stamp(2)), (1, "b", stamp(2)), (2, None, stamp(9)), (2, "x", stamp(3)), (3, "n", None), (None, "z", stamp(1))]
    df = spark.createDataFrame(rows, "id long, v string, at timestamp_ntz")
    assert {r[0]: r[1] for r in latest_rows(df, "id", "at", ["v"]).collect()} == {1: "b", 2: None, 3: "n"}


def test_cents_of_missing_amounts(spark):
    df = spark.createDataFrame([(1.005,), (None,), (float("nan"),), (float("inf"),), (-2.3,)], "a double")
    assert [r[0] for r in df.select(cents(F.col("a"))).collect()] == [100, None, None, None, -230]


def test_tree_aggregate_matches_plain_group_by(spark):
    rng = random.Random(1)
    rows = [(i, 7 if rng.random() < 0.4 else rng.choice([None, 1, 2, 3]), rng.choice([None, rng.randrange(-50, 50)])) for i in range(3000)]
    df = spark.createDataFrame(rows, "id long, k long, v long").withColumn("__tree_node_", F.lit(1))
    states = {"n": (F.lit(1).cast("long"), "sum"), "s": (F.col("v"), "sum"), "lo": (F.col("v"), "min"), "hi": (F.col("v"), "max"), "known": (F.col("v"), "count"), "mean": (F.col("v"), "mean"), "kinds": (F.col("v"), "distinct")}
    got = {r["k"]: tuple(r)[1:] for r in tree_aggregate(df, ["k"], states, ["id"], chunk_rows=64, fan_in=3).collect()}
    want = defaultdict(list)
    for _, k, v in rows:
        want[k].append(v)
    for k, vs in want.items():
        known = [v for v in vs if v is not None]
        assert got[k][:5] == (len(vs), sum(known), min(known), max(known), len(known)) and got[k][5] == pytest.approx(sum(known) / len(known))
        assert got[k][6] == pytest.approx(len(set(known)), rel=0.05)
    assert set(got) == set(want)
    assert tree_aggregate(df.limit(0), ["k"], states, ["id"]).count() == 0
    with pytest.raises(ValueError):
        tree_aggregate(df, ["k"], {"m": (F.col("v"), "median")}, ["id"])


def test_carry_add_and_batches():
    a, b = np.array([1, 7, 12, 0]), np.array([3, 1, 30, 0])
    bits = lambda x: [((x >> k) & 1).astype(np.uint8) for k in range(6)]
    s = carry_add(bits(a), bits(b))
    assert (sum(x.astype(int) << k for k, x in enumerate(s)) == a + b).all()
    n = 5000
    rng = np.random.default_rng(2)
    e, k = rng.integers(-9000, 9000, n) // 700, rng.integers(0, 3, n)
    c, t = rng.integers(-500, 500, n), rng.integers(0, 99, n)
    seen = {}
    for block, table in batch_tables(e, k, c, t):
        m = len(table.ordinals)
        cnt, tot = numbers_of(table.numbers["count"], m), numbers_of(table.numbers["plus"], m) - numbers_of(table.numbers["minus"], m)
        for kk, o, x, y, z in zip(np.repeat(table.types, table.sizes), table.ordinals, cnt, tot, table.latest):
            seen[(block << 12) + o, kk] = (x, y, z)
    for key in {(int(a), int(b)) for a, b in zip(e, k)}:
        at = (e == key[0]) & (k == key[1])
        assert seen[key] == (at.sum(), c[at].sum(), t[at].max())


def test_entity_features(spark):
    rng = random.Random(3)
    rows = []
    for _ in range(4000):
        e = 5 if rng.random() < 0.4 else rng.choice([None, -3, 0, 4095, 4096, 2**40, 77])
        rows.append((e, rng.choice([None, 1, 2, 300]), rng.choice([None, rng.randrange(-900, 900)]), rng.choice([None, stamp(rng.randrange(9999))])))
    df = spark.createDataFrame(rows, "e long, k long, v long, t timestamp_ntz").withColumn("block", F.lit("x"))
    got = {}
    for r in entity_features(df, F.col("e"), F.col("k"), F.col("v"), F.col("t"), batch_rows=300, fan_in=2, block_rows=80).collect():
        assert list(r["types"]) == sorted(r["types"])
        for k, n, s, t in zip(r["types"], r["counts"], r["totals"], r["latest"]):
            got[r["entity_id"], k] = (n, s, t)
    want = defaultdict(list)
    for e, k, v, t in rows:
        if e is not None and k is not None:
            want[e, k].append((v, t))
    assert got == {key: (len(x), sum(v or 0 for v, _ in x), max((t for _, t in x if t), default=None)) for key, x in want.items()}
    assert entity_features(df.limit(0), F.col("e"), F.col("k"), F.col("v"), F.col("t")).count() == 0


def _asof_brute(events, versions):
    out = {}
    for i, e, t in events:
        seen = [(f, k, v) for v, c, f, k in versions if None not in (c, f, k) and c == e and t and f <= t and k <= t]
        out[i] = max(seen)[2] if seen else None
    return out


@pytest.mark.parametrize("slice_rows", [10, 100_000])
def test_asof_attributes(spark, slice_rows):
    rng = random.Random(4)
    events = [(i, 1 if rng.random() < 0.3 else rng.choice([None, 2, 3, 99]), rng.choice([None, *map(stamp, range(40))])) for i in range(800)]
    versions = [(v, rng.choice([1, 1, 2, None]), rng.choice([None, *map(stamp, range(45))]), rng.choice([None, *map(stamp, range(45))])) for v in range(90)]
    versions += versions[:10]
    ev = spark.createDataFrame(events, "id long, who long, at timestamp_ntz").withColumn("effective_from", F.lit("mine"))
    ve = spark.createDataFrame(versions, "version_id long, who long, effective_from timestamp_ntz, known_at timestamp_ntz")
    out = asof_attributes(ev, ve, "who", "at", "who", "effective_from", "known_at", "version_id", slice_rows=slice_rows)
    assert out.columns == ["id", "who", "at", "effective_from", "version"]
    got = {r["id"]: r["version"] and r["version"]["version_id"] for r in out.collect()}
    assert got == _asof_brute(events, versions)
    assert asof_attributes(ev.limit(0), ve, "who", "at", "who", "effective_from", "known_at", "version_id").count() == 0
    none = asof_attributes(ev, ve.limit(0), "who", "at", "who", "effective_from", "known_at", "version_id")
    assert none.where("version is null").count() == 800
    with pytest.raises(ValueError):
        asof_attributes(ev, ve, "who", "at", "who", "effective_from", "known_at", "version_id", into="id")


def test_one_block_of_many_partials_merges_in_rounds(spark):
    """One block of 4,096 entities, met by every batch: counts stay right over three rounds of merging."""
    df = spark.range(0, 200_000, 1, 8).selectExpr("id % 4096 as e", "id % 3 as k", "id % 7 - 3 as v", "cast(null as timestamp_ntz) as t")
    out = entity_features(df, F.col("e"), F.col("k"), F.col("v"), F.col("t"), batch_rows=1_000, fan_in=4, block_rows=1)
    got = {(r["entity_id"], k): (n, s) for r in out.collect() for k, n, s in zip(r["types"], r["counts"], r["totals"])}
    assert got == {(r["e"], r["k"]): (r["n"], r["s"]) for r in df.groupBy("e", "k").agg(F.count("*").alias("n"), F.sum("v").alias("s")).collect()}


def test_entity_with_most_versions_is_cut_into_slices(spark):
    """Nine in ten versions are of an entity with few events: it is found by them, and no slice holds them all."""
    rng = random.Random(8)
    versions = [(v, 1 if rng.random() < 0.9 else 2, stamp(rng.randrange(2000)), stamp(rng.randrange(2000))) for v in range(1500)]
    events = [(i, rng.choice([1, 2]), stamp(rng.randrange(2000))) for i in range(40)]
    ev = spark.createDataFrame(events, "id long, who long, at timestamp_ntz")
    ve = spark.createDataFrame(versions, "version_id long, who long, effective_from timestamp_ntz, known_at timestamp_ntz")
    out = asof_attributes(ev, ve, "who", "at", "who", "effective_from", "known_at", "version_id", slice_rows=100)
    assert {r["id"]: r["version"] and r["version"]["version_id"] for r in out.collect()} == _asof_brute(events, versions)
    assert "__slice" in out._jdf.queryExecution().analyzed().toString()


def test_heavy_keys_are_bounded(spark):
    df = spark.range(1000).selectExpr("case when id < 400 then 1 when id < 500 then null else id end k")
    h = heavy_keys(df, "k", 10, 5)
    assert h.counts == {1: 400} and h.limit == 200


def test_two_stack_window_without_inverse():
    rng = np.random.default_rng(6)
    x = rng.integers(-9, 9, (50, 7))
    q = TwoStackWindow(8, np.iinfo(np.int64).max, np.minimum, 7)
    for d in range(50):
        assert (q.push(x[d]) == x[max(0, d - 7) : d + 1].min(0)).all()


def test_rolling_totals(spark):
    rng = random.Random(7)
    daily = {(e, d): rng.randrange(-50, 50) for e in (1, 2, 3) for d in range(-3, 70) if rng.random() < 0.3}
    df = spark.createDataFrame([(e, d, v, v) for (e, d), v in daily.items()] + [(None, 1, 5, 5)], "entity long, day int, s long, m long")
    ids = spark.createDataFrame([(1,), (2,), (9,), (None,)], "entity long")
    out = rolling_totals(df, ids, DAY0.date(), (DAY0 + dt.timedelta(days=59)).date(), (7, 30), {"s": "sum", "m": "max"}, block=1)
    got = {(r["entity"], r["day"]): (r["s_7"], r["s_30"], r["m_7"]) for r in out.collect()}
    assert set(got) == {(e, d) for e in (1, 2, 9) for d in range(60)}
    for (e, d), (s7, s30, m7) in got.items():
        v = lambda w: [daily[e, x] for x in range(max(0, d - w + 1), d + 1) if (e, x) in daily]
        assert (s7, s30) == (sum(v(7)), sum(v(30))) and m7 == max(v(7), default=None)
    few = rolling_totals(df, ids, DAY0.date(), (DAY0 + dt.timedelta(days=59)).date(), (7,), {"s": "sum"}, keep=lambda d, first, c: (d >= first + 5) & (c["s_7"] > 20))
    for r in few.collect():
        first = min(d for e, d in daily if e == r["entity"] and 0 <= d < 60)
        assert r["day"] >= first + 5 and r["s_7"] > 20
    holes = spark.createDataFrame([(1, 0, None), (1, 1, 5), (1, 3, None)], "entity long, day int, m long")
    end = (DAY0 + dt.timedelta(days=3)).date()
    least = rolling_totals(holes, ids.where("entity = 1"), DAY0.date(), end, (2,), {"m": "min"})
    assert [r["m_2"] for r in least.orderBy("day").collect()] == [None, 5, 5, None]
    assert rolling_totals(df.limit(0), ids.limit(0), DAY0.date(), DAY0.date(), (7,), {"s": "sum"}).count() == 0
