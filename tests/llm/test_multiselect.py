"""Multi-select against sorting: ties, nulls, hot groups, several days, extreme values, empty tables."""

import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from tallyloom.llm.multiselect import build_runs, ranks, select_in_runs, select_percentiles, weighted_medians
from tallyloom.session import materialize

PERCENTS = (50, 90, 99)


@pytest.fixture(scope="module")
def rows():
    rng = random.Random(5)
    out = [(i, 1 if rng.random() < 0.5 else rng.choice([None, 2, 3, 4]), rng.choice([None, 5, rng.randrange(-40, 40), rng.randrange(10**9)])) for i in range(2500)]
    out += [(9999, 50, -(2**63)), (10000, 51, 2**63 - 1), (10001, 51, -(2**63)), (10002, 51, -(2**63))]
    return out + out[:200]


def expected(rows):
    want = defaultdict(list)
    for _, g, v in rows:
        if g is not None and v is not None:
            want[g].append(v)
    return {g: (len(v), *(sorted(v)[-(-p * len(v) // 100) - 1] for p in PERCENTS)) for g, v in want.items()}


@pytest.mark.parametrize("run_rows", [16, 65_536])
def test_percentiles_are_exact_and_mergeable(spark, rows, run_rows):
    df = spark.createDataFrame(rows, "id long, g long, v long").withColumns({"n": F.lit("x"), "vals": F.lit(1)})
    days = [build_runs(df.where(f"id % 2 = {k}"), "g", "v", "id", run_rows) for k in (0, 1)]
    for runs in (build_runs(df, "g", "v", "id", run_rows), days[0].unionByName(days[1])):
        runs = materialize(runs)
        assert runs.where(f"n > {run_rows} or n <> size(vals)").isEmpty()
        assert {r["group_id"]: tuple(r)[1:] for r in select_percentiles(runs, PERCENTS, run_rows).collect()} == expected(rows)


def test_empty_and_one_hot_group(spark):
    none = spark.createDataFrame([], "id long, g long, v long")
    assert select_percentiles(materialize(build_runs(none, "g", "v", "id")), (50,)).count() == 0
    hot = spark.range(30_000).selectExpr("id", "7L as g", "id * 7919 % 30000 as v")
    runs = materialize(build_runs(hot, "g", "v", "id", 1_000, partitions=6))
    assert runs.rdd.getNumPartitions() > 1 and runs.agg(F.max("n")).first()[0] == 1_000  # no task holds the group
    assert select_percentiles(runs, (1, 50, 100), 1_000).collect() == [(7, 30_000, 299, 14_999, 29_999)]
    same = materialize(build_runs(hot.withColumn("v", F.lit(3).cast("long")), "g", "v", "id", 1_000))
    assert select_percentiles(same, (50, 99), 1_000).collect() == [(7, 30_000, 3, 3)]


def test_rounds_inside_a_run():
    rng = np.random.default_rng(1)
    parts = [np.sort(rng.integers(-5, 5, n)) for n in (1, 2, 7, 100)] + [np.sort(rng.integers(-(2**62), 2**62, 333))]
    cut = np.r_[0, np.cumsum([len(p) for p in parts])]
    got = select_in_runs(np.concatenate(parts), cut, ranks(np.diff(cut), (1, 50, 90, 100)))
    assert got.tolist() == [[int(p[-(-q * len(p) // 100) - 1]) for q in (1, 50, 90, 100)] for p in parts]


def test_weighted_medians():
    keys, got, weight = weighted_medians(np.array([1, 1, 1, 2, 3]), np.array([10, 20, 30, 4, 9]), np.array([1, 1, 5, 3, 0]))
    assert keys.tolist() == [1, 2] and got.tolist() == [30, 4] and weight.tolist() == [7, 3]
