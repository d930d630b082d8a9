"""Entropy balancing: targets met, caps kept, unreachable sources told, hostile inputs."""

import os
import random

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tallyloom.llm.mixture import balance, source_key

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def sizes(spark):
    rng = random.Random(1)
    rows = []
    for i in range(4000):
        s = rng.choice(["a b", " A-B ", "big", "BIG", "big", "big", "tiny", None, "unlisted"]) if i else "tiny"
        if s == "tiny" and rng.random() < 0.9:
            s = "big"
        rows.append((i, s, rng.choice([None, 0, rng.randrange(1, 400)])))
    return spark.createDataFrame(rows, "doc_id long, source string, n_tokens long")


def test_targets_caps_and_unreachable(spark, sizes):
    targets = spark.createDataFrame([("a_b", 5.0, 4), ("big", 4.0, 1), ("tiny", 3.0, 2), ("absent", 1.0, 9), (None, 1.0, 1)], "source string, target_weight double, max_repeats long")
    m = balance(sizes, targets)
    s = {r["source"]: r for r in m.sources.collect()}
    total = sizes.selectExpr("sum(n_tokens)").first()[0]
    assert s["a_b"]["target_tokens"] == pytest.approx(total * 5 / 13)
    assert {n: r["reachable"] for n, r in s.items()} == {"a_b": True, "big": True, "tiny": False, "absent": False}
    rates = m.rates.collect()
    by = {}
    for r in rates:
        by.setdefault(r["source"], []).append(r)
    cap = {"a_b": 4, "big": 1, "tiny": 2}
    for k, rows in by.items():
        assert all(0 <= r["copies"] <= cap[k] and 0 <= r["rate"] <= cap[k] for r in rows)
    for k in ("a_b", "big"):
        assert sum(r["rate"] * r["n_tokens"] for r in by[k]) == pytest.approx(s[k]["target_tokens"], rel=1e-5)
        assert s[k]["mixed_tokens"] == pytest.approx(s[k]["target_tokens"], rel=0.01)
    assert all(r["copies"] == 2 for r in by["tiny"])


def test_unreachable_by_the_steps_as_by_capacity(spark):
    """The steps' answer is that of counting capacity, on either side of the edge, with sizes that differ widely."""
    rows = [(i, s, t) for s in ("just", "short", "even", "zero", "none") for i, t in enumerate([1, 1, 2, 50, 4000, 90_000])]
    rows = [(j, s, t) for j, (_, s, t) in enumerate(rows)]
    total = sum(t for *_, t in rows)
    own = total // 5
    caps = {"just": 3, "short": 3, "even": 2, "zero": 0, "none": 5}
    aim = {"just": 3 * own - 1, "short": 3 * own + 1, "even": 2 * own, "zero": 5, "none": 0}
    rest = 10**7
    docs = spark.createDataFrame([*rows, (99, "big", rest)], "doc_id long, source string, n_tokens long")
    size = total + rest
    aim["big"], caps["big"] = size - sum(aim.values()), 9
    targets = spark.createDataFrame([(s, float(w), caps[s]) for s, w in aim.items()], "source string, target_weight double, max_repeats long")
    m = balance(docs, targets)
    got = {r["source"]: r for r in m.sources.collect()}
    assert {s: r["reachable"] for s, r in got.items()} == {"just": True, "short": False, "even": True, "zero": False, "none": True, "big": True}
    assert all(r["reachable"] == (r["capacity_tokens"] >= aim[s]) for s, r in got.items())
    assert all(r["rate"] == 0 and r["copies"] == 0 for r in m.rates.where("source in ('none', 'zero')").collect())


def test_empty_inputs(spark, sizes):
    targets = spark.createDataFrame([("a_b", None, None), ("big", 1.0, 1)], "source string, target_weight double, max_repeats long")
    assert balance(sizes.limit(0), targets).sources.where("not reachable").count() == 0
    assert balance(sizes, targets.limit(0)).sources.count() == 0
    assert balance(sizes, targets).sources.count() == 2


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_mixture_has_every_document(spark):
    got = entry.queries()["p7_mixture"](spark, FOLDER)
    assert got.columns == ["doc_id", "source", "n_tokens", "rate", "copies"]
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    listed = {r[0] for r in spark.read.parquet(f"{FOLDER}/source_targets.parquet").where("source is not null").select(source_key(F.col("source"))).collect()}
    rows = got.collect()
    assert sorted(r["doc_id"] for r in rows) == sorted(r["doc_id"] for r in docs.select("doc_id").collect())
    assert all(r["rate"] == 0 and r["copies"] == 0 for r in rows if r["source"] not in listed)
    shares = entry.queries()["p7_shares"](spark, FOLDER).collect()
    assert sum(r["copies"] for r in rows) == sum(r["copies"] for r in shares) > 0
