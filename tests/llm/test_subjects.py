"""Subjects: features against a plain version, held-out accuracy on made-up topics, hostile texts."""

import os
import random

import numpy as np
import pyarrow as pa
import pytest

from tallyloom.llm.bytescan import text_slices
from tallyloom.llm.subjects import REST, Rows, Settings, Words, _gradients, _summed, assign_subjects, best_cut, doc_features, fit, score_slice

TOPICS = {"Law": "court clause verdict notary".split(), "food": "bread cheese dough yeast".split(), "sport": "racket goal athlete match".split()}
FILL = "the part is held near another part and moved with it by hand".split()


def words_of(texts):
    for _, _, data, offsets in text_slices(pa.array(texts)):
        w = Words(data, offsets)
        return [(int(d), bytes(w.data[a : a + n]).decode()) for d, a, n in zip(w.doc, w.start, w.length)]


def test_words_of_whole_texts():
    got = words_of(["Ab cD-é1x", None, "温室和 x", "One two. Unlike a bread, this. From XQ 1999/014088 a court is known", ""])
    text = {}
    for d, w in got:
        text.setdefault(d, []).append(w)
    assert text[0] == ["ab", "cd", "é", "x"]
    assert text[2] == ["温室", "室和", "x"]
    assert text[3] == "one two unlike a bread this from xq a court is known".split()
    assert 1 not in text and 4 not in text


def test_score_is_the_weighted_sum_of_features():
    rng = np.random.default_rng(1)
    table, bias = rng.normal(size=(1 << 18, 3)).astype(np.float32), np.array([0.1, 0.2, 0.3])
    texts = ["knitting machines knit", "", "a", "温室和牲畜栏 greenhouse", None, "word " * 500]
    for _, _, data, offsets in text_slices(pa.array(texts)):
        got = score_slice(data, offsets, table, bias)
        for i, (k, v) in enumerate(doc_features(data, offsets)):
            if len(k):
                assert got[i] == pytest.approx(bias + (table[k] * v[:, None]).sum(0), rel=1e-4, abs=1e-4)
            else:
                assert np.isneginf(got[i]).all()


def test_best_cut():
    logit, label = np.arange(200.0), np.arange(200) >= 120
    assert 119 < best_cut(logit, label) < 121
    assert 1 < best_cut(np.array([1.0, 2.0, 3.0]), np.array([False, True, True])) < 3
    assert best_cut(logit, label & False) == 0.0 and best_cut(logit[:0], label[:0]) == 0.0


def test_gradients_summed_by_blocks():
    """Blocks of all partitions add up to the gradient of all rows, up to the rounding to whole numbers."""

    class Held:
        def __init__(self, value):
            self.value = value

    rng = np.random.default_rng(3)
    n, dim, subjects, rows = 50, 4, 3, 30
    e, w, b = (rng.normal(size=x).astype(np.float32) for x in ((n, dim), (dim, subjects), subjects))
    packed, keys, vals, sizes, marks = [], [], [], [], []
    for part in range(3):
        size = rng.integers(0, 6, rows).astype(np.int32)
        key = np.concatenate([np.sort(rng.choice(n, k, False)) for k in size]).astype(np.int32)
        val, mark = rng.random(len(key)).astype(np.float32), rng.integers(0, 2, (rows, subjects)).astype(np.uint8)
        cols = [pa.array([x], t) for x, t in zip((rows, *(x.tobytes() for x in (mark, size, key, val))), (pa.int32(), *[pa.binary()] * 4))]
        packed.append(pa.RecordBatch.from_arrays(cols, ["n", "labels", "sizes", "keys", "vals"]))
        for held, x in zip((keys, vals, sizes, marks), (key, val, size, mark)):
            held.append(x)
    index = Held(np.arange(n, dtype=np.int32))
    parts = [x for p in packed for x in _gradients(index, Held((e, w, b)), 20)(iter([p]))]
    (got,) = _summed(20, dim)(iter(parts))
    whole = Rows(np.r_[0, np.cumsum(np.concatenate(sizes))], np.concatenate(keys), np.concatenate(vals), np.concatenate(marks).astype(np.float32))
    cols, de, dw, db = whole.gradient(e, w, b)
    want, have = np.zeros((60, dim)), np.zeros((60, dim))
    want[cols] = de
    for r in got.to_pylist():
        if r["block"] == REST:
            assert np.allclose(np.frombuffer(r["scale"], np.float32), np.r_[dw.ravel(), db, 90], atol=1e-4)
        else:
            live = np.flatnonzero(np.unpackbits(np.frombuffer(r["live"], np.uint8), count=20)) + 20 * r["block"]
            have[live] = np.frombuffer(r["steps"], np.int8).reshape(-1, dim) * np.frombuffer(r["scale"], np.float32)[:, None] / 127
    assert np.abs(have - want).max() <= np.abs(want).max() / 200
    none = pa.RecordBatch.from_arrays([pa.array([], t) for t in (pa.int32(), *[pa.binary()] * 4)], ["n", "labels", "sizes", "keys", "vals"])
    assert list(_gradients(index, Held((e, w, b)), 20)(iter([none]))) == [] and list(_summed(20, dim)(iter([]))) == []


FOLDER = "/root/testdata/sf0.1"


@pytest.mark.skipif(not os.path.isdir(FOLDER), reason="no test tables here")
def test_held_out_labels_of_the_documents(spark):
    """A third of the labelled documents teach nothing: precision and recall on their noisy labels, in four languages, from about 660 others."""
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    labels = spark.read.parquet(f"{FOLDER}/subject_labels.parquet").selectExpr("doc_id", "lower(trim(subject)) as subject").where("subject is not null")
    names = sorted(r[0] for r in spark.read.parquet(f"{FOLDER}/subjects.parquet").select("subject").collect())
    labels = labels.where(labels.subject.isin(names)).join(docs.where("text is not null").select("doc_id"), "doc_id", "left_semi").distinct()
    tested = labels.where("pmod(hash(doc_id), 3) = 0")
    model = fit(docs, labels.where("pmod(hash(doc_id), 3) <> 0"), names)
    got = {tuple(r) for r in assign_subjects(docs.join(tested.select("doc_id").distinct(), "doc_id", "left_semi"), model).select("doc_id", "subject").collect()}
    want = {tuple(r) for r in tested.collect()}
    assert len(want) > 400
    assert len(got & want) >= 0.8 * len(got) and len(got & want) >= 0.75 * len(want), (len(got), len(want), len(got & want))


def test_held_out_accuracy_and_hostile_rows(spark):
    rng = random.Random(2)
    docs, labels, truth = [], [], {}
    for i in range(900):
        about = rng.sample(sorted(TOPICS), rng.choice([1, 1, 2]))
        text = " ".join(rng.choice(TOPICS[rng.choice(about)] if rng.random() < 0.4 else FILL) for _ in range(80))
        other = rng.choice(sorted(set(TOPICS) - set(about)))
        docs.append((i, text + f". Unlike a {rng.choice(TOPICS[other])}, it has no such thing. Done."))
        truth[i] = set(about)
        if i < 600:
            labels += [(i, s.upper() + " ") for s in about if rng.random() < 0.9]
    docs += [(9001, None), (9002, ""), (9003, "12 34"), (9004, "bread cheese " * 30_000), (0, docs[0][1])]
    labels += [(5, None), (None, "food"), (5, "astrology"), (99999, "food"), (9001, "food")]
    d = spark.createDataFrame(docs, "doc_id long, text string").selectExpr("*", "1 as subject")
    found = {}
    s = Settings(batch_docs=100, steps=48, part_docs=300)
    model = fit(d, spark.createDataFrame(labels, "doc_id long, subject string"), sorted(TOPICS), s)
    rows = assign_subjects(d, model).collect()
    for r in rows:
        found.setdefault(r["doc_id"], set()).add(r["subject"])
    right = sum(found.get(i, set()) == truth[i] for i in range(600, 900))
    assert right >= 285
    assert not {9001, 9002, 9003} & set(found) and found[9004] == {"food"}
    none = fit(d, spark.createDataFrame([], "doc_id long, subject string"), sorted(TOPICS), s)
    assert assign_subjects(d, none).count() == 0
    assert assign_subjects(d.limit(0), model).count() == 0
