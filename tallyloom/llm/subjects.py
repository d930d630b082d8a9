"""Subject areas of documents: averaged word and subword embeddings with independent logistic outputs."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bytescan import LETTER, Chars, mix, span_hash, text_slices, words64
from tallyloom.session import discard, materialize

BUCKETS = 1 << 18
GRAM = 5


@dataclass(frozen=True)
class Settings:
    """Bounds and steps of the training.

    most_labelled is the bound on labelled documents that are learnt from (chosen by
    a hash of doc_id); everything else covers all documents. held_out is the part of
    them, in percent, that sets the threshold instead. Each step takes one of about
    most_batches shares of the others, of batch_docs documents or more. Labelled
    documents are spread over a partition for every part_docs of them; gradients are
    summed by as many ranges of the embedding table as blocks.
    """

    most_labelled: int = 20_000
    dim: int = 12
    least_docs: int = 4
    steps: int = 48
    rate: float = 0.12
    batch_docs: int = 1_000
    most_batches: int = 8
    part_docs: int = 1_000
    blocks: int = 3
    held_out: int = 15
    seed: int = 7


class Words:
    """Words of a run of texts: hash, length, text they stand in; Han runs give overlapping pairs of characters."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        upper = (data >= 0x41) & (data <= 0x5A)
        data = np.where(upper, data + 32, data).astype(np.uint8)
        ch = Chars(data, offsets)
        n = len(ch.cls)
        han = np.zeros(n, bool)
        han[ch.wide] = (ch.point >= 0x3400) & (ch.point <= 0x9FFF)
        plain = (ch.cls == LETTER) & ~han
        goes_on = plain & np.r_[False, plain[:-1]] & ~ch.begin if n else plain
        first = np.flatnonzero(plain & ~goes_on)
        last = np.flatnonzero(plain & ~np.r_[goes_on[1:], False]) if n else first
        edge = np.r_[ch.pos, ch.size]
        start, end = edge[first], edge[last + 1]
        follow = np.r_[han[1:] & ~ch.begin[1:], False] if n else han
        pair = np.flatnonzero(han & follow)
        s2, e2 = edge[pair], edge[pair + 2] if len(pair) else edge[pair]
        order = np.argsort(np.r_[start, s2], kind="stable")
        self.start = np.r_[start, s2][order]
        self.length = np.r_[end, e2][order] - self.start
        self.is_plain = np.r_[np.ones(len(start), bool), np.zeros(len(s2), bool)][order]
        self.data = data
        self.doc = np.searchsorted(offsets, self.start, "right") - 1
        self.hash = span_hash(data, self.start, self.length)

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Buckets of two consecutive words, and their texts."""
        same = self.doc[1:] == self.doc[:-1]
        h = mix(self.hash[:-1] * np.uint64(3) ^ self.hash[1:])[same]
        return (h % np.uint64(BUCKETS)).astype(np.int64), self.doc[1:][same]

    def distinct(self):
        """(index of each word among the distinct ones, buckets of those, grams' owner, grams' buckets)."""
        _, first, at = np.unique(self.hash, return_index=True, return_inverse=True)
        bucket = (self.hash[first] % np.uint64(BUCKETS)).astype(np.int64)
        n = np.where(self.is_plain[first], np.maximum(self.length[first] - GRAM + 1, 0), 0)
        n[n < 2] = 0
        owner = np.repeat(np.arange(len(first)), n)
        step = np.arange(len(owner)) - np.repeat(np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n)
        at_byte = self.start[first][owner] + step
        value = words64(self.data)[at_byte] & np.uint64((1 << (8 * GRAM)) - 1)
        grams = (mix(value * np.uint64(0xD6E8FEB86659FD93) + np.uint64(11)) % np.uint64(BUCKETS)).astype(np.int64)
        return at, bucket, owner, grams


def doc_features(data: np.ndarray, offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """Buckets and weights of each text: its vector is the weighted sum of their embeddings.

    A word is the mean of itself and its grams; a text is the mean of its words plus
    the mean of its pairs of words.
    """
    w = Words(data, offsets)
    at, bucket, owner, grams = w.distinct()
    n_grams = np.bincount(owner, minlength=len(bucket))
    share = 1.0 / (1 + n_grams)
    pair, pair_doc = w.pairs()
    cuts_w = np.searchsorted(w.doc, np.arange(len(offsets)))
    cuts_p = np.searchsorted(pair_doc, np.arange(len(offsets)))
    gram_cut = np.r_[0, np.cumsum(n_grams)]
    out = []
    for d in range(len(offsets) - 1):
        words, times = np.unique(at[cuts_w[d] : cuts_w[d + 1]], return_counts=True)
        weight = times * share[words] / max(1, times.sum())
        n = n_grams[words]
        idx = np.repeat(gram_cut[words], n) + np.arange(n.sum()) - np.repeat(np.r_[0, np.cumsum(n)[:-1]] if len(n) else n, n)
        p = pair[cuts_p[d] : cuts_p[d + 1]]
        keys = np.r_[bucket[words], grams[idx], p]
        vals = np.r_[weight, np.repeat(weight, n), np.full(len(p), 1.0 / max(1, len(p)))]
        k, inv = np.unique(keys, return_inverse=True)
        out.append((k.astype(np.int32), np.bincount(inv, weights=vals, minlength=len(k)).astype(np.float32)))
    return out


@dataclass
class Rows:
    """Sparse rows of labelled texts over the active buckets, and their labels, a 0/1 row each."""

    cut: np.ndarray
    col: np.ndarray
    val: np.ndarray
    labels: np.ndarray

    def vectors(self, e: np.ndarray) -> np.ndarray:
        z = np.zeros((len(self.labels), e.shape[1]), np.float32)
        full = self.cut[1:] > self.cut[:-1]
        if full.any():
            z[full] = np.add.reduceat(e[self.col] * self.val[:, None], self.cut[:-1][full])
        return z

    def gradient(self, e: np.ndarray, w: np.ndarray, b: np.ndarray):
        """Sums over the rows: columns that occur, gradients of their embeddings, of weights and of biases."""
        z = self.vectors(e)
        p = 1 / (1 + np.exp(-np.clip(z @ w + b, -50, 50)))
        d = (p - self.labels).astype(np.float32)
        dz = d @ w.T
        row = np.repeat(np.arange(len(self.labels)), np.diff(self.cut))
        order = np.argsort(self.col, kind="stable")
        cols, first = np.unique(self.col[order], return_index=True)
        de = np.add.reduceat((dz[row] * self.val[:, None])[order], first) if len(cols) else np.zeros((0, e.shape[1]), np.float32)
        return cols, de.astype(np.float32), (z.T @ d).astype(np.float32), d.sum(0)


TRAIN = "n int, labels binary, sizes binary, keys binary, vals binary, share int"


def _features(n_subjects: int, held: int, shares: int):
    """Features of labelled texts, packed: a row holds those of one share, -1 being held out."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                got = doc_features(data, offsets)
                fold = batch.column(2).slice(a, b - a).to_numpy(zero_copy_only=False)
                marks = np.zeros((b - a, n_subjects), np.uint8)
                for i, own in enumerate(batch.column(0).slice(a, b - a).to_pylist()):
                    marks[i, own] = 1
                share = np.where(fold < held, -1, fold % shares)
                out = []
                for k in np.unique(share):
                    docs = np.flatnonzero(share == k)
                    keys, vals = (np.concatenate([got[i][j] for i in docs]) for j in (0, 1))
                    sizes = np.array([len(got[i][0]) for i in docs], np.int32)
                    out.append((len(docs), *(x.tobytes() for x in (marks[docs], sizes, keys, vals)), int(k)))
                kinds = [pa.int32(), *[pa.binary()] * 4, pa.int32()]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], ["n", "labels", "sizes", "keys", "vals", "share"]
                )

    return run


def _occurrences(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Labelled texts that each bucket occurs in, summed within the partition."""
    total = np.zeros(BUCKETS, np.int64)
    for batch in batches:
        for keys in batch.column(0).to_pylist():
            total += np.bincount(np.frombuffer(keys, np.int32), minlength=BUCKETS)
    k = np.flatnonzero(total)
    yield pa.RecordBatch.from_arrays([pa.array(k), pa.array(total[k])], ["k", "n"])


def rows_of(batches, active: np.ndarray) -> Rows | None:
    """Reads packed rows; buckets outside the active ones have no embedding."""
    sizes, cols, vals, labels = [np.zeros(1, np.int64)], [], [], []
    for batch in batches:
        for n, mark, size, keys, val in zip(*(batch.column(i).to_pylist() for i in range(5))):
            at = active[np.frombuffer(keys, np.int32)]
            keep = at >= 0
            doc = np.repeat(np.arange(n), np.frombuffer(size, np.int32))
            sizes.append(np.bincount(doc[keep], minlength=n))
            cols.append(at[keep])
            vals.append(np.frombuffer(val, np.float32)[keep])
            labels.append(np.frombuffer(mark, np.uint8).reshape(n, -1))
    if not labels:
        return None
    return Rows(np.cumsum(np.concatenate(sizes)), np.concatenate(cols), np.concatenate(vals), np.concatenate(labels).astype(np.float32))


REST = -1  #: the block of the gradients of weights and biases


def _gradients(index, shared, block_rows: int):
    """The partition's gradient, by blocks of block_rows embeddings."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, index.value)
        if rows is None:
            return
        cols, de, dw, db = rows.gradient(*shared.value)
        block = cols // block_rows
        names, first = np.unique(block, return_index=True)
        end = np.r_[first[1:], len(cols)]
        rest = np.r_[dw.ravel(), db, len(rows.labels)].astype(np.float32)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array([REST, *names.tolist()], pa.int32()),
                pa.array([b"", *((cols[a:b] % block_rows).astype(np.int32).tobytes() for a, b in zip(first, end))], pa.binary()),
                pa.array([rest.tobytes(), *(de[a:b].tobytes() for a, b in zip(first, end))], pa.binary()),
            ],
            ["block", "at", "grad"],
        )

    return run


def _summed(block_rows: int, dim: int):
    """Sums of each block over all partitions; embeddings' gradients leave as whole numbers up to 127 and a scale for each row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[int, np.ndarray] = {}
        rest = None
        for batch in batches:
            for block, at, grad in zip(*(c.to_pylist() for c in batch.columns)):
                grad = np.frombuffer(grad, np.float32)
                if block == REST:
                    rest = grad.copy() if rest is None else rest + grad
                    continue
                own = total.setdefault(block, np.zeros((block_rows, dim), np.float32))
                own[np.frombuffer(at, np.int32)] += grad.reshape(-1, dim)
        out = [] if rest is None else [(REST, b"", b"", rest.tobytes())]
        for block, own in total.items():
            most = np.abs(own).max(1)
            live = most > 0
            steps = np.rint(own[live] * (127 / most[live])[:, None]).astype(np.int8)
            out.append((block, np.packbits(live).tobytes(), steps.tobytes(), most[live].tobytes()))
        if out:
            kinds = [pa.int32(), pa.binary(), pa.binary(), pa.binary()]
            yield pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(zip(*out), kinds)], ["block", "live", "steps", "scale"])

    return run


def _logits(index, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows = rows_of(batches, index.value)
        if rows is not None:
            e, w, b = shared.value
            logit = (rows.vectors(e) @ w + b).ravel().astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(logit), pa.array(rows.labels.ravel() > 0)], ["logit", "label"])

    return run


def best_cut(logit: np.ndarray, label: np.ndarray, near: float = 0.995) -> float:
    """A logit above which the F1 measure over all pairs of document and subject is greatest.

    It is the middle of the range in which F1 comes to ``near`` of the greatest, which
    steadies it where few labels are held out. Without any label it is 0.
    """
    if not label.any():
        return 0.0
    order = np.argsort(-logit, kind="stable")
    hits = np.cumsum(label[order])
    f1 = 2 * hits / (np.arange(1, len(logit) + 1) + label.sum())
    good = np.flatnonzero(f1 >= near * f1.max())
    last = int(good[-1])
    below = logit[order[last + 1]] if last + 1 < len(logit) else logit[order[last]] - 1
    return float((logit[order[good[0]]] + below) / 2)


class Adam:
    def __init__(self, params, rate):
        self.params, self.rate, self.t = params, rate, 0
        self.m = [np.zeros_like(p) for p in params]
        self.v = [np.zeros_like(p) for p in params]

    def step(self, grads):
        self.t += 1
        for p, g, m, v in zip(self.params, grads, self.m, self.v):
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)


@dataclass
class Model:
    subjects: list[str]
    table: np.ndarray  # score of each bucket for each subject
    bias: np.ndarray
    cut: float  # logit above which a document is about a subject


def fit(docs: DataFrame, labels: DataFrame, subjects: list[str], settings: Settings = Settings()) -> Model:
    """Train on the labelled documents; the gradients of all partitions are summed in every step.

    ``labels``: doc_id, subject (blanks and case ignored; null or unknown subjects
    are left out; repeated labels count once). A label's document that does not
    exist, or whose text is null, teaches nothing. Without any label the model
    gives no document a subject.

    In a step each partition sums the gradient of its documents, the executors sum
    those of all partitions by ranges of buckets, and the driver gets the sum alone,
    a byte for each number, whatever the number of documents.
    """
    spark, s = docs.sparkSession, settings
    sc = spark.sparkContext
    key = lambda c: F.lower(F.trim(c))
    numbered = spark.createDataFrame([(x.strip().lower(), i) for i, x in enumerate(subjects)], "s string, i int")
    marked = materialize(
        labels.where("doc_id is not null and subject is not null")
        .select("doc_id", key(F.col("subject")).alias("s"))
        .join(F.broadcast(numbered), "s")  # one row per subject
        .groupBy("doc_id")
        .agg(F.collect_set("i").alias("own"))
        .orderBy(F.xxhash64("doc_id"))
        .limit(s.most_labelled),
        "p8labels",
    )
    n, held = marked.count(), s.held_out * 10
    parts = max(1, -(-n // s.part_docs))
    shares = max(1, min(s.most_batches, n * (100 - s.held_out) // 100 // s.batch_docs))
    labelled = docs.where("text is not null").select("doc_id", "text").join(F.broadcast(marked), "doc_id")  # at most most_labelled rows
    train = materialize(
        labelled.select("own", "text", F.pmod(F.xxhash64("doc_id", F.lit(3)), F.lit(1000)).cast("int").alias("fold"))
        .repartition(parts)
        .mapInArrow(_features(len(subjects), held, shares), TRAIN),
        "p8train",
        ("share",),
    )
    taught = train.where("share >= 0")
    seen = (
        taught.select("keys").mapInArrow(_occurrences, "k long, n long").groupBy("k").agg(F.sum("n").alias("n"))
        .where(F.col("n") >= s.least_docs).orderBy("k").select("k").toArrow()["k"].to_numpy()
    )  # at most BUCKETS
    active = np.full(BUCKETS, -1, np.int32)
    active[seen] = np.arange(len(seen), dtype=np.int32)
    rng = np.random.default_rng(s.seed)
    e = np.zeros((len(seen), s.dim), np.float32)  # rare buckets start without an opinion; w breaks the symmetry
    w = rng.normal(0, 1, (s.dim, len(subjects))).astype(np.float32)
    b = np.full(len(subjects), -2.0, np.float32)
    params = [e, w, b]
    adam = Adam(params, s.rate)
    index = sc.broadcast(active)
    block_rows = max(1, -(-len(seen) // s.blocks))
    for t in range(s.steps if len(seen) else 0):
        shared = sc.broadcast(tuple(params))
        own = taught.where(F.col("share") == t % shares).mapInArrow(_gradients(index, shared, block_rows), "block int, at binary, grad binary")
        spread = own.repartition(s.blocks, "block") if parts > 1 else own.coalesce(1)
        got = spread.mapInArrow(_summed(block_rows, s.dim), "block int, live binary, steps binary, scale binary").toArrow().to_pylist()
        shared.destroy()
        rest = [np.frombuffer(r["scale"], np.float32) for r in got if r["block"] == REST]
        if not rest:
            continue
        count, dw, db = rest[0][-1], rest[0][: w.size].reshape(w.shape), rest[0][w.size : -1]
        de = np.zeros_like(e)
        for r in got:
            if r["block"] != REST:
                live = np.flatnonzero(np.unpackbits(np.frombuffer(r["live"], np.uint8), count=block_rows))
                scale = np.frombuffer(r["scale"], np.float32) / 127
                de[live + r["block"] * block_rows] = np.frombuffer(r["steps"], np.int8).reshape(-1, s.dim) * scale[:, None]
        adam.step([de / count, dw / count, db / count])
    shared = sc.broadcast(tuple(params))
    got = train.where("share < 0").mapInArrow(_logits(index, shared), "logit double, label boolean").toArrow()
    shared.destroy()  # of at most held_out percent of most_labelled documents
    index.destroy()
    discard(train, marked)
    cut = best_cut(got["logit"].to_numpy(), got["label"].to_numpy())
    table = np.zeros((BUCKETS, len(subjects)), np.float32)
    table[seen] = e @ w
    return Model(subjects, table, b, cut)


def score_slice(data: np.ndarray, offsets: np.ndarray, table: np.ndarray, bias: np.ndarray) -> np.ndarray:
    """Logits of each text; a text without words has those of nothing, minus infinity."""
    n = len(offsets) - 1
    w = Words(data, offsets)
    out = np.full((n, len(bias)), -np.inf)
    if not len(w.start):
        return out
    at, bucket, owner, grams = w.distinct()
    word = table[bucket].astype(np.float64)
    if len(owner):
        has, first = np.unique(owner, return_index=True)
        word[has] += np.add.reduceat(table[grams], first)
        word /= (1 + np.bincount(owner, minlength=len(bucket)))[:, None]
    docs, first, count = np.unique(w.doc, return_index=True, return_counts=True)
    out[docs] = bias + np.add.reduceat(word[at], first) / count[:, None]
    pair, pair_doc = w.pairs()
    if len(pair):
        docs, first, count = np.unique(pair_doc, return_index=True, return_counts=True)
        out[docs] += np.add.reduceat(table[pair].astype(np.float64), first) / count[:, None]
    return out


def _score(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = shared.value
        names = np.array(model.subjects, object)
        for batch in batches:
            for a, b, data, offsets in text_slices(batch.column(1)):
                logit = score_slice(data, offsets, model.table, model.bias)
                row, col = np.nonzero(logit > model.cut)
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(a, b - a).take(pa.array(row)), pa.array(names[col], pa.string()), pa.array(1 / (1 + np.exp(-logit[row, col])))],
                    ["doc_id", "subject", "probability"],
                )

    return run


def assign_subjects(docs: DataFrame, model: Model) -> DataFrame:
    """doc_id, subject, probability of every document and each subject it is about.

    All documents are scored where they are read, whole, with every sentence. Null,
    empty and wordless texts have no subject. A subject that is only brought up takes
    up few of a text's words, so its mean stays below the threshold, which the labels
    set. Repeated documents give repeated rows.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)
    kind = docs.schema["doc_id"].dataType.simpleString()
    return docs.select("doc_id", "text").mapInArrow(
        _score(shared), f"doc_id {kind}, subject string, probability double"
    )
