"""Encoding with a byte-level BPE vocabulary, two-tier: perfect hash, then a heap over linked bytes."""

from __future__ import annotations

import heapq
import json
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tallyloom.llm.bytescan import (
    BLANK, LETTER, NONE, NUMBER, OTHER, SPACE, Chars, mix, span_hash, span_words, text_slices,
)

DEFAULT_VOCABULARY = "/opt/tokenizers/byte_bpe_50k.json"
WORDS = 4  # eight-byte words of a key; longer entries of the vocabulary go through the heap
SHIFT = 20


def byte_alphabet() -> dict[str, int]:
    """The printable stand-ins of the 256 bytes in the vocabulary's file."""
    plain = [b for b in range(256) if 0x21 <= b <= 0x7E or 0xA1 <= b <= 0xAC or 0xAE <= b]
    out = {chr(b): b for b in plain}
    rest = [b for b in range(256) if b not in set(plain)]
    out.update({chr(256 + i): b for i, b in enumerate(rest)})
    return out


class HeapBPE:
    """Merges of one pre-token: parts are a doubly linked list over bytes, candidate pairs wait in a heap."""

    def __init__(self, byte_ids: list[int], merges: dict[int, int]):
        self.byte_ids, self.merges = byte_ids, merges

    def encode(self, word: bytes) -> list[int]:
        ids = [self.byte_ids[b] for b in word]
        n = len(ids)
        if n < 2:
            return ids
        get = self.merges.get
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = []
        for i in range(n - 1):
            m = get(ids[i] << SHIFT | ids[i + 1])
            if m is not None:
                heap.append((m >> SHIFT) << 32 | i)
        heapq.heapify(heap)
        while heap:
            top = heapq.heappop(heap)
            i, rank = top & 0xFFFFFFFF, top >> 32
            j = after[i]
            if ids[i] < 0 or j >= n:
                continue
            m = get(ids[i] << SHIFT | ids[j])
            if m is None or m >> SHIFT != rank:
                continue  # a neighbour has changed since
            ids[i] = m & ((1 << SHIFT) - 1)
            ids[j] = -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                m = get(ids[i] << SHIFT | ids[k])
                if m is not None:
                    heapq.heappush(heap, (m >> SHIFT) << 32 | i)
            h = before[i]
            if h >= 0:
                m = get(ids[h] << SHIFT | ids[i])
                if m is not None:
                    heapq.heappush(heap, (m >> SHIFT) << 32 | h)
        return [x for x in ids if x >= 0]


def perfect_hash(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A minimal perfect hash of distinct 64-bit hashes by displacement: (displacements, slot of each key).

    Buckets of several keys, largest first, get the least displacement that sends
    all of them to free slots; single keys take what is left and note it directly.
    """
    n = len(hashes)
    bucket = ((hashes >> np.uint64(32)) % np.uint64(n)).astype(np.int64)
    shift = np.zeros(n, np.int64)
    taken, slot = np.zeros(n, bool), np.zeros(n, np.int64)
    order = np.argsort(bucket, kind="stable")
    keys, first, size = np.unique(bucket[order], return_index=True, return_counts=True)
    for b in np.argsort(-size, kind="stable"):
        mine = order[first[b] : first[b] + size[b]]
        if size[b] == 1:
            break
        d = 0
        while True:
            d += 1
            at = slots(hashes[mine], np.full(len(mine), d), n)
            if not taken[at].any() and len(set(at.tolist())) == len(at):
                break
        shift[keys[b]], slot[mine], taken[at] = d, at, True
    free = iter(np.flatnonzero(~taken))
    for b in np.flatnonzero(size == 1):
        at = next(free)
        slot[order[first[b]]] = at
        shift[keys[b]] = -at - 1
    return shift, slot


def slots(h: np.ndarray, d: np.ndarray, n: int) -> np.ndarray:
    return (mix(h + d.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) % np.uint64(n)).astype(np.int64)


@cache
def load_vocabulary(path: str) -> dict:
    """Arrays of the vocabulary: bounded by it, whatever the corpus; safe to broadcast."""
    model = json.load(open(path, encoding="utf-8"))["model"]
    letters, vocab = byte_alphabet(), model["vocab"]
    raw = lambda s: bytes(letters[c] for c in s)
    pairs = [m if isinstance(m, list) else m.split(" ") for m in model["merges"]]
    merges = np.array(
        [(vocab[a] << SHIFT | vocab[b], rank << SHIFT | vocab[a + b]) for rank, (a, b) in enumerate(pairs)], np.int64
    )
    byte_ids = [0] * 256
    for c, b in letters.items():
        byte_ids[b] = vocab[c]
    heap = HeapBPE(byte_ids, dict(merges.tolist()))
    entries = []
    for s, i in vocab.items():
        if all(c in letters for c in s) and (w := raw(s)) and len(w) <= 8 * WORDS and heap.encode(w) == [i]:
            entries.append((w, i))
    blob = np.frombuffer(b"".join(w for w, _ in entries) + bytes(64), np.uint8)
    length = np.array([len(w) for w, _ in entries], np.int64)
    start = np.r_[0, np.cumsum(length)[:-1]]
    shift, slot = perfect_hash(span_hash(blob, start, length))
    n = len(entries)
    words, ids, lengths = np.zeros((WORDS, n), np.uint64), np.zeros(n, np.int32), np.zeros(n, np.int64)
    for k in range(WORDS):
        words[k, slot] = span_words(blob, start, length, k)
    ids[slot], lengths[slot] = [i for _, i in entries], length
    return {"shift": shift, "words": words, "ids": ids, "lengths": lengths, "merges": merges, "byte_ids": byte_ids}


def pre_tokens(ch: Chars) -> np.ndarray:
    """Byte positions at which pre-tokens begin, by the pattern of the vocabulary.

    Letters, numbers and other characters form runs that take one space before
    them; blanks before a run form a span without the last of them; the English
    contractions 's 't 're 've 'm 'll 'd split off where a pre-token begins.
    """
    c, begin = ch.cls, ch.begin
    if not len(c):
        return np.zeros(0, np.int64)
    prev = np.r_[np.uint8(NONE), c[:-1]]
    prev[begin] = NONE
    nxt = np.r_[c[1:], np.uint8(NONE)]
    nxt[np.flatnonzero(begin[1:])] = NONE
    white = (c == SPACE) | (c == BLANK)
    prev_white = (prev == SPACE) | (prev == BLANK)
    next_solid = (nxt == LETTER) | (nxt == NUMBER) | (nxt == OTHER)
    start = np.where(white, ~prev_white | next_solid, (prev != c) & (prev != SPACE))
    quote = np.flatnonzero((ch.byte == 0x27) & start)
    if len(quote):
        n = len(c)
        at = lambda k: np.where(quote + k < n, ch.byte[np.minimum(quote + k, n - 1)], 0)
        cut = lambda k: (quote + k >= n) | begin[np.minimum(quote + k, n - 1)]
        b1, b2 = np.where(cut(1), 0, at(1)), np.where(cut(1) | cut(2), 0, at(2))
        one = np.isin(b1, [ord(x) for x in "stmd"])
        two = ((b1 == ord("r")) | (b1 == ord("v"))) & (b2 == ord("e")) | (b1 == ord("l")) & (b2 == ord("l"))
        for hit, size in ((one, 2), (two, 3)):
            q = quote[hit]
            start[q + 1] = False
            q = q[q + size < n]
            start[q + size] = True
    return ch.pos[start]


class Encoder:
    """Encodes runs of texts; remembers how missed pre-tokens of up to LONGEST bytes were split, up to a bound on them all."""

    REMEMBER, LONGEST = 500_000, 128

    def __init__(self, vocabulary: dict):
        self.v = vocabulary
        self.heap = HeapBPE(vocabulary["byte_ids"], dict(vocabulary["merges"].tolist()))
        self.seen: dict[bytes, list[int]] = {}

    def lookup(self, data, start, length) -> np.ndarray:
        """Ids of whole pre-tokens, -1 for those not in the table."""
        v, n = self.v, len(self.v["ids"])
        out = np.full(len(start), -1, np.int32)
        short = np.flatnonzero(length <= 8 * WORDS)
        s, ln = start[short], length[short]
        h = span_hash(data, s, ln)
        d = v["shift"][((h >> np.uint64(32)) % np.uint64(n)).astype(np.int64)]
        at = np.where(d < 0, -d - 1, slots(h, d, n))
        same = v["lengths"][at] == ln
        for k in range(WORDS):
            some = np.flatnonzero(same & (ln > 8 * k))
            same[some] = v["words"][k, at[some]] == span_words(data, s[some], ln[some], k)
        out[short[same]] = v["ids"][at[same]]
        return out

    def encode(self, data: np.ndarray, offsets: np.ndarray, count_only: bool = False):
        """(ids, ids per text), or (None, ids per text)."""
        ch = Chars(data, offsets)
        start = pre_tokens(ch)
        length = np.diff(np.r_[start, ch.size])
        ids = self.lookup(data, start, length)
        per = np.ones(len(start), np.int64)
        miss = np.flatnonzero(ids < 0)
        text = data.tobytes()
        if len(self.seen) > self.REMEMBER:
            self.seen.clear()
        seen, encode = self.seen, self.heap.encode
        parts = []
        for a, b in zip(start[miss].tolist(), (start[miss] + length[miss]).tolist()):
            w = text[a:b]
            got = seen.get(w)
            if got is None:
                got = encode(w)
                if len(w) <= self.LONGEST:
                    seen[w] = got
            parts.append(got)
        per[miss] = [len(p) for p in parts]
        run = np.r_[0, np.cumsum(per)]
        ends = run[np.searchsorted(start, offsets)]
        if count_only:
            return None, np.diff(ends)
        out = np.repeat(ids, per)
        if parts:
            flat = np.fromiter((x for p in parts for x in p), np.int32, int(per[miss].sum()))
            out[out < 0] = flat
        return out, np.diff(ends)


def _encode(shared, count_only: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = None
        for batch in batches:
            enc = enc or Encoder(shared.value)
            for a, b, data, offsets in text_slices(batch.column(batch.num_columns - 1)):
                ids, per = enc.encode(data, offsets, count_only)
                rest = [batch.column(i).slice(a, b - a) for i in range(batch.num_columns - 1)]
                if count_only:
                    last = pa.array(per)
                else:
                    last = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum(per)].astype(np.int32)), pa.array(ids))
                names = [*batch.schema.names[:-1], "n_tokens" if count_only else "ids"]
                yield pa.RecordBatch.from_arrays([*rest, last], names)

    return run


def _apply(docs: DataFrame, text: str, keep: list[str], vocabulary: str, count_only: bool) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(load_vocabulary(vocabulary))
    rows = docs.select(*[F.col(f"`{c}`") for c in keep], F.col(f"`{text}`").alias("__text"))
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[:-1])
    return rows.mapInArrow(_encode(shared, count_only), f"{kinds}, {'n_tokens long' if count_only else 'ids array<int>'}")


def encode_corpus(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """Token ids of each text, no special tokens; their strings are ordinary text.

    One row per input row in the columns ``keep`` and ``ids``. Null and empty text
    give the empty list. Nothing is shuffled: every text is encoded where it is
    read. Tier one looks each pre-token up, all of a slice at once, in a minimal
    perfect hash of the vocabulary and compares the bytes; only entries that the
    merges themselves lead to are in it. Tier two merges the others by a heap over
    linked bytes, which a run of n bytes passes in n log n steps.
    """
    return _apply(docs, text, list(keep), vocabulary, False)


def token_counts(
    docs: DataFrame, text: str = "text", keep: tuple[str, ...] = ("doc_id",), vocabulary: str = DEFAULT_VOCABULARY
) -> DataFrame:
    """The number of ids that encode_corpus gives, as ``n_tokens``; 0 for null and empty text."""
    return _apply(docs, text, list(keep), vocabulary, True)
