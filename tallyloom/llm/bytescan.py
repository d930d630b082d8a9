"""Vectorised scanning of UTF-8 text held in Arrow buffers: character classes, spans, hashes."""

from __future__ import annotations

import unicodedata
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa

NONE, LETTER, NUMBER, SPACE, BLANK, OTHER = range(6)
#: Code points with the property White_Space other than U+0020.
WHITE = [*range(9, 14), 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]
PAD = 64
MASKS = np.array([(1 << (8 * k)) - 1 for k in range(8)] + [(1 << 64) - 1], np.uint64)
K = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93)]


@cache
def class_table() -> np.ndarray:
    out = np.full(0x110000, OTHER, np.uint8)
    for cp in range(0x110000):
        kind = unicodedata.category(chr(cp))[0]
        if kind == "L":
            out[cp] = LETTER
        elif kind == "N":
            out[cp] = NUMBER
    out[WHITE] = BLANK
    out[0x20] = SPACE
    return out


def text_slices(column: pa.Array, most_bytes: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of rows of about ``most_bytes``: first row, end row, padded bytes, offsets. Nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = column.cast(pa.large_string()).fill_null("")
    _, off, data = column.buffers()
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    a = 0
    while a < len(column):
        b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + most_bytes, "right")) - 1)
        b = min(b, len(column))
        part = raw[offsets[a] : offsets[b]]
        yield a, b, np.concatenate([part, np.zeros(PAD, np.uint8)]), offsets[a : b + 1] - offsets[a]
        a = b


class Chars:
    """Characters of a run of texts: byte position, first byte, class, and whether a text begins there."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        raw = data[:-PAD]
        self.size = len(raw)
        lead = (raw & 0xC0) != 0x80
        self.pos = np.flatnonzero(lead)
        self.byte = raw[self.pos]
        table = class_table()
        self.cls = table[self.byte]
        wide = np.flatnonzero(self.byte >= 0xC0)
        if len(wide):
            at, b = self.pos[wide], self.byte[wide].astype(np.int32)
            c1, c2, c3 = (data[at + k].astype(np.int32) & 0x3F for k in (1, 2, 3))
            cp = np.where(
                b < 0xE0,
                ((b & 0x1F) << 6) | c1,
                np.where(b < 0xF0, ((b & 0x0F) << 12) | (c1 << 6) | c2, ((b & 0x07) << 18) | (c1 << 12) | (c2 << 6) | c3),
            )
            self.cls[wide] = table[np.minimum(cp, 0x10FFFF)]
            self.wide, self.point = wide, cp
        else:
            self.wide, self.point = wide, np.zeros(0, np.int32)
        self.begin = np.zeros(len(self.pos), bool)
        starts = offsets[:-1][offsets[1:] > offsets[:-1]]
        self.begin[np.searchsorted(self.pos, starts)] = True


def words64(data: np.ndarray) -> np.ndarray:
    """The eight bytes from each position on, as one number."""
    return np.lib.stride_tricks.as_strided(data[:8].view(np.uint64), shape=(len(data) - 8,), strides=(1,))


def mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * K[1]
    h = (h ^ (h >> np.uint64(29))) * K[2]
    return h ^ (h >> np.uint64(32))


def span_words(data: np.ndarray, start: np.ndarray, length: np.ndarray, k: int) -> np.ndarray:
    """Bytes 8k to 8k + 8 of each span, zero beyond its end."""
    left = np.clip(length - 8 * k, 0, 8)
    at = np.minimum(start + 8 * k, len(data) - 9)
    return words64(data)[at] & MASKS[left]


def span_hash(data: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """64-bit hash of whole spans of any length."""
    h = mix(length.astype(np.uint64) * K[0])
    live = np.arange(len(start))
    k = 0
    while len(live):
        w = span_words(data, start[live], length[live], k)
        h[live] = mix(h[live] ^ (w * K[3]))
        k += 1
        live = live[length[live] > 8 * k]
    return h
