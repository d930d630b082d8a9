"""Word and name lists read from public files; none is kept in the code."""

from __future__ import annotations

import base64
import json
import os
from functools import cache

#: Where the public tokenizers' files lie; a parameter of those who read them.
VOCABULARIES = "/opt/tokenizers"


@cache
def common_words(folder: str = VOCABULARIES, most: int = 1_000) -> frozenset[str]:
    """The commonest English words, by rule from two public vocabularies.

    A vocabulary of byte pairs names its pieces in the order of how often they were
    met. A lower-case piece that begins a word in byte_bpe_50k and also ends one in
    word_bpe_49k is a whole word; the first ``most`` of them by rank are taken.
    """
    begins, ends = os.path.join(folder, "byte_bpe_50k.tiktoken"), os.path.join(folder, "word_bpe_49k.json")
    if not (os.path.exists(begins) and os.path.exists(ends)):
        raise FileNotFoundError(f"no vocabularies in {folder}: give word_set, or their folder as vocabularies")
    with open(ends, encoding="utf-8") as f:
        last = {w[:-4] for w in json.load(f)["model"]["vocab"] if w.endswith("</w>")}
    ranked = []
    with open(begins, "rb") as f:
        for piece, rank in map(bytes.split, f):
            w = base64.b64decode(piece).decode("utf-8", "replace")
            if w[:1] == " " and w[1:].isascii() and w[1:].isalpha() and w[1:].islower() and w[1:] in last:
                ranked.append((int(rank), w[1:]))
    return frozenset(w for _, w in sorted(ranked)[:most])


def names(given) -> list[str]:
    """A list as given, or the lines of the text file that a text names; blank lines and those that begin with // are left out."""
    if not isinstance(given, str):
        return list(given)
    with open(given, encoding="utf-8") as f:
        lines = (line.strip() for line in f)
        return [x.lstrip(".").lower() for x in lines if x and not x.startswith("//")]
