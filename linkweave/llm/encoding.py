"""Token ids of a corpus by a public byte-level BPE tokenizer.

Method: a text is cut into pieces by the tokenizer's pattern. Over the pairs of neighbouring symbols of a piece
stands a segment tree of their ranks; its root gives the leftmost pair of lowest rank, which is merged, and the
two pairs around it are updated in logarithmic time, until no pair can be merged. A piece of n bytes takes
O(n log n). Workers remember the ids of short pieces, of which a language has few.

The vocabulary (under 1 MB) is read once from its file, named by a parameter, and broadcast.

Defined results: null, empty texts give an empty list; special tokens' strings are ordinary text; texts are taken
whole, of any length; lone surrogates can't occur in a Spark string; an empty table gives no rows.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

VOCABULARY = "/opt/tokenizers/byte_bpe_50k.tiktoken"
# Fixed value: the pattern by which this tokenizer cuts texts into pieces.
PATTERN = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces of up to so many characters are remembered, so many of them.
SHORT, REMEMBERED = 32, 400_000
NONE = 1 << 40


def read_vocabulary(path: str = VOCABULARY) -> bytes:
    with open(path, "rb") as f:
        return f.read()


@lru_cache(maxsize=2)
def ranks_of(vocabulary: bytes) -> dict[bytes, int]:
    return {base64.b64decode(a): int(b) for a, b in (line.split() for line in vocabulary.splitlines() if line)}


class PairTree:
    """A segment tree over the pairs of neighbouring symbols; leaves are rank and position in one number."""

    def __init__(self, keys: list[int]) -> None:
        size = 1
        while size < len(keys):
            size *= 2
        self.size = size
        self.tree = [NONE << 32] * (2 * size)
        self.tree[size : size + len(keys)] = keys
        for i in range(size - 1, 0, -1):
            a, b = self.tree[2 * i], self.tree[2 * i + 1]
            self.tree[i] = a if a <= b else b

    def least(self) -> int:
        return self.tree[1]

    def set(self, i: int, key: int) -> None:
        tree = self.tree
        i += self.size
        tree[i] = key
        i >>= 1
        while i:
            a, b = tree[2 * i], tree[2 * i + 1]
            least = a if a <= b else b
            if tree[i] == least:
                return
            tree[i] = least
            i >>= 1


def encode_piece(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of a piece: leftmost pairs of lowest rank are merged first."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    parts: list[bytes] = [piece[i : i + 1] for i in range(n)]
    if n == 1:
        return [ranks[parts[0]]]
    after = list(range(1, n + 1))
    before = list(range(-1, n - 1))

    def key(i: int) -> int:
        j = after[i]
        return (ranks.get(parts[i] + parts[j], NONE) if j < n else NONE) << 32 | i

    tree = PairTree([key(i) for i in range(n)])
    while (least := tree.least()) >> 32 != NONE:
        i = least & 0xFFFFFFFF
        j = after[i]
        parts[i] += parts[j]
        after[i] = after[j]
        if after[j] < n:
            before[after[j]] = i
        tree.set(j, NONE << 32)
        tree.set(i, key(i))
        if before[i] >= 0:
            tree.set(before[i], key(before[i]))
    out, i = [], 0
    while i < n:
        out.append(ranks[parts[i]])
        i = after[i]
    return out


class Encoder:
    """Encodes texts; one per worker process and vocabulary."""

    def __init__(self, vocabulary: bytes, pattern: str = PATTERN) -> None:
        self.ranks = ranks_of(vocabulary)
        self.find = regex.compile(pattern).findall
        self.known: dict[str, list[int]] = {}

    def __call__(self, text: str | None) -> list[int]:
        out: list[int] = []
        known, extend = self.known, out.extend
        for p in self.find(text) if text else ():
            got = known.get(p)
            if got is None:
                got = encode_piece(p.encode(), self.ranks)
                if len(p) <= SHORT:
                    if len(known) >= REMEMBERED:
                        known.clear()
                    known[p] = got
            extend(got)
        return out


@lru_cache(maxsize=2)
def encoder(vocabulary: bytes, pattern: str = PATTERN) -> Encoder:
    return Encoder(vocabulary, pattern)


def encode(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, ids`` and the columns ``keep``: the ids of every text, without special tokens."""
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            offsets, values = [0], []
            for t in b.column("_text").to_pylist():
                values += enc(t)
                offsets.append(len(values))
            ids = pa.ListArray.from_arrays(pa.array(np.array(offsets, dtype=np.int32)), pa.array(np.array(values, dtype=np.int32)))
            yield pa.RecordBatch.from_arrays([b.column(0), ids, *[b.column(c) for c in keep]], names=["id", "ids", *keep])

    source = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as _text", *[f"`{c}`" for c in keep])
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"id {types['id']}", "ids array<int>", *[f"`{c}` {types[c]}" for c in keep]]))


def count_tokens(df: DataFrame, id_col: str, text_col: str, path: str = VOCABULARY, keep: tuple[str, ...] = ()) -> DataFrame:
    """``id, tokens`` and the columns ``keep``: how many ids every text has."""
    held = df.sparkSession.sparkContext.broadcast(read_vocabulary(path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(held.value)
        for b in batches:
            n = pa.array([len(enc(t)) for t in b.column("_text").to_pylist()], type=pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), n, *[b.column(c) for c in keep]], names=["id", "tokens", *keep])

    source = df.selectExpr(f"`{id_col}` as id", f"`{text_col}` as _text", *[f"`{c}`" for c in keep])
    types = dict(source.dtypes)
    return source.mapInArrow(run, ", ".join([f"id {types['id']}", "tokens long", *[f"`{c}` {types[c]}" for c in keep]]))
