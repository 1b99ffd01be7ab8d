"""Byte-level BPE by the ranks of a public vocabulary file.

Each match of the splitting pattern is encoded by itself. A segment tree over its
byte positions holds, for each live position, the rank of the pair that starts there;
the root is the leftmost pair of least rank. A merge is three point updates: the
merged part, the part it swallowed, and the live neighbour before it. A piece of n
bytes costs O(n log n), so one endless word is no trap. Up to ``SHORT`` bytes, where
building the tree is most of the work, a list of the pairs' ranks is searched instead.

Texts are read where they lie: no shuffle, one batch in memory, and a table of the
short pieces a worker has met (at most ``CACHED`` entries) in front of the tree.
"""

from __future__ import annotations

import base64
from collections.abc import Callable
from functools import lru_cache
from hashlib import sha256
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame

from .common import add_columns

CACHED = 300_000
CACHED_LENGTH = 40
SHORT = 64
NONE = 1 << 62
LOW = (1 << 32) - 1


def merge_short(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece, whose pairs are looked over anew for every merge: the square
    of its bytes, but for a word less than a tree takes to be built."""
    n = len(piece)
    rank, cut = ranks.get, list(range(n + 1))  # where the parts begin, and the end
    pairs = [rank(piece[i : i + 2], NONE) for i in range(n - 1)]
    while pairs and (least := min(pairs)) != NONE:
        i = pairs.index(least)
        del pairs[i], cut[i + 1]
        if i < len(pairs):
            pairs[i] = rank(piece[cut[i] : cut[i + 2]], NONE)
        if i:
            pairs[i - 1] = rank(piece[cut[i - 1] : cut[i + 1]], NONE)
    return [ranks[piece[a:b]] for a, b in pairwise(cut)]


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """The ids of one piece."""
    if piece in ranks:
        return [ranks[piece]]
    n = len(piece)
    if n <= SHORT:
        return merge_short(piece, ranks)
    size = 1 << (n - 1).bit_length()
    after, before = list(range(1, n + 1)), list(range(-1, n - 1))
    tree = [NONE] * (2 * size)
    rank = ranks.get
    for i in range(n - 1):
        r = rank(piece[i : i + 2])
        if r is not None:
            tree[size + i] = r << 32 | i
    for i in range(size - 1, 0, -1):
        tree[i] = min(tree[2 * i], tree[2 * i + 1])

    def put(i: int, r: int | None) -> None:
        node = size + i
        tree[node] = NONE if r is None else r << 32 | i
        node >>= 1
        while node:
            least = min(tree[2 * node], tree[2 * node + 1])
            if tree[node] == least:
                break
            tree[node] = least
            node >>= 1

    while tree[1] != NONE:
        i = tree[1] & LOW
        gone = after[i]
        end = after[i] = after[gone]
        put(gone, None)
        if end < n:
            before[end] = i
            put(i, rank(piece[i : after[end]]))
        else:
            put(i, None)
        if before[i] >= 0:
            put(before[i], rank(piece[before[i] : end]))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : after[i]]])
        i = after[i]
    return ids


class Codec:
    """Encoder and decoder for one vocabulary file, kept by a worker."""

    def __init__(self, path: str, pattern: str):
        with open(path, "rb") as lines:
            self.ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.vocabulary = {i: token for token, i in self.ranks.items()}
        self.pieces = regex.compile(pattern).findall
        self.known: dict[str, bytes] = {}

    def _new(self, piece: str) -> bytes:
        out = np.array(merge(piece.encode(), self.ranks), "<u4").tobytes()
        if len(piece) <= CACHED_LENGTH:
            if len(self.known) >= CACHED:
                self.known.clear()
            self.known[piece] = out
        return out

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        known, new = self.known.get, self._new
        return b"".join([known(p) or new(p) for p in self.pieces(text)])

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.vocabulary.__getitem__, np.frombuffer(ids, "<u4").tolist()))


@lru_cache(maxsize=2)
def codec(path: str, pattern: str) -> Codec:
    return Codec(path, pattern)


def texts_of(column: pa.Array):
    """Python texts one by one; null is empty, bytes that are no UTF-8 become U+FFFD."""
    for value in column.cast(pa.binary()):
        raw = value.as_py()
        yield raw.decode("utf-8", "replace") if raw else ""


def _apply(df: DataFrame, text: str, added: str, one: Callable, keep, path: str, pattern: str) -> DataFrame:
    def batch(column: pa.Array) -> dict[str, list]:
        own = codec(path, pattern)
        rows = [one(own, t) for t in texts_of(column)]
        return {name: [r[name] for r in rows] for name in (rows[0] if rows else ())}

    return add_columns(df, text, batch, added, keep)


def encode_texts(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``ids`` (binary, little-endian unsigned 32-bit) and ``n_tokens`` to every
    row. Null and empty texts have no ids. Rows are neither joined nor merged, so
    repeated rows and any other column stay as they are."""

    def one(own: Codec, t: str) -> dict:
        ids = own.encode(t)
        return {"ids": ids, "n_tokens": len(ids) // 4}

    return _apply(df, text, "ids binary, n_tokens bigint", one, keep, path, pattern)


def decode_ids(df: DataFrame, path: str, pattern: str, ids: str = "ids", keep: list[str] | None = None) -> DataFrame:
    """Add ``decoded`` (binary) to every row of encoded ids; null ids decode to
    nothing."""

    def batch(column: pa.Array) -> dict[str, list]:
        own = codec(path, pattern)
        return {"decoded": [own.decode(v.as_py() or b"") for v in column]}

    return add_columns(df, ids, batch, "decoded binary", keep)


def round_trip(df: DataFrame, path: str, pattern: str, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Encode and decode in one pass and keep digests only: ``n_tokens``,
    ``ids_sha256`` and ``decoded_sha256`` (lower-case hex)."""

    def one(own: Codec, t: str) -> dict:
        ids = own.encode(t)
        return {
            "n_tokens": len(ids) // 4,
            "ids_sha256": sha256(ids).hexdigest(),
            "decoded_sha256": sha256(own.decode(ids)).hexdigest(),
        }

    return _apply(df, text, "n_tokens bigint, ids_sha256 string, decoded_sha256 string", one, keep, path, pattern)
