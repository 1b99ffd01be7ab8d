"""Quality: naive Bayes support vectors over word-shape n-grams.

A word is a run of non-blank bytes. Its shape keeps the order of letter cases, digits
and marks, not the letters, so one model serves every language; beside it stand the
rough length and how lately the same word came before. Features are hashed n-grams
(n = 1..3) of shapes, as indicators at several levels: the n-gram occurs, and it makes
up at least 1/32, 1/8 or 1/2 of all n-grams of its size.

Each indicator is scaled by its class log-count ratio, counted by Spark over *all*
labelled training rows. A linear hinge-loss model is then fitted by dual coordinate
descent on a bounded sample of the labelled rows (``per_class`` of each class, the
least by hash). Every text is scored whole.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import add_columns, blocks, map_batches, utf8

BITS = 18
MIX = np.uint64(0x9E3779B97F4A7C15)
BASE = np.uint64(0x100000001B3)
BLOCK_BYTES = 1 << 20
SIZES = (1, 2, 3)
#: An n-gram is at level i once its count times SHARES[i] reaches the text's n-grams.
SHARES = (0, 32, 8, 2)
#: A word that came before within this many words.
NEAR = np.array([1, 4, 32])

#: Blank 0, small letter and any byte of a longer sequence 1, capital 2, digit 3, each mark its own.
KIND = np.arange(256, dtype=np.uint8) + 4
KIND[[9, 10, 11, 12, 13, 32]] = 0
KIND[97:123] = KIND[128:] = 1
KIND[65:91] = 2
KIND[48:58] = 3


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(31))) * MIX
    return x ^ (x >> np.uint64(29))


def _sums(values: np.ndarray, word: np.ndarray, n: int) -> np.ndarray:
    """Polynomial hash of the values of each word (ascending word numbers)."""
    first = np.searchsorted(word, np.arange(n))
    place = np.arange(len(word)) - first[word]
    power = np.full(int(place.max()) + 1, BASE)
    power[0] = 1
    return np.add.reduceat((values.astype(np.uint64) + np.uint64(1)) * np.multiply.accumulate(power)[place], first)


def shapes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, shape code) of every word, in order."""
    kind = KIND[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    at = np.flatnonzero(kind)
    if not len(at):
        return np.zeros(0, np.int32), np.zeros(0, np.uint64)
    new = np.ones(len(at), bool)
    new[1:] = (np.diff(at) > 1) | (row[at[1:]] != row[at[:-1]])
    word = np.cumsum(new) - 1
    n = int(word[-1]) + 1
    of = row[at[new]]
    # a run of letters of one case, or of digits, counts once
    kept = np.ones(len(at), bool)
    kept[1:] = new[1:] | (kind[at[1:]] != kind[at[:-1]]) | (kind[at[1:]] > 3)
    shape = _sums(kind[at[kept]], word[kept], n)
    length = np.bincount(word, minlength=n)
    same = _mixed(_sums(data[at], word, n)) ^ _mixed(of.astype(np.uint64))
    order = np.argsort(same, kind="stable")
    gap = np.zeros(n, np.int64)
    again = same[order[1:]] == same[order[:-1]]
    gap[order[1:][again]] = np.diff(order)[again]
    lately = np.where(gap > 0, np.searchsorted(NEAR, gap) + 1, 0)
    extra = np.log2(length).astype(np.int64) * 8 + lately
    return of, _mixed(shape + extra.astype(np.uint64) * MIX)


def buckets(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, bucket) of every indicator that is set, once each."""
    row, code = shapes(data, offsets)
    words = np.bincount(row, minlength=len(offsets) - 1) if len(row) else np.zeros(len(offsets) - 1, np.int64)
    rows, found = [], []
    joined = code
    for n in SIZES:
        if n > 1:
            joined = _mixed(joined[:-1] * BASE + code[n - 1 :])
        own = row[: len(joined)]
        inside = own == row[n - 1 :]
        keys = (own[inside].astype(np.uint64) << np.uint64(32)) | (_mixed(joined[inside] + np.uint64(n)) >> np.uint64(32))
        keys, count = np.unique(keys, return_counts=True)
        of, gram = (keys >> np.uint64(32)).astype(np.int64), keys & np.uint64(0xFFFFFFFF)
        for level, share in enumerate(SHARES):
            there = count * share >= words[of] - n + 1 if share else slice(None)
            rows.append(of[there])
            found.append((_mixed(gram[there] * np.uint64(4) + np.uint64(level)) >> np.uint64(64 - BITS)).astype(np.int64))
        if len(joined) < 2:
            break
    keys = np.unique((np.concatenate(rows) << BITS) | np.concatenate(found))
    return keys >> BITS, keys & ((1 << BITS) - 1)


def _rows(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The set buckets of each row, by blocks of rows."""
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1]
        row, bucket = buckets(data[own[0] : own[-1]], own - own[0])
        yield from np.split(bucket, np.searchsorted(row, np.arange(1, last - first)))


@dataclass
class Model:
    bucket: np.ndarray  # ascending
    weight: np.ndarray
    square: np.ndarray  # of the ratios: a row's squared length is 1 + their sum
    bias: float

    def packed(self) -> bytes:
        return pickle.dumps((self.bucket, self.weight, self.square, self.bias))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class with a set bucket, over one partition; bucket -1 counts
    the texts themselves."""
    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        for y, own in zip(batch.column(1).to_pylist(), _rows(*utf8(batch.column(0))), strict=True):
            n[y, own] += 1
            n[y, -1] += 1
    at = np.flatnonzero(n.sum(axis=0))
    bucket = np.where(at == 1 << BITS, -1, at)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "low", "high"])


def log_ratios(low: np.ndarray, high: np.ndarray, n_low: int, n_high: int, smooth: float) -> np.ndarray:
    return np.log((high + smooth) / (n_high + 2 * smooth)) - np.log((low + smooth) / (n_low + 2 * smooth))


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "quality",
    per_class: int = 2000, least_texts: int = 3, smooth: float = 1.0, cost: float = 1.0, blend: float = 0.5, epochs: int = 40,
) -> Model:
    """Learn from rows with label 0 or 1 (others are ignored); a null text is an empty
    one. ``blend`` is the share of the support vectors' own weights, the rest being
    their mean size for every feature, as naive Bayes has it. Without rows of both
    classes every score is that of the only class (0 without rows)."""
    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(key).alias("k")).where("y in (0, 1)")
    # each task hands on one row per bucket at most, so few, larger tasks
    tasks = max(64, 2 * labelled.sparkSession.sparkContext.defaultParallelism)
    counted = map_batches(rows.select("t", "y").coalesce(tasks), _counts, "bucket bigint, low bigint, high bigint")
    counted = counted.groupBy("bucket").agg(F.sum("low").alias("low"), F.sum("high").alias("high"))
    # at most 2^18 buckets by construction
    table = counted.where(f"bucket < 0 or low + high >= {int(least_texts)}").orderBy("bucket").toPandas()
    n_low, n_high = (int(table.iloc[0][c]) for c in ("low", "high")) if len(table) else (0, 0)
    if not n_low or not n_high:
        return Model(np.zeros(0, np.int64), np.zeros(0), np.zeros(0), 20.0 if n_high else -20.0)
    bucket, low, high = (table[c].to_numpy()[1:] for c in ("bucket", "low", "high"))
    ratio = log_ratios(low, high, n_low, n_high, smooth)
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))

    hashed = rows.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit(13)) / F.lit(2.0**64) + F.lit(0.5))
    chosen = F.lit(False)
    for y, n in ((0, n_low), (1, n_high)):
        chosen = chosen | ((F.col("y") == y) & (F.col("h") < 1.5 * (per_class + 50) / n))

    def known(column: pa.Array) -> dict[str, list]:
        found = (place[own] for own in _rows(*utf8(column)))
        return {"x": [f[f >= 0].astype("<i4").tobytes() for f in found]}

    sample = add_columns(hashed.where(chosen), "t", known, "x binary", keep=["y", "h"]).collect()
    sample = [r for y in (0, 1) for r in sorted((r for r in sample if r["y"] == y), key=lambda r: (r["h"], bytes(r["x"])))[:per_class]]
    xs = [np.frombuffer(r["x"], "<i4") for r in sample]
    w, bias = hinge(xs, np.array([1.0 if r["y"] else -1.0 for r in sample]), ratio, cost, epochs)
    w = blend * w + (1 - blend) * np.abs(w).mean()
    return Model(bucket, w * ratio, ratio**2, bias)


def hinge(xs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, cost: float, epochs: int) -> tuple[np.ndarray, float]:
    """min |w|^2 / 2 + sum C max(0, 1 - y (w x + b))^2 over unit-length rows x of scaled
    indicators, by dual coordinate descent; both classes weigh the same. The order of
    the coordinates is fixed, so every run gives the same model."""
    bounded = np.array([cost * len(y) / (2 * max(1, np.count_nonzero(y == s))) for s in y])
    values = [np.append(ratio[x], 1.0) for x in xs]
    values = [v / np.linalg.norm(v) for v in values]
    places = [np.append(x, len(ratio)) for x in xs]
    diagonal = np.array([1 + 1 / (2 * c) for c in bounded])
    w, alpha = np.zeros(len(ratio) + 1), np.zeros(len(xs))
    rng = np.random.default_rng(13)
    for _ in range(epochs):
        worst = 0.0
        for i in rng.permutation(len(xs)):
            at, v = places[i], values[i]
            gradient = y[i] * (w[at] @ v) - 1 + alpha[i] / (2 * bounded[i])
            new = max(0.0, alpha[i] - gradient / diagonal[i])
            if new != alpha[i]:
                worst = max(worst, abs(new - alpha[i]))
                w[at] += (new - alpha[i]) * y[i] * v
                alpha[i] = new
        if worst < 1e-4:
            break
    return w[:-1], float(w[-1])


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, np.ndarray, float]:
    return pickle.loads(packed)


def score_texts(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row. A null
    text, or one without a word, scores by the model's bias alone. Rows may repeat;
    other columns pass through."""
    packed = model.packed()

    def batch(column: pa.Array) -> dict[str, list]:
        known, weight, square, bias = _unpacked(packed)
        out = []
        for own in _rows(*utf8(column)):
            at = np.searchsorted(known, own)
            at = at[known[np.minimum(at, len(known) - 1)] == own] if len(known) else at[:0]
            out.append((weight[at].sum() + bias) / np.sqrt(1 + square[at].sum()))
        score = 1 / (1 + np.exp(-np.clip(np.array(out, np.float64), -30, 30)))
        return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

    return add_columns(df, text, batch, "score double, predicted int", keep)
