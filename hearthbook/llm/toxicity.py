"""Toxicity: a character n-gram linear classifier on naive Bayes features.

Presence of hashed byte n-grams (n = 3..6, A-Z lower-cased). Each bucket has a naive
Bayes log-count ratio r between toxic and clean training texts, counted by Spark over
*all* labelled training rows. The ``features`` buckets of most weight enter a
logistic regression on presence times r, fitted on a bounded sample of the labelled
rows (``per_class`` of each class, the least by hash). Every text is scored whole.
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

from .common import LOWER, add_columns, blocks, map_batches, utf8

SIZES = (3, 4, 5, 6)
BITS = 18
MIX = np.uint32(0x9E3779B1)
BLOCK_BYTES = 1 << 20

#: What is no letter counts as one blank.
FOLD = np.where((LOWER >= 97) & (LOWER <= 122) | (LOWER >= 128), LOWER, 32).astype(np.uint32)


def buckets(data: np.ndarray, offsets: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For each n: (row, bucket) of the n-grams within a row. A blank is thought
    before and after every text."""
    n_rows = len(offsets) - 1
    size = np.diff(offsets)
    c = np.full(len(data) + 2 * n_rows, 32, np.uint32)
    row = np.repeat(np.arange(n_rows, dtype=np.int32), size + 2)
    inner = np.ones(len(c), bool)
    starts = offsets[:-1] + 2 * np.arange(n_rows)
    inner[starts] = inner[starts + size + 1] = False
    c[inner] = FOLD[data]
    code, n = c * MIX, 1
    while n < SIZES[-1]:
        code = (code[:-1] ^ (code[:-1] >> np.uint32(15))) * MIX + c[n:]
        n += 1
        if n in SIZES:
            same = row[: len(code)] == row[n - 1 :]
            mixed = (code + np.uint32(n)) * MIX
            yield row[: len(code)][same], ((mixed ^ (mixed >> np.uint32(13))) * MIX >> np.uint32(32 - BITS))[same].astype(np.int64)


def presence(data: np.ndarray, offsets: np.ndarray) -> Iterator[np.ndarray]:
    """The distinct buckets of each row."""
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        seen = np.zeros(1 << BITS, bool)
        for _, bucket in buckets(data[a:b], np.array([0, b - a])):
            seen[bucket] = True
        yield np.flatnonzero(seen)


@dataclass
class Model:
    bucket: np.ndarray
    weight: np.ndarray
    bias: float

    def packed(self) -> bytes:
        return pickle.dumps((self.bucket, self.weight, self.bias))


def _counts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts of each class in which a bucket occurs, over one partition; bucket -1
    counts the texts themselves."""
    n = np.zeros((2, (1 << BITS) + 1), np.int64)
    for batch in batches:
        data, offsets = utf8(batch.column(0))
        for y, own in zip(batch.column(1).to_pylist(), presence(data, offsets), strict=True):
            n[y, own] += 1
            n[y, -1] += 1
    at = np.flatnonzero(n.sum(axis=0))
    bucket = np.where(at == 1 << BITS, -1, at)
    yield pa.RecordBatch.from_arrays([pa.array(bucket), pa.array(n[0, at]), pa.array(n[1, at])], names=["bucket", "clean", "toxic"])


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic",
    per_class: int = 2000, features: int = 4000, least_texts: int = 3, smooth: float = 1.0, ridge: float = 1.0,
) -> Model:
    """Learn from rows with label 0 or 1 (others are ignored); a null text is an
    empty one. Without rows of both classes every score is the share of toxic rows
    (0 without rows)."""
    rows = labelled.select(F.col(text).alias("t"), F.col(label).cast("int").alias("y"), F.col(key).alias("k")).where("y in (0, 1)")
    # each task hands on one row per bucket at most, so few, larger tasks
    tasks = max(64, 2 * labelled.sparkSession.sparkContext.defaultParallelism)
    counted = map_batches(rows.select("t", "y").coalesce(tasks), _counts, "bucket bigint, clean bigint, toxic bigint")
    counted = counted.groupBy("bucket").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic"))
    # at most 2^18 buckets by construction
    table = counted.where(f"bucket < 0 or clean + toxic >= {int(least_texts)}").orderBy("bucket").toPandas()
    totals = dict(table.iloc[0]) if len(table) else {"clean": 0, "toxic": 0}
    if not totals["clean"] or not totals["toxic"]:
        share = float(totals["toxic"] > 0)
        return Model(np.zeros(0, np.int64), np.zeros(0, np.float32), 40.0 * share - 20.0)
    table = table[table["bucket"] >= 0]
    bucket, clean, toxic = (table[c].to_numpy() for c in ("bucket", "clean", "toxic"))
    p = (toxic + smooth) / (totals["toxic"] + 2 * smooth)
    q = (clean + smooth) / (totals["clean"] + 2 * smooth)
    ratio = np.log(p / q)
    # information about the class, in texts: frequent and one-sided buckets first
    gain = (toxic + clean) * np.abs(p - q) * np.abs(ratio)
    top = np.sort(np.argsort(-gain, kind="stable")[:features])
    bucket, ratio = bucket[top].astype(np.int64), ratio[top]
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))

    hashed = rows.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit(7)) / F.lit(2.0**64) + F.lit(0.5))
    chosen = F.lit(False)
    for y, name in enumerate(("clean", "toxic")):
        chosen = chosen | ((F.col("y") == y) & (F.col("h") < 1.5 * (per_class + 50) / totals[name]))

    def known(column: pa.Array) -> dict[str, list]:
        found = (place[own] for own in presence(*utf8(column)))
        return {"x": [f[f >= 0].astype("<i4").tobytes() for f in found]}

    sample = add_columns(hashed.where(chosen), "t", known, "x binary", keep=["y", "h"]).collect()
    sample = [r for y in (0, 1) for r in sorted((r for r in sample if r["y"] == y), key=lambda r: (r["h"], bytes(r["x"])))[:per_class]]
    y = np.array([r["y"] for r in sample], np.float64)
    xs = [np.frombuffer(r["x"], "<i4") for r in sample]
    w, bias = _logistic(xs, y, ratio, ridge, float(totals["toxic"]) / (totals["toxic"] + totals["clean"]))
    return Model(bucket, (w * ratio).astype(np.float32), bias)


def _logistic(xs: list[np.ndarray], y: np.ndarray, ratio: np.ndarray, ridge: float, share: float) -> tuple[np.ndarray, float]:
    """Regularised logistic regression on presence * ratio, both classes with equal
    weight, by accelerated gradient steps; the result is the same on every run."""
    row = np.repeat(np.arange(len(xs)), [len(x) for x in xs])
    col = np.concatenate(xs) if xs else np.zeros(0, np.int64)
    value = ratio[col]
    weight = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    norm = np.bincount(row, value**2, minlength=len(xs))
    step = 1 / (0.25 * (weight * (norm + 1)).sum() + ridge / len(y))
    w, b = np.zeros(len(ratio)), 0.0
    ahead_w, ahead_b, t = w.copy(), b, 1.0
    for _ in range(200):
        z = np.bincount(row, value * ahead_w[col], minlength=len(xs)) + ahead_b
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.bincount(col, value * error[row], minlength=len(ratio)) + ridge / len(y) * ahead_w
        new_w, new_b = ahead_w - step * grad, ahead_b - step * error.sum()
        t, last = (1 + np.sqrt(1 + 4 * t * t)) / 2, t
        ahead_w = new_w + (last - 1) / t * (new_w - w)
        ahead_b = new_b + (last - 1) / t * (new_b - b)
        w, b = new_w, new_b
    return w, float(b)


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> tuple[np.ndarray, np.ndarray, float]:
    bucket, weight, bias = pickle.loads(packed)
    place = np.full(1 << BITS, -1, np.int32)
    place[bucket] = np.arange(len(bucket))
    return place, weight, bias


def score_texts(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``score`` (0 to 1) and ``predicted`` (1 from 0.5 on) to every row. A null
    text scores as an empty one. Rows may repeat; other columns pass through."""
    packed = model.packed()

    def batch(column: pa.Array) -> dict[str, list]:
        place, weight, bias = _unpacked(packed)
        data, offsets = utf8(column)
        total = np.full(len(offsets) - 1, bias)
        k = max(1, len(weight))
        for first, last in blocks(offsets, BLOCK_BYTES):
            own = offsets[first : last + 1]
            found = []
            for row, bucket in buckets(data[own[0] : own[-1]], own - own[0]):
                at = place[bucket]
                hit = at >= 0
                found.append(row[hit].astype(np.int64) * k + at[hit])
            seen = np.zeros((last - first) * k, bool)
            for f in found:
                seen[f] = True
            seen = np.flatnonzero(seen)
            if len(seen):
                total[first:last] += np.bincount(seen // k, weight[seen % k], minlength=last - first)
        score = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        return {"score": score.tolist(), "predicted": (score >= 0.5).astype(int).tolist()}

    return add_columns(df, text, batch, "score double, predicted int", keep)
