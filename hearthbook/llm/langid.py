"""Language identification with a blended-spectrum string kernel.

Two texts are compared by the byte n-grams (n = 1, 2, 3) that occur in both:
k(x, y) = |X and Y| / sqrt(|X| |Y|), presence only, over the n-grams that occur in
some landmark text. Nystrom: the landmarks stand for the whole kernel matrix, and
one ridge regression per language (targets +1 and -1) is solved in their space. The
scores of a batch of texts are one product of their presence matrix with the
landmark presences folded with the regression weights.

Bounded samples, both parameters: ``per_language`` training rows and ``landmarks``
of them, the least by hash of the key within a language. Everything else - counts
and predictions - covers every row and the whole of every text.
"""

from __future__ import annotations

import pickle
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import LOWER, add_columns, blocks, text_remainder, utf8

UNKNOWN = "und"
BLOCK_BYTES = 1 << 19

#: Byte classes: the 26 letters, every byte of a longer UTF-8 sequence, and one class
#: for all other ASCII.
CLASS = np.zeros(256, np.int32)
CLASS[97:123] = np.arange(1, 27)
CLASS[128:] = np.arange(27, 155)
CLASS = CLASS[LOWER]
N_CLASSES = 155
SHIFT2, SHIFT3 = N_CLASSES, N_CLASSES + N_CLASSES**2
N_CODES = SHIFT3 + N_CLASSES**3


def grams(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(row, n-gram code) of every n-gram within a row, n = 1..3."""
    c = CLASS[data]
    row = np.repeat(np.arange(len(offsets) - 1, dtype=np.int32), np.diff(offsets))
    two = c[:-1] * N_CLASSES + c[1:]
    three = two[:-1] * N_CLASSES + c[2:]
    in2, in3 = row[:-1] == row[1:], row[:-2] == row[2:]
    return (
        np.concatenate([row, row[:-1][in2], row[:-2][in3]]),
        np.concatenate([c, two[in2] + SHIFT2, three[in3] + SHIFT3]),
    )


def has_letter(raw: bytes) -> bool:
    if any(97 <= x | 32 <= 122 for x in raw[:64]):
        return True
    return any(ch.isalpha() for ch in raw.decode("utf-8", "replace"))


@dataclass
class Model:
    languages: list[str]
    codes: np.ndarray  # n-grams of the landmarks, ascending
    weights: np.ndarray  # n-gram x language

    def packed(self) -> bytes:
        return pickle.dumps((self.languages, self.codes, self.weights))


@lru_cache(maxsize=2)
def _unpacked(packed: bytes) -> tuple[list[str], np.ndarray, np.ndarray]:
    languages, codes, weights = pickle.loads(packed)
    place = np.full(N_CODES, len(codes), np.int32)  # the last column is for n-grams of no landmark
    place[codes] = np.arange(len(codes), dtype=np.int32)
    return languages, place, weights


def fit(
    labelled: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang",
    per_language: int = 300, landmarks: int = 64, ridge: float = 0.1,
) -> Model:
    """Learn from the rows whose language and text are not null. With no such row
    the model knows no language; with one it always predicts that one. Languages are
    few values by nature: one count of each comes to the driver."""
    labelled = labelled.select(F.col(key).alias("k"), F.col(text).alias("t"), F.col(lang).alias("l")).where("l is not null and t is not null")
    labelled = labelled.withColumn("h", F.xxhash64(F.col("k").cast("string"), F.lit(9)) / F.lit(2.0**64) + F.lit(0.5))
    counts = {r["l"]: r["count"] for r in labelled.groupBy("l").count().collect()}
    if not counts:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0), np.float32))
    # about twice the bound passes by hash; the driver keeps the least
    chosen = F.lit(False)
    for value, n in counts.items():
        chosen = chosen | ((F.col("l") == value) & (F.col("h") < 2.0 * (per_language + 20) / n))
    sample = add_columns(labelled.where(chosen), "t", _presence, "codes binary", keep=["l", "h"]).collect()
    languages = sorted(counts)
    rows, of = [], []
    for i, value in enumerate(languages):
        own = sorted((r for r in sample if r["l"] == value), key=lambda r: (r["h"], bytes(r["codes"])))
        own = [r for r in own if len(r["codes"])][:per_language]
        rows += [np.frombuffer(r["codes"], "<i4") for r in own]
        of += [(i, j < landmarks) for j in range(len(own))]
    marks = [r for r, (_, m) in zip(rows, of, strict=True) if m]
    if not marks:
        return Model([], np.zeros(0, np.int64), np.zeros((1, 0), np.float32))
    codes = np.unique(np.concatenate(marks))

    def matrix(sets: list[np.ndarray]) -> np.ndarray:
        out = np.zeros((len(sets), len(codes)), np.float32)
        for x, own in zip(out, sets, strict=True):
            at = np.searchsorted(codes, own)
            at = at[codes[np.minimum(at, len(codes) - 1)] == own]
            x[at] = 1 / np.sqrt(max(1, len(at)))
        return out

    z = matrix(marks)
    k_train = (matrix(rows) @ z.T).astype(np.float64)
    k_marks = (z @ z.T).astype(np.float64)
    target = np.where(np.array([i for i, _ in of])[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # rows of a rare language weigh as much as those of a common one
    share = np.bincount([i for i, _ in of], minlength=len(languages))
    weight = np.array([len(of) / (np.count_nonzero(share) * share[i]) for i, _ in of])[:, None]
    left = k_train.T @ (k_train * weight) + ridge * k_marks + 1e-6 * np.eye(len(marks))
    alpha = np.linalg.solve(left, k_train.T @ (target * weight))
    weights = np.vstack([z.T @ alpha, np.zeros((1, len(languages)))])
    return Model(languages, codes, weights.astype(np.float32))


def _presence(column: pa.Array) -> dict[str, list]:
    data, offsets = utf8(column)
    out = []
    for a, b in zip(offsets[:-1], offsets[1:], strict=True):
        _, codes = grams(data[a:b], np.array([0, b - a]))
        out.append(np.unique(codes).astype("<i4").tobytes())
    return {"codes": out}


def scores(model: tuple, data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """text x language, by blocks of texts."""
    languages, place, weights = model
    out = np.zeros((len(offsets) - 1, len(languages)), np.float32)
    for first, last in blocks(offsets, BLOCK_BYTES):
        own = offsets[first : last + 1]
        row, code = grams(data[own[0] : own[-1]], own - own[0])
        present = np.zeros((last - first, len(weights)), np.float32)
        present[row, place[code]] = 1
        present[:, -1] = 0
        size = np.sqrt(np.maximum(1, present.sum(axis=1)))
        out[first:last] = present @ weights / size[:, None]
    return out


def predict(df: DataFrame, model: Model, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Add ``lang_pred`` and ``score`` (0 to 1, from the lead of the best language
    over the second) to every row. A null text, one without a letter, or a model
    that knows no language gives ``und`` and 0. Ties go to the first language in
    order. Rows may repeat; other columns pass through."""
    packed = model.packed()

    def batch(column: pa.Array) -> dict[str, list]:
        known = _unpacked(packed)
        languages = known[0]
        data, offsets = utf8(column)
        raw = data.tobytes()
        letters = [has_letter(raw[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
        if not languages:
            return {"lang_pred": [UNKNOWN] * len(letters), "score": [0.0] * len(letters)}
        s = scores(known, data, offsets).astype(np.float64)
        best = s.argmax(axis=1)
        top = np.sort(s, axis=1)
        lead = np.clip(0.5 + (top[:, -1] - top[:, -2]) / 4, 0, 1) if len(languages) > 1 else np.ones(len(s))
        return {
            "lang_pred": [languages[i] if ok else UNKNOWN for i, ok in zip(best, letters, strict=True)],
            "score": [float(x) if ok else 0.0 for x, ok in zip(lead, letters, strict=True)],
        }

    return add_columns(df, text, batch, "lang_pred string, score double", keep)


def held_out(key: Column, divisor: int = 3, remainder: int = 1) -> Column:
    return text_remainder(key, divisor) == remainder
