"""Hashed text features, and bounded samples of labelled rows, for the trained operators."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Code points of a text that are turned into features at once; longer texts go in pieces that overlap.
PIECE = 1 << 20
_ODD = np.uint64(0x9E3779B97F4A7C15)


def held_out(doc_id: Column) -> Column:
    """True for the fifth of the documents that no model learns from."""
    return (F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0) & doc_id.isNotNull()


def bounded_sample(rows: DataFrame, n: int, key: str = "doc_id") -> DataFrame:
    """At most n rows, those with the least hash of the key: the same ones on every run."""
    return rows.orderBy(F.xxhash64(key), *rows.columns).limit(n)


def sampled_texts(docs: DataFrame, sample: DataFrame, *keys: str) -> DataFrame:
    """(keys, text): one row for each row of a bounded sample that docs has, with the text that sorts first, however often the keys occur."""
    met = docs.select(*keys, "text").join(F.broadcast(sample.distinct()), list(keys))
    return met.groupBy(*sample.columns).agg(F.min("text").alias("text"))


def code_points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype="<u4")


def pieces(points: np.ndarray, overlap: int) -> list[np.ndarray]:
    if len(points) <= PIECE:
        return [points]
    return [points[max(0, i - overlap) : i + PIECE] for i in range(0, len(points), PIECE)]


def mixed(x: np.ndarray, salt: int, bits: int) -> np.ndarray:
    """Buckets of 64-bit values: multiplied, folded, multiplied, and the upper bits kept."""
    with np.errstate(over="ignore"):
        x = (x + np.uint64(salt)) * _ODD
        x ^= x >> np.uint64(29)
        x *= _ODD
    return (x >> np.uint64(64 - bits)).astype(np.int64)


def char_grams(points: np.ndarray, n: int, bits: int) -> np.ndarray:
    """Buckets of all runs of n code points; each fits 21 bits, so n up to 3 is exact before hashing."""
    if len(points) < n:
        return np.empty(0, dtype=np.int64)
    wide = points.astype(np.uint64)
    x = wide[: len(wide) - n + 1].copy()
    for k in range(1, n):
        x = (x << np.uint64(21)) ^ wide[k : len(wide) - n + 1 + k]
    return mixed(x, n, bits)


def word_hashes(points: np.ndarray) -> np.ndarray:
    """A 64-bit value for each run of points above the space: a polynomial in its points."""
    inside = points > 32
    inside &= points != 0xA0
    edge = np.flatnonzero(np.diff(np.concatenate(([0], inside.view(np.int8), [0]))))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return np.empty(0, dtype=np.uint64)
    with np.errstate(over="ignore"):
        place = np.arange(len(points), dtype=np.int64)
        place -= np.repeat(np.concatenate(([0], starts[1:])), np.diff(np.concatenate(([0], starts[1:], [len(points)]))))
        # Within a word the place counts from its start; the value of a point depends on both.
        each = (points.astype(np.uint64) + np.uint64(1)) * _ODD ^ (np.clip(place, 0, None).astype(np.uint64) + np.uint64(7)) * np.uint64(0xC2B2AE3D27D4EB4F)
        each ^= each >> np.uint64(31)
        each *= _ODD
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(each, dtype=np.uint64)))
        return total[ends] - total[starts]
