"""Quality classifier: supervised subword embeddings.

A document's features are its words, its word pairs and its character trigrams, each
hashed into one table of vectors (a pair of equal words has one bucket of its own, so
that repetition is learned as such). The vectors are averaged over the document, a
softmax layer gives the probability of label 1, and numpy stochastic gradient descent
trains both layers. As the output is linear in the average, scoring needs only each
bucket's projection on the softmax weights.

The model is fitted on a bounded sample of labelled rows (TRAIN_ROWS, those with the least
hash of doc_id, each with the text that sorts first), never on held-out ones; every
document's whole text is scored.

Defined cases: a null text is empty; an empty text gets the score of the bias alone;
without labelled rows every score is 0.5; a document labelled twice takes the smaller
label; repeated rows get equal scores; a score of exactly ACCEPT
is predicted 1; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.features import bounded_sample, char_grams, code_points, held_out, mixed, pieces, sampled_texts, word_hashes

BITS = 17
DIM = 16
TRAIN_ROWS = 3000
EPOCHS = 6
RATE = 0.5
ACCEPT = 0.3
_SAME_PAIR = np.uint64(0x5851F42D4C957F2D)


def features(points: np.ndarray) -> np.ndarray:
    """Buckets of one text's words, word pairs and character trigrams, repeats included."""
    words = word_hashes(points)
    with np.errstate(over="ignore"):
        pairs = words[:-1] * np.uint64(3) + words[1:]
    pairs[words[:-1] == words[1:]] = _SAME_PAIR
    return np.concatenate((mixed(words, 101, BITS), mixed(pairs, 211, BITS), char_grams(points, 3, BITS)))


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, how often) over a whole text."""
    found = [np.unique(features(p), return_counts=True) for p in pieces(code_points(text), 64)]
    if len(found) == 1:
        return found[0]
    buckets, at = np.unique(np.concatenate([b for b, _ in found]), return_inverse=True)
    return buckets, np.bincount(at, weights=np.concatenate([n for _, n in found])).astype(np.int64)


def train(rows: list[tuple[np.ndarray, np.ndarray, int]], seed: int = 7) -> tuple[np.ndarray, float]:
    """(projection of each bucket, bias): a text's logit is the mean projection plus the bias."""
    table = np.zeros(1 << BITS, dtype=np.float32)
    rows = [r for r in rows if len(r[0])]
    if not rows:
        return table, 0.0
    rng = np.random.default_rng(seed)
    vectors = rng.uniform(-1 / DIM, 1 / DIM, (1 << BITS, DIM)).astype(np.float32)
    weights = np.zeros((DIM, 2), dtype=np.float32)
    bias = np.log(np.bincount([y for _, _, y in rows], minlength=2).astype(np.float32) + 1)
    total = EPOCHS * len(rows)
    step = 0
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            buckets, counts, label = rows[i]
            share = (counts / counts.sum()).astype(np.float32)
            rate = RATE * (1 - step / total)
            step += 1
            hidden = share @ vectors[buckets]
            logit = hidden @ weights + bias
            p = np.exp(logit - logit.max())
            p /= p.sum()
            p[label] -= 1
            back = weights @ p
            weights -= rate * np.outer(hidden, p)
            bias -= rate * 0.1 * p
            # A mean hands each vector its share of the gradient; scaled by the number of distinct features so that long texts still learn.
            vectors[buckets] -= rate * np.outer(share * min(len(buckets), 200), back)
    return vectors @ (weights[:, 1] - weights[:, 0]), float(bias[1] - bias[0])


def score(text: str, table: np.ndarray, bias: float) -> float:
    total, n = 0.0, 0
    for p in pieces(code_points(text), 64):
        found = features(p)
        total += float(table[found].sum(dtype=np.float64))
        n += len(found)
    logit = bias + (total / n if n else 0.0)
    return float(1 / (1 + np.exp(-min(max(logit, -500.0), 500.0))))


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counted(t.as_py() or "") for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary()), batch.column(1)],
            names=["buckets", "counts", "label"],
        )


def fit(docs: DataFrame, labels: DataFrame, rows: int = TRAIN_ROWS) -> tuple[np.ndarray, float]:
    """Trains on at most so many labelled documents outside the held-out fifth."""
    known = labels.where(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id"))).groupBy("doc_id").agg(F.min("quality").cast("int").alias("label"))
    sample = bounded_sample(known, rows)
    texts = sampled_texts(docs, sample, "doc_id").select("text", "label")
    # The bounded sample is learned from in one task; the driver gets the model alone.
    found = texts.mapInArrow(_count_batches, "buckets binary, counts binary, label int").repartition(1).mapInArrow(_train_batches, "projection binary, bias double").first()
    return train([]) if found is None else (np.frombuffer(found.projection, "<f4"), found.bias)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data = [(np.frombuffer(b.as_py(), "<i4"), np.frombuffer(n.as_py(), "<i4"), y.as_py()) for batch in batches for b, n, y in zip(*batch.columns, strict=True)]
    # Rows come in any order; the order of training must not depend on it.
    data.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes(), r[2]))
    table, bias = train(data)
    yield pa.RecordBatch.from_arrays([pa.array([table.astype("<f4").tobytes()], pa.binary()), pa.array([bias], pa.float64())], names=["projection", "bias"])


def _score_batches(table: np.ndarray, bias: float):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scores = np.fromiter((score(t.as_py() or "", table, bias) for t in batch.column(1)), dtype=np.float64, count=batch.num_rows)
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(scores)], names=["doc_id", "score"])

    return run


def score_documents(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """(doc_id, held_out, score, predicted): one row per document."""
    table, bias = fit(docs, labels)
    scored = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_score_batches(table, bias), "doc_id long, score double")
    return scored.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "score", (F.col("score") >= ACCEPT).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that are predicted 1, with their columns."""
    table, bias = fit(docs, labels)
    rest = [F.col(c) for c in docs.columns]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(batch.schema.get_field_index("text"))
            yield batch.filter(pa.array([score(t.as_py() or "", table, bias) >= ACCEPT for t in texts], pa.bool_()))

    return docs.select(*rest).mapInArrow(run, docs.schema)
