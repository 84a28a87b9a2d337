"""Language identification: sparse multinomial logistic regression on TF-IDF character n-grams.

Features are the runs of 1 to 3 code points of the lower-cased text with white space
folded, hashed into 2**BITS buckets, weighted (1 + ln tf) * idf and scaled to length 1.
Weights follow the regularised leader (FTRL-proximal) with elastic-net penalties, which
leaves most of them at exactly 0. A temperature, found by golden-section search on
documents of the sample that the weights have not seen, calibrates the probabilities.

Model and document frequencies are fitted on a bounded sample of rows with a language
(TRAIN_ROWS, those with the least hash of doc_id, each doc_id and language once with the
text that sorts first), never on held-out ones; every document's whole text is predicted.

Defined cases: a null text and one without a letter are `und` with score 0; without
learned languages everything is; a null lang is not learned from; repeated rows get equal
predictions; of languages that are equally likely the one that sorts first is predicted; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.features import bounded_sample, char_grams, code_points, held_out, pieces, sampled_texts

BITS = 15
ORDERS = (1, 2, 3)
TRAIN_ROWS = 2000
EPOCHS = 3
ALPHA, BETA, L1, L2 = 2.0, 1.0, 1e-3, 1e-4
UNKNOWN = "und"
#: A document whose language is less certain than this is rejected by the pipeline's stage.
CERTAIN = 0.3


@dataclass
class Model:
    languages: list[str]
    idf: np.ndarray
    weights: np.ndarray
    temperature: float


def counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """(bucket, how often) of the n-grams of a whole text."""
    tf = np.zeros(1 << BITS, dtype=np.int64)
    for p in pieces(code_points(" ".join(text.lower().split())), max(ORDERS) - 1):
        for n in ORDERS:
            tf += np.bincount(char_grams(p, n, BITS), minlength=1 << BITS)
    buckets = np.flatnonzero(tf)
    return buckets, tf[buckets]


def vector(buckets: np.ndarray, tf: np.ndarray, idf: np.ndarray) -> np.ndarray:
    v = (1 + np.log(tf)) * idf[buckets]
    return v / max(float(np.sqrt(v @ v)), 1e-12)


def probabilities(logits: np.ndarray, temperature: float = 1.0) -> np.ndarray:
    x = np.exp((logits - logits.max(axis=-1, keepdims=True)) / temperature)
    return x / x.sum(axis=-1, keepdims=True)


def follow_the_leader(rows: list[tuple[np.ndarray, np.ndarray, int]], classes: int, seed: int = 5) -> np.ndarray:
    """Weights (bucket, class) by FTRL-proximal: weights are formed from the sums z and n when used."""
    z = np.zeros((1 << BITS, classes))
    n = np.zeros((1 << BITS, classes))

    def weights(at) -> np.ndarray:
        near, sums = z[at], n[at]
        w = -(near - np.sign(near) * L1) / ((BETA + np.sqrt(sums)) / ALPHA + L2)
        return np.where(np.abs(near) <= L1, 0.0, w)

    rng = np.random.default_rng(seed)
    for _ in range(EPOCHS):
        for i in rng.permutation(len(rows)):
            at, v, label = rows[i]
            w = weights(at)
            p = probabilities(v @ w)
            p[label] -= 1
            g = np.outer(v, p)
            more = n[at] + g * g
            z[at] += g - (np.sqrt(more) - np.sqrt(n[at])) / ALPHA * w
            n[at] = more
    return weights(slice(None))


def best_temperature(logits: np.ndarray, labels: np.ndarray) -> float:
    """The temperature of least log loss, between 1/20 and 20."""
    if not len(labels):
        return 1.0

    def loss(log_t: float) -> float:
        p = probabilities(logits, float(np.exp(log_t)))
        return float(-np.log(p[np.arange(len(labels)), labels] + 1e-12).mean())

    lo, hi, ratio = -3.0, 3.0, (5**0.5 - 1) / 2
    for _ in range(40):
        a, b = hi - (hi - lo) * ratio, lo + (hi - lo) * ratio
        lo, hi = (lo, b) if loss(a) <= loss(b) else (a, hi)
    return float(np.exp((lo + hi) / 2))


def train(rows: list[tuple[np.ndarray, np.ndarray, str]]) -> Model | None:
    rows = [r for r in rows if len(r[0])]
    languages = sorted({y for _, _, y in rows})
    if not languages:
        return None
    seen = np.zeros(1 << BITS)
    for buckets, _, _ in rows:
        seen[buckets] += 1
    idf = np.log((1 + len(rows)) / (1 + seen)) + 1
    data = [(b, vector(b, tf, idf), languages.index(y)) for b, tf, y in rows]
    fit, rest = [r for i, r in enumerate(data) if i % 5], data[::5]
    weights = follow_the_leader(fit or data, len(languages))
    logits = np.array([v @ weights[b] for b, v, _ in rest])
    return Model(languages, idf, weights, best_temperature(logits, np.array([y for _, _, y in rest])))


def predict(text: str | None, model: Model | None) -> tuple[str, float]:
    if not text or model is None or not any(map(str.isalpha, text)):
        return UNKNOWN, 0.0
    buckets, tf = counted(text)
    p = probabilities(vector(buckets, tf, model.idf) @ model.weights[buckets], model.temperature)
    best = int(p.argmax())
    return model.languages[best], float(p[best])


def _count_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = [counted(t.as_py() or "") for t in batch.column(0)]
        yield pa.RecordBatch.from_arrays(
            [pa.array([b.astype("<i4").tobytes() for b, _ in found], pa.binary()), pa.array([n.astype("<i4").tobytes() for _, n in found], pa.binary()), batch.column(1)],
            names=["buckets", "counts", "lang"],
        )


def fit(docs: DataFrame, rows: int = TRAIN_ROWS) -> Model | None:
    """Learns from at most so many documents with a language, outside the held-out fifth."""
    known = docs.where(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out(F.col("doc_id")))
    texts = sampled_texts(docs, bounded_sample(known.select("doc_id", "lang"), rows), "doc_id", "lang").select("text", "lang")
    # The bounded sample is learned from in one task; the driver gets the model alone.
    found = texts.mapInArrow(_count_batches, "buckets binary, counts binary, lang string").repartition(1).mapInArrow(_train_batches, "languages array<string>, idf binary, weights binary, temperature double").first()
    if found is None:
        return None
    return Model(found.languages, np.frombuffer(found.idf), np.frombuffer(found.weights).reshape(1 << BITS, -1), found.temperature)


def _train_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    data = [(np.frombuffer(b.as_py(), "<i4"), np.frombuffer(n.as_py(), "<i4"), y.as_py()) for batch in batches for b, n, y in zip(*batch.columns, strict=True)]
    data.sort(key=lambda r: (len(r[0]), r[0].tobytes(), r[1].tobytes(), r[2]))
    if model := train(data):
        columns = [pa.array([model.languages]), pa.array([model.idf.tobytes()], pa.binary()), pa.array([model.weights.tobytes()], pa.binary()), pa.array([model.temperature], pa.float64())]
        yield pa.RecordBatch.from_arrays(columns, names=["languages", "idf", "weights", "temperature"])


def identify(docs: DataFrame) -> DataFrame:
    """(doc_id, held_out, lang_pred, score): one row per document."""
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), model) for t in batch.column(1)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([x for x, _ in found], pa.string()), pa.array([p for _, p in found], pa.float64())], names=["doc_id", "lang_pred", "score"])

    rows = docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(run, "doc_id long, lang_pred string, score double")
    return rows.select("doc_id", F.coalesce(held_out(F.col("doc_id")), F.lit(False)).alias("held_out"), "lang_pred", "score")


def keep_identified(docs: DataFrame, least: float = CERTAIN) -> DataFrame:
    """The documents whose language is recognised with enough certainty, with their columns."""
    model = fit(docs)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [predict(t.as_py(), model) for t in batch.column(batch.schema.get_field_index("text"))]
            yield batch.filter(pa.array([x != UNKNOWN and p >= least for x, p in found], pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
