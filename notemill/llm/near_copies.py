"""Near copies: candidates by bit-sliced SimHash and by bands of least values, pairs of Jaccard index SIMILAR or more, verified exactly.

1. Every whole text gets the set of the XXH64 values of its five-word shingles and op4's
   fingerprint. Texts with equal sets and fingerprints become one node, its id the smallest
   doc_id that has them.
2. Candidates by fingerprint: op4's bit-sliced comparison in block tables (simhash_dedup)
   links the fingerprints that differ in at most 3 bits; nodes of equal ones meet.
3. Candidates by bands, for the near copies beyond 3 bits: ROWS * BANDS random permutations
   of the set give a least value each. Two texts of Jaccard index j agree in a whole band with
   probability 1 - (1 - j**ROWS)**BANDS: of pairs at 0.8 all but 6 in a million meet, above it
   still more, of those at 0.3 3 in a hundred.
4. Nodes that meet in a band or a fingerprint are linked with its least node; the components
   of these links and of those between fingerprints hold all candidates, and each node goes
   to its component once.
5. Within a component the sets are compared through an inverted index, whole sets, no
   sample. Only links that join two classes leave it. A component of more than PART members
   is dealt into parts and every pair of parts is compared in a task of its own.
6. Connected components of the verified links.

Defined cases: texts without words are copies of each other and of nothing else; a text of
fewer than five words has one shingle of all its words; rows with a null doc_id stay.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm import simhash_dedup
from notemill.llm.components import components
from notemill.session import cut

SHINGLE = 5
#: The least Jaccard index, as a fraction.
SIMILAR = (4, 5)
ROWS, BANDS = 6, 40
SEED = 42
PART = 1024
_RNG = np.random.default_rng(SEED)
_ODD = _RNG.integers(0, 1 << 64, ROWS * BANDS, dtype=np.uint64) | np.uint64(1)
_MIX = _RNG.integers(0, 1 << 64, (BANDS, ROWS), dtype=np.uint64) | np.uint64(1)


def shingles(text: bytes) -> np.ndarray:
    """The distinct shingles of a UTF-8 text as sorted numbers. bytes.lower and bytes.split act on ASCII alone."""
    words = text.lower().split()
    if not words:
        return np.empty(0, dtype=np.uint64)
    if len(words) < SHINGLE:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(SHINGLE)], strict=False))
    digest = xxhash.xxh64_intdigest
    return np.unique(np.array([digest(g, SEED) for g in grams], dtype=np.uint64))


def band_keys(found: np.ndarray) -> np.ndarray:
    """One key a band; none for an empty set."""
    if not len(found):
        return np.empty(0, dtype=np.int64)
    least = np.full(len(_ODD), np.iinfo(np.uint64).max, dtype=np.uint64)
    for at in range(0, len(found), 256):
        np.minimum(least, (found[at : at + 256, None] * _ODD).min(axis=0), out=least)
    return (least.reshape(BANDS, ROWS) * _MIX).sum(axis=1, dtype=np.uint64).view(np.int64)


def _print_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        same, keys, prints = [], [], []
        for t in batch.column(1):
            text = t.as_py() or b""
            found = shingles(text)
            same.append(xxhash.xxh3_128_digest(found.tobytes()))
            keys.append(band_keys(found))
            prints.append(simhash_dedup.fingerprint(text))
        offsets = np.concatenate(([0], np.cumsum([len(k) for k in keys]))).astype(np.int32)
        values = np.concatenate(keys) if keys else np.empty(0, dtype=np.int64)
        fps = np.array(prints, dtype=np.uint64).view(np.int64)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(same, pa.binary()), pa.array(fps), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values))], names=["doc_id", "same", "fp", "keys"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = pa.array([shingles(t.as_py() or b"").tobytes() for t in batch.column(3)], pa.binary())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], found], names=["component", "parts", "node", "found"])


def links(sets: list[np.ndarray], split: int | None = None) -> list[tuple[int, int]]:
    """Links that join the members into their classes; with split, those between members below it and others only."""
    n = len(sets)
    size = np.array([len(s) for s in sets])
    starts = np.concatenate(([0], np.cumsum(size)))
    _, word = np.unique(np.concatenate(sets), return_inverse=True)
    holders = np.repeat(np.arange(n), size)[np.argsort(word, kind="stable")]
    count = np.bincount(word)
    first = np.concatenate(([0], np.cumsum(count)))
    owner, place = np.arange(n), np.arange(n)
    out = []
    for i in range(n if split is None else split):
        open_ = (owner != owner[i]) & (place > i if split is None else place >= split)
        if not open_.any():
            continue
        own = word[starts[i] : starts[i + 1]]
        many = count[own]
        at = np.repeat(first[own] - np.concatenate(([0], np.cumsum(many)[:-1])), many) + np.arange(many.sum())
        shared = np.bincount(holders[at], minlength=n)
        # shared / (both - shared) >= a / b
        for j in np.flatnonzero(open_ & (shared * (SIMILAR[0] + SIMILAR[1]) >= SIMILAR[0] * (size + size[i]))):
            if owner[j] != owner[i]:
                out.append((i, int(j)))
                owner[owner == owner[j]] = owner[i]
    return out


def _compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of (component, pair, side, node, found), sorted by the first three, to links (a, b)."""

    def group(rows: list, out: list[tuple[int, int]]) -> None:
        split = None
        if rows[-1][0]:  # two parts against each other; a part against itself has side 0 only
            split = sum(not r[0] for r in rows)
        out.extend((rows[i][1], rows[j][1]) for i, j in links([np.frombuffer(r[2], dtype=np.uint64) for r in rows], split))

    held, of = [], None
    for batch in batches:
        out: list[tuple[int, int]] = []
        for component, pair, side, node, found in zip(*[c.to_pylist() for c in batch.columns], strict=True):
            if of != (component, pair):
                if len(held) > 1:
                    group(held, out)
                held, of = [], (component, pair)
            held.append((side, node, found))
        yield _edges(out)
    if len(held) > 1:
        out = []
        group(held, out)
        yield _edges(out)


def _edges(out: list[tuple[int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([e[k] for e in out], pa.int64()) for k in (0, 1)], names=["a", "b"])


def verified_links(texts: DataFrame, loose: DataFrame, part: int = PART) -> DataFrame:
    """texts (doc_id, text) and loose (node, component) to links (a, b) that span the classes within each component."""
    sized = loose.groupBy("component").agg(F.count("*").alias("n"))
    placed = loose.join(sized, "component").select("component", F.ceil(F.col("n") / part).cast("int").alias("parts"), F.col("node").alias("doc_id"))
    rows = texts.join(placed, "doc_id").select("component", "parts", F.col("doc_id").alias("node"), "text").distinct()
    sets = rows.mapInArrow(_set_batches, "component long, parts int, node long, found binary")
    # Parts p <= q of a component meet in pair p * parts + q; a component that is not divided has the one pair 0.
    own = F.pmod(F.xxhash64("node"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct((F.least("part", q) * F.col("parts") + F.greatest("part", q)).cast("long").alias("pair"), (F.col("part") > q).cast("int").alias("side")),
    )
    met = sets.withColumn("part", own).select("component", F.explode(pairs).alias("p"), "node", "found").select("component", "p.pair", "p.side", "node", "found")
    return met.repartition("component", "pair").sortWithinPartitions("component", "pair", "side").mapInArrow(_compare, "a long, b long").distinct()


def candidate_links(nodes: DataFrame) -> DataFrame:
    """nodes (node, fp, keys) to links (a, b) between nodes that meet by fingerprint or in a band.

    Texts without words have no keys; they are one node and meet nothing.
    """
    worded = nodes.where(F.size("keys") > 0)
    near = simhash_dedup.fingerprint_links(worded.groupBy("fp").agg(F.min("node").alias("node")))
    keyed = worded.select("node", F.explode(F.concat("keys", F.array(F.xxhash64("fp")))).alias("key"))
    least = keyed.groupBy("key").agg(F.min("node").alias("least"), F.count("*").alias("n")).where("n > 1").select("key", "least")
    met = keyed.join(least, "key").where("node <> least").select(F.col("node").alias("a"), F.col("least").alias("b"))
    return met.unionByName(near).distinct()


def classes(docs: DataFrame, part: int = PART) -> DataFrame:
    """(node, component_id): one row for each different set of shingles and fingerprint that a row with a doc_id has."""
    texts = docs.where("doc_id IS NOT NULL").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("binary").alias("text"))
    prints = texts.mapInArrow(_print_batches, "doc_id long, same binary, fp long, keys array<long>")
    nodes = cut(prints.groupBy("same", "fp", "keys").agg(F.min("doc_id").alias("node")))
    found = components(verified_links(texts, components(candidate_links(nodes)), part))
    return nodes.select("node").join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component_id"))


def keep_one(docs: DataFrame) -> DataFrame:
    """The documents that stay: of each class the one with the smallest doc_id.

    Rows with a null doc_id have no place in that order and stay.
    """
    kept = classes(docs).where("node = component_id").select(F.col("node").alias("doc_id")).distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
