"""Near-duplicate classes from SimHash fingerprints, compared bit-sliced.

1. Every whole text gets a 64-bit fingerprint: the XXH64 values of its three-word
   shingles vote on each bit, repeats included.
2. Equal fingerprints become one node, its id the smallest doc_id that has it.
3. The 64 bits fall into BLOCKS blocks. Two fingerprints that differ in at most RADIUS
   bits agree in at least BLOCKS - RADIUS whole blocks, so every choice of that many
   blocks makes a table whose key holds their bits, and each linked pair meets in one.
4. Within a bucket the fingerprints are stored as vertical bit planes. One fingerprint is
   compared with all others at once: each plane that differs is added into carry-save
   counters, started so that they overflow just beyond the radius; when all members
   have overflowed the bucket is abandoned for this fingerprint. Only links that join
   two classes of the bucket leave it, so a bucket of m members gives at most m - 1.
   A bucket of more than BUCKET members is dealt into parts and every pair of parts is
   compared in a task of its own, so nothing is dropped and no task's memory grows.
5. Connected components of the links, carried back to all documents.

Defined cases: a null text, an empty text and one of white space only have fingerprint 0;
a null doc_id gets its class like any other row, and a class with no doc_id at all has a
null component; repeated rows are in one class; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.llm.components import components
from notemill.session import cut

BITS = 64
SHINGLE = 3
SEED = 42
RADIUS = 3
BLOCKS = 5
BUCKET = 2048


def fingerprint(text: bytes, shingle: int = SHINGLE) -> int:
    """The fingerprint of a UTF-8 text. bytes.lower and bytes.split act on ASCII alone."""
    words = text.lower().split()
    if not words:
        return 0
    if len(words) < shingle:
        grams = [b" ".join(words)]
    else:
        grams = map(b" ".join, zip(*[words[i:] for i in range(shingle)], strict=False))
    digest = xxhash.xxh64_intdigest
    hashes = np.array([digest(g, SEED) for g in grams], dtype="<u8")
    votes = np.zeros(BITS, dtype=np.int64)
    for at in range(0, len(hashes), 1 << 16):
        some = hashes[at : at + (1 << 16)]
        votes += np.unpackbits(some.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(votes * 2 > len(hashes), bitorder="little").view("<u8")[0])


def _fingerprint_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        found = np.fromiter((fingerprint(t.as_py() or b"") for t in batch.column(1)), dtype=np.uint64, count=batch.num_rows)
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found.view(np.int64))], names=["doc_id", "fp"])


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id long, fp long): the fingerprint's bits as a signed number."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("binary").alias("text")).mapInArrow(_fingerprint_batches, "doc_id long, fp long")


def block_bounds(blocks: int, bits: int = BITS) -> list[tuple[int, int]]:
    """(first bit, width) of each block."""
    cuts = [bits * i // blocks for i in range(blocks + 1)]
    return [(a, b - a) for a, b in zip(cuts, cuts[1:], strict=False)]


def table_keys(fp, radius: int, blocks: int):
    """array<long>: the bucket keys of a fingerprint, one for each choice of blocks."""
    bounds, keys = block_bounds(blocks), []
    for table, chosen in enumerate(combinations(range(blocks), blocks - radius)):
        key = F.lit(table).cast("long")
        for b in chosen:
            start, width = bounds[b]
            key = F.shiftleft(key, width).bitwiseOR(F.shiftrightunsigned(fp, start).bitwiseAND(F.lit((1 << width) - 1)))
        keys.append(key)
    return F.array(*keys)


def planes_of(fps: np.ndarray) -> list[int]:
    """Bit plane b as an integer: its bit i is bit b of fingerprint i."""
    bits = np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
    return [int.from_bytes(np.packbits(bits[:, b], bitorder="little").tobytes(), "little") for b in range(BITS)]


def near(planes: list[int], fp: int, alive: int, radius: int, every: int = 8) -> int:
    """Members of alive, as bits, that differ from fp in at most radius bits."""
    width = max(1, radius.bit_length())
    ahead = (1 << width) - 1 - radius
    counters = [alive if ahead >> k & 1 else 0 for k in range(width)]
    for b, plane in enumerate(planes):
        carry = (plane ^ alive if fp >> b & 1 else plane) & alive
        for k in range(width):
            counters[k], carry = counters[k] ^ carry, counters[k] & carry
        if carry:
            alive &= ~carry
            counters = [c & alive for c in counters]
        if b % every == every - 1 and not alive:
            break
    return alive


def links(fps: np.ndarray, radius: int, split: int | None = None) -> list[tuple[int, int]]:
    """Links that join the members into their classes; with split, those between members below it and others only."""
    n = len(fps)
    planes = planes_of(fps)
    full = (1 << n) - 1
    owner = list(range(n))
    members = {i: 1 << i for i in range(n)}
    out = []
    for i in range(n if split is None else split):
        alive = full >> (i + 1) << (i + 1) if split is None else full >> split << split
        alive &= ~members[owner[i]]
        found = near(planes, int(fps[i]), alive, radius)
        while found:
            j = (found & -found).bit_length() - 1
            out.append((i, j))
            a, b = owner[i], owner[j]
            if members[a].bit_count() < members[b].bit_count():
                a, b = b, a
            rest = members.pop(b)
            members[a] |= rest
            while rest:
                k = rest & -rest
                owner[k.bit_length() - 1] = a
                rest ^= k
            found &= ~members[a]
    return out


def _compare_buckets(radius: int):
    """Batches of (key, pair, side, fp, node), sorted by key and pair, to links (a, b)."""

    def bucket(cols: list[np.ndarray], lo: int, hi: int, out: list[np.ndarray]) -> None:
        side, fps, nodes = (c[lo:hi] for c in cols[2:])
        split = None
        if side[-1]:  # two parts against each other; a part against itself has side 0 only
            split = int(np.searchsorted(side, 1))
        found = links(fps.view(np.uint64), radius, split)
        if found:
            out.append(nodes[np.array(found)])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = None
        for batch in batches:
            cols = [c.to_numpy(zero_copy_only=False) for c in batch.columns]
            if held is not None:
                cols = [np.concatenate(x) for x in zip(held, cols, strict=True)]
            edges = np.flatnonzero((np.diff(cols[0]) != 0) | (np.diff(cols[1]) != 0)) + 1
            bounds = [0, *edges.tolist()]
            held = [c[bounds[-1] :] for c in cols]
            out: list[np.ndarray] = []
            for lo, hi in zip(bounds, bounds[1:], strict=False):
                bucket(cols, lo, hi, out)
            yield _edges(out)
        if held is not None and len(held[0]):
            out = []
            bucket(held, 0, len(held[0]), out)
            yield _edges(out)

    return run


def _edges(out: list[np.ndarray]) -> pa.RecordBatch:
    both = np.concatenate(out) if out else np.zeros((0, 2), dtype=np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.ascontiguousarray(both[:, 0])), pa.array(np.ascontiguousarray(both[:, 1]))], names=["a", "b"])


def fingerprint_links(nodes: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS, bucket: int = BUCKET) -> DataFrame:
    """nodes (fp long, all different; node long) to links (a long, b long) that span the classes of the radius."""
    keyed = nodes.select("fp", "node", F.explode(table_keys(F.col("fp"), radius, blocks)).alias("key"))
    shared = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    # Parts p <= q of a bucket meet in pair p * parts + q; a bucket that is not divided has the one pair 0.
    parts = F.ceil(F.col("n") / bucket).cast("int")
    part = F.pmod(F.xxhash64("fp"), F.col("parts")).cast("int")
    pairs = F.transform(
        F.sequence(F.lit(0), F.col("parts") - 1),
        lambda q: F.struct((F.least("part", q) * F.col("parts") + F.greatest("part", q)).alias("pair"), (F.col("part") > q).cast("int").alias("side")),
    )
    met = (
        keyed.join(shared, "key")
        .withColumn("parts", parts)
        .withColumn("part", part)
        .select("key", F.explode(pairs).alias("p"), "fp", "node")
        .select("key", F.col("p.pair").alias("pair"), F.col("p.side").alias("side"), "fp", "node")
    )
    return met.repartition("key", "pair").sortWithinPartitions("key", "pair", "side").mapInArrow(_compare_buckets(radius), "a long, b long").distinct()


def dedup_documents(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(doc_id, fingerprint, component_id): one row per document."""
    prints = cut(fingerprints(docs))
    nodes = prints.groupBy("fp").agg(F.min("doc_id").alias("node"))
    found = components(fingerprint_links(nodes.where("node IS NOT NULL"), radius))
    classes = nodes.join(found, "node", "left").select("fp", F.coalesce("component", "node").alias("component_id"))
    out = prints.join(classes, "fp")
    return out.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def keep_one(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """The documents that stay: of each class the one with the smallest doc_id.

    Rows with a null doc_id have no place in that order and stay.
    """
    kept = dedup_documents(docs, radius).where("doc_id = component_id").select("doc_id").distinct()
    return docs.join(kept, "doc_id", "left_semi").unionByName(docs.where("doc_id IS NULL"))
