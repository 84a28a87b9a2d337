"""An exact vector index as a table: upsert, delete, lookup, top-k search, retrieval for questions."""

from __future__ import annotations

import heapq
from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Vectors of an index that a task compares at once.
BLOCK = 8192


def dot(a: Column, b: Column) -> Column:
    """Inner product in double precision, summed from the first component on."""
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def norm(a: Column) -> Column:
    return F.sqrt(dot(a, a))


def cosine(a: Column, b: Column) -> Column:
    """0 if a norm is 0; vectors of different lengths are an error."""
    same = F.when(F.size(a) == F.size(b), True).otherwise(F.raise_error(F.lit("the vectors differ in length")).cast("boolean"))
    return F.when(same & ((norm(a) == 0) | (norm(b) == 0)), 0.0).otherwise(dot(a, b) / (norm(a) * norm(b)))


def unit(a: Column) -> Column:
    """A vector of length 1; a zero vector stays."""
    return F.when(norm(a) > 0, F.transform(a, lambda x: x / norm(a))).otherwise(a)


def upsert(index: DataFrame, rows: DataFrame, dimension: int) -> DataFrame:
    """index and rows (document_id, vector, metadata, ordinal): the row with the last ordinal of each id, vectors of length 1."""
    fits = F.when(F.size("vector") == dimension, True).otherwise(F.raise_error(F.lit(f"a vector has not {dimension} components")).cast("boolean"))
    fresh = rows.where(fits).withColumn("vector", unit(F.col("vector")))
    last = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("ordinal").desc()))
    return index.unionByName(fresh).withColumn("_r", last).where("_r = 1").drop("_r")


def remove(index: DataFrame, ids: DataFrame) -> DataFrame:
    return index.join(ids.select("document_id"), "document_id", "left_anti")


def lookup(index: DataFrame, document_id: str) -> DataFrame:
    return index.where(F.col("document_id") == document_id).select("document_id", "vector")


def search(index: DataFrame, query: Sequence[float], k: int = 10, threshold: float | None = None) -> DataFrame:
    """(document_id, similarity, metadata): the k greatest inner products with the unit query; the threshold acts on those k.

    The query is a literal of the plan; each task keeps its own k best, so k rows a task move.
    """
    length = sum(x * x for x in query) ** 0.5
    q = F.array(*[F.lit(float(x) / length if length else 0.0) for x in query])
    best = index.select("document_id", dot(F.col("vector"), q).alias("similarity"), "metadata", "ordinal").orderBy(F.col("similarity").desc(), "ordinal").limit(k)
    return (best if threshold is None else best.where(F.col("similarity") >= threshold)).drop("ordinal")


def statistics(index: DataFrame) -> DataFrame:
    """(total_documents, dimension, memory_bytes, with_metadata)."""
    n = F.count("*")
    return index.agg(
        n.alias("total_documents"), F.coalesce(F.max(F.size("vector")), F.lit(0)).alias("dimension"), F.coalesce(F.sum(F.size("vector").cast("long") * 4), F.lit(0)).alias("memory_bytes"), F.count_if(F.size("metadata") > 0).alias("with_metadata")
    )


def _best_of_blocks(k: int, threshold: float):
    """Batches of (block, asks, document_id, vector), sorted by the first two: a block of the index, then the sources for it; one matrix product a batch."""

    def matrix(batch: pa.RecordBatch, rows: slice) -> np.ndarray:
        column = batch.column(3).slice(rows.start, rows.stop - rows.start)
        return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, ids, parts, whole = None, [], [], None
        for batch in batches:
            blocks, asks = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(2))
            names = batch.column(2).to_pylist()
            edges = np.flatnonzero((np.diff(blocks) != 0) | (np.diff(asks) != 0)) + 1
            out: list[tuple[str, str, float]] = []
            for lo, hi in zip([0, *edges], [*edges, len(blocks)], strict=True):
                if lo == hi:
                    continue
                if of != blocks[lo]:
                    of, ids, parts, whole = blocks[lo], [], [], None
                if not asks[lo]:
                    ids += names[lo:hi]
                    parts.append(matrix(batch, slice(lo, hi)))
                    continue
                if not parts:
                    continue
                whole = np.concatenate(parts) if whole is None else whole
                for name, row in zip(names[lo:hi], matrix(batch, slice(lo, hi)) @ whole.T, strict=True):
                    near = [(-float(row[i]), ids[i]) for i in np.flatnonzero(row >= threshold) if ids[i] != name]
                    out += [(name, other, -score) for score, other in heapq.nsmallest(k, near)]
            yield pa.RecordBatch.from_arrays([pa.array([o[0] for o in out], pa.string()), pa.array([o[1] for o in out], pa.string()), pa.array([o[2] for o in out], pa.float64())], names=["document_id", "other_id", "similarity"])

    return run


def semantic_links(index: DataFrame, sources: DataFrame, k: int = 5, threshold: float = 0.7, block: int = BLOCK) -> DataFrame:
    """(document_id, other_id, similarity): of each source the best k of the index, itself not, with the threshold.

    sources is a stated set of queries, and all vectors have one length. The index is dealt
    into blocks, each shuffled once; the sources go to every block, stream through it in
    batches, and leave k rows a block at most, so no pair below the threshold leaves a task.
    """
    blocks = max(1, -(-index.count() // block))
    of_index = index.select(F.pmod(F.xxhash64("document_id"), F.lit(blocks)).cast("int").alias("block"), F.lit(0).alias("asks"), "document_id", F.col("vector").cast("array<double>").alias("vector"))
    asked = sources.select(F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).alias("block"), F.lit(1).alias("asks"), "document_id", F.col("vector").cast("array<double>").alias("vector"))
    dealt = of_index.unionByName(asked).repartition("block").sortWithinPartitions("block", "asks")
    scored = dealt.mapInArrow(_best_of_blocks(k, threshold), "document_id string, other_id string, similarity double")
    rank = F.row_number().over(Window.partitionBy("document_id").orderBy(F.col("similarity").desc(), "other_id"))
    return scored.withColumn("_r", rank).where(F.col("_r") <= k).drop("_r")


def semantic_candidates(hits: DataFrame, notes: DataFrame) -> DataFrame:
    """(path, target_path, target_file_id, text, confidence): hits (document_id, other_id, similarity) as link candidates, joined with the notes they name; a note is no candidate of itself."""
    key = F.coalesce("file_id", "path")
    left = notes.select(key.alias("document_id"), "path")
    right = notes.select(key.alias("other_id"), F.col("path").alias("target_path"), F.col("file_id").alias("target_file_id"), F.coalesce("title", "stem").alias("text"))
    found = hits.join(left, "document_id").join(right, "other_id").where("path <> target_path")
    return found.select("path", "target_path", "target_file_id", "text", F.col("similarity").alias("confidence"))


def all_candidates(lexical: DataFrame, semantic: DataFrame) -> DataFrame:
    """(path, target_file_id, text, confidence, source_type): mentions and semantic links together, nothing merged."""
    columns = ["path", "target_file_id", "text", "confidence"]
    return lexical.select(*columns, "source_type").unionByName(semantic.select(*columns, F.lit("semantic").alias("source_type")))


def retrieval_context(hits: DataFrame) -> DataFrame:
    """(rank, document_id, similarity, passage): what an answer is made from: titles, paths and tags of the hits, not their bodies."""
    rank = F.row_number().over(Window.orderBy(F.col("similarity").desc(), "document_id"))
    m = F.col("metadata")
    passage = F.concat_ws("\n", F.concat(F.lit("Title: "), F.coalesce(m["title"], F.col("document_id"))), F.concat(F.lit("Path: "), m["path"]), F.concat(F.lit("Tags: "), m["tags"]))
    return hits.select(rank.alias("rank"), "document_id", "similarity", passage.alias("passage"))
