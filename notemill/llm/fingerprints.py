"""Document fingerprints: SimHash by weighted votes, and search in permuted block tables.

A text's terms are its pairs of neighbouring words (lower-cased, cut at white space; the
last word stands alone). A term's weight is how often it occurs: each occurrence adds one
vote for the set bits of its hash and one against the others, and the fingerprint has the
bits with a positive sum. Votes are counted eight bits to a number, a byte lane each, over
runs of at most 127 terms, so a term costs eight additions and no lane overflows.

near_fingerprints finds all fingerprints within a Hamming radius: for every choice of
blocks a table is keyed by their bits, and a pair within the radius meets in one of them.
It works on different fingerprints with the number of documents of each, so copies never
multiply.

fingerprint_documents compares each text with its edited form, in which the last third of
the code points gives way to the first ones of the next document in descending doc_id.
Neighbours are found on ids alone: they are dealt by range, linked within each range, and
the ranges' ends are linked by a table of one row a range. The texts are shuffled once,
the needed beginnings once more.

Everything is DataFrame expressions. Defined cases: a null text is empty; a text without
words has fingerprint 0; with a single doc_id the next document is the document itself;
of rows that share a doc_id the one whose beginning (then fingerprint) sorts first is the
neighbour's next text; a row with a null doc_id is followed by the empty document, so its edited
text only loses its last third and near_next is the likeness to fingerprint 0; an empty table gives an empty result;
other columns are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.llm.simhash_dedup import BLOCKS, RADIUS, table_keys
from notemill.session import cut

LANES = 0x0101010101010101
RUN = 127
#: Fingerprints of one key that are compared together.
BUCKET = 4096
#: Ids in a range of the neighbour search, about.
RANGE_ROWS = 20_000


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def simhash(text: Column) -> Column:
    """The 64-bit fingerprint of a text, as a signed number."""

    def votes(terms: Column) -> Column:
        runs = F.transform(F.sequence(F.lit(0), F.floor((F.greatest(F.size(terms), F.lit(1)) - 1) / RUN).cast("int")), lambda i: F.slice(terms, i * RUN + 1, RUN))

        def lane(k: int) -> Callable[[Column], Column]:
            return lambda run: F.aggregate(run, F.lit(0).cast("long"), lambda a, x: a + F.shiftrightunsigned(x, k).bitwiseAND(F.lit(LANES)))

        return let(runs, lambda r: bits(F.array(*[F.transform(r, lane(k)) for k in range(8)]), F.size(terms)))

    def bits(lanes: Column, n: Column) -> Column:
        def one(sums: Column, b: Column) -> Column:
            counted = F.aggregate(F.get(sums, b % 8), F.lit(0).cast("long"), lambda a, x: a + _byte(x, b))
            return F.when(counted * 2 > n, F.call_function("shiftleft", F.lit(1).cast("long"), b)).otherwise(F.lit(0).cast("long"))

        return let(lanes, lambda s: F.aggregate(F.sequence(F.lit(0), F.lit(63)), F.lit(0).cast("long"), lambda fp, b: fp.bitwiseOR(one(s, b))))

    words = F.filter(F.split(F.lower(text), r"\s+"), lambda w: w != "")
    hashes = F.transform(words, lambda w: F.xxhash64(w))
    pairs = let(hashes, lambda h: F.zip_with(h, F.slice(h, 2, F.greatest(F.size(h), F.lit(1))), lambda a, b: F.xxhash64(a, b)))
    return let(pairs, votes)


def _byte(x: Column, b: Column) -> Column:
    return F.call_function("shiftrightunsigned", x, F.floor(b / 8).cast("int") * 8).bitwiseAND(F.lit(255))


def as_hex(fp: Column) -> Column:
    return F.lpad(F.lower(F.hex(fp)), 16, "0")


def likeness(a: Column, b: Column) -> Column:
    """The share of equal bits."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / F.lit(64.0)


def near_fingerprints(queries: DataFrame, corpus: DataFrame, radius: int = RADIUS, blocks: int = BLOCKS) -> DataFrame:
    """(query_fp, fp, distance, documents): all corpus fingerprints within the radius of each query's.

    queries and corpus have a column fp; documents is how many corpus rows have it. A key
    that more than BUCKET fingerprints share is dealt into parts of about so many, and its
    queries go to each part, so a hot bucket is the work of many tasks.
    """
    rows = corpus.groupBy("fp").agg(F.count("*").alias("documents"))
    keyed = rows.select("fp", "documents", F.explode(table_keys(F.col("fp"), radius, blocks)).alias("key"))
    asked = queries.select(F.col("fp").alias("query_fp")).distinct()
    asked = asked.select("query_fp", F.explode(table_keys(F.col("query_fp"), radius, blocks)).alias("key"))
    hot = keyed.groupBy("key").agg(F.ceil(F.count("*") / BUCKET).cast("int").alias("parts")).where("parts > 1")
    part = F.when(F.col("parts").isNull(), 0).otherwise(F.pmod(F.xxhash64("fp"), F.col("parts"))).cast("int")
    keyed = keyed.join(hot, "key", "left").select("key", part.alias("part"), "fp", "documents")
    asked = asked.join(hot, "key", "left").select("key", "query_fp", F.explode(F.sequence(F.lit(0), F.coalesce("parts", F.lit(1)) - 1)).alias("part"))
    distance = F.bit_count(F.col("fp").bitwiseXOR(F.col("query_fp")))
    return asked.join(keyed, ["key", "part"]).where(distance <= radius).select("query_fp", "fp", distance.alias("distance"), "documents").distinct()


def neighbours(ids: DataFrame, rows: int) -> DataFrame:
    """ids (doc_id, n) to (doc_id, n, next_id, prev_id, prev_n) in a ring by descending doc_id."""
    parts = max(1, math.ceil(rows / RANGE_ROWS))
    dealt = cut(ids.repartitionByRange(parts, F.col("doc_id").desc()).withColumn("part", F.spark_partition_id()))
    along = Window.partitionBy("part").orderBy(F.col("doc_id").desc())
    inner = dealt.select("part", "doc_id", "n", F.lead("doc_id").over(along).alias("next_in"), F.lag("doc_id").over(along).alias("prev_in"), F.lag("n").over(along).alias("prev_n_in"))
    ends = dealt.groupBy("part").agg(F.max("doc_id").alias("first"), F.min("doc_id").alias("last"), F.min_by("n", "doc_id").alias("last_n"))
    order, every = Window.orderBy("part"), Window.orderBy("part").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ends = ends.select(
        "part",
        F.coalesce(F.lead("first").over(order), F.first("first").over(every)).alias("next_out"),
        F.coalesce(F.lag("last").over(order), F.last("last").over(every)).alias("prev_out"),
        F.coalesce(F.lag("last_n").over(order), F.last("last_n").over(every)).alias("prev_n_out"),
    )
    return inner.join(ends, "part").select(
        "doc_id",
        "n",
        F.coalesce("next_in", "next_out").alias("next_id"),
        F.coalesce("prev_in", "prev_out").alias("prev_id"),
        F.coalesce("prev_n_in", "prev_n_out").alias("prev_n"),
    )


def fingerprint_documents(docs: DataFrame) -> DataFrame:
    """One row per document: fingerprints of its text and of its edited text, and their likenesses."""
    # Plain columns up to the shuffle: both readers of the texts then share one exchange.
    docs = docs.select("doc_id" if dict(docs.dtypes)["doc_id"] == "bigint" else F.col("doc_id").cast("long"), "text")
    known = docs.where("doc_id IS NOT NULL")
    ring = cut(neighbours(known.groupBy("doc_id").agg(F.max(F.coalesce(F.length("text"), F.lit(0))).cast("long").alias("n")), docs.count()))
    own = known.join(ring.select("doc_id", "next_id", "prev_id", "prev_n"), "doc_id")
    heads = own.select(F.col("prev_id").alias("doc_id"), F.substring(F.coalesce("text", F.lit("")), F.lit(1), F.floor(F.col("prev_n") / 3).cast("int")).alias("head"))
    heads = heads.groupBy("doc_id").agg(F.min("head").alias("head"))
    paired = own.select("doc_id", "text", "next_id").join(heads, "doc_id")
    alone = docs.where("doc_id IS NULL").select("doc_id", "text", F.lit(None).cast("long").alias("next_id"), F.lit("").alias("head"))
    n = F.length("text")
    third = F.floor(n / 3).cast("int")
    edited = F.concat(F.substring("text", F.lit(1), n - third), F.substring("head", F.lit(1), third))
    made = paired.unionByName(alone).withColumn("text", F.coalesce("text", F.lit(""))).select("doc_id", "next_id", n.cast("long").alias("n_chars"), "text", edited.alias("edited"))
    made = made.select("doc_id", "next_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"), simhash(F.col("text")).alias("fp"), simhash(F.col("edited")).alias("edited_fp"))
    made = cut(made)
    following = made.where("doc_id IS NOT NULL").groupBy(F.col("doc_id").alias("next_id")).agg(F.min("fp").alias("next_fp"))
    return made.join(following, "next_id", "left").select(
        "doc_id",
        "n_chars",
        "edited_sha256",
        as_hex(F.col("fp")).alias("fingerprint"),
        as_hex(F.col("edited_fp")).alias("edited_fingerprint"),
        likeness(F.col("fp"), F.col("edited_fp")).alias("near_edited"),
        likeness(F.col("fp"), F.coalesce("next_fp", F.lit(0).cast("long"))).alias("near_next"),
    )
