"""The trie of conversation prefixes, without a trie: every node is owned by its smallest member.

A node is a distinct sequence of first turns. Of the conversations through a node the one
with the smallest conv_id owns it. If a conversation owns a node it owns all below on its
own path (fewer members, and it is still among them), so what a conversation owns is the
end of its path, from its first owned depth on. From this follow, without walking a tree:

- the tokens that a shared prefix saves below a node, (members - 1) x tokens of each node:
  over the members, the tokens of their turns from the node on, minus those of the turns
  that they own (each node is owned once);
- the leaves below a node: the members that own a childless node, their last one.

1. Turns are numbered within their conversation and become a digest and a length.
2. A prefix is the exclusive-or of 120-bit digests of (depth, turn), a running sum in a
   window; a node's parent is the prefix without the last digest.
3. A window marks the owned nodes: the first conversation of each prefix. Only the first
   of a task leaves it, so a prefix that all conversations share is a row a task.
4. One group-by over prefixes sums occurrence tokens minus owned tokens and leaf flags.

Numbers and running sums within a conversation are made in blocks (BLOCK turns) and the
totals of blocks are summed over the blocks, so a conversation that holds a large part of
all turns is many small windows. The ids that end in a node are joined in buckets of
conv_id and hashed bucket by bucket in a stream.

Defined cases: a null role or text is empty; null turns come first; rows with the same
turn are ordered by role and then by the digest of role and text, repeated rows count as
turns of their own; rows without conv_id are no conversation and go; a conversation
without turns is a member of the root only; an empty table has no nodes, not even a root;
other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import cut

#: Turns of a conversation that one window numbers and sums.
BLOCK_BITS = 12
#: Neighbouring conv_ids whose ends are joined at once.
ENDS_BITS = 16
#: A conversation is rebuilt from the first turns of the one that its id, less its remainder by GROUP, names.
GROUP = 100
HEADS = 6
NODE = ["p1", "p2", "depth"]


def _before(blocks: DataFrame, *totals) -> DataFrame:
    """For each (conv_id, block) the totals of the conversation's blocks before it."""
    earlier = Window.partitionBy("conv_id").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    return blocks.select("conv_id", "block", *[F.coalesce(f(F.col(name)).over(earlier), F.lit(0)).alias(f"{name}_before") for name, f in totals])


def numbered(conversations: DataFrame) -> DataFrame:
    """(conv_id, place from 1, digest, chars): the turns of each conversation in order."""
    role, text = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in ("role", "text"))
    turns = conversations.where(F.col("conv_id").isNotNull()).select(
        F.col("conv_id").cast("long").alias("conv_id"),
        F.col("turn").cast("long").alias("turn"),
        role.alias("role"),
        F.sha2(F.concat(F.length(role).cast("string"), F.lit(":"), role, text), 256).alias("digest"),
        F.length(text).cast("long").alias("chars"),
    )
    turns = turns.withColumn("block", F.shiftright(F.coalesce("turn", F.lit(-(1 << 62))), BLOCK_BITS))
    own = Window.partitionBy("conv_id", "block").orderBy(F.col("turn").asc_nulls_first(), "role", "digest")
    blocks = _before(turns.groupBy("conv_id", "block").agg(F.count("*").alias("n")), ("n", F.sum))
    local = turns.withColumn("place", F.row_number().over(own))
    return local.join(blocks, ["conv_id", "block"]).select("conv_id", (F.col("place") + F.col("n_before")).alias("place"), "digest", "chars")


def rebuilt(conversations: DataFrame) -> tuple[DataFrame, DataFrame]:
    """((conv_id, depth, digest, chars) of the rebuilt turns, (conv_id) of all conversations).

    Conversation c begins with the first h turns of conversation c - c % GROUP (all, if it
    has fewer; none, if there is none), with h the CRC-32 of c in decimals modulo HEADS,
    and goes on with its own turns after its first h.
    """
    turns = cut(numbered(conversations))
    ids = turns.select("conv_id").distinct()
    base = F.col("conv_id") - F.col("conv_id") % GROUP
    heads = (
        turns.where((F.col("conv_id") % GROUP == 0) & (F.col("place") < HEADS))
        .groupBy(F.col("conv_id").alias("base"))
        .agg(F.sort_array(F.collect_list(F.struct("place", "digest", "chars"))).alias("head"))
    )
    each = ids.select("conv_id", base.alias("base"), (F.crc32(F.col("conv_id").cast("string").cast("binary")) % HEADS).cast("int").alias("h")).join(heads, "base", "left")
    each = each.select("conv_id", "h", F.when(F.col("head").isNotNull(), F.slice("head", F.lit(1), F.col("h"))).alias("head"))
    first = each.select("conv_id", F.explode("head").alias("t")).select("conv_id", F.col("t.place").alias("depth"), "t.digest", "t.chars")
    after = turns.join(each.select("conv_id", "h", F.when(F.col("head").isNull(), 0).otherwise(F.size("head")).alias("n")), "conv_id").where("place > h")
    return first.unionByName(after.select("conv_id", (F.col("place") - F.col("h") + F.col("n")).alias("depth"), "digest", "chars")), ids


def occurrences(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """(conv_id, depth, p1, p2, q1, q2, chars, upto): a row for each conversation and each prefix of it.

    p is the prefix, q that of the turns before the last, chars the length of the last
    turn and upto that of all. The root is depth 0.
    """
    mixed = F.sha2(F.concat(F.col("depth").cast("string"), F.lit(":"), F.col("digest")), 256)
    part = lambda at: F.conv(F.substring(mixed, at, 15), 16, 10).cast("long")
    keyed = turns.select("conv_id", "depth", "chars", F.shiftright(F.col("depth") - 1, BLOCK_BITS).alias("block"), part(1).alias("k1"), part(16).alias("k2"))
    own = Window.partitionBy("conv_id", "block").orderBy("depth")
    sums = (("k1", F.bit_xor), ("k2", F.bit_xor), ("chars", F.sum))
    local = keyed.withColumns({"x1": F.bit_xor("k1").over(own), "x2": F.bit_xor("k2").over(own), "upto": F.sum("chars").over(own)})
    blocks = _before(keyed.groupBy("conv_id", "block").agg(*[f(name).alias(name) for name, f in sums]), *sums)
    joined = local.join(blocks, ["conv_id", "block"])
    p1, p2 = F.col("x1").bitwiseXOR(F.col("k1_before")), F.col("x2").bitwiseXOR(F.col("k2_before"))
    paths = joined.select(
        "conv_id",
        F.col("depth").cast("long").alias("depth"),
        p1.alias("p1"),
        p2.alias("p2"),
        p1.bitwiseXOR(F.col("k1")).alias("q1"),
        p2.bitwiseXOR(F.col("k2")).alias("q2"),
        "chars",
        (F.col("upto") + F.col("chars_before")).alias("upto"),
    )
    zero = F.lit(0).cast("long")
    return ids.select("conv_id", *[zero.alias(c) for c in NODE[2:] + NODE[:2] + ["q1", "q2", "chars", "upto"]]).unionByName(paths)


def _hashed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """SHA-256 over the comma-joined pieces of each node, which come one behind the other."""
    node, sha = None, None
    for batch in batches:
        out: list[tuple] = []
        for *key, piece in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if key != node:
                if node is not None:
                    out.append((*node, sha.hexdigest()))
                node, sha = key, hashlib.sha256(piece.encode())
            else:
                sha.update(b"," + piece.encode())
        yield _ends_batch(out)
    if node is not None:
        yield _ends_batch([(*node, sha.hexdigest())])


def _ends_batch(rows: list[tuple]) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[]] * 4
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64()] * 3 + [pa.string()], strict=True)], names=[*NODE, "ends_sha256"])


def ends_hashes(ends: DataFrame) -> DataFrame:
    """(p1, p2, depth, ends_sha256): the hash of the ascending conv_ids that end in a node."""
    ids = F.array_join(F.array_sort(F.collect_list("conv_id")).cast("array<string>"), ",")
    pieces = ends.groupBy(*NODE, F.shiftright("conv_id", ENDS_BITS).alias("bucket")).agg(ids.alias("ids"))
    return pieces.repartition(*NODE).sortWithinPartitions(*NODE, "bucket").select(*NODE, "ids").mapInArrow(_hashed, "p1 long, p2 long, depth long, ends_sha256 string")


def prefix_nodes(turns: DataFrame, ids: DataFrame) -> DataFrame:
    """The nodes of the trie of conversations: turns is (conv_id, depth from 1, digest, chars), ids all of them.

    (conv_id, depth, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens,
    ends_sha256), a row per node; conv_id is its smallest member.
    """
    paths = cut(occurrences(turns, ids))
    first = Window.partitionBy(*NODE).orderBy("conv_id")
    owned = cut(paths.withColumn("nth", F.row_number().over(first)).where("nth = 1").drop("nth"))
    children = owned.where("depth > 0").groupBy(F.col("q1").alias("p1"), F.col("q2").alias("p2"), (F.col("depth") - 1).alias("depth")).agg(F.count("*").alias("n_children"))
    nodes = owned.join(children, NODE, "left")
    # Where a conversation's own part begins, as tokens before it, and whether it owns a leaf.
    owners = nodes.groupBy("conv_id").agg(F.min(F.col("upto") - F.col("chars")).alias("own_from"), F.max(F.when(F.col("n_children").isNull(), 1).otherwise(0)).alias("leaf"))
    ends = paths.groupBy("conv_id").agg(F.max_by(F.struct(*NODE), "depth").alias("end"), F.max("upto").alias("total"))
    each = ends.join(owners, "conv_id", "left").select("conv_id", "total", F.coalesce("own_from", "total").alias("own_from"), F.coalesce("leaf", F.lit(0)).alias("leaf"))
    before = F.col("upto") - F.col("chars")
    sums = (
        paths.join(each, "conv_id")
        .groupBy(*NODE)
        .agg(
            F.count("*").alias("n_convs"),
            F.sum("leaf").alias("n_leaves"),
            (F.sum(F.col("total") - before) - F.sum(F.col("total") - F.greatest("own_from", before))).alias("saved_tokens"),
        )
    )
    parents = owned.select(F.col("p1").alias("q1"), F.col("p2").alias("q2"), (F.col("depth") + 1).alias("depth"), F.col("conv_id").alias("parent_conv_id"))
    hashed = ends_hashes(ends.select("conv_id", "end.*"))
    return (
        nodes.join(sums, NODE)
        .join(hashed, NODE, "left")
        .join(parents, ["q1", "q2", "depth"], "left")
        .select(
            "conv_id",
            "depth",
            "parent_conv_id",
            "n_convs",
            F.coalesce("n_children", F.lit(0)).cast("long").alias("n_children"),
            F.col("n_leaves").cast("long").alias("n_leaves"),
            "saved_tokens",
            F.coalesce("ends_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("ends_sha256"),
        )
    )


def conversation_nodes(conversations: DataFrame) -> DataFrame:
    """The nodes of the trie of the rebuilt conversations."""
    return prefix_nodes(*rebuilt(conversations))


#: The same in SQL, with prefixes as strings of digests and subtrees by their prefixes.
SQL = """
WITH turns AS (
    SELECT conv_id, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, '')) AS digest, length(coalesce(text, '')) AS chars,
        row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, coalesce(role, ''), sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS place
    FROM conversations WHERE conv_id IS NOT NULL),
ids AS (
    SELECT DISTINCT conv_id, xor(4294967295, list_reduce(list_prepend(4294967295::BIGINT, list_transform(string_split(conv_id::VARCHAR, ''), lambda c: ascii(c)::BIGINT)),
        lambda a, b: list_reduce(list_prepend(xor(a, b), [1::BIGINT, 2, 3, 4, 5, 6, 7, 8]), lambda u, i: xor(u >> 1, (u & 1) * 3988292384)))) % 6 AS h
    FROM turns),
head AS (SELECT i.conv_id, t.place AS depth, t.digest, t.chars FROM ids i JOIN turns t ON t.conv_id = i.conv_id - i.conv_id % 100 AND t.place <= i.h),
own AS (
    SELECT t.conv_id, t.place - i.h + (SELECT count(*) FROM head WHERE head.conv_id = t.conv_id) AS depth, t.digest, t.chars
    FROM turns t JOIN ids i ON t.conv_id = i.conv_id AND t.place > i.h),
paths AS (
    SELECT conv_id, depth, chars, string_agg(digest, '' ORDER BY depth) OVER (PARTITION BY conv_id ORDER BY depth ROWS UNBOUNDED PRECEDING) AS prefix FROM (SELECT * FROM head UNION ALL SELECT * FROM own)
    UNION ALL SELECT conv_id, 0, 0, '' FROM ids),
nodes AS (SELECT prefix, depth, any_value(chars) AS chars, min(conv_id) AS conv_id, count(*) AS n_convs FROM paths GROUP BY prefix, depth),
children AS (SELECT substr(prefix, 1, 64 * (depth - 1)) AS prefix, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
below AS (
    SELECT substr(n.prefix, 1, 64 * k) AS prefix, sum((n.n_convs - 1) * n.chars) AS saved, count(*) FILTER (c.n IS NULL) AS leaves
    FROM (SELECT *, unnest(range(0, depth + 1)) AS k FROM nodes) n LEFT JOIN children c ON c.prefix = n.prefix GROUP BY ALL),
ends AS (SELECT prefix, sha256(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id)) AS sha FROM (SELECT conv_id, arg_max(prefix, depth) AS prefix FROM paths GROUP BY conv_id) GROUP BY prefix)
SELECT n.conv_id, n.depth, p.conv_id AS parent_conv_id, n.n_convs, coalesce(c.n, 0) AS n_children, b.leaves AS n_leaves, b.saved::BIGINT AS saved_tokens, coalesce(e.sha, sha256('')) AS ends_sha256
FROM nodes n JOIN below b ON b.prefix = n.prefix LEFT JOIN children c ON c.prefix = n.prefix LEFT JOIN ends e ON e.prefix = n.prefix
LEFT JOIN nodes p ON n.depth > 0 AND p.prefix = substr(n.prefix, 1, 64 * (n.depth - 1))
"""
