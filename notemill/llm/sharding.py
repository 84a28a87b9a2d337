"""Sharding by a hierarchical weighted hash tree.

A row descends three levels, region, rack and shard. At each node every child draws a
weighted hash of the row's key and the child's own name, -ln(u) / weight, and the least
draw wins; a child's weight is the sum of the weights of its shards. The draws of a level
are made for the children of the node that was reached and for no others, so a row costs
one draw for each region, each rack of its region and each shard of its rack.

A changed weight changes only the draws on the path from the root to it, so rows move into
or out of the subtrees on that path and between no others: a row whose region's weight is
the same before and after, and which stays there, keeps its rack and shard.

Place of a shard (Tree.of, a fixed rule, so doc_id and the number of shards decide): full
regions of RACKS_PER_REGION racks of SHARDS_PER_RACK shards first; each shard beyond the
last full region is a region of its own. A tree grows (Tree.grown) by a region of one new
shard and is not laid out anew, so one more shard takes rows only into itself, whatever
their number. Tree.of(n).grown() is Tree.of(n + 1) unless n + 1 fills a region.

Defined cases: a null key is a key like any other; repeated rows share a shard and take
different slots; ties of draws go to the child that comes first; a null text has 16 bytes
and the checksum of the empty text (0); an empty table gives an empty result; other columns
of the input are ignored.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import cut

SHARDS_PER_RACK = 5
RACKS_PER_REGION = 2
#: Rows that one group of the slot numbering holds, about.
ROWS_PER_GROUP = 20_000
_LEVELS = ("region", "rack", "shard")


@dataclass(frozen=True)
class Tree:
    """Regions of racks of shards, by number, and the weight of each shard."""

    regions: tuple[tuple[tuple[int, ...], ...], ...]
    weights: tuple[float, ...]

    @classmethod
    def of(cls, shards: int, weights: Sequence[float] | None = None) -> Tree:
        made = (1.0,) * shards if weights is None else tuple(map(float, weights))
        if shards < 1 or len(made) != shards or min(made) < 0 or not any(made):
            raise ValueError("one weight of at least 0 for each shard, not all 0")
        per_region = SHARDS_PER_RACK * RACKS_PER_REGION
        full = shards // per_region
        regions = [tuple(tuple(range(start, start + SHARDS_PER_RACK)) for start in range(r * per_region, (r + 1) * per_region, SHARDS_PER_RACK)) for r in range(full)]
        return cls((*regions, *(((s,),) for s in range(full * per_region, shards))), made)

    def grown(self, weight: float = 1.0) -> Tree:
        """With one more shard, a region of its own."""
        return Tree((*self.regions, ((len(self.weights),),)), (*self.weights, float(weight)))

    def weight(self, node) -> float:
        return self.weights[node] if isinstance(node, int) else sum(map(self.weight, node))


def draw(key: Column, level: str, name: Column, weight: Column | float) -> Column:
    """A child's draw for the key; infinite without weight."""
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(level), name), 11).cast("double") + F.lit(0.5)) / F.lit(2.0**53)
    w = F.lit(weight) if isinstance(weight, (int, float)) else weight
    return F.when(w > 0, -F.ln(u) / w).otherwise(F.lit(float("inf")))


def _chosen(key: Column, level: str, children: Column) -> Column:
    """The name of the child with the least draw; children is array<struct<name int, weight double>>."""
    drawn = F.transform(children, lambda c: F.struct(draw(key, level, c["name"], c["weight"]).alias("draw"), c["name"].alias("name")))
    return F.array_min(drawn)["name"]


def _children(named: Sequence[tuple[int, float]]) -> Column:
    return F.array(*[F.struct(F.lit(name).alias("name"), F.lit(float(weight)).alias("weight")) for name, weight in named])


def descend(df: DataFrame, key: Column, tree: Tree, prefix: str = "") -> DataFrame:
    """Adds <prefix>region, <prefix>rack and <prefix>shard, one level at a time.

    Racks are numbered through all regions. The table of a level's children is a literal of
    the plan, one entry a node, and each row looks up the entry of the node it is at.
    """
    racks = [rack for region in tree.regions for rack in region]
    numbers = iter(range(len(racks)))
    by_region = [[(next(numbers), tree.weight(rack)) for rack in region] for region in tree.regions]
    region, rack, shard = (f"{prefix}{x}" for x in _LEVELS)
    df = df.withColumn(region, _chosen(key, "region", _children([(i, tree.weight(r)) for i, r in enumerate(tree.regions)])))
    df = df.withColumn(rack, _chosen(key, "rack", F.get(F.array(*[_children(c) for c in by_region]), F.col(region))))
    return df.withColumn(shard, _chosen(key, "shard", F.get(F.array(*[_children([(s, tree.weights[s]) for s in r]) for r in racks]), F.col(rack))))


def numbered(df: DataFrame, group: str, order: Sequence[str], rows: int, groups: int, name: str) -> DataFrame:
    """Adds the row's number within its group, gapless from 0.

    Each group is dealt into parts by a hash of the ordering columns, numbered part by
    part, and shifted by the sizes of the parts before; no group meets in one task.
    """
    parts = max(1, math.ceil(rows / (max(1, groups) * ROWS_PER_GROUP)))
    df = df.withColumn("_part", F.pmod(F.xxhash64(*order), F.lit(parts)).cast("int"))
    sizes = df.groupBy(group, "_part").agg(F.count("*").alias("_n"))
    before = Window.partitionBy(group).orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select(group, "_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    within = F.row_number().over(Window.partitionBy(group, "_part").orderBy(*order))
    return df.withColumn("_row", within).join(starts, [group, "_part"]).withColumn(name, F.col("_start") + F.col("_row") - 1).drop("_part", "_row", "_start")


def shard_documents(docs: DataFrame, shards: int = 40) -> DataFrame:
    """One row per document: its sizes, its shard, its slot there, and its shard with one more."""
    text = F.coalesce(F.col("text"), F.lit(""))
    tree, key = Tree.of(shards), F.col("doc_id")
    df = docs.select(
        "doc_id",
        (F.octet_length(text).cast("long") + 16).alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.lit("key").alias("law"),
    )
    df = descend(descend(df, key, tree), key, tree.grown(), "grown_").drop("grown_region", "grown_rack")
    # The numbering reads the rows three times; a checkpoint of these few columns keeps texts and draws from being read and made again.
    df = cut(df)
    df = numbered(df, "shard", ["doc_id", "text_crc32", "size"], df.count(), shards, "slot")
    return df.select("doc_id", "size", "text_crc32", "law", "shard", F.col("slot").cast("long").alias("slot"), "grown_shard", "region", "rack")
