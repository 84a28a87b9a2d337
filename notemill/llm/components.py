"""Connected components of an edge table, by alternating large and small stars.

Every round joins each node's larger neighbours to the least node it knows, then each
node and its smaller neighbours to the least of them. All steps are partial aggregates
and joins against one row a node, so a node with very many edges is aggregated before the
shuffle and its side of the join can be split; nothing is gathered in one task or on the
driver except two numbers a round. Each round ends in a checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.session import cut


def _state(edges: DataFrame) -> tuple[int, int]:
    row = edges.agg(F.count("*").alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")).alias("h")).first()
    return row["n"], int(row["h"] or 0)


def components(edges: DataFrame) -> DataFrame:
    """edges (a long, b long) to (node long, component long), the least node that it reaches.

    Nodes that no edge names are not in the result; edges of a node to itself are ignored.
    """
    stars = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = _state(stars)
    while before[0]:
        both = stars.select(F.explode(F.array(F.struct("u", "v"), F.struct(F.col("v").alias("u"), F.col("u").alias("v")))).alias("e")).select("e.*")
        least = both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m"))
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        lower = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(lower, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        stars = cut(small.unionByName(lower.select("u", F.col("m").alias("v"))).distinct())
        after = _state(stars)
        if after == before:
            break
        before = after
    return stars.select(F.col("u").alias("node"), F.col("v").alias("component")).unionByName(stars.select(F.col("v").alias("node"), F.col("v").alias("component")).distinct())
