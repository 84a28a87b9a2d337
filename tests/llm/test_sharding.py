import math
import zlib
from collections import Counter

import pytest
from pyspark.sql import functions as F

from notemill.llm import sharding
from notemill.llm.sharding import Tree


def test_slots_sizes_and_growth(spark, sf, monkeypatch):
    monkeypatch.setattr(sharding, "ROWS_PER_GROUP", 2)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    out = sharding.shard_documents(docs, 40).collect()
    texts = {r.doc_id: r.text for r in docs.collect()}
    assert len(out) == len(texts)
    for r in out:
        t = texts[r.doc_id].encode()
        assert (r["size"], r.text_crc32, r.law) == (len(t) + 16, zlib.crc32(t), "key")
        assert 0 <= r.shard < 40 and (r.grown_shard == r.shard or r.grown_shard == 40)
        assert (r.region, r.rack) == (r.shard // 10, r.shard // 5)
    for shard in {r.shard for r in out}:
        own = sorted(r.slot for r in out if r.shard == shard)
        assert own == list(range(len(own)))


def places(spark, tree, keys):
    return {r.id: (r.region, r.rack, r.shard) for r in sharding.descend(spark.range(keys), F.col("id"), tree).collect()}


def brute_force(spark, tree, keys):
    """Every draw made by itself from its own hash, and the least one taken at each node."""
    racks = [rack for region in tree.regions for rack in region]
    names = [("region", i) for i in range(len(tree.regions))] + [("rack", i) for i in range(len(racks))] + [("shard", s) for s in range(len(tree.weights))]
    hashes = spark.range(keys).crossJoin(spark.createDataFrame(names, "level string, name int")).select("id", "level", "name", F.xxhash64("id", "level", "name").alias("h")).collect()
    drawn = {(r.id, r.level, r.name): -math.log(((r.h & (2**64 - 1)) >> 11) / 2**53 + 0.5 / 2**53) for r in hashes}
    out = {}
    for key in range(keys):
        best = lambda level, named: min((drawn[key, level, n] / w if w else math.inf, n) for n, w in named)[1]
        region = best("region", [(i, tree.weight(r)) for i, r in enumerate(tree.regions)])
        rack = best("rack", [(racks.index(r), tree.weight(r)) for r in tree.regions[region]])
        out[key] = (region, rack, best("shard", [(s, tree.weights[s]) for s in racks[rack]]))
    return out


@pytest.mark.parametrize("tree", [Tree.of(1), Tree.of(7), Tree.of(23, [1 + s % 4 for s in range(23)]), Tree.of(40), Tree.of(40).grown()])
def test_descent_against_brute_force(spark, tree):
    assert places(spark, tree, 200) == brute_force(spark, tree, 200)


def test_one_more_shard_takes_rows_only_into_itself(spark):
    for n in (1, 4, 5, 9, 10, 25, 39, 40, 49):
        tree = Tree.of(n)
        before, after = places(spark, tree, 3000), places(spark, tree.grown(), 3000)
        moved = [k for k in before if before[k] != after[k]]
        assert {after[k][2] for k in moved} <= {n}
        assert abs(len(moved) / 3000 - 1 / (n + 1)) < 0.05
    assert Tree.of(40).grown() == Tree.of(41) and Tree.of(41).grown() == Tree.of(42)


def test_movement_stays_in_the_subtrees_whose_weight_changes(spark):
    """Shard 13 (region 1, rack 2) grows: rows move into region 1 only, in it into rack 2 only, in that onto shard 13 only."""
    weights = [1.0] * 40
    before = places(spark, Tree.of(40, weights), 6000)
    weights[13] = 3.0
    after = places(spark, Tree.of(40, weights), 6000)
    moved = 0
    for k in before:
        (r0, k0, s0), (r1, k1, s1) = before[k], after[k]
        moved += s0 != s1
        assert r0 == r1 or r1 == 1
        assert k0 == k1 or r0 != r1 or (r1, k1) == (1, 2)
        assert s0 == s1 or k0 != k1 or s1 == 13
    assert 0 < moved / 6000 < 0.2


def test_weights(spark):
    n = Counter(s for _, _, s in places(spark, Tree.of(3, [1.0, 0.0, 3.0]), 6000).values())
    assert n[1] == 0 and 0.7 < n[2] / 6000 < 0.8
    n = Counter(s for _, _, s in places(spark, Tree.of(20, [1.0] * 10 + [3.0] * 10), 6000).values())
    assert abs(sum(n[s] for s in range(10)) / 6000 - 0.25) < 0.03 and min(n.values()) > 100
    with pytest.raises(ValueError):
        Tree.of(2, [0.0, 0.0])


def test_odd_rows(odd, empty):
    out = sharding.shard_documents(odd, 7).collect()
    assert len(out) == odd.count()
    assert len({r.shard for r in out if r.doc_id is None}) == 1
    nulls = [r for r in out if r.doc_id == 1]
    assert [(r["size"], r.text_crc32) for r in nulls] == [(16, 0)]
    assert len({r.slot for r in out if r.doc_id == 4}) == 3
    assert sharding.shard_documents(empty, 7).count() == 0
