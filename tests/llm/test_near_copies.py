import random

import numpy as np
import pytest

import corpus_pipeline as pipeline
from notemill.llm import near_copies as n


def brute_classes(texts):
    def grams(t):
        w = (t or "").lower().split()
        return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()

    sets, own = [grams(t) for t in texts], list(range(len(texts)))
    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] | sets[j])
            if own[i] != own[j] and (both == 0 or len(sets[i] & sets[j]) / both >= 0.8):
                a, b = sorted((own[i], own[j]))
                own = [a if x == b else x for x in own]
    return own


def edited(rng, base, edits):
    words = list(base)
    for _ in range(edits):
        words[rng.randrange(len(words))] = f"new{rng.random()}"
    return " ".join(words)


@pytest.fixture(scope="module")
def texts():
    """Near copies around the threshold, some in chains, a shared passage, and short texts."""
    rng = random.Random(5)
    out = []
    for _ in range(25):
        base = [f"w{rng.randrange(5000)}" for _ in range(rng.randrange(60, 400))]
        out += [edited(rng, base, k * len(base) // 100) for k in (0, 1, 1, 2, 3, 4)]
    passage = [f"p{i}" for i in range(60)]
    out += [" ".join(passage + [f"o{rng.random()}" for _ in range(rng.randrange(5, 40))]) for _ in range(40)]
    return [*out, "one", "One", "a b c d", "a b c d e", "", " ", None]


@pytest.mark.parametrize("part", [3, 1024])
def test_classes_are_those_of_brute_force(spark, texts, part):
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    expected = brute_classes(texts)
    got = {r.node: r.component_id for r in n.classes(docs, part).collect()}
    assert {i for i, c in got.items() if i == c} == set(expected)
    assert all(expected[i] == c for i, c in got.items())


def test_stage_drops_a_near_copy_beyond_three_bits(spark, sf):
    from notemill.llm import simhash_dedup

    rng = random.Random(8)
    base = [f"w{i}" for i in range(120)]
    far = next(t for t in iter(lambda: edited(rng, base, 2), None) if (simhash_dedup.fingerprint(t.encode()) ^ simhash_dedup.fingerprint(" ".join(base).encode())).bit_count() > 3)
    docs = spark.createDataFrame([(1, " ".join(base)), (2, far), (3, "another text")], "doc_id long, text string")
    assert sorted(r.doc_id for r in pipeline.near_dedup(spark, docs, sf).collect()) == [1, 3]


def test_near_fingerprints_are_candidates_without_a_common_band(spark):
    far = lambda k: list(range(k * 40, k * 40 + 40))
    nodes = spark.createDataFrame([(1, 0b0, far(1)), (2, 0b111, far(2)), (3, 0b1111000, far(3)), (4, 0b0, far(4)), (5, 0b0, [])], "node long, fp long, keys array<long>")
    assert {tuple(sorted(r)) for r in n.candidate_links(nodes).collect()} == {(1, 2), (1, 4)}


def test_links_between_parts_only():
    sets = [np.arange(10, dtype=np.uint64), np.arange(10, dtype=np.uint64), np.arange(9, dtype=np.uint64), np.arange(90, 95, dtype=np.uint64)]
    assert n.links(sets) == [(0, 1), (0, 2)] and n.links(sets, 2) == [(0, 2), (1, 2)]


def test_odd_rows(odd, empty):
    kept = n.keep_one(odd)
    assert kept.columns == odd.columns and n.keep_one(empty).count() == 0
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 4, 4, 5, 7, 8, 9]
