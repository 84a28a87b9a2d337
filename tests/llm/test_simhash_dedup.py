import re

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import simhash_dedup as s
from notemill.llm.components import components
from notemill.llm.queries import op4_bit_sliced_simhash_dedup


def brute_fingerprint(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if not w:
        return 0
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]), 42) for i in range(max(1, len(w) - 2))]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_classes(fps, radius):
    own = list(range(len(fps)))
    for i in range(len(fps)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius and own[i] != own[j]:
                a, b = sorted((own[i], own[j]))
                own = [a if x == b else x for x in own]
    return own


@settings(max_examples=40, deadline=None)
@given(st.text(max_size=200))
def test_fingerprint(text):
    text = text.encode("utf-8", "ignore").decode()
    assert s.fingerprint(text.encode()) == brute_fingerprint(text)


def clustered(rng, n, flips=4):
    base = [int(x) for x in rng.integers(0, 2**63, 3)]
    return sorted({b ^ sum(1 << int(k) for k in rng.integers(0, 64, rng.integers(0, flips + 1))) for b in base for _ in range(n)})


@pytest.mark.parametrize("radius", [1, 2, 3, 5])
def test_bit_sliced_links_join_what_brute_force_joins(radius):
    rng = np.random.default_rng(radius)
    for _ in range(10):
        fps = clustered(rng, 15)
        own = list(range(len(fps)))
        for i, j in s.links(np.array(fps, dtype=np.uint64), radius):
            assert (fps[i] ^ fps[j]).bit_count() <= radius
            a, b = sorted((own[i], own[j]))
            own = [a if x == b else x for x in own]
        assert own == brute_classes(fps, radius)


@pytest.mark.parametrize("bucket", [2, 7, 2048])
def test_divided_buckets_lose_no_link(spark, bucket):
    fps = clustered(np.random.default_rng(9), 40, 3)
    nodes = spark.createDataFrame([(int(np.uint64(f).astype(np.int64)), i) for i, f in enumerate(fps)], "fp long, node long")
    found = {r.node: r.component for r in components(s.fingerprint_links(nodes, 3, bucket=bucket)).collect()}
    assert [found.get(i, i) for i in range(len(fps))] == brute_classes(fps, 3)


def test_components_of_a_chain_and_a_star(spark):
    edges = [(i, i + 1) for i in range(40)] + [(100, 100 + i) for i in range(1, 200)] + [(500, 500)]
    found = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {**{i: 0 for i in range(41)}, **{100 + i: 100 for i in range(200)}}


def test_query(spark, sf):
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: r.doc_id)
    fps = [brute_fingerprint(r.text) for r in docs]
    own = brute_classes(fps, 3)
    out = {r.doc_id: r for r in op4_bit_sliced_simhash_dedup(spark, sf).collect()}
    assert {d.doc_id: (f"{f:016x}", docs[o].doc_id) for d, f, o in zip(docs, fps, own)} == {k: (r.fingerprint, r.component_id) for k, r in out.items()}


def test_odd_rows(odd, empty):
    out = s.dedup_documents(odd).collect()
    assert len(out) == odd.count()
    by = {r.doc_id: r for r in out if r.doc_id is not None}
    assert {by[i].component_id for i in (1, 2, 3)} == {1} and by[1].fingerprint == "0" * 16
    assert by[6].component_id == 5
    assert s.dedup_documents(empty).count() == 0
    kept = s.keep_one(odd)
    assert kept.columns == odd.columns
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == [1, 4, 4, 4, 5, 7, 8, 9]
