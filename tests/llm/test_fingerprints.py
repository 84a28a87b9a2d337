import hashlib

import pytest
from pyspark.sql import functions as F

from notemill.llm import fingerprints as f
from notemill.llm.queries import op8_simhash_fingerprints


def edited(texts):
    out = []
    for i, t in enumerate(texts):
        k = len(t) // 3
        out.append(t[: len(t) - k] + texts[(i + 1) % len(texts)][:k])
    return out


@pytest.mark.parametrize("rows", [7, 10**6])
def test_query_against_brute_force(spark, sf, monkeypatch, rows):
    monkeypatch.setattr(f, "RANGE_ROWS", rows)
    docs = sorted(spark.read.parquet(f"{sf}/documents.parquet").collect(), key=lambda r: -r.doc_id)
    out = {r.doc_id: r for r in op8_simhash_fingerprints(spark, sf).collect()}
    texts = [r.text for r in docs]
    apart = 0
    for i, (d, e) in enumerate(zip(docs, edited(texts))):
        r, following = out[d.doc_id], out[docs[(i + 1) % len(docs)].doc_id]
        assert r.n_chars == len(d.text) and r.edited_sha256 == hashlib.sha256(e.encode()).hexdigest()
        bits = lambda a, b: 1 - (int(a, 16) ^ int(b, 16)).bit_count() / 64
        assert r.near_edited == bits(r.fingerprint, r.edited_fingerprint) and r.near_next == bits(r.fingerprint, following.fingerprint)
        apart += r.near_edited > r.near_next
    assert len(out) == len(docs) and apart / len(docs) > 0.95
    for a in docs:
        for b in docs[:20]:
            assert a.text != b.text or out[a.doc_id].fingerprint == out[b.doc_id].fingerprint


def test_votes(spark):
    texts = ["", "a", "a b", "b a " * 500, "The the THE", "x y z " * 3000]
    df = spark.createDataFrame([(t,) for t in texts], "text string")
    got = [r.fp for r in df.select(f.simhash(F.col("text")).alias("fp")).collect()]

    def hashed(values, kinds):
        return spark.createDataFrame([tuple(values)], kinds).select(F.xxhash64("*")).first()[0]

    for t, fp in zip(texts, got):
        words = t.lower().split()
        h = [hashed([w], "a string") for w in words[:4]] if len(set(words)) > 3 else None
        value = {w: hashed([w], "a string") for w in set(words)}
        pair = {}
        terms = []
        for i, w in enumerate(words):
            k = (w, words[i + 1]) if i + 1 < len(words) else (w,)
            if k not in pair:
                pair[k] = hashed([value[x] for x in k], ", ".join(f"c{i} long" for i in range(len(k))))
            terms.append(pair[k] & (2**64 - 1))
        want = sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in terms) > len(terms))
        assert fp & (2**64 - 1) == want


def test_search_in_block_tables(spark):
    import numpy as np

    rng = np.random.default_rng(1)
    base = [int(x) for x in rng.integers(0, 2**63, 4)]
    fps = [b ^ sum(1 << int(k) for k in rng.integers(0, 63, rng.integers(0, 6))) for b in base for _ in range(30)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate([*fps, *fps[:10]])], "doc_id long, fp long")
    got = {(r.query_fp, r.fp): (r.distance, r.documents) for r in f.near_fingerprints(rows.where("doc_id % 10 = 0"), rows).collect()}
    every = [*fps, *fps[:10]]
    want = {(a, b): ((a ^ b).bit_count(), every.count(b)) for a in every[::10] for b in every if (a ^ b).bit_count() <= 3}
    assert got == want


@pytest.mark.parametrize("bucket", [3, 4096])
def test_search_in_hot_buckets(spark, monkeypatch, bucket):
    """A third of all fingerprints share all their blocks but one, and meet in the same keys."""
    monkeypatch.setattr(f, "BUCKET", bucket)
    fps = [0x5A5A << 40 | i for i in range(80)] + [(i * 0x9E3779B97F4A7C15) % 2**63 for i in range(1, 160)]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(fps)], "doc_id long, fp long")
    got = {(r.query_fp, r.fp, r.distance, r.documents) for r in f.near_fingerprints(rows.where("doc_id % 4 = 0"), rows).collect()}
    assert got == {(a, b, (a ^ b).bit_count(), 1) for a in fps[::4] for b in fps if (a ^ b).bit_count() <= 3}


def test_search_on_documents(spark, sf, monkeypatch):
    monkeypatch.setattr(f, "BUCKET", 5)
    made = op8_simhash_fingerprints(spark, sf.replace("0.001", "0.01")).select("doc_id", "fingerprint").collect()
    signed = lambda h: int(h, 16) - (int(h, 16) >> 63 << 64)
    fps = [signed(r.fingerprint) for r in made]
    rows = spark.createDataFrame([(r.doc_id, x) for r, x in zip(made, fps)], "doc_id long, fp long")
    got = {(r.query_fp, r.fp, r.documents) for r in f.near_fingerprints(rows.where("doc_id % 100 = 0"), rows).collect()}
    bits = lambda a, b: ((a ^ b) & (2**64 - 1)).bit_count()
    asked = {x for r, x in zip(made, fps) if r.doc_id % 100 == 0}
    assert got == {(a, b, fps.count(b)) for a in asked for b in set(fps) if bits(a, b) <= 3} and len(got) >= len(asked)


def test_odd_rows(odd, empty, spark):
    out = f.fingerprint_documents(odd).collect()
    assert len(out) == odd.count()
    assert {r.fingerprint for r in out if r.doc_id in (1, 2, 3)} == {"0" * 16}
    assert all(r.near_next == 1 - int(r.fingerprint, 16).bit_count() / 64 for r in out if r.doc_id is None)
    assert len({(r.fingerprint, r.edited_sha256) for r in out if r.doc_id == 4}) == 1
    assert f.fingerprint_documents(empty).count() == 0
    single = f.fingerprint_documents(spark.createDataFrame([(5, "abcdef")], "doc_id long, text string")).first()
    assert single.edited_sha256 == hashlib.sha256(b"abcdab").hexdigest() and single.near_next == 1
