import numpy as np
import pyarrow as pa
import pytest

from notemill.llm import neighbours as n


def table(spark, vectors, start=0):
    return spark.createDataFrame([(start + i, None if v is None else [None if x is None else float(x) for x in v], 1) for i, v in enumerate(vectors)], "vec_id long, embedding array<float>, label int")


def exact(vectors, q, k):
    s = [(-sum(float(np.float32(a)) * float(np.float32(b)) for a, b in zip(vectors[q], v)), i) for i, v in enumerate(vectors) if i != q]
    return [i for _, i in sorted(s)[:k]]


def test_recall_on_random_vectors_in_blocks(spark):
    rng = np.random.default_rng(0)
    vectors = rng.standard_normal((3000, 32)) * rng.uniform(0.5, 2, (3000, 1))
    out = n.nearest(table(spark, vectors), 20, 100, block=1500).collect()
    hits = total = 0
    for q in range(0, 3000, 100):
        own = sorted((r for r in out if r.query_id == q), key=lambda r: r.rank)
        assert [r.rank for r in own] == list(range(1, 21))
        assert all(abs(r.score - float(vectors[q].astype(np.float32).astype(float) @ vectors[r.vec_id].astype(np.float32).astype(float))) < 1e-9 for r in own)
        assert [(-r.score, r.vec_id) for r in own] == sorted((-r.score, r.vec_id) for r in own)
        hits += len({r.vec_id for r in own} & set(exact(vectors, q, 20)))
        total += 20
    assert hits / total >= 0.9


@pytest.mark.parametrize(("size", "every"), [(500, 20), (5000, 100), (50000, 1000)])
def test_recall_at_every_size(spark, size, every):
    """Unit vectors without any structure, the hardest case; the smallest table is one block, the largest seven."""
    x = np.random.default_rng(size).standard_normal((size, 64)).astype(np.float32)
    x /= np.linalg.norm(x, axis=1)[:, None]
    arrow = pa.table({"vec_id": np.arange(size), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), 64).cast(pa.list_(pa.float32()))})
    found = {}
    for r in n.nearest(spark.createDataFrame(arrow), 20, every).collect():
        found.setdefault(r.query_id, set()).add(r.vec_id)
    wide, hits = x.astype(float), 0
    for q in range(0, size, every):
        s = wide @ wide[q]
        s[q] = -np.inf
        hits += len(found[q] & set(np.argsort(-s)[:20].tolist()))
    assert hits / (20 * len(found)) >= 0.9 and len(found) == size // every


def test_query_recall(spark):
    from notemill.llm.queries import op5_collision_counting_neighbours

    for sf in ("/root/testdata/sf0.01", "/root/testdata/sf0.1"):
        rows = sorted(spark.read.parquet(f"{sf}/embeddings.parquet").collect(), key=lambda r: r.vec_id)
        x = np.array([r.embedding for r in rows], dtype=float)
        ids = np.array([r.vec_id for r in rows])
        found = {}
        for r in op5_collision_counting_neighbours(spark, sf).collect():
            found.setdefault(r.query_id, set()).add(r.vec_id)
        hits = 0
        for q in found:
            s = x @ x[ids == q][0]
            s[ids == q] = -np.inf
            hits += len(found[q] & set(ids[np.argsort(-s)[:20]]))
        assert hits / (20 * len(found)) >= 0.9 and len(found) == (ids % 20 == 0).sum()


def test_few_and_unusable_vectors(spark):
    good = [[1, 0], [1, 0], [0.5, 0.5], [-1, 0]]
    bad = [None, [0, 0], [float("nan"), 1], [float("inf"), 1], [None, 1], [], [1, 2, 3]]
    out = n.nearest(table(spark, good + bad), 20, 4).collect()
    assert [(r.query_id, r.rank, r.vec_id) for r in sorted(out, key=lambda r: (r.query_id, r.rank))] == [(0, 1, 1), (0, 2, 2), (0, 3, 3)]
    assert n.nearest(table(spark, []), 20, 20).count() == 0


def test_other_rows_of_the_same_id_are_candidates(spark):
    twice = table(spark, [[1, 0], [1, 0], [0.5, 0.5]]).union(table(spark, [[1, 0], [0.9, 0], [0.5, 0.5]]))
    own = sorted((r for r in n.nearest(twice, 4, 4).collect()), key=lambda r: r.rank)
    assert [(r.query_id, r.vec_id, r.score) for r in own] == [(0, 0, 1.0), (0, 1, 1.0), (0, 1, pytest.approx(0.9)), (0, 2, 0.5)]


@pytest.mark.parametrize("scale", [1e-300, 1e-200, 1e-30, 1e30, 1e200, 1e300])
def test_vectors_of_any_finite_magnitude(spark, scale):
    x = np.random.default_rng(2).standard_normal((60, 8))
    rows = [(i, (v * scale).tolist(), "clash", i) for i, v in enumerate(x)] + [(60, [1.0] * 8, None, 0), (61, [-1.0] * 8, None, 0)]
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>, score string, rank int")
    out = {}
    for r in n.nearest(df, 70, 20).collect():
        out.setdefault(r.query_id, []).append(r)
    # With as many asked for as there are rows, every search goes to its end.
    assert sorted(out) == [0, 20, 40, 60] and all(len(v) == 61 for v in out.values())
    with np.errstate(over="ignore", invalid="ignore"):
        assert all(r.score == pytest.approx(float((x[0] * scale * (x[r.vec_id] * scale)).sum()), nan_ok=True) for r in out[0] if r.vec_id < 60)


@pytest.mark.parametrize("lengths", ["sigma 0.25", "sigma 0.5", "one of 2", "one of 5", "one of 1000"])
def test_recall_of_a_full_block_with_unequal_lengths(lengths):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((n.BLOCK, 64))
    x /= np.linalg.norm(x, axis=1)[:, None]
    kind, value = lengths.rsplit(" ", 1)
    if kind == "sigma":
        x *= rng.lognormal(0, float(value), (n.BLOCK, 1))
    else:
        x[5] *= float(value)
    index, hits, verified, asked = n.Index(x), 0, 0, range(0, n.BLOCK, 128)
    for q in asked:
        at, scores, _ = index.search(x[q], 21)
        best = x @ x[q]
        best[q] = -np.inf
        hits += len({int(i) for i in at[np.argsort(-scores)] if i != q} & set(np.argsort(-best)[:20].tolist()))
        verified += counted(index, x[q])
    assert hits / (20 * len(asked)) >= 0.9
    assert verified / len(asked) < n.BLOCK / 4


def counted(index, query):
    """How many vectors of a block the windows of a search verify."""
    tau = index.search(query, 21)[2]
    centre = query / np.linalg.norm(query) @ index.directions[:-1]
    return sum(len(n.Count(g, centre).grow(tau)) for g in index.groups)


def test_growing_windows_count_what_windows_of_that_width_hold():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((700, 16))
    index = n.Index(x)
    direction = x[3] / np.linalg.norm(x[3])
    centre = direction @ index.directions[:-1]
    for group in index.groups:
        grown, last = n.Count(group, centre), None
        for share in (0.9, 0.5, 0.2, -0.3, -1.0):
            tau = share * group.length
            grown.grow(tau)
            half, flat = group.half(tau), group.projected.reshape(n.PROJECTIONS, -1)
            inside = np.abs(flat - (centre * group.length + group.shifts)[:, None]) <= half
            brute = np.zeros(len(group.members), dtype=int)
            for p in range(n.PROJECTIONS):
                brute[group.order[p][inside[p]]] += 1
            assert np.abs(brute - grown.counts).max() <= 1  # the bounds differ by rounding at most
            assert last is None or (grown.counts >= last).all()
            last = grown.counts.copy()
