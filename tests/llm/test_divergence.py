import os
import re
import subprocess
import sys
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import divergence
from notemill.llm.queries import op11_systolic_divergence

TERM = re.compile("[^\x00-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "text string, lang string, source string"


def brute(docs, term_ranks=200):
    """Rows from (text, lang, source), over the whole matrix."""
    counts, held = defaultdict(Counter), defaultdict(Counter)
    for text, lang, source in docs:
        found = TERM.findall((text or "").translate(LOWER))
        counts[lang or "", source or ""].update(found)
        held[lang or ""].update(set(found))
    out = []
    for lang in {k for k, _ in counts}:
        kept = sorted(t for t, n in held[lang].items() if n >= 3)
        own = {s: counts[lang, s] for g, s in counts if g == lang}
        share = lambda c: {t: 1 + 1_000_000_000 * (c[t] + 1) // (sum(c[x] for x in kept) + len(kept)) for t in kept}
        p = {s: share(c) for s, c in own.items()}
        q = share(sum(own.values(), Counter()))
        f = lambda a, b: (a - b) ** 2 // b
        for s in own:
            pairs = [(h, sum(f(p[s][t], p[h][t]) for t in kept)) for h in own if h != s]
            terms = [(t, f(p[s][t], q[t])) for t in kept if own[s][t] and p[s][t] > q[t]]
            for part, found, most in (("pair", pairs, None), ("term", terms, term_ranks)):
                ranked = sorted(found, key=lambda x: (-x[1], x[0].encode()))[:most]
                out += [(lang, s, part, item, value, i) for i, (item, value) in enumerate(ranked, 1)]
    return sorted(out)


def ran(df):
    assert df.columns == ["lang", "source", "part", "item", "value", "rank"]
    return sorted(tuple(r) for r in df.collect())


def documents(spark, sf):
    return [tuple(r) for r in spark.read.parquet(f"{sf}/documents.parquet").select("text", "lang", "source").collect()]


def test_query(spark, sf):
    assert ran(op11_systolic_divergence(spark, sf)) == brute(documents(spark, sf))


def test_sql(spark, sf):
    with duckdb.connect() as db:
        db.execute(f"CREATE VIEW documents AS FROM '{sf}/documents.parquet'")
        assert sorted(db.execute(divergence.SQL).fetchall()) == brute(documents(spark, sf))


@pytest.mark.parametrize("residents, slice_rows", [(1, 8), (2, 64), (3, 1 << 14), (50, 16)])
def test_blocks_and_slices_change_nothing(spark, monkeypatch, residents, slice_rows):
    monkeypatch.setattr(divergence, "RESIDENTS", residents)
    monkeypatch.setattr(divergence, "SLICE_ROWS", slice_rows)
    rng = np.random.default_rng(3)
    words = [f"w{chr(97 + i)}{'é' * (i % 3)}" for i in range(24)]
    docs = [(" ".join(rng.choice(words, p=np.arange(1, 25) / 300, size=rng.integers(0, 40))), "en", f"s{rng.integers(0, 11)}") for _ in range(120)]
    docs += [("only one doc here", "fr", "x"), ("", "fr", "y"), (None, None, None)]
    assert ran(divergence.audit_documents(spark.createDataFrame(docs, DOCS))) == brute(docs)


@pytest.mark.parametrize("blocks", range(1, 10))
def test_every_two_blocks_meet_once(spark, blocks):
    from pyspark.sql import functions as F

    ids = spark.range(blocks).select(F.col("id").cast("int").alias("b"), F.lit(blocks).alias("n"))
    rows = ids.select("b", divergence.meetings(F.col("b"), F.col("n")).alias("v")).select("b", "v.round", "v.cell").collect()
    assert sorted(r.b for r in rows if r.round == 0 and r.cell == r.b) == list(range(blocks))
    away = [r for r in rows if r.round]
    assert sorted({min(r.b, r.cell), max(r.b, r.cell)} for r in away) == sorted({a, b} for a in range(blocks) for b in range(a + 1, blocks)) or len(away) == blocks * (blocks - 1) // 2
    assert len({frozenset((r.b, r.cell)) for r in away}) == len(away) == blocks * (blocks - 1) // 2
    for turn in {r.round for r in away}:
        playing = [x for r in away if r.round == turn for x in (r.b, r.cell)]
        assert len(playing) == len(set(playing))


@settings(max_examples=200, deadline=None)
@given(st.integers(0, 10**14), st.integers(0, 10**14))
def test_shares_are_exact(n, more):
    m = n + 1 + more
    assert divergence.shares(np.array([n]), m).tolist() == [1 + 10**9 * (n + 1) // m]


def test_terms_of_a_long_text_in_pieces(monkeypatch):
    text = "Ab cé  DE'f 12 x\u0000Y " * 300
    monkeypatch.setattr(divergence, "PIECE", 64)
    pieces = list(divergence.terms(text))
    assert len(pieces) > 50
    assert [t.decode() for p in pieces for t in p] == TERM.findall(text.translate(LOWER))


def test_packed_vectors_come_back():
    places, n = np.array([0, 3, 4, 900]), np.array([1, 7, 10**12, 2])
    for got, want in zip(divergence.unpacked(divergence.packed(places, n)), (places, n)):
        assert got.tolist() == want.tolist()


def test_odd_rows(odd, empty, monkeypatch):
    monkeypatch.setattr(divergence, "HELD", 3)
    assert ran(divergence.audit_documents(odd)) == brute([(r.text, r.lang, r.source) for r in odd.collect()])
    assert divergence.audit_documents(empty).count() == 0


def test_langs_without_kept_terms_and_ties(spark):
    docs = [("a b", "x", "s1"), ("c", "x", "s2"), (None, "x", "s3"), ("12 !", "y", "only")] + [("B a", "z", s) for s in "qrst"] + [("zz yy", "z", "q")] * 3
    got = ran(divergence.audit_documents(spark.createDataFrame(docs, DOCS)))
    assert got == brute(docs)
    assert [r for r in got if r[0] == "x"] and all(r[4] == 0 for r in got if r[0] == "x") and not [r for r in got if r[0] == "y"]


def test_a_fresh_worker_has_what_a_slice_needs():
    # In a worker that imported nothing else, pyarrow brings no compute module by itself.
    code = "import sys; import pyarrow; from notemill.llm import divergence; assert 'pyarrow.compute' in sys.modules"
    assert subprocess.run([sys.executable, "-c", code], cwd=os.path.dirname(os.path.dirname(os.path.dirname(__file__)))).returncode == 0
