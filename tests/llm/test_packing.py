import struct
import zlib
from itertools import product

from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from notemill.llm import packing
from notemill.llm.queries import TOKENIZERS, op7_minimum_bin_slack_packing

PATH = f"{TOKENIZERS}/word_bpe_49k.json"
WHOLE = Tokenizer.from_file(PATH)


def ids_of(text):
    return WHOLE.encode(text or "", add_special_tokens=False).ids + [2]


@settings(max_examples=60, deadline=None)
@given(st.dictionaries(st.integers(1, 12), st.integers(1, 3), max_size=4), st.integers(0, 30))
def test_fill_is_the_best_multiset(counts, capacity):
    chosen = packing.fill(dict(counts), capacity)
    assert all(0 < n <= counts[k] for k, n in chosen.items() if n)
    best = max(s for c in product(*[range(n + 1) for n in counts.values()]) if (s := sum(a * b for a, b in zip(c, counts))) <= capacity)
    assert sum(k * n for k, n in chosen.items()) == best


ODD = st.sampled_from([*"abZ'sStTrevmlLdD019.,!?-_ \t\n\x0b\x1c\x85\xa0éÉßİıŸſσςΣ中́ ", "<|endoftext|>", "<|ENDOFTEXT|>", "'LL"])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.one_of(ODD, st.characters(exclude_categories=["Cs"])), max_size=20).map("".join))
def test_ids_are_the_tokenizers(text):
    assert packing.runs_of(PATH).ids(text) == struct.pack(f"<{len(ids_of(text)) - 1}I", *ids_of(text)[:-1])


def check(out, texts, capacity):
    pieces, sequences = {}, {}
    for r in out:
        pieces.setdefault(r.doc_id, []).append(r)
        sequences.setdefault(r.sequence_id, []).append(r)
    for doc, own in pieces.items():
        ids = ids_of(texts[doc])
        own.sort(key=lambda r: r.start)
        at = 0
        for r in own:
            assert r.start == at and r.doc_tokens == len(ids) and 0 < r.length
            assert r.ids_crc32 == zlib.crc32(struct.pack(f"<{r.length}I", *ids[at : at + r.length]))
            at += r.length
        assert at == len(ids)
    padding = 0
    for own in sequences.values():
        own.sort(key=lambda r: r.offset)
        at = 0
        for r in own:
            assert r.offset == at
            at += r.length
        assert at <= capacity
        padding += capacity - at if at & (at - 1) else 0
    return padding


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = op7_minimum_bin_slack_packing(spark, sf).collect()
    assert {r.doc_id for r in out} == set(texts)
    assert check(out, texts, 4096) == 0


def test_small_capacity_and_pool(spark, monkeypatch):
    monkeypatch.setattr(packing, "POOL", 3)
    texts = {i: "word " * (i * 7 % 23) for i in range(60)}
    packer = packing.Packer(16, 0)
    for i, t in texts.items():
        packer.add(i, packing.runs_of(PATH).ids(t) + packing.END_ID.to_bytes(4, "little"))
    packer.finish()
    names = packing.SCHEMA.replace(" long", "").split(", ")
    rows = [type("R", (), dict(zip(names, r))) for r in packer.out]
    assert check(rows, texts, 16) == 0


def test_odd_rows(odd, empty):
    out = packing.pack_documents(odd, PATH).collect()
    assert sum(r.start == 0 for r in out) == odd.count()
    assert [(r.length, r.doc_tokens) for r in out if r.doc_id == 1] == [(1, 1)]
    assert packing.pack_documents(empty, PATH).count() == 0
