import hashlib
from collections import Counter

import numpy as np
import pytest
import regex
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from notemill.llm import bpe
from notemill.llm.lexicon import Lexicon, compiled
from notemill.llm.queries import TOKENIZERS, op13_transducer_bpe

PATH = f"{TOKENIZERS}/byte_bpe_50k.json"
WHOLE = Tokenizer.from_file(PATH)
WORD = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")


def file_of(folder, words):
    path = folder / "lexicon"
    path.write_bytes(compiled(sorted(words.items())))
    return Lexicon(str(path))


def looked_up(lexicon, words):
    n = np.array([len(w) for w in words], dtype=np.int64)
    found, counts, pool = lexicon.lookup(np.frombuffer(b"".join(words), dtype=np.uint8), np.cumsum(n) - n, np.cumsum(n))
    ends = np.cumsum(counts * found)
    return {w: tuple(pool[e - c : e].tolist()) if f else None for w, f, c, e in zip(words, found, counts, ends)}


@settings(max_examples=150, deadline=None)
@given(st.dictionaries(st.binary(min_size=1, max_size=5), st.lists(st.integers(0, 3), max_size=4).map(tuple), max_size=30), st.lists(st.binary(min_size=1, max_size=6), max_size=10))
def test_transducer_is_the_dictionary(tmp_path_factory, words, others):
    asked = [*words, *others]
    assert looked_up(file_of(tmp_path_factory.mktemp("lexicon"), words), asked) == {w: words.get(w) for w in asked}


def test_endings_and_beginnings_are_shared(tmp_path):
    words = {a + b: (1, 2) for a in (b"walk", b"talk", b"stalk") for b in (b"", b"s", b"ed", b"ing")}
    lexicon = file_of(tmp_path, words)
    # The start, what s leaves, three on the way through alk, its end, and e, i, n and the last of the endings.
    assert len(lexicon.final) == 10
    with pytest.raises(ValueError):
        compiled([(b"b", (1,)), (b"a", (1,))])


def test_outputs_stand_as_early_as_they_can(tmp_path):
    lexicon = file_of(tmp_path, {b"ab": (7, 8), b"ac": (7, 9), b"a": (7,)})
    root = [lexicon.pool[lexicon.out_at[i] : lexicon.out_at[i + 1]].tolist() for i in range(len(lexicon.target))][-1]
    assert root == [7]


ODD = st.sampled_from([*"abZ'sStTrevmlLdD019.,!?-_ \t\n\x0b\x1c\x85\xa0\u3000éÉßİ中́👍\u0558\u088f\U00018d10\x00", "<|endoftext|>", "<|", "'ll", " '", "  "])


@settings(max_examples=400, deadline=None)
@given(st.lists(st.lists(st.one_of(ODD, st.characters(exclude_categories=["Cs"])), max_size=20).map("".join), min_size=1, max_size=5))
def test_ids_and_text_are_the_tokenizers(tmp_path_factory, texts):
    words = bpe.vocabulary(PATH)
    some = {w.encode(): tuple(words.merged(w.encode())) for w in (" and", "and", "'s", " a", "ab", "é")}
    ids, n = bpe.encoded(texts, words, file_of(tmp_path_factory.mktemp("lexicon"), some))
    ends = np.cumsum(n)
    for text, e, k in zip(texts, ends, n):
        expected = WHOLE.encode(text, add_special_tokens=False).ids
        assert ids[e - k : e].tolist() == expected
        assert words.decoded(ids[e - k : e]) == WHOLE.decode(expected, skip_special_tokens=False) == text


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 50256), max_size=12))
def test_any_ids_decode_as_the_tokenizer_does(ids):
    assert bpe.vocabulary(PATH).decoded(np.array(ids, dtype=np.int64)) == WHOLE.decode(ids, skip_special_tokens=False)


@settings(max_examples=200, deadline=None)
@given(st.lists(st.binary(min_size=1, max_size=40), max_size=30))
def test_merging_in_step_is_merging_one_by_one(words):
    v = bpe.vocabulary(PATH)
    assert v.merged_all(words * 4) == [v.merged(w) for w in words] * 4


def test_pieces_cut_no_word():
    text = "a b  c\n d's  \t x" * 200
    bpe_piece, bpe.PIECE = bpe.PIECE, 50
    try:
        pieces = list(bpe.cut_pieces(text))
    finally:
        bpe.PIECE = bpe_piece
    assert len(pieces) > 20 and "".join(pieces) == text
    assert [w for p in pieces for w in WORD.findall(p)] == WORD.findall(text)


def expected(text):
    ids = WHOLE.encode(text or "", add_special_tokens=False).ids
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    return len(ids), sha(",".join(map(str, ids))), sha(WHOLE.decode(ids, skip_special_tokens=False))


def test_query(spark, sf):
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    out = {r.doc_id: tuple(r)[1:] for r in op13_transducer_bpe(spark, sf).collect()}
    assert out == {k: expected(t) for k, t in texts.items()}


def test_odd_rows(odd, empty, monkeypatch):
    got = Counter(tuple(r) for r in bpe.digests(odd, PATH).collect())
    assert got == Counter((r.doc_id, *expected(r.text)) for r in odd.collect())
    assert bpe.digests(empty, PATH).count() == 0
    back = bpe.decode_documents(bpe.encode_documents(odd, PATH, 5), PATH)
    assert Counter((r.doc_id, r.text) for r in back.collect()) == Counter((r.doc_id, r.text or "") for r in odd.collect())
    loose = odd.sparkSession.createDataFrame([(1, [None, 50257, 10**6, -1, 64]), (2, None), (3, [])], "doc_id long, ids array<int>")
    assert {r.doc_id: r.text for r in bpe.decode_documents(loose, PATH).collect()} == {1: "a", 2: "", 3: ""}


def test_long_texts_and_a_lexicon_of_any_size(spark):
    texts = ["x" * 300_000, "de " * 1_000_000 + "end", "  \n" * 100_000, "中文" * 50_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for most in (0, 3, 1000):
        out = {r.doc_id: r.ids for r in bpe.encode_documents(docs, PATH, most).collect()}
        assert out == {i: WHOLE.encode(t, add_special_tokens=False).ids for i, t in enumerate(texts)}


def test_frequent_words_keep_the_bound(spark):
    rows = [(f"w{i}".encode(), 1 + i // 3) for i in range(600)]
    counts = spark.createDataFrame(rows, "word binary, n long")
    for most in (0, 1, 7, 100, 10_000):
        kept = {bytes(r.word) for r in bpe.frequent(counts, most).collect()}
        assert len(kept) <= most
        least = min((n for w, n in rows if w in kept), default=None)
        assert least is None or kept == {w for w, n in rows if n >= least}
    assert bpe.frequent(counts, 100).count() > 50


def test_words_are_counted_over_all_texts(spark):
    docs = spark.createDataFrame([(i, "the cat, the hat") for i in range(50)] + [(99, None)], "doc_id long, text string")
    counts = {bytes(r.word): r.n for r in bpe.word_counts(docs, PATH).collect()}
    assert counts == {b" the": 100, b" cat": 50, b",": 50, b" hat": 50}
