import math
from collections import Counter

import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from notemill.llm import pieces as p
from notemill.llm.queries import TOKENIZERS, op6_sampled_pieces

MODEL = f"{TOKENIZERS}/piece_bpe_32k.model"


@pytest.fixture(scope="module")
def runs():
    return p.Runs(p.Vocabulary(MODEL))


def segmentations(text, names, v):
    if not text:
        yield (), 0.0
    for n in range(1, min(p.LONGEST, len(text)) + 1):
        if text[:n] in names:
            weight, piece = v.weight[names[text[:n]]], names[text[:n]]
        elif n == 1:
            weight, piece = v.byte_weight, None
        else:
            continue
        for rest, more in segmentations(text[n:], names, v):
            yield (piece, *rest), weight + more


@pytest.mark.parametrize("text", [" there", "  ab", "token"])
def test_samples_follow_the_lattice_distribution(runs, text):
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=MODEL)
    names = {model.id_to_piece(i): i for i in range(259, model.get_piece_size())}
    every = dict(segmentations(p.MARK + text.replace(" ", p.MARK), names, runs.vocabulary))
    total = sum(map(math.exp, every.values()))
    n = 30000
    seen = Counter(tuple(x.tolist()) for x in p.encode([text] * n, list(range(n)), runs))
    assert set(seen) <= set(every)
    for k, w in every.items():
        share = math.exp(w) / total
        assert abs(seen[k] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(max_size=60), min_size=1, max_size=5))
def test_lossless_and_independent_of_the_batch(texts):
    runs = p.runs_of(MODEL)
    texts = [t.encode("utf-8", "ignore").decode() for t in texts]
    together = p.encode(texts, list(range(len(texts))), runs)
    for i, t in enumerate(texts):
        assert p.decode(together[i].tolist(), runs.vocabulary) == t
        assert p.encode([t], [i], p.Runs(runs.vocabulary))[0].tolist() == together[i].tolist()


def test_query(spark, sf):
    out = op6_sampled_pieces(spark, sf)
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    assert out.where("lossless AND n_pieces = size(ids)").count() == docs.count()
    back = {r.doc_id: r.text for r in p.decode_documents(out, MODEL).collect()}
    assert back == {r.doc_id: r.text for r in docs.collect()}


def test_odd_rows(odd, empty):
    out = p.encode_documents(odd, MODEL).collect()
    assert len(out) == odd.count() and all(r.lossless for r in out)
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r.ids)
    assert by[1] == [[]] and by[2] == [[]] and by[4][0] == by[4][1] == by[4][2]
    assert p.encode_documents(empty, MODEL).count() == 0
    assert p.encode_documents(odd, MODEL, seed=2).where("lossless").count() == len(out)
