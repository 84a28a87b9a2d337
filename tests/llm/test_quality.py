import numpy as np

from notemill.llm import quality
from notemill.llm.queries import op10_subword_quality


def test_query_on_held_out_labels(spark, sf):
    sf = sf.replace("0.001", "0.01")
    out = {r.doc_id: r for r in op10_subword_quality(spark, sf).collect()}
    labels = spark.read.parquet(f"{sf}/labels.parquet").collect()
    assert len(out) == spark.read.parquet(f"{sf}/documents.parquet").count()
    held = [(out[r.doc_id].predicted == r.quality) for r in labels if r.doc_id in out and out[r.doc_id].held_out]
    assert len(held) > 20 and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.3) for r in out.values())


def test_held_out_labels_teach_nothing(spark, sf):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    labels = spark.read.parquet(f"{sf}/labels.parquet")
    before = {r.doc_id: r.score for r in quality.score_documents(docs, labels).collect()}
    held = [r.doc_id for r in quality.score_documents(docs, labels).collect() if r.held_out]
    turned = labels.withColumn("quality", (1 - labels.quality) * labels.doc_id.isin(held).cast("int") + labels.quality * (~labels.doc_id.isin(held)).cast("int"))
    assert before == {r.doc_id: r.score for r in quality.score_documents(docs, turned).collect()}


def test_score_is_the_mean_projection():
    rows = [(*quality.counted(t), y) for t, y in (("good words here", 1), ("BAD!! BAD!! BAD!!", 0)) for _ in range(20)]
    table, bias = quality.train(rows)
    buckets, counts = quality.counted("good words here")
    logit = bias + float((table[buckets] * counts).sum() / counts.sum())
    assert abs(quality.score("good words here", table, bias) - 1 / (1 + np.exp(-logit))) < 1e-5
    assert quality.score("good words", table, bias) > quality.score("BAD!! BAD!!", table, bias)


def test_long_texts_go_in_pieces(monkeypatch):
    from notemill.llm import features

    text = "some words and more " * 200
    whole = dict(zip(*[x.tolist() for x in quality.counted(text)]))
    monkeypatch.setattr(features, "PIECE", 500)
    parts = dict(zip(*[x.tolist() for x in quality.counted(text)]))
    assert whole.keys() <= parts.keys()


def test_odd_rows(odd, empty, spark):
    labels = spark.createDataFrame([(5, 1, 0), (7, 0, None), (5, 1, None), (None, 1, 1), (8, None, 1)], "doc_id long, quality int, toxic int")
    out = quality.score_documents(odd, labels).collect()
    assert len(out) == odd.count()
    assert len({r.score for r in out if r.doc_id in (1, 2)}) == 1
    none = spark.createDataFrame([], labels.schema)
    assert {r.score for r in quality.score_documents(odd, none).collect()} == {0.5}
    assert quality.score_documents(empty, labels).count() == 0
    assert quality.keep_good(odd, labels).columns == odd.columns
