import corpus_pipeline as pipeline

from notemill.llm import secrets
from tests.llm.test_near_copies import brute_classes


def test_stages_on_what_the_one_before_kept(spark, sf, tmp_path):
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    columns, kept = docs.columns, []
    for name, stage in pipeline.STAGES[:-1]:
        stage(spark, docs, sf).write.parquet(str(tmp_path / name))
        docs = spark.read.parquet(str(tmp_path / name))
        assert docs.columns == columns
        kept.append({r.doc_id: r.text for r in docs.collect()})
    labels = {r.doc_id: r.quality for r in spark.read.parquet(f"{sf}/labels.parquet").collect()}
    good = [d for d, q in labels.items() if q == 1]
    assert sum(d in kept[0] for d in good) / len(good) > 0.97
    assert kept[1].keys() <= kept[0].keys() and len(kept[1]) > 0.98 * len(kept[0])
    # Near copies go as well as copies: what stays is the first document of each class that brute force finds.
    ids = sorted(kept[1])
    classes = brute_classes([kept[1][d] for d in ids])
    assert kept[2].keys() == {ids[c] for c in classes} and all(kept[2][d] == kept[1][d] for d in kept[2])
    assert kept[3].keys() == kept[2].keys()
    changed = [d for d in kept[3] if kept[3][d] != kept[2][d]]
    assert all(secrets.MASK in kept[3][d] for d in changed)
    packed = pipeline.STAGES[-1][1](spark, docs, sf).collect()
    assert {r.doc_id for r in packed} == kept[3].keys()


def test_run(spark, sf):
    out = pipeline.run(spark, sf)
    assert out.columns == ["doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset"] and out.count() > 0
    assert [n for n, _ in pipeline.STAGES] == ["quality_classifier", "language_id", "near_dedup", "secret_scan", "packing"]


def test_odd_rows(odd, empty, spark, sf):
    for docs in (odd, empty):
        for _, stage in pipeline.STAGES[:-1]:
            docs = stage(spark, docs, sf)
        assert docs.columns == odd.columns
        pipeline.STAGES[-1][1](spark, docs, sf).count()
