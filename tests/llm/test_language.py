import numpy as np

from notemill.llm import language
from notemill.llm.queries import op2_ftrl_language_id


def test_query_is_right_on_held_out_documents(spark, sf):
    out = {r.doc_id: r for r in op2_ftrl_language_id(spark, sf).collect()}
    docs = spark.read.parquet(f"{sf}/documents.parquet").collect()
    assert len(out) == len(docs)
    held = [(out[d.doc_id].lang_pred == d.lang) for d in docs if out[d.doc_id].held_out]
    assert held and np.mean(held) > 0.95
    assert all(0 <= r.score <= 1 for r in out.values())


def test_held_out_rows_teach_nothing(spark):
    # crc32 of 5 mod 5 is not 0 for these ids only by chance, so take both kinds from the operator itself.
    rows = [(i, "bonjour le monde" if i % 2 else "hello the world", "fr" if i % 2 else "en") for i in range(200)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    held = [r.doc_id for r in language.identify(df).collect() if r.held_out]
    changed = df.rdd.map(lambda r: (r.doc_id, r.text, "xx" if r.doc_id in held else r.lang)).toDF("doc_id long, text string, lang string")
    assert {r.lang_pred for r in language.identify(changed).collect()} == {"en", "fr"}


def test_penalties_leave_weights_at_zero_and_temperature_calibrates():
    rng = np.random.default_rng(0)
    rows = [(*language.counted(" ".join(rng.choice(w, 30))), y) for y, w in (("a", ["the", "and", "of"]), ("b", ["der", "und", "von"])) for _ in range(40)]
    model = language.train(rows)
    assert (model.weights == 0).mean() > 0.9
    assert language.predict("the and of", model)[0] == "a"
    logits = np.array([[5.0, 0.0]] * 10)
    labels = np.array([0] * 7 + [1] * 3)
    assert abs(language.probabilities(logits, language.best_temperature(logits, labels))[0, 0] - 0.7) < 0.01


def test_odd_rows(odd, empty):
    out = language.identify(odd).collect()
    assert len(out) == odd.count()
    by = {}
    for r in out:
        by.setdefault(r.doc_id, []).append(r)
    assert all(by[i][0].lang_pred == "und" and by[i][0].score == 0 for i in (1, 2, 3))
    assert all(r.lang_pred == "en" for i in (4, 5, 7, 8, 9) for r in by[i])
    assert len({(r.lang_pred, r.score) for r in by[4]}) == 1
    assert language.identify(empty).count() == 0
    assert language.keep_identified(empty).columns == empty.columns
    assert {r.lang_pred for r in language.identify(odd.selectExpr("doc_id", "text", "cast(null as string) lang")).collect()} == {"und"}
