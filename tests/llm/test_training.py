"""The models are trained in a task; the driver gets the model alone."""

from notemill.llm import language, quality


def test_training_leaves_the_driver_alone(spark, monkeypatch):
    texts = [(i, "good words stand here" if i % 2 else "bad bad junk", "en" if i % 2 else "de") for i in range(60)]
    docs = spark.createDataFrame(texts, "doc_id long, text string, lang string").repartition(4)
    labels = spark.createDataFrame([(i, i % 2) for i in range(60)], "doc_id long, quality int")

    def barred(rows):
        raise AssertionError("trained on the driver")

    for module in (quality, language):
        monkeypatch.setattr(module, "train", barred)
    table, bias = quality.fit(docs, labels)
    assert quality.score("good words stand here", table, bias) > 0.5 > quality.score("bad bad junk", table, bias)
    model = language.fit(docs)
    assert [language.predict(t, model)[0] for t in ("good words stand here", "bad bad junk")] == ["en", "de"]
