import pytest

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, score double, fp long, shard int"


def rows(*texts, start=1):
    return [(start + i, t, "en", "src", len(t or ""), 0.5, 7, 3) for i, t in enumerate(texts)]


@pytest.fixture(scope="session")
def odd(spark):
    """Nulls in every column, empty and long texts, repeated rows, and extra columns whose names clash."""
    long = "long words of text " * 30000
    data = [*rows(None, "", " \n\t ", "one", "The same text here.", "The same text here.", long, "x" * 50000, "Ünï ▁ 中文 👍 \x00 <|endoftext|>"), (None, "no id", None, None, None, None, None, None), (None, None, None, None, None, None, None, None)]
    return spark.createDataFrame([*data, data[3], data[3]], SCHEMA)


@pytest.fixture(scope="session")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)
