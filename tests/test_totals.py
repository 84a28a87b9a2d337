import pytest
from pyspark.sql import functions as F

from notemill.operators import services, tags, vectors
from notemill.sources import config, templates
from tests.test_links import COLUMNS, note


def test_catalogue_of_patterns(spark):
    one = tags.add_pattern((), "c", "n", ["k"], 0.5, 7)
    assert tags.update_pattern(one, "c", "n", keywords=["x"], weight=1.5) == (("c", 7, "n", ("x",), 1.5),)
    with pytest.raises(ValueError):
        tags.update_pattern(one, "c", "other")
    assert tags.from_json(tags.as_json(tags.TAG_PATTERNS)) == tags.TAG_PATTERNS
    assert tags.merged(one, (("c", 1, "n", ["z"], 1.0), ("d", 2, "m", ["y"], 1.0))) == (("c", 7, "n", ("z",), 1.0), ("d", 2, "m", ("y",), 1.0))
    assert [p[1] for p in tags.listed()] == sorted((p[1] for p in tags.TAG_PATTERNS), reverse=True) and {p[0] for p in tags.listed(category="concepts")} == {"concepts"}
    n = spark.createDataFrame([note("a", "python django flask", tags=["python"]), note("b", "python pandas", tags=[])], COLUMNS)
    assert {(r.path, r.pattern, r.status) for r in tags.with_status(tags.suggestions(n), n, 0.4).collect()} == {("a", "python", "Current"), ("b", "python", "New")}
    assert tags.vault_statistics(n).first().asDict() == {"notes": 2, "tagged": 1, "tags": 1, "uses": 1, "single": 1}


def test_services_of_a_callable(spark):
    n = spark.createDataFrame([note("a", "Spark reads my_data fast", "1", "T"), note("b", "nothing", "2", "U")], COLUMNS)
    answer = lambda texts: ["CONCEPTS: my_data, Spark,, unheard of thing\nTAGS: x, y\nDESCRIPTION: Some text.\nSCORE: 1.7\nRELATIONSHIP: same\nCONFIDENCE: much" if "Spark" in t else "no sections" for t in texts]
    got = {(r.path, r.concept): round(r.confidence, 6) for r in services.concepts(n, answer).collect()}
    assert got == {("a", "my_data"): 0.9, ("a", "Spark"): 0.9, ("a", "unheard of thing"): 0.6}
    meta = {r.path: (r.tags, r.aliases, r.description) for r in services.suggested_metadata(n, answer).collect()}
    assert meta == {"a": (["x", "y"], [], "Some text."), "b": ([], [], None)}
    pairs = spark.createDataFrame([("p", "q", "Spark", "z"), ("p", "r", "w", "z")], "a string, b string, text_a string, text_b string")
    assert {(r.b, r.relationship, r.confidence) for r in services.relationships(pairs, answer).collect()} == {("q", "same", 0.5), ("r", "", 0.5)}
    choices = pairs.select(F.col("a").alias("key"), F.col("text_b").alias("text"), F.col("b").alias("target_id"), F.col("text_a").alias("target_text"))
    assert [(r.target_id, r.score, r["rank"]) for r in services.disambiguated(choices, answer).orderBy("rank").collect()] == [("q", 1.0, 1), ("r", 0.5, 2)]


def test_semantic_candidates(spark):
    n = spark.createDataFrame([note("a", "x", "1", "T"), note("b", "y", "2", "U"), note("c", "z", None, None)], COLUMNS)
    index = spark.createDataFrame([("1", [1.0, 0.0]), ("2", [0.8, 0.6]), ("c", [0.0, 1.0])], "document_id string, vector array<double>")
    for block in (1, 100):
        hits = vectors.semantic_links(index, index, 1, 0.5, block)
        assert {(r.document_id, r.other_id, round(r.similarity, 6)) for r in hits.collect()} == {("1", "2", 0.8), ("2", "1", 0.8), ("c", "2", 0.6)}
    found = vectors.semantic_candidates(hits, n)
    assert {(r.path, r.target_file_id, r.text) for r in found.collect()} == {("a", "2", "U"), ("b", "1", "T"), ("c", "2", "U")}
    lexical = found.withColumn("source_type", F.lit("title"))
    assert vectors.all_candidates(lexical, found).count() == 6


def test_settings_and_templates(spark, tmp_path):
    path = tmp_path / "own.yaml"
    path.write_text("max_links: 7\nexclude_tables: yes\nspellings: {db: [database]}\ninclude: ['a/*.md']\n")
    got = config.load(str(path), {"NOTEMILL_THRESHOLD": "0.5"})
    assert (got.max_links, got.exclude_tables, got.threshold, got.spellings, got.include) == (7, True, 0.5, (("db", ("database",)),), ("a/*.md",))
    assert config.load(environment={}) == config.Config()
    path.write_text("nonsense: 1")
    with pytest.raises(ValueError):
        config.load(str(path), {})
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.yaml"))
    raws = spark.createDataFrame([("v/Templates/t.md", "---\ntitle: x\n---\n"), ("v/Templates/deep/u.md", ""), ("v/n.md", "")], "path string, raw string")
    assert set(templates.schemas(templates.scan(raws))) == {"t"}
