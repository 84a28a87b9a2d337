import os
import re
import shutil
import subprocess
import sys

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from notemill.functions.dictionaries import STOP_WORDS_EN, TECHNICAL_TERMS
from notemill.operators import analysis, enhancement, keywords, mentions, report, services, tags, vectors
from notemill.sources import adapters
from notemill.streaming import index
from tests.test_links import COLUMNS, note


def test_keywords(spark):
    text = "---\na: b\n---\nThe APIServer uses snake_case and kebab-case in API `code` http://x.y/z [Link text](u) 日本語 データベース 12345 ab écran " + "x" * 60
    got = {r.keyword: r.weight for r in keywords.note_keywords(spark.createDataFrame([note("p.md", text)], COLUMNS)).collect()}
    assert got == {"APIServer": 1.3, "uses": 1.0, "snake_case": 1.1, "kebab-case": 1.1, "API": 1.5, "Link": 1.3, "日本語": 1.0, "データベース": 1.0}
    many = " ".join(f"word{chr(97 + i // 26)}{chr(97 + i % 26)}" for i in range(150)) + " Zebra"
    got = [r.keyword for r in keywords.note_keywords(spark.createDataFrame([note("p.md", many)], COLUMNS)).collect()]
    assert len(got) == 100 and got[0] == "Zebra" and got[1:] == sorted(got[1:])
    assert "API" in TECHNICAL_TERMS and len(STOP_WORDS_EN) > 80


def test_tags(spark):
    n = spark.createDataFrame([note("a", "Python and django with pandas", tags=["x", "y", "x"]), note("b", "サーヴィス service", tags=["x"]), note("c", "", tags=["z"])], COLUMNS)
    assert {(r.tag, r.files) for r in tags.frequencies(n).collect()} == {("x", 2), ("y", 1), ("z", 1)}
    assert {(r.tag, r.other, r.together, r.strength) for r in tags.cooccurrence(n).collect()} == {("x", "y", 1, 0.5), ("y", "x", 1, 1.0)}
    assert [(r.tag, r.other) for r in tags.related(tags.cooccurrence(n), "x", 0.6).collect()] == []
    assert {r.tag for r in tags.rare(n).collect()} == {"y", "z"}
    found = {(r.path, r.pattern): r.confidence for r in tags.suggestions(n).collect()}
    assert found[("a", "python")] == pytest.approx(0.95) and ("b", "service") in found
    assert {(r.path, r.other) for r in tags.related_for_notes(n, tags.cooccurrence(n)).collect()} == {("b", "y")}
    more = tags.add_pattern((), "c", "n", ["k"])
    assert tags.search("k", more) and tags.remove_pattern(more, "c", "n") == ()
    with pytest.raises(ValueError):
        tags.add_pattern(more, "c", "n", ["k"])
    assert {"サーヴィス", "サーブィス"} & set(tags.spelled("サーヴィス"))
    assert set(spark.range(1).select(mentions.variations(F.lit("サーバー"))).first()[0]) == {"サバ", "サウバウ"}


def test_quality_and_enhancement(spark):
    n = spark.createDataFrame([note("v/20230101120000.md", "TODO short", tags=[]), note("v/my-file.md", "A book about code, software, programming and a class.\n\n#deep #ab more " + "w " * 60, "1", "My file", ["x"], ["a", "b"])], COLUMNS)
    done = analysis.improvements(n)
    got = {r.path: (r.improvements_found, r.quality_score) for r in analysis.quality(done).collect()}
    assert got["v/20230101120000.md"][1] == 0.0
    kinds = {i.improvement_type for r in done.where("path = 'v/my-file.md'").collect() for i in r.improvements}
    assert kinds == {"missing_required_field", "missing_tags", "missing_description", "missing_category", "filename_mismatch"}
    out = {r.path: r for r in enhancement.enhanced(n).collect()}
    assert out["v/20230101120000.md"].title == "Note 20230101" and "deep" in out["v/my-file.md"].tags and "code" in out["v/my-file.md"].tags
    assert out["v/my-file.md"].category == ["technical", "book"]
    meta = {r.path: r for r in analysis.metadata(n).collect()}
    assert meta["v/20230101120000.md"].published == "2023-01-01" and meta["v/20230101120000.md"].created_time == "2023-01-01 12:00:00" and meta["v/my-file.md"].language == "english"


def test_vectors_and_services(spark):
    rows = [(str(i), v, {"title": f"t{i}"}, i) for i, v in enumerate([[3.0, 4.0], [1.0, 0.0], [0.0, 0.0], [0.0, 2.0]])]
    schema = "document_id string, vector array<double>, metadata map<string,string>, ordinal long"
    none = spark.createDataFrame([], schema)
    idx = vectors.upsert(none, spark.createDataFrame(rows, schema), 2)
    assert vectors.lookup(idx, "0").first().vector == pytest.approx([0.6, 0.8])
    assert [(r.document_id, r.similarity) for r in vectors.search(idx, [0.0, 5.0], 2).collect()] == [("3", 1.0), ("0", 0.8)]
    assert [r.document_id for r in vectors.search(idx, [0.0, 5.0], 2, 0.9).collect()] == ["3"]
    again = vectors.upsert(idx, spark.createDataFrame([("3", [1.0, 0.0], {}, 9)], schema), 2)
    assert vectors.lookup(again, "3").first().vector == [1.0, 0.0] and again.count() == 4
    assert vectors.remove(idx, spark.createDataFrame([("0",)], "document_id string")).count() == 3
    with pytest.raises(Exception, match="components"):
        vectors.upsert(none, spark.createDataFrame(rows, schema), 3).collect()
    assert vectors.retrieval_context(vectors.search(idx, [0.0, 1.0], 1)).first().passage == "Title: t3"
    n = spark.createDataFrame([note("a", "Some words. More of them here.", "1", "T"), note("b", "   ")], COLUMNS)
    assert [r.document_id for r in services.embedded(n).collect()] == ["1"]
    assert services.cut("One. Two three.", 8) == "One. Two..." or services.cut("One two. Three", 9) == "One two."
    assert {r.path: r.summary for r in services.summarised(n).collect()}["a"].startswith("Some words")
    s = spark.createDataFrame([("TAGS: a, b\nDESCRIPTION: d",)], "x string").select(services.sections(F.col("x"), ["TAGS", "DESCRIPTION"]).alias("s")).first().s
    assert (s.tags, s.description) == ("a, b", "d")


def test_streams(spark, sf, tmp_path):
    events = adapters.table(spark, sf, "events")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(events.schema).parquet(str(tmp_path / "in"))
    q = index.event_windows(stream, late="3650 days").writeStream.outputMode("complete").format("memory").queryName("w").trigger(availableNow=True).start()
    q.awaitTermination(120)
    key = lambda r: (r.start, r.event_type)
    assert sorted(map(key, spark.table("w").collect())) == sorted(map(key, index.event_windows(events).collect()))
    n = spark.createDataFrame([note("a", "first", "1", "T"), note("b", "second", "2", "U")], COLUMNS)
    n.coalesce(1).write.parquet(str(tmp_path / "notes"))
    for _ in range(2):
        index.follow(spark.readStream.schema(n.schema).parquet(str(tmp_path / "notes")), str(tmp_path / "index"), str(tmp_path / "cp")).awaitTermination(120)
    assert {r.document_id for r in index.latest(spark, str(tmp_path / "index")).collect()} == {"1", "2"}


def test_report(spark):
    n = spark.createDataFrame([note("a", "[[x]]", "1", "T"), note("b", "", "2", "U")], COLUMNS)
    counts = {r.task: r.issues for r in report.task_counts(n, ["orphans", "dead-links"]).collect()}
    assert counts == {"orphans": 1, "dead-links": 1}
    assert report.health(report.task_counts(n, ["orphans", "dead-links"])).first().health_score == pytest.approx(98)
    with pytest.raises(ValueError):
        report.checked_tasks(["nonsense"])


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
    assert all(re.fullmatch(r"(q|op)\w+|pipeline", n) for n in entry.queries())


@pytest.mark.parametrize("gone", [("notemill/llm", "tests/llm"), ("notemill/llm", "tests/llm", "corpus_pipeline.py"), ("corpus_pipeline.py",)])
def test_entry_without_llm(tmp_path, gone):
    root = os.path.dirname(os.path.abspath(entry.__file__))
    copy = str(tmp_path / "copy")
    shutil.copytree(root, copy, ignore=shutil.ignore_patterns(".git", "__pycache__", ".pytest_cache", *[g for g in gone if "/" not in g], "llm" if "notemill/llm" in gone else "-"))
    code = "import __spark_entry__ as e; q = e.queries(); assert len(q) > 50 and not any(n.startswith('op') or n == 'pipeline' for n in q); assert set(e.oracle_sql()) <= set(q)"
    env = {k: v for k, v in os.environ.items() if k != "PYTHONPATH"}
    subprocess.run([sys.executable, "-c", code], cwd=copy, env=env, check=True, timeout=120)
