import json

import pytest
from pyspark.sql import functions as F

from notemill import cli
from notemill.operators import japanese, keywords, mentions
from notemill.sources import rules
from tests.test_links import COLUMNS, note


def aliases(spark, notes, path=None):
    return {r.path: r.aliases for r in rules.title_aliases(notes, rules.spellings(spark, path), rules.names(spark, path)).collect()}


def test_rules_as_tables_give_what_the_dictionaries_give(spark):
    notes = spark.createDataFrame([note(f"v/{i}.md", "", str(i), t, a) for i, (t, a) in enumerate([("API", []), ("サーバー", ["サバ"]), ("人工知能", []), ("ティム", []), ("plain", []), (None, [])])], COLUMNS)
    assert aliases(spark, notes) == {r.path: r.aliases for r in japanese.aliases(notes).collect()}


def test_a_changed_file_changes_the_result(spark, tmp_path):
    path = str(tmp_path / "rules.yaml")
    notes = spark.createDataFrame([note("v/a.md", "", "1", "Colour"), note("v/b.md", "", "2", "MQ")], COLUMNS)
    assert aliases(spark, notes, path) == {"v/a.md": [], "v/b.md": []}
    rules.add(path, "consonant_patterns", "our", ["or"])
    rules.add(path, "english_japanese_pairs", "MQ", {"japanese": ["メッセージキュー"], "aliases": ["エムキュー"]})
    assert aliases(spark, notes, path) == {"v/a.md": ["Color"], "v/b.md": ["エムキュー", "メッセージキュー"]}
    rules.add_keywords(path, ["zebra", "okapi"], "animals")
    rules.add_keywords(path, ["okapi", "gnu"], "animals")
    assert [r.keyword for r in rules.keywords(spark, path).collect()] == ["zebra", "okapi", "gnu"]
    copy = str(tmp_path / "copy.yaml")
    assert rules.export(path, copy) and not rules.export(str(tmp_path / "none"), copy)
    (tmp_path / "bad.yaml").write_text("- a list")
    assert not rules.take(str(tmp_path / "bad.yaml"), path) and not rules.take(str(tmp_path / "none"), path) and rules.take(copy, path)
    with pytest.raises(ValueError):
        rules.load(str(tmp_path / "bad.yaml"))
    assert aliases(spark, notes, path)["v/a.md"] == ["Color"]


def test_more_stop_words(spark):
    found = spark.range(1).select(keywords.keywords(F.lit("Zebra crossing paths"), stop_words=["ZEBRA"]).alias("k")).first().k
    assert [k.keyword for k in found] == ["crossing", "paths"]


def test_best_alias(spark):
    df = spark.createDataFrame([("Api", "API"), ("api", "Interface"), ("x", None)], "matched string, title string")
    assert [r[0] for r in df.select(mentions.best_alias(F.col("matched"), F.col("title"))).collect()] == [None, "api", "x"]


def test_summaries_and_reports_as_files(spark, tmp_path):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "a.md").write_text("---\ntitle: A\n---\nSome words of a note. And some more.\n")
    assert cli.main(["summarize", str(folder), "--markdown", str(tmp_path / "out")]) == 0
    text = (tmp_path / "out" / "a.summary.md").read_text()
    assert text.startswith("# Summary of a.md\n\n**Source:** ") and text.endswith("## Summary\n\nSome words of a note. And some more.\n")
    assert cli.main(["organize", str(folder), "--report", str(tmp_path / "report")]) == 0
    totals = [json.loads(x) for p in (tmp_path / "report" / "summary").glob("*.json") for x in p.read_text().splitlines()]
    details = [json.loads(x) for p in (tmp_path / "report" / "details").glob("*.json") for x in p.read_text().splitlines()]
    assert totals[0]["analysed"] == 1 and details[0]["improvements"] == len(details[0]["changes"]) > 3
