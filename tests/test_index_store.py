import json
from dataclasses import asdict

import pytest
from pyspark.sql import functions as F

from notemill import cli
from notemill.operators import services, vectors
from notemill.sources import index_store, vault
from notemill.streaming import index

SCHEMA = "document_id string, vector array<double>, metadata map<string,string>, ordinal long"


def rows(spark, *made):
    return spark.createDataFrame([(i, v, {"title": i}, n) for n, (i, v) in enumerate(made)], SCHEMA)


def test_snapshots_and_manifests(spark, tmp_path):
    path = str(tmp_path / "index")
    with pytest.raises(FileNotFoundError):
        index_store.load(spark, path)
    first = index_store.update(spark, path, rows(spark, ("a", [3.0, 4.0]), ("b", [1.0, 0.0])), 2)
    assert (first.version, first.count, first.dimension) == (1, 2, 2)
    # What is there already makes no new version; a changed vector does, and takes the old one's place.
    assert index_store.update(spark, path, rows(spark, ("a", [6.0, 8.0])), 2) == first
    second = index_store.update(spark, path, rows(spark, ("a", [0.0, 2.0]), ("c", [1.0, 1.0])), 2, spark.createDataFrame([("b",)], "document_id string"))
    assert (second.version, second.count) == (2, 2)
    assert {r.document_id: [round(x, 6) for x in r.vector] for r in index_store.load(spark, path).collect()} == {"a": [0.0, 1.0], "c": [0.707107, 0.707107]}
    assert {r.document_id for r in index_store.load(spark, path, 1).collect()} == {"a", "b"}
    with pytest.raises(FileNotFoundError):
        index_store.load(spark, path, 7)
    with pytest.raises(ValueError):
        index_store.save(rows(spark, ("a", [1.0]), ("b", [1.0, 2.0])), path)
    # The failed version has no manifest, so the one before it is still in force.
    assert index_store.manifest(spark, path) == second


def test_a_snapshot_that_lost_rows_is_an_error(spark, tmp_path):
    path = str(tmp_path / "index")
    made = index_store.save(rows(spark, *[(f"d{i}", [1.0, float(i)]) for i in range(8)]).repartition(4), path)
    parts = sorted((tmp_path / "index" / "v1").glob("*.parquet"))
    assert made.parts == len(parts)
    parts[0].unlink()
    with pytest.raises(ValueError, match="files"):
        index_store.load(spark, path)
    (tmp_path / "index" / ".manifest-1.json.crc").unlink(missing_ok=True)
    (tmp_path / "index" / "manifest-1.json").write_text(json.dumps(asdict(made) | {"parts": len(parts) - 1}))
    with pytest.raises(ValueError, match="vectors"):
        index_store.load(spark, path)


def test_a_failed_batch_is_taken_in_once(spark, tmp_path):
    notes = tmp_path / "notes"
    notes.mkdir()
    log, saved, check = (str(tmp_path / n) for n in ("log", "saved", "check"))

    def put(number, *names):
        spark.createDataFrame([(f"v/{n}.md", n, f"text of {n} {number}") for n in names], "path string, file_id string, content string").coalesce(1).write.mode("append").json(str(notes))

    def stream():
        read = spark.readStream.schema("path string, file_id string, content string").json(str(notes))
        none = F.array().cast("array<string>")
        return read.select("path", "file_id", F.col("file_id").alias("title"), none.alias("tags"), "content")

    put(1, "a", "b")
    index.follow(stream(), log, check).awaitTermination()
    assert index_store.compact(spark, log, saved).count == 2
    put(2, "b", "c")

    def fails(texts):
        raise RuntimeError("no service")

    with pytest.raises(Exception, match="no service"):
        index.follow(stream(), log, check, fails).awaitTermination()
    assert index_store.compact(spark, log, saved).version == 1
    index.follow(stream(), log, check).awaitTermination()
    made = index_store.compact(spark, log, saved)
    assert (made.version, made.count, made.through) == (2, 3, 1) and index_store.compact(spark, log, saved) == made
    assert sorted(r.document_id for r in index_store.load(spark, saved).collect()) == ["a", "b", "c"]
    fresh = services.hashing_embedder()(["text of b 2"])[0]
    got = index_store.load(spark, saved).where("document_id = 'b'").first().vector
    assert max(range(len(fresh)), key=lambda i: fresh[i]) == max(range(len(got)), key=lambda i: got[i])


def test_commands_on_a_saved_index(spark, tmp_path, capsys):
    folder = tmp_path / "vault"
    folder.mkdir()
    (folder / "a.md").write_text("---\ntitle: Interface Design\nid: 20230101120000\n---\nText about interfaces.\n")
    path = str(tmp_path / "index")
    assert cli.main(["index", str(folder), "--output", path]) == 0
    assert index_store.load(spark, path).count() == 1
    (folder / "a.md").unlink()
    (folder / "b.md").write_text("---\ntitle: Other\nid: 20230101120001\n---\nNothing alike.\n")
    assert cli.main(["ask", str(folder), "text about interfaces", "--index", path, "--threshold", "0.1"]) == 0
    assert "Interface Design" in capsys.readouterr().out
    assert vault.notes(spark, str(folder)).count() == 1 and vectors.statistics(index_store.load(spark, path)).first().total_documents == 1
