import json

from pyspark.sql import functions as F

from notemill.operators import connections, graph, repair, similarity
from notemill.operators.validation import Field
from notemill.sources import frontmatter
from tests.test_links import COLUMNS, note

SCHEMA = (Field("title", required=True), Field("id"), Field("tags", "array"), Field("publish", "boolean"), Field("pages", "integer"), Field("rating", "number"), Field("published"), Field("image"))


def rows(spark, *fields):
    return spark.createDataFrame([(f"n{i}", {k: json.dumps(v, ensure_ascii=False) for k, v in f.items()}) for i, f in enumerate(fields)], "path string, fields map<string,string>")


def test_conversions(spark):
    df = rows(
        spark,
        {"title": 5, "id": 20240101000000, "tags": "a, b,, c ", "publish": "On", "pages": "12", "rating": "2.5", "other": 1},
        {"title": ["x", "y"], "tags": 7, "publish": 0, "pages": 3.9, "rating": "no", "image": None},
        {"title": True, "tags": " ", "publish": [], "pages": 4.0, "rating": 2, "id": "é"},
        {"title": "same", "tags": ["q"], "publish": False, "pages": True},
        {},
    )
    got = {r.path: {k: json.loads(v) for k, v in r.fields.items()} for r in repair.convert(df, SCHEMA).collect()}
    assert got == {
        "n0": {"title": "5", "id": "20240101000000", "tags": ["a", "b", "c"], "publish": True, "pages": 12, "rating": 2.5, "other": 1},
        "n1": {"title": "x, y", "tags": [7], "publish": False, "pages": 3, "rating": "no", "image": None},
        "n2": {"title": "true", "tags": [], "publish": False, "pages": 4, "rating": 2, "id": "é"},
        "n3": {"title": "same", "tags": ["q"], "publish": False, "pages": True},
        "n4": {},
    }
    found = repair.conversions(df, SCHEMA)
    assert {(r.path, r.field_name) for r in found.collect()} == {("n0", f) for f in ("title", "id", "tags", "publish", "pages", "rating")} | {("n1", f) for f in ("title", "tags", "publish", "pages")} | {("n2", f) for f in ("title", "tags", "publish")}
    summary = {r.conversion: (r.times, r.fields) for r in repair.conversion_summary(found).collect()}
    assert summary[None] == (13, 6) and summary["string -> array"] == (2, 1)
    assert [r.times for r in repair.conversion_summary(found, 2).collect()] == sorted((n for k, (n, _) in summary.items() if k), reverse=True)[:2]


def test_template_is_applied_without_overwriting(spark):
    df = rows(spark, {"title": " ", "date": "2024-01-05", "image": ""}, {"title": "T", "id": "", "tags": [], "published": None, "image": "x"}, {"title": None, "id": "1"})
    got = {r.path: ({k: json.loads(v) for k, v in r.fields.items()}, r.added) for r in repair.templated(df, SCHEMA).collect()}
    assert got["n0"][0] == {"title": "", "date": "2024-01-05", "image": "", "id": "", "tags": [], "publish": False, "pages": 0, "rating": 0.0, "published": "2024-01-05"}
    assert got["n1"] == ({"title": "T", "id": "", "tags": [], "published": None, "image": "x"}, [])
    assert got["n2"][0]["image"] == repair.IMAGE and got["n2"][0]["published"] == "" and got["n2"][1] == ["image", "pages", "publish", "published", "rating", "tags", "title"]


def test_repaired_files_read_back(spark):
    raw = "---\nid: 20240101000000\ntags: a, b\ntitle: 12\nmore: {x: [1, 'y']}\n---\nbody\n---\n[[x]]"
    notes = frontmatter.parsed(spark.createDataFrame([("a.md", raw), ("b.md", "no front matter")], "path string, raw string"))
    done = repair.rewritten_files(notes, SCHEMA[:3])
    again = {r.path: r for r in frontmatter.as_notes(frontmatter.parsed(done)).collect()}
    assert set(again) == {"a.md", "b.md"} and again["a.md"].content == "body\n---\n[[x]]"
    assert (again["a.md"].title, again["a.md"].tags, again["a.md"].file_id) == ("12", ["a", "b"], "20240101000000")
    assert json.loads(again["a.md"].fields["more"]) == {"x": [1, "y"]} and again["b.md"].content == "no front matter"
    assert repair.rewritten_files(frontmatter.parsed(done), SCHEMA[:3]).where("path = 'a.md'").count() == 0


def test_best_duplicates(spark):
    pairs = spark.createDataFrame([("a", "b", 0.8), ("a", "c", 0.9), ("b", "c", 0.8)], "a string, b string, confidence double")
    assert {(r.path, r.other) for r in similarity.best_duplicates(pairs).collect()} == {("a", "c"), ("b", "a"), ("c", "a")}


def test_connections(spark):
    n = spark.createDataFrame(
        [
            note("v/1.md", "[[2]] alone", "1", "Zebra", tags=["x", "y"]),
            *[note(f"v/{i}.md", f"Kubernetes cluster number{i}", str(i), f"T{i}" * 3, tags=["x", "y"]) for i in range(2, 9)],
            note("v/a.md", "one zebrasand more", "a", "Crossing", tags=[]),
            note("v/b.md", "Kubernetes cluster number2", "b", "alone", tags=["q"]),
        ],
        COLUMNS,
    )
    edges = graph.edges(n)
    got = connections.suggestions(n.where("fm_id IN ('1', 'b')"), n, edges).collect()
    # 2 is linked already and goes before the cut to five, so the sixth of equal tags comes in.
    assert [(r.target_id, r.reason) for r in sorted(got, key=lambda r: r.rank) if r.fm_id == "1"] == [(str(i), "tags") for i in range(3, 8)]
    assert {(r.target_id, r.confidence, r.reason) for r in got if r.fm_id == "b" and r.rank == 1} == {("2", 1.0, "keywords")}
    titles = {(r.fm_id, r.target_id): round(r.confidence, 6) for r in connections.title_mentions(n.where("fm_id IN ('1', 'b')"), n).collect()}
    assert titles == {("1", "a"): 0.8, ("1", "b"): 0.8, ("b", "1"): 0.8}
    shared = {(r.fm_id, r.target_id): round(r.confidence, 6) for r in connections.shared_keywords(n.where("fm_id = 'b'"), n, 9).collect()}
    assert shared[("b", "3")] == 0.6 and ("b", "1") not in shared
    quick = connections.simple(n.where("fm_id = '1'"), n).collect()
    assert len(quick) == 5 and quick[0].confidence == 1.0 and {r.target_id for r in quick} == {"2", "3", "4", "5", "6"}
    assert [r.fm_id for r in graph.most_isolated(spark.createDataFrame([("a", 0.5), ("b", 1.0), ("c", 1.0)], "fm_id string, isolation double")).collect()] == ["b", "c", "a"]
