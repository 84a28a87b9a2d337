import json

from pyspark.sql import functions as F

from notemill.operators import validation
from notemill.sources import frontmatter, sinks, templates, vault


def test_parse_normalise_and_coerce():
    got = {k: json.loads(v) for k, v in frontmatter.parse("title: [A, B]\nTag: x\ntags: [x, y]\naka: z\nid: 20230624195207\ncreated: 2023-06-24\npublic: 'Yes'\ndescription:\nmore: {a: 1}\nt: <% tp.x %>").items()}
    assert got == {"title": "A", "tags": ["x", "y"], "aliases": ["z"], "id": "20230624195207", "date": "2023-06-24", "publish": True, "description": "", "more": {"a": 1}, "t": None}
    assert frontmatter.parse("- a\n- b") == {} and frontmatter.parse("a: [") == {} and frontmatter.parse("1: x") == {} and frontmatter.parse(None) == {}


def test_vault_notes_and_sinks(spark, tmp_path):
    root = tmp_path / "v"
    for path, text in {
        "a/20230101120000.md": "body only",
        "a/b.md": "---\ntitle: T\nid: 5\ntags: [q]\n---\n# H\n[[x]]",
        ".obsidian/c.md": "no",
        "a/d.txt": "no",
        "b/e.md": "+++\ntitle: {{x}}\n---\nrest",
    }.items():
        (root / path).parent.mkdir(parents=True, exist_ok=True)
        (root / path).write_text(text)
    notes = {r.stem: r for r in vault.notes(spark, str(root)).collect()}
    assert set(notes) == {"20230101120000", "b", "e"}
    assert (notes["20230101120000"].file_id, notes["20230101120000"].fm_id, notes["20230101120000"].present_keys) == ("20230101120000", None, [])
    assert (notes["b"].file_id, notes["b"].title, notes["b"].tags, notes["b"].content) == ("5", "T", ["q"], "# H\n[[x]]")
    assert notes["e"].content == "rest" and notes["e"].title is None
    assert {r.path.rsplit("/", 1)[1] for r in vault.files(spark, str(root), include=["a/*.md"]).collect()} == {"20230101120000.md", "b.md"}
    assert vault.files(spark, str(root), exclude=["**/a/**", "**/.obsidian/**"]).count() == 1
    new = vault.notes(spark, str(root)).where("stem = 'b'").select("path", frontmatter.with_body(F.col("raw"), F.lit("new")).alias("raw"))
    sinks.save_notes(new, "20240101_000000")
    path = str(root / "a/b.md")
    assert open(path).read() == "---\ntitle: T\nid: 5\ntags: [q]\n---\nnew"
    sinks.restore(path, sinks.backup_name(path, "20240101_000000"))
    assert open(path).read().endswith("[[x]]")
    sinks.write_csv(notes_df := vault.notes(spark, str(root)).select("stem", "tags").orderBy("stem"), str(tmp_path / "csv"))
    assert spark.read.option("header", "true").csv(str(tmp_path / "csv")).where("stem = 'b'").first().tags == "q"
    sinks.write_json(notes_df, str(tmp_path / "json"))
    assert spark.read.json(str(tmp_path / "json")).count() == 3


def test_written(spark):
    fields = {"title": '"a: b"', "image": '"x.png"', "id": '"20230101120000"', "tags": '["x","1","y z"]', "aliases": "[]", "publish": "true", "date": "null", "n": '"12"', "description": '""'}
    df = spark.createDataFrame([(fields,)], "f map<string,string>")
    got = df.select(frontmatter.written(F.col("f"), ["title", "image", "id", "tags", "aliases", "publish", "date", "n", "description", "missing"])).first()[0]
    assert got == "---\ntitle: 'a: b'\nimage: 'x.png'\nid: 20230101120000\ntags: [x,'1',y z]\naliases: []\npublish: true\ndate:\nn: '12'\ndescription:\n---\n"


def test_templates(spark):
    note = "---\ntitle: {{title}}\naliases:\ntags: []\nid: <% tp.file.creation_date(\"YYYYMMDDHHmmss\") %>\npublished: <% tp.file.creation_date() %>\nimage: ../../assets/x.svg\npublish: false\nn: '12'\n---\n"
    assert templates.schema(note) is None  # {{title}} is no YAML as it stands
    fields = {f.name: f for f in templates.schema("---\ntitle:\naliases:\nid: '<% creation_date(\"YYYYMMDDHHmmss\") %>'\nimage: ../../assets/x.svg\npublish: false\nn: '12'\n---\n")}
    assert (fields["title"].required, fields["aliases"].kind, fields["image"].default, fields["publish"].kind, fields["n"].kind) == (True, "array", "../../assets/x.svg", "boolean", "integer")
    assert fields["id"].required and fields["id"].pattern == r"^\d{14}$"
    assert templates.variable("id", "id: <% x %>") == "x" and templates.variable("t", 't: "{{y}}"') == "y" and templates.variable("t", "t: z") is None
    assert set(templates.schemas({"a": note, "b": "---\nid: 1\n---\n", "c": "none"})) == {"b"}
    rows = [("v/Books/x", ["title"]), ("v/my_fleetingnotes_old", []), ("v/z", ["isbn", "description"]), ("v/z", ["description"]), ("v/z", [])]
    got = [r[0] for r in spark.createDataFrame(rows, "d string, k array<string>").select(templates.template_of(F.col("d"), F.col("k"))).collect()]
    assert got == ["booksearchtemplate", "new-fleeing-note", "booksearchtemplate", "new-fleeing-note", "new-fleeing-note"]


def test_validation_and_fixes(spark):
    rows = [
        ("ok", {"title": '"T"', "id": '"20230101120000"', "tags": '["a"]'}),
        ("bad", {"title": '""', "id": '"x"', "tags": '"a"', "date": '"2023/1/5"', "aliases": '["T"," T "]', "odd": "1"}),
        ("warn", {"title": '"T"', "id": '"20231301120000"', "aliases": '["T"]', "date": '"2023-02-31"'}),
        ("none", {}),
    ]
    df = spark.createDataFrame(rows, "path string, fields map<string,string>")
    out = {r.path: r for r in validation.validate(df).collect()}
    assert out["ok"].is_valid and not out["ok"].warnings
    assert out["bad"].missing_fields == ["title"] and [x.split(":")[0] for x in out["bad"].invalid_fields] == ["tags", "id", "date"]
    assert out["bad"].warnings[-1] == "unexpected fields: odd"
    assert out["warn"].is_valid and out["warn"].warnings == ["id is not a time stamp", "title is among the aliases", "date is not a date"]
    assert out["none"].missing_fields == ["title", "id"]
    fixes = {(r.path, r.field_name): (r.fix_type, r.suggested_value) for r in validation.fixes(df, validation.validate(df), "20240102030405").collect()}
    assert fixes[("bad", "date")] == ("modify", "2023-1-5") and fixes[("bad", "aliases")] == ("modify", '["T"]') and fixes[("none", "id")] == ("add", "20240102030405")
    s = validation.summary(validation.validate(df)).first()
    assert (s.total, s.valid, s.missing_issues, s.valid_rate) == (4, 2, 3, 0.5)
    assert [(r.field, r.notes) for r in validation.most_missing(validation.validate(df)).collect()] == [("title", 2), ("id", 1)]
