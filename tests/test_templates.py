import json

import pytest

from notemill import cli
from notemill.operators import validation
from notemill.operators.validation import Field
from notemill.sources import sinks, templates, vault

SCHEMAS = {"book": (Field("title", required=True), Field("isbn", required=True, pattern=r"^\d{13}$"), Field("pages", "integer")), "note": (Field("title", required=True, default="?"), Field("done", "boolean", True), Field("tags", "array"))}


def rows(spark, *each):
    return spark.createDataFrame([(f"n{i}", {k: json.dumps(v) for k, v in f.items()}, t) for i, (t, f) in enumerate(each)], "path string, fields map<string,string>, template string")


def test_each_note_by_its_own_template(spark):
    df = rows(
        spark,
        ("book", {"title": "T", "isbn": "1234567890123", "pages": 3}),
        ("book", {"title": "", "isbn": "12", "pages": "x", "tags": []}),
        ("note", {"done": False, "tags": "x"}),
        ("note", {"title": "T", "done": None}),
        ("nothing", {"title": "T"}),
        (None, {}),
    )
    schemas = validation.schema_rows(spark, SCHEMAS)
    got = {r.path: (r.is_valid, r.missing_fields, r.invalid_fields, r.warnings) for r in validation.by_template(df, schemas).collect()}
    assert got == {
        "n0": (True, [], [], []),
        "n1": (False, ["title"], [r"isbn: does not match ^\d{13}$", "pages: expected integer, got string"], ["unexpected fields: tags"]),
        "n2": (False, ["title"], ["tags: expected array, got string"], []),
        "n3": (True, [], [], []),
        "n4": (False, [], [], ["no schema of nothing"]),
        "n5": (False, [], [], ["no schema of no template"]),
    }
    fixes = {tuple(r) for r in validation.template_fixes(df, schemas).collect()}
    assert fixes == {("n1", "title", "modify", None), ("n2", "title", "add", "?")}
    totals = {r.template: (r.total, r.valid, r.invalid, r.with_warnings) for r in validation.template_summary(validation.by_template(df.where("path < 'n4'"), schemas)).collect()}
    assert totals == {"book": (2, 1, 1, 1), "note": (2, 1, 1, 0), None: (4, 2, 2, 1)}


def test_one_schema_gives_what_validate_gives(spark):
    df = rows(spark, *[("plain", f) for f in ({"title": "T", "id": "20240101000000"}, {"id": 5, "date": "2024/1/1", "tags": "x"}, {"title": None, "id": "20249999000000", "aliases": ["T"], "more": 1}, {})])
    schemas = validation.schema_rows(spark, {"plain": validation.NOTE_SCHEMA})
    assert sorted(validation.by_template(df, schemas).drop("template").collect()) == sorted(validation.validate(df.drop("template")).collect())


@pytest.fixture
def folder(tmp_path):
    (tmp_path / "Templates").mkdir()
    (tmp_path / "Templates" / "new-fleeing-note.md").write_text("---\ntitle: x\nid: x\ntags:\n---\n")
    (tmp_path / "Templates" / "booksearchtemplate.md").write_text("---\ntitle: x\nisbn: x\n---\n")
    (tmp_path / "Books").mkdir()
    (tmp_path / "Books" / "b.md").write_text("---\ntitle: B\n---\nbook\n")
    (tmp_path / "a.md").write_text("---\ntitle: 12\nid: 20230101120000\ntags: one\n---\ntext\n")
    return tmp_path


def test_template_mode_of_a_folder(spark, folder, capsys):
    notes = vault.notes(spark, str(folder))
    own = templates.assigned(notes)
    assert {(r.stem, r.template) for r in own.select("stem", "template").collect()} == {("a", "new-fleeing-note"), ("b", "booksearchtemplate")}
    before = (folder / "a.md").read_text()
    assert cli.main(["validate-frontmatter", str(folder)]) == 0
    assert (folder / "a.md").read_text() == before
    assert cli.main(["validate-frontmatter", str(folder), "--execute", "--stamp", "20240101_000000"]) == 0
    assert "tags: [one]" in (folder / "a.md").read_text() and (folder / "a.backup_20240101_000000.bak").read_text() == before
    assert cli.main(["validate-frontmatter", str(folder), "--template", str(folder / "Templates" / "booksearchtemplate.md")]) == 0
    assert "booksearchtemplate" not in (folder / "Templates" / "booksearchtemplate.md").read_text()


def test_a_single_template_says_what_is_wrong(folder):
    assert [f.name for f in templates.single(str(folder / "Templates" / "booksearchtemplate.md"))] == ["title", "isbn"]
    with pytest.raises(FileNotFoundError):
        templates.single(str(folder / "none.md"))
    (folder / "x.txt").write_text("---\na: 1\n---\n")
    (folder / "bad.md").write_text("no front matter")
    for bad in (folder, folder / "x.txt", folder / "bad.md"):
        with pytest.raises(ValueError):
            templates.single(str(bad))


def test_sink_gives_an_account_of_every_file(spark, tmp_path):
    (tmp_path / "same.md").write_text("same")
    (tmp_path / "old.md").write_text("old")
    (tmp_path / "dir.md").mkdir()
    made = [(str(tmp_path / n), t) for n, t in (("same.md", "same"), ("old.md", "new"), ("fresh.md", "fresh"), ("dir.md", "x"), ("none.md", None), ("nowhere/x.md", "x"))]
    rows = spark.createDataFrame(made, "path string, raw string")
    done = {r.path.removeprefix(f"{tmp_path}/"): r.status for r in sinks.save_notes(rows, "s").collect()}
    assert done == {"same.md": "skipped", "old.md": "applied", "fresh.md": "applied", "dir.md": "error", "none.md": "skipped", "nowhere/x.md": "error"}
    assert (tmp_path / "old.md").read_text() == "new" and (tmp_path / "old.backup_s.bak").read_text() == "old"
    again = sinks.save_notes(rows, "s")
    assert {r.status for r in again.where("path LIKE '%/old.md' OR path LIKE '%/fresh.md'").collect()} == {"skipped"}
    totals = sinks.save_totals(again).collect()[0]
    assert (totals.files, totals.applied, totals.skipped, totals.errors, totals.success_rate) == (6, 0, 4, 2, 0.0)
    assert not [p for p in tmp_path.iterdir() if ".part" in p.name]


def test_organize_writes_what_it_shows(spark, folder):
    assert cli.main(["organize", str(folder), "--execute", "--stamp", "20240101_000000"]) == 0
    again = {r.stem: r for r in vault.notes(spark, str(folder)).collect()}
    assert again["b"].file_id == "20240101000000" and json.loads(again["b"].fields["word_count"]) in ("1", 1) and again["b"].content == "book\n"
