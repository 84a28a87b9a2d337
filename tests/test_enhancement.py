import datetime
import json
import os

import pytest

from notemill.operators import enhancement, tags
from notemill.sources import frontmatter, vault
from tests.test_links import COLUMNS, note


@pytest.fixture
def folder(tmp_path):
    def file(name, text, day):
        (tmp_path / name).write_text(text)
        at = datetime.datetime.fromisoformat(f"{day}T12:00:00+00:00").timestamp()
        os.utime(tmp_path / name, (at, at))

    file("20230102030405.md", "---\nid: 20230102030405\ntags: [web]\ntitle: Web\n---\nWebpack, vite, sass and a work note about the web. #Build-it\n\nAuthor: Ann\n", "2024-05-06")
    file("plain.md", "---\ntitle: Plain\nid: 20239999000000\n---\nNothing here.\n", "2024-05-07")
    file("bare.md", "no front matter; created: 2020-02-03", "2024-05-08")
    return tmp_path


def test_dates_by_id_and_by_file(spark, folder):
    notes = vault.notes(spark, str(folder))
    got = {os.path.basename(r.path): tuple(r)[1:] for r in enhancement.dates(notes).collect()}
    assert got == {
        "20230102030405.md": ("2024-05-06", "2024-05-06", "2023-01-02", "file", "id"),
        "plain.md": ("2024-05-07", "2024-05-07", "2024-05-07", "file", "file"),
        "bare.md": ("2024-05-08", "2024-05-08", "2024-05-08", "file", "file"),
    }


def test_dates_without_a_file(spark):
    notes = spark.createDataFrame([note("v/a.md", "", "20230102030405"), note("v/b.md", "", None)], COLUMNS)
    assert {tuple(r) for r in enhancement.dates(notes).collect()} == {("v/a.md", None, None, "2023-01-02", None, "id"), ("v/b.md", None, None, None, None, None)}
    got = {tuple(r) for r in enhancement.dates(notes, "20240506070809").collect()}
    assert got == {("v/a.md", "2024-05-06", None, "2023-01-02", "clock", "id"), ("v/b.md", "2024-05-06", None, "2024-05-06", "clock", "clock")}


def entries(row):
    return [(e.step, e.field, e.value, e.overwrote) for e in row.log]


def test_steps_see_what_those_before_them_left(spark, folder):
    notes = vault.notes(spark, str(folder))
    out = {os.path.basename(r.path): r for r in enhancement.enhanced(notes, tags.frequencies(notes), as_of="20240101000000").collect()}
    web = out["20230102030405.md"]
    assert web.tags == ["web", "build", "frontend", "technologies", "tech-ui"]
    assert entries(web)[:4] == [("tags", "tags", "build, frontend, technologies", False), ("technical", "tags", "tech-ui", False), ("metadata", "author", "Ann", False), ("metadata", "date_created", "2024-05-06", False)]
    # The file's name gives published before the dates do; the template's rule puts the file's day there in any case.
    assert [e for e in entries(web) if e[1] == "published"] == [("metadata", "published", "2023-01-02", False), ("required", "published", "2024-05-06", True)]
    assert web.fields["created"] == web.fields["modified"] == "2024-05-06" and web.fields["published"] == "2024-05-06" and web.aliases == ["Web"]
    bare = out["bare.md"]
    assert (bare.id, bare.title) == ("20240101000000", "bare") and entries(bare)[-2:] == [("id", "id", "20240101000000", False), ("title", "title", "bare", False)]
    assert bare.fields["date_created"] == "2020-02-03" and bare.description == "no front matter; created: 2020-02-03"
    assert all(e.confidence == 0.9 for r in out.values() for e in r.log if e.step == "required")
    assert "Added required field aliases: Web" in web.changes


def test_suggestions_of_a_service_and_own_fields(spark):
    raw = '---\ntitle: T\nid: "20230102030405"\ntags: [a]\naliases: [x]\ndescription: mine\npublished: 2020-01-01\ncategory: [own]\n---\nbody text\n'
    notes = frontmatter.as_notes(frontmatter.parsed(spark.createDataFrame([("a.md", raw)], "path string, raw string")))
    said = spark.createDataFrame([("a.md", ["b", "a", "b"], ["y"], "other")], "path string, tags array<string>, aliases array<string>, description string")
    row = enhancement.enhanced(notes, suggested=said).collect()[0]
    assert (row.tags, row.aliases, row.description, row.category, row.fields["published"]) == (["a", "b"], ["x", "y"], "mine", ["own"], "2020-01-01")
    assert not [e for e in row.log if e.step in ("required", "content", "id", "title")]
    assert [tuple(r) for r in enhancement.summary(enhancement.enhanced(notes, suggested=said)).where("step = 'suggested'").orderBy("field").collect()] == [("suggested", "aliases", 1, 0), ("suggested", "tags", 1, 0)]
    written = json.loads(enhancement.written_fields(enhancement.enhanced(notes, suggested=said)).collect()[0].fields["tags"])
    assert written == ["a", "b"]


def test_many_tags_that_share_a_word(spark):
    notes = spark.createDataFrame([note(f"v/{i}.md", "the project at hand", str(i)) for i in range(20)], COLUMNS)
    many = spark.range(20_000).selectExpr("concat('project-', id) AS tag")
    near = enhancement.near_tags(notes, many).selectExpr("path", "size(near) AS n").collect()
    assert len(near) == 20 and {r.n for r in near} == {20_000}


def test_empty_table(spark):
    assert enhancement.enhanced(spark.createDataFrame([], COLUMNS)).count() == 0
