"""The scan of notes in Arrow batches finds what the column expressions find."""

import pytest
from pyspark.sql import functions as F

from notemill.operators import links, mentions, zones

ODD = [
    "",
    "\n",
    "# A [[x|y]] `code` http://a.b/c) <a href='u'>t</a>",
    "---\na: [[in front]]\n---\nb `c` [t](u) [[w]]\n",
    " --- \nopen [[x]]",
    "```\n[[a]]\n```\n[[b]] `q`\n```\nnever [[closed]]",
    "　# wide　\n | a | [[b]] | \n|\n| x",
    "a b <%* x  y *%> <%* x y *%> <%= [[in]] %> [[out]]",
    "${{[[a]]}} {{b [[c]] }} ${x} [[d| e ]] [[ f |\t]] [[g|h|i]] [[j|]]",
    "[a|b]: /u \"t\" [c|d]:x\n \t[e|f]: v\n[g](h)[i]( )[n [m]](o) [[p](q)]",
    "é𝒳 `𝒳` [[𝒳|é]] [𝒳](é) https://é.𝒳/ü end",
    "x\r# y\r\n| z |\r\n`a\r\nb` \x1c# not\x1c",
]


@pytest.fixture(scope="module")
def odd(spark):
    rows = [(f"n{i}", f"{i:04d}", "T", x) for i, x in enumerate([*ODD, None])]
    return spark.createDataFrame(rows, "path string, file_id string, title string, content string")


def plan(df):
    return df._jdf.queryExecution().optimizedPlan().toString()


def same(a, b):
    assert sorted(map(str, a.collect())) == sorted(map(str, b.collect()))


@pytest.mark.parametrize("tables", [True, False])
def test_zones_are_those_of_the_expressions(odd, tables):
    found = zones.zones(odd, tables)
    assert "lambda" not in plan(found)
    same(found, zones.zones(odd, tables, custom=["never there"]))


def test_links_are_those_of_the_expressions(odd):
    found = links.all_links(odd, links.LINK_TYPES, "file_id")
    assert "lambda" not in plan(found)
    each = links.lines(odd, "file_id").select("path", "file_id", "line_number", F.explode(links.line_links(F.col("line"))).alias("l"))
    same(found, each.select("path", "file_id", "l.kind", "l.target", "l.text", "line_number", "l.alias"))


def test_mentions_are_those_of_the_expressions(spark):
    names = ["Red Fox", "red", "(fox)", "fox-trot", "c++", "K", "Straße", "a.b"]
    texts = ["a red fox, RED FOX and redfox [[red fox]] `red`", "é red fox STRASSE straße K k", "x(fox) (fox) fox-trot C++ c++x a.b axb", "```\nred\n```\nred\n| red fox |\n```\nfox-trot", "---\nred\n---\nred fox", "K k K", None, "red"]
    rows = [(f"n{i}", f"{i:02d}", names[i], [], x) for i, x in enumerate(texts)]
    notes = spark.createDataFrame(rows, "path string, file_id string, title string, aliases array<string>, content string")
    for known in (notes, notes.where(F.col("title") == F.regexp_replace("title", "[^ -~]", ""))):
        for tables in (None, True, False):
            same(mentions.candidates(notes, mentions.targets(known), tables), mentions.candidates(notes, mentions.targets(known), tables, few=0))


def test_ascii_notes_are_searched_in_batches(spark):
    notes = spark.createDataFrame([("a", "1", "Red", [], "red and Red"), ("b", "2", "Blue", [], "é red")], "path string, file_id string, title string, aliases array<string>, content string")
    own = notes.select("path", F.col("file_id").alias("own_id"), "content")
    _, table = mentions._table(mentions.targets(notes), 256)
    found = mentions._scanned(own, table, True).collect()
    assert [(r.path, r.line_of, r.content) for r in found] == [("b", None, "é red")]
