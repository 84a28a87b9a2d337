import pytest

from notemill.operators import graph, links, mentions, stats, zones

COLUMNS = "path string, dir string, stem string, ext string, file_id string, fm_id string, title string, aliases array<string>, tags array<string>, present_keys array<string>, content string"


def note(path, content, file_id=None, title=None, aliases=(), tags=()):
    stem = path.rsplit("/", 1)[-1][:-3]
    return (path, "v", stem, ".md", file_id, file_id, title, list(aliases), list(tags), ["id"] if file_id else [], content)


@pytest.fixture
def notes(spark):
    def make(*rows):
        return spark.createDataFrame(list(rows), COLUMNS)

    return make


def test_extraction(notes):
    n = notes(note("v/a.md", 'See [[20230101120000| Alias ]] and [t](u)\n[id|al]: /p "T"\n${[[no]]} [[yes]]\n[[x]] {{[[n]]}} <% [[n]] %>'))
    assert [(r.line_number, r.column_start, r.column_end, r.target, r.alias) for r in links.wikilinks(n).orderBy("line_number", "column_start").collect()] == [
        (1, 4, 30, "20230101120000", "Alias"),
        (3, 10, 17, "yes", None),
        (4, 0, 5, "x", None),
    ]
    assert [(r.text, r.url) for r in links.regular_links(n).collect()] == [("t", "u")]
    assert [(r.id, r.alias, r.target, r.title) for r in links.definitions(n).collect()] == [("id", "al", "/p", "T")]


def test_dead_links_and_suggestions(notes):
    n = notes(note("v/a.md", "[[20230101120009]] [[b]] [[20230101120001]] [x]( )", "20230101120000"), note("v/b.md", "", "20230101120001"), note("v/c.md", "", "20230101120002"), note("v/d.md", "", "20230101120003"))
    dead = links.dead_links(n)
    out = {r.target: r.suggested_fixes for r in links.suggestions(dead, links.registry(n)).collect()}
    assert out == {"20230101120009": [f"Did you mean '2023010112000{i}'?" for i in (0, 1, 2)], "b": [], " ": []}
    assert {(r.link_type, r.dead) for r in stats.dead_link_totals(dead).collect()} == {("wikilink", 2), ("regular_link", 1), (None, 3)}
    with pytest.raises(ValueError):
        links.selected(dead, ["nonsense"])
    with pytest.raises(ValueError):
        links.selected(dead, sort_by="nonsense")


def spans(rows):
    return {(r.line_number, r.column_start, r.column_end, r.zone_type) for r in rows.collect()}


def test_zones(notes):
    content = "# Head\n```\n[[in]]\n```\ntext [[a]] `c` http://x.y\n| t |\n[i|a]: /p\n```\nopen [[z]]"
    found = spans(zones.zones(notes(note("v/a.md", content)), tables=True))
    assert found == {
        (1, 0, 6, "heading"),
        (2, 0, 3, "code_block"),
        (3, 0, 6, "code_block"),
        (4, 0, 3, "code_block"),
        (5, 5, 10, "wikilink"),
        (5, 11, 14, "inline_code"),
        (5, 15, 25, "url"),
        (6, 0, 5, "table"),
        (7, 0, 9, "link_ref_def"),
    }
    assert not any(z[3] == "table" for z in spans(zones.zones(notes(note("v/a.md", content)))))
    front = spans(zones.zones(notes(note("v/a.md", "---\n[[a]]\n---\n[[b]]"))))
    assert front == {(1, 0, 3, "frontmatter"), (2, 0, 5, "frontmatter"), (3, 0, 3, "frontmatter"), (4, 0, 5, "wikilink")}
    assert spans(zones.zones(notes(note("v/a.md", "---\n[[a]]")))) == set()
    assert (1, 2, 4, "custom") in spans(zones.zones(notes(note("v/a.md", "a BB c")), custom=["b+"]))


def test_mentions_conflicts_and_rewriting(notes):
    targets = [note("v/1.md", "", "20230101120000", "Interface Design", ["UI"]), note("v/2.md", "", "20230101120001", "Design"), note("v/3.md", "", "20230101120002", "design")]
    n = notes(*targets, note("v/a.md", "An interface design and a Design.\n`Design` redesign UI", "20230101120009", "A"))
    found = zones.outside(mentions.candidates(n, mentions.targets(n)), zones.zones(n)).where("path = 'v/a.md' AND text <> 'An' AND target_file_id <> '20230101120009'")
    got = {(r.line_number, r.column_start, r.text, r.target_file_id, r.notes) for r in found.collect()}
    assert got == {(1, 3, "interface design", "20230101120000", 1), (1, 13, "design", "20230101120001", 2), (1, 26, "Design", "20230101120001", 2), (2, 18, "UI", "20230101120000", 1)}
    chosen = mentions.resolved(found)
    assert {(r.text, r.conflicts) for r in chosen.collect()} == {("interface design", 1), ("Design", 0), ("UI", 0)}
    text = mentions.rewritten(n, mentions.capped(chosen, 50)).first()
    assert text.content == "An [[20230101120000|interface design]] and a [[20230101120001|Design]].\n`Design` redesign [[20230101120000|UI]]" and text.applied == 3
    assert mentions.capped(chosen, 1).count() == 1
    own = mentions.candidates(notes(*targets[1:], note("v/b.md", "design", "20230101120001", "Design")), mentions.targets(notes(*targets[1:])))
    assert [r.target_file_id for r in own.where("path = 'v/b.md'").collect()] == ["20230101120002"]


def test_notes_of_one_text_are_members_and_conflicts(notes):
    same = [note(f"v/{i}.md", "", f"2023010112000{i}", "Design") for i in range(4)]
    n = notes(*same, note("v/5.md", "", "20230101120005", "Plan"), note("v/a.md", "Design and Plan", "20230101120009", "A"), note("v/b.md", "Design", "20230101120002", "Design"))
    targets = mentions.targets(n)
    assert {r.file_id for r in mentions.members(targets).where("low = 'design'").collect()} == {f"2023010112000{i}" for i in range(4)}
    found = mentions.candidates(n, targets).where("path IN ('v/a.md', 'v/b.md') AND text <> 'a'")
    chosen = mentions.resolved(found)
    assert {(r.path, r.text, r.target_file_id, r.conflicts, r.others) for r in chosen.collect()} == {("v/a.md", "Design", "20230101120000", 0, 3), ("v/a.md", "Plan", "20230101120005", 0, 0), ("v/b.md", "Design", "20230101120000", 0, 2)}
    assert [r.text for r in mentions.capped(chosen.where("path = 'v/a.md'"), 1).collect()] == ["Plan"]


def test_orphan_rules(notes):
    n = notes(note("v/a.md", "[[2]]", "1"), note("v/b.md", "", "2"), note("v/c.md", "[x](y)", "3"), note("v/d.md", "[[4]]", "4"), note("v/e.md", "", None))
    wiki = links.wikilinks(n)
    edges = graph.edges(n)
    assert {(r.src, r.dst) for r in edges.collect()} == {("1", "2"), ("4", "4")}
    assert {r.fm_id for r in graph.orphans(n, graph.degrees(n, edges)).collect()} == {"3"}
    assert {r.path for r in graph.unlinked(n, wiki, links.regular_links(n)).collect()} == set()
