import pytest

from notemill import sql
from notemill.operators import graph, links, vectors
from tests.test_links import COLUMNS, note


@pytest.fixture
def made(spark):
    notes = spark.createDataFrame([note("v/a.md", "[[2]] [[gone]] [x]( )", "1", "A", tags=["t"]), note("v/b.md", "[[1]]", "2", "B"), note("v/c.md", "", "3", "C", tags=["t", "u"])], COLUMNS)
    rows = [(str(i), v, {}, i) for i, v in enumerate([[1.0, 0.0], [0.6, 0.8], [0.0, 1.0], [1.0, 0.0]])]
    index = spark.createDataFrame(rows, "document_id string, vector array<double>, metadata map<string,string>, ordinal long")
    return notes, index, sql.register(spark, notes, index)


def test_views_are_the_operators(spark, made):
    notes, _, names = made
    assert {"notes", "dead_links", "orphans", "vectors", "nearest", "dead_links_of"} <= set(names)
    rows = lambda df: sorted(map(tuple, df.collect()), key=str)
    assert rows(spark.sql("SELECT * FROM edges")) == rows(graph.edges(notes))
    assert rows(spark.sql("SELECT source_file, target FROM dead_links_of('wikilink')")) == [("v/a.md", "gone")]
    assert rows(spark.sql("SELECT source_file, link_type FROM dead_links")) == rows(links.dead_links(notes).select("source_file", "link_type"))
    assert rows(spark.sql("SELECT fm_id FROM orphans WHERE isolation = 1")) == [("3",)]
    assert rows(spark.sql("SELECT path FROM tagged('t')")) == [("v/a.md",), ("v/c.md",)]
    assert rows(spark.sql("SELECT path FROM links_to('1')")) == [("v/b.md",)] and rows(spark.sql("SELECT target FROM links_from('v/b.md')")) == [("1",)]
    assert rows(spark.sql("SELECT n.title, d.incoming FROM notes n JOIN degrees d ON n.fm_id = d.fm_id WHERE d.incoming > 0")) == [("A", 1), ("B", 1)]


def test_nearest_is_the_search(spark, made):
    _, index, _ = made
    for asked, k in (([2.0, 0.0], 3), ([1.0, 1.0], 1), ([0.0, 3.0], 9)):
        got = [(r.document_id, round(r.similarity, 9)) for r in spark.sql("SELECT * FROM nearest(:asked, :k) ORDER BY rank", args={"asked": asked, "k": k}).collect()]
        assert got == [(r.document_id, round(r.similarity, 9)) for r in vectors.search(index, asked, k).collect()]
