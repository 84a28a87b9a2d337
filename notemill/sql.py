"""SQL over notes: temporary views of the canonical tables, and table functions for operators with parameters.

    from notemill import sql
    sql.register(spark, notes, index)
    spark.sql("SELECT source_file, target FROM dead_links_of('wikilink') ORDER BY target")

Views and functions are definitions, not results: a query runs only what it reads, with
its filters pushed into the operators' plans.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from notemill.operators import graph, links, stats, tags, zones

#: The view of each table, and the operator behind it.
VIEWS = {
    "notes": lambda notes: notes,
    "note_lines": links.lines,
    "note_links": links.all_links,
    "wiki_links": links.wikilinks,
    "dead_links": lambda notes: links.suggestions(links.dead_links(notes), links.registry(notes)),
    "note_zones": lambda notes: zones.zones(notes, tables=True),
    "edges": graph.edges,
    "degrees": lambda notes: graph.degrees(notes, graph.edges(notes)),
    "orphans": lambda notes: graph.orphans(notes, graph.degrees(notes, graph.edges(notes))),
    "unlinked_notes": graph.unlinked,
    "tag_frequencies": tags.frequencies,
    "tag_pairs": tags.cooccurrence,
    "link_density": links.density,
    "content_statistics": stats.content_statistics,
}

#: Table functions over these views: (name, parameters, columns, query).
FUNCTIONS = (
    ("dead_links_of", "kind STRING", "source_file STRING, link_text STRING, line_number INT, target STRING", "SELECT source_file, link_text, line_number, target FROM dead_links WHERE link_type = kind"),
    ("links_from", "note STRING", "kind STRING, target STRING, line_number INT", "SELECT note_links.kind, note_links.target, note_links.line_number FROM note_links WHERE note_links.path = note"),
    ("links_to", "id STRING", "path STRING, line_number INT", "SELECT wiki_links.path, wiki_links.line_number FROM wiki_links WHERE wiki_links.target = id"),
    ("tagged", "wanted STRING", "path STRING, title STRING", "SELECT notes.path, notes.title FROM notes WHERE array_contains(notes.tags, wanted)"),
)
#: Over the view vectors, where an index is given. Products are summed from the first component on; equal ones rank by
#: ordinal. Ranks are made part by part first, so that no task ranks all vectors.
NEAREST = (
    "nearest",
    "asked ARRAY<DOUBLE>, most INT",
    "document_id STRING, similarity DOUBLE, rank INT",
    """SELECT r.document_id, r.similarity, r.rank FROM (
  SELECT p.document_id, p.similarity, row_number() OVER (ORDER BY p.similarity DESC, p.ordinal) AS rank FROM (
    SELECT s.document_id, s.ordinal, s.similarity, row_number() OVER (PARTITION BY s.part ORDER BY s.similarity DESC, s.ordinal) AS within FROM (
      SELECT vectors.document_id, vectors.ordinal, pmod(xxhash64(vectors.document_id), 64) AS part, aggregate(zip_with(vectors.vector, asked, (x, y) -> x * y), CAST(0 AS DOUBLE), (t, x) -> t + x)
        / sqrt(aggregate(asked, CAST(0 AS DOUBLE), (t, x) -> t + x * x)) AS similarity FROM vectors) s) p WHERE p.within <= most) r WHERE r.rank <= most""",
)


def register(spark: SparkSession, notes: DataFrame, index: DataFrame | None = None) -> list[str]:
    """Makes the views of notes, of an index as view vectors where there is one, and the functions; their names."""
    made = []
    for name, of in VIEWS.items():
        of(notes).createOrReplaceTempView(name)
        made.append(name)
    functions = list(FUNCTIONS)
    if index is not None:
        index.createOrReplaceTempView("vectors")
        functions.append(NEAREST)
        made.append("vectors")
    for name, parameters, columns, query in functions:
        spark.sql(f"CREATE OR REPLACE TEMPORARY FUNCTION {name}({parameters}) RETURNS TABLE ({columns}) RETURN {query}")
        made.append(name)
    return made
