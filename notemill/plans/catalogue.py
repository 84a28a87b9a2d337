"""The catalogue of named queries and of the SQL they are checked against.

Three queries of SQL end in an order: DuckDB 2.0 with four threads or more never ends when
they are put under a LIMIT without one. Doubles are rounded to six places on both sides of the comparison and arrays are joined to
strings; the operators themselves return them unrounded.
"""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from notemill import sql
from notemill.operators import analysis, connections, enhancement, graph, japanese, keywords, links, mentions, repair, report, services, similarity, stats, tags, validation, vectors, zones
from notemill.plans import oracle as o
from notemill.session import cut
from notemill.sources import adapters, index_store, rules
from notemill.streaming import index

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None) -> Callable[[Query], Query]:
    """Registers a query under its name, with its SQL where there is one."""

    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def rounded(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.round(n, 6) for n in names})


def joined(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: F.array_join(n, "; ") for n in names})


# Lines and links


@query(f"WITH {o.NOTES} SELECT path, generate_subscripts(string_split(content, chr(10)), 1)::INT AS line_number, unnest(string_split(content, chr(10))) AS line FROM notes")
def q_lines(spark, d):
    return links.lines(adapters.document_notes(spark, d))


@query(f"WITH {o.LINKS} SELECT path, line_number::INT AS line_number, target, CASE WHEN alias <> '' THEN alias END AS alias FROM wiki")
def q_wikilinks(spark, d):
    return links.wikilinks(adapters.vault(spark, d)).select("path", "line_number", "target", "alias")


@query(f"WITH {o.LINKS} SELECT path, line_number::INT AS line_number, text, url FROM regular")
def q_regular_links(spark, d):
    return links.regular_links(adapters.vault(spark, d))


@query(f"WITH {o.LINKS} SELECT path, line_number::INT AS line_number, d.id AS id, d.alias AS alias, d.target AS target, d.title AS title FROM definition")
def q_definitions(spark, d):
    return links.definitions(adapters.vault(spark, d))


@query(f"WITH {o.LINKS} SELECT source_file, link_text, link_type, line_number::INT AS line_number, target FROM dead")
def q_dead_links(spark, d):
    return links.dead_links(adapters.vault(spark, d))


@query(
    f"""WITH {o.LINKS}, ids AS (SELECT substring(file_id, 1, 4) AS prefix, list_sort(list(DISTINCT file_id))[1:4] AS ids FROM vault GROUP BY 1)
SELECT source_file, link_text, link_type, line_number::INT AS line_number, target, CASE WHEN link_type = 'wikilink' AND length(target) >= 4 AND ids IS NOT NULL
  THEN array_to_string(list_transform(list_filter(ids, lambda x: x <> target)[1:3], lambda x: concat('Did you mean ''', x, '''?')), '; ') ELSE '' END AS suggested_fixes
FROM dead LEFT JOIN ids ON link_type = 'wikilink' AND prefix = substring(target, 1, 4)"""
)
def q_dead_suggestions(spark, d):
    notes = adapters.vault(spark, d)
    known = notes.select("file_id")
    return joined(links.suggestions(links.dead_links(notes, known), known), "suggested_fixes")


@query(f"WITH {o.LINKS} SELECT link_type, count(*) AS dead, count(DISTINCT source_file) AS files FROM dead GROUP BY ROLLUP (link_type)")
def q_dead_by_type(spark, d):
    return stats.dead_link_totals(links.dead_links(adapters.vault(spark, d)))


@query(f"WITH {o.LINKS} SELECT source_file, link_text, link_type, line_number::INT AS line_number, target FROM dead WHERE link_type = 'wikilink' ORDER BY target, source_file, line_number, link_text LIMIT 50")
def q_dead_sorted_limit(spark, d):
    return links.selected(links.dead_links(adapters.vault(spark, d)), ["wikilink"], sort_by="target", limit=50)


@query(
    f"""WITH {o.LINKS}, w AS (SELECT path, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> ''))::INT AS words FROM vault),
k AS (SELECT path, count(*) FILTER (kind = 'wikilink') AS wiki_links, count(*) FILTER (kind = 'regular_link') AS regular_links, count(*) FILTER (kind = 'link_reference_definition') AS definitions,
  count(DISTINCT target) AS unique_targets, count(*) AS total FROM links GROUP BY path)
SELECT path, words, coalesce(wiki_links, 0) AS wiki_links, coalesce(regular_links, 0) AS regular_links, coalesce(definitions, 0) AS definitions, coalesce(unique_targets, 0) AS unique_targets,
  coalesce(total, 0) AS total_links, round(CASE WHEN words > 0 THEN coalesce(total, 0) / words::DOUBLE * 100 ELSE 0 END, 6) AS density FROM w LEFT JOIN k USING (path) ORDER BY ALL"""
)
def q_link_density(spark, d):
    return rounded(links.density(adapters.vault(spark, d)), "density")


# Zones: the oracle recomputes fences with a window over lines.


@query(
    f"""WITH {o.LINKS}, s AS (SELECT *, starts_with(trim(line), '```') AS fence, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY path ORDER BY line_number) AS upto,
  sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY path) AS total FROM split),
t AS (SELECT *, (upto % 2 = 1) OR fence AS inside, CASE WHEN upto % 2 = 1 THEN total > upto ELSE true END AS closed FROM s),
z AS (SELECT 'code_block' AS zone_type, 1 AS n FROM t WHERE inside AND closed
 UNION ALL SELECT 'heading', 1 FROM t WHERE NOT inside AND starts_with(trim(line), '# ')
 UNION ALL SELECT 'table', 1 FROM t WHERE NOT inside AND starts_with(trim(line), '|') AND ends_with(trim(line), '|')
 UNION ALL SELECT 'link_ref_def', len(regexp_extract_all(line, '\\[[^\\]]+\\|[^\\]]+\\]:\\s*\\S+')) FROM t WHERE NOT inside
 UNION ALL SELECT 'url', len(regexp_extract_all(line, 'https?://[^\\s\\)]+')) FROM t WHERE NOT inside
 UNION ALL SELECT 'inline_code', len(regexp_extract_all(line, '`[^`]+`')) FROM t WHERE NOT inside
 UNION ALL SELECT 'wikilink', len(regexp_extract_all(line, '\\[\\[[^\\]]+\\]\\]')) FROM t WHERE NOT inside
 UNION ALL SELECT 'template_variable', len(regexp_extract_all(line, '\\$\\{{[^}}]*\\}}')) FROM t WHERE NOT inside
 UNION ALL SELECT 'template_templater', len(regexp_extract_all(line, '<%[^%]*%>')) FROM t WHERE NOT inside)
SELECT zone_type, sum(n)::BIGINT AS zones FROM z GROUP BY 1 HAVING sum(n) > 0"""
)
def q_zones_by_type(spark, d):
    kinds = ["code_block", "heading", "table", "link_ref_def", "url", "inline_code", "wikilink", "template_variable", "template_templater"]
    found = zones.zones(adapters.vault(spark, d), tables=True)
    return found.where(F.col("zone_type").isin(kinds)).groupBy("zone_type").agg(F.count("*").alias("zones"))


@query(f"WITH {o.LINKS}, {o.ZONES} SELECT path, line_number::INT AS line_number, column_start::INT AS column_start, column_end::INT AS column_end, zone_type FROM zone")
def q_zones(spark, d):
    return zones.zones(adapters.vault(spark, d), tables=True)


# Statistics


@query(
    f"""WITH {o.VAULT}, e AS (SELECT CASE WHEN path LIKE '%/parts/%' THEN '.markdown' ELSE '.md' END AS ext, NOT ends_with(stem, '3') AS fm, NOT ends_with(stem, '7') AS named FROM vault)
SELECT CASE WHEN grouping(ext) = 0 THEN ext END AS extension, count(*) AS total_files, count(*) FILTER (fm) AS with_frontmatter, count(*) FILTER (named) AS with_id FROM e GROUP BY ROLLUP (ext)"""
)
def q_file_stats(spark, d):
    mixed = adapters.vault(spark, d).select(
        F.when(F.col("path").contains("/parts/"), ".markdown").otherwise(".md").alias("ext"),
        F.when(F.col("stem").endswith("3"), F.array().cast("array<string>")).otherwise(F.col("present_keys")).alias("present_keys"),
        F.when(~F.col("stem").endswith("7"), F.col("file_id")).alias("file_id"),
    )
    return stats.file_statistics(mixed)


@query(f"WITH {o.VAULT}, k AS (SELECT unnest(['title', 'tags', 'id']) AS field FROM order_notes UNION ALL SELECT unnest(['title', 'aliases', 'tags', 'id']) FROM part_notes) SELECT field, count(*) AS files FROM k GROUP BY 1")
def q_field_distribution(spark, d):
    return stats.field_distribution(adapters.vault(spark, d))


@query(f"WITH {o.LINKS} SELECT kind, count(*) AS total, count(DISTINCT path) AS files, round(count(*) / (SELECT count(*) FROM vault)::DOUBLE, 6) AS average FROM links GROUP BY ROLLUP (kind)")
def q_link_stats(spark, d):
    notes = adapters.vault(spark, d)
    return rounded(stats.link_statistics(links.all_links(notes), notes), "average")


@query("SELECT sum(length(text))::BIGINT AS total_length, round(avg(length(text)), 6) AS average_length, max(length(text))::INT AS max_length, min(length(text))::INT AS min_length FROM documents")
def q_content_stats(spark, d):
    return rounded(stats.content_statistics(adapters.document_notes(spark, d)), "average_length")


# Graph


@query(f"WITH {o.LINKS} SELECT src, target AS dst FROM wiki WHERE target IN (SELECT file_id FROM vault) ORDER BY ALL")
def q_edges(spark, d):
    notes = adapters.vault(spark, d)
    return graph.edges(notes)


_DEGREES = f"""WITH {o.LINKS}, e AS (SELECT src, target AS dst FROM wiki WHERE target IN (SELECT file_id FROM vault)),
deg AS (SELECT file_id AS fm_id, coalesce(i.n, 0) AS incoming, coalesce(u.n, 0) AS outgoing FROM vault LEFT JOIN (SELECT dst, count(*) AS n FROM e GROUP BY 1) i ON i.dst = file_id
  LEFT JOIN (SELECT src, count(*) AS n FROM e GROUP BY 1) u ON u.src = file_id)"""


@query(f"{_DEGREES} SELECT * FROM deg ORDER BY ALL")
def q_degrees(spark, d):
    notes = adapters.vault(spark, d)
    return graph.degrees(notes, graph.edges(notes))


@query(
    f"""{_DEGREES}, s AS (SELECT *, incoming + outgoing AS g, CASE WHEN incoming + outgoing = 0 THEN 1.0 ELSE 1 - least(1.0, (incoming + outgoing) / greatest(2.0, (SELECT count(*) FROM vault) * 0.05::DOUBLE)) END AS iso FROM deg)
SELECT fm_id, incoming, outgoing, round(iso::DOUBLE, 6) AS isolation FROM s WHERE g = 0 OR (g <= 1 AND iso >= 0.7)"""
)
def q_orphans(spark, d):
    notes = adapters.vault(spark, d)
    return rounded(graph.orphans(notes, graph.degrees(notes, graph.edges(notes))), "isolation")


@query(f"WITH {o.LINKS} SELECT path, file_id FROM vault v WHERE path NOT IN (SELECT path FROM wiki UNION SELECT path FROM regular) AND NOT EXISTS (SELECT 1 FROM wiki w WHERE w.target = v.file_id AND w.path <> v.path)")
def q_orphans_strict(spark, d):
    notes = adapters.vault(spark, d)
    return graph.unlinked(notes)


# Tags

_TAGS = f"WITH {o.VAULT}, t AS (SELECT path, unnest(list_distinct(tags)) AS tag FROM vault), f AS (SELECT tag, count(*) AS files FROM t GROUP BY 1)"
_PAIRS = f"{_TAGS}, p AS (SELECT a.tag, b.tag AS other, count(*) AS together FROM t a JOIN t b ON a.path = b.path AND a.tag <> b.tag GROUP BY 1, 2)"


@query(f"{_TAGS} SELECT tag, files FROM f")
def q_tag_freq(spark, d):
    return tags.frequencies(adapters.vault(spark, d))


@query(f"{_PAIRS} SELECT p.tag, other, together, round(together / files::DOUBLE, 6) AS strength FROM p JOIN f ON p.tag = f.tag")
def q_tag_cooc(spark, d):
    return rounded(tags.cooccurrence(adapters.vault(spark, d)), "strength")


@query(f"{_PAIRS} SELECT p.tag, other, round(together / files::DOUBLE, 6) AS strength FROM p JOIN f ON p.tag = f.tag WHERE together / files::DOUBLE >= 0.3")
def q_tag_related(spark, d):
    return rounded(tags.related(tags.cooccurrence(adapters.vault(spark, d))), "strength")


@query(f"{_TAGS} SELECT tag FROM f WHERE files = 1")
def q_tag_orphans(spark, d):
    return tags.rare(adapters.vault(spark, d))


@query(o.tag_suggestions())
def q_tag_suggest(spark, d):
    return rounded(tags.suggestions(adapters.document_notes(spark, d)), "confidence")


# Keywords: texts here have no code, links or Japanese, so one token pattern tells all.


@query()
def q_keywords(spark, d):
    return keywords.note_keywords(adapters.document_notes(spark, d))


@query()
def q_keyword_stats(spark, d):
    return keywords.statistics(adapters.document_notes(spark, d))


# Similarity


@query(
    f"""WITH {o.NOTES}, s AS (SELECT list_sort({o.word_set("title")}) AS w, min(path) AS id FROM notes GROUP BY 1), e AS (SELECT id, len(w) AS n, unnest(w) AS x FROM s),
p AS (SELECT a.id AS a, b.id AS b, count(*) AS c, a.n AS na, b.n AS nb FROM e a JOIN e b ON a.x = b.x AND a.id < b.id GROUP BY ALL)
SELECT a, b, round(c / (na + nb - c)::DOUBLE, 6) AS similarity FROM p WHERE c / (na + nb - c)::DOUBLE >= 0.7"""
)
def q_title_jaccard(spark, d):
    return rounded(similarity.similar_titles(adapters.document_notes(spark, d)), "similarity")


@query(
    f"""WITH {o.NOTES}, reps AS (SELECT min(path) AS path, title, content FROM notes GROUP BY 2, 3),
r AS (SELECT path, regexp_replace(path, '/[^/]*$', '') AS dir, length(content) < 200 AS tiny, {o.word_set("title")} AS t, {o.main("content")} AS m FROM reps), w AS (SELECT *, {o.word_set("m")} AS c FROM r),
te AS (SELECT path, len(t) AS n, unnest(t) AS x FROM w), ce AS (SELECT path, len(c) AS n, unnest(c) AS x FROM w),
tj AS (SELECT a.path AS a, b.path AS b, count(*) / (a.n + b.n - count(*))::DOUBLE AS s FROM te a JOIN te b ON a.x = b.x AND a.path < b.path GROUP BY a.path, b.path, a.n, b.n),
cj AS (SELECT a.path AS a, b.path AS b, count(*) / least(a.n, b.n)::DOUBLE AS s FROM ce a JOIN ce b ON a.x = b.x AND a.path < b.path GROUP BY a.path, b.path, a.n, b.n),
p0 AS (SELECT a, b, coalesce(tj.s, 0) AS t, coalesce(cj.s, 0) AS c FROM tj FULL JOIN cj USING (a, b)),
p AS (SELECT * FROM p0 WHERE t >= 0.7 OR c >= 0.7 UNION ALL
  SELECT x.path, y.path, coalesce(tj.s, 0), 0 FROM w x JOIN w y ON x.m = y.m AND x.path < y.path LEFT JOIN tj ON tj.a = x.path AND tj.b = y.path WHERE length(x.m) < 100 AND len(x.c) = 0 AND coalesce(tj.s, 0) < 0.7),
q AS (SELECT p.a, p.b, p.t, CASE WHEN length(x.m) < 100 AND length(y.m) < 100 THEN (x.m = y.m)::INT::DOUBLE ELSE p.c END AS c, x.tiny AND y.tiny AS tiny, x.dir = y.dir AS near FROM p JOIN w x ON x.path = p.a JOIN w y ON y.path = p.b),
s AS (SELECT *, greatest(t, c, t * 0.4::DOUBLE + c * 0.4::DOUBLE) AS similarity, CASE WHEN t > 0.7 AND c > 0.7 THEN least(1, greatest(t, c) + 0.1::DOUBLE) ELSE greatest(t, c) END AS k1 FROM q),
u AS (SELECT *, CASE WHEN c > 0.9 AND tiny THEN least(1, k1 + 0.1::DOUBLE) ELSE k1 END AS k2 FROM s), v AS (SELECT *, CASE WHEN near THEN k2 ELSE greatest(0, k2 - 0.1::DOUBLE) END AS k FROM u WHERE similarity >= 0.7),
z AS (SELECT *, CASE WHEN t >= c THEN 'title' ELSE 'content' END AS kind FROM v)
SELECT a, b, round(t, 6) AS title_similarity, round(c, 6) AS content_similarity, 0.0::DOUBLE AS filename_similarity, round(similarity, 6) AS similarity, kind AS match_type, round(k, 6) AS confidence, k > 0.8 AS is_likely_duplicate,
  CASE WHEN k > 0.95 THEN 'Files are nearly identical: keep one' WHEN k > 0.8 THEN printf('Consider merging (%s similarity %.2f)', kind, similarity) END AS suggestion FROM z"""
)
def q_duplicates(spark, d):
    pairs = similarity.duplicates(adapters.document_notes(spark, d))
    return rounded(similarity.merge_strategy(pairs), "title_similarity", "content_similarity", "filename_similarity", "similarity", "confidence")


@query(f"WITH {o.NOTES}, c AS (SELECT title, content, min(path) AS representative FROM notes GROUP BY 1, 2) SELECT path, representative FROM notes JOIN c USING (title, content)")
def q_copy_classes(spark, d):
    return similarity.classes(adapters.document_notes(spark, d), "title", "content").select("path", "representative")


# Mentions and rewriting


def _mentions(spark, d):
    notes = adapters.vault(spark, d)
    return notes, mentions.candidates(notes, mentions.targets(adapters.part_notes(spark, d)), tables=True)


@query(f"WITH {o.MENTIONS} SELECT * EXCLUDE (low) FROM mention")
def q_mentions(spark, d):
    return _mentions(spark, d)[1]


@query(f"WITH {o.TARGETS} SELECT * FROM target")
def q_mention_targets(spark, d):
    return mentions.members(mentions.targets(adapters.part_notes(spark, d)))


@query(f"WITH RECURSIVE {o.CONFLICTS} SELECT * FROM resolved")
def q_conflicts(spark, d):
    return mentions.resolved(_mentions(spark, d)[1])


@query(f"WITH RECURSIVE {o.REWRITTEN} SELECT path, content, applied FROM rewritten")
def q_rewritten(spark, d):
    notes, found = _mentions(spark, d)
    return mentions.rewritten(notes, mentions.capped(mentions.resolved(found), 50))


# Brands as notes whose titles are spelled otherwise in the texts, so that every one gets an alias.


@query(f"WITH {o.brand_mentions()} SELECT file_id, new_aliases FROM updates")
def q_alias_updates(spark, d):
    brand = F.regexp_replace("p_brand", "Brand#", "")
    names = adapters.table(spark, d, "part").select(brand.alias("b")).distinct().select(F.concat(F.lit("brand-"), "b").alias("file_id"), F.concat(F.lit("サーバー"), "b").alias("title"), F.array().cast("array<string>").alias("aliases"))
    notes = adapters.vault(spark, d).withColumn("content", F.replace("content", F.lit("Brand#"), F.lit("サバ")))
    found = mentions.candidates(notes, mentions.targets(names), tables=True)
    return joined(mentions.alias_updates(mentions.resolved(found), names), "new_aliases")


# Analysis

_LOW = f"WITH {o.NOTES}, l AS (SELECT *, lower(content) AS low FROM notes)"


@query(f"{_LOW} SELECT path, array_to_string({o.categories('low')}, '; ') AS categories FROM l")
def q_category(spark, d):
    notes = adapters.document_notes(spark, d)
    return joined(notes.select("path", analysis.category(F.col("content")).alias("categories")), "categories")


@query(f"{_LOW} SELECT path, array_to_string({o.content_tag_list('low')}, '; ') AS tags FROM l")
def q_content_tags(spark, d):
    notes = adapters.document_notes(spark, d)
    return joined(notes.select("path", analysis.content_tags(F.col("content"))["tags"].alias("tags")), "tags")


_CHECKS = f"""{_LOW}, c AS (SELECT path, len(list_filter({o.content_tag_list("low")}, lambda t: NOT list_contains(tags, t))) > 0 AS t, len({o.categories("low")}) > 0 AS g,
  len(list_filter(list_transform(string_split(content, chr(10)), lambda x: trim(x)), lambda x: x <> '' AND NOT starts_with(x, '#'))) > 0 AS a,
  trim(title) <> '' AS has_title,
  coalesce(len(list_intersect({o.word_set("stem")}, {o.word_set("title")})) / nullif(len(list_distinct(list_concat({o.word_set("stem")}, {o.word_set("title")}))), 0)::DOUBLE, 0) < 0.5 AND trim(title) <> '' AS m,
  length(trim(content, E' \\n\\t\\r')) < 100 AS s, regexp_matches(content, '(?i)TODO|FIXME|placeholder|coming soon|to be written|未完成|作成中') AS u FROM l)"""


@query(
    f"""{_CHECKS} SELECT path, (4 + (NOT has_title)::INT + t::INT + a::INT + g::INT + m::INT + s::INT + u::INT)::INT AS improvements_found,
  round(greatest(0, least(1, 1 - 0.25 * (4 + (NOT has_title)::INT) - 0.15 * t::INT - 0.15 * a::INT - 0.1 * g::INT - 0.1 * m::INT - 0.3 * s::INT - 0.25 * u::INT))::DOUBLE, 6) AS quality_score FROM c"""
)
def q_quality(spark, d):
    return rounded(analysis.quality(analysis.improvements(adapters.document_notes(spark, d))), "quality_score")


_IMPROVEMENTS = f"""{_CHECKS}, i AS (SELECT unnest(list_filter([CASE WHEN NOT has_title THEN 'missing_required_field:title' END, 'missing_required_field:aliases', 'missing_required_field:published', 'missing_required_field:description',
  'missing_required_field:category', CASE WHEN t THEN 'missing_tags:tags' END, CASE WHEN a THEN 'missing_description:description' END, CASE WHEN g THEN 'missing_category:category' END, CASE WHEN m THEN 'filename_mismatch:title' END,
  CASE WHEN s THEN 'incomplete_content:content' END, CASE WHEN u THEN 'placeholder_content:content' END], lambda x: x IS NOT NULL)) AS i FROM c)"""


@query(f"{_IMPROVEMENTS} SELECT split_part(i, ':', 1) AS improvement_type, split_part(i, ':', 2) AS field_name, count(*) AS notes FROM i GROUP BY 1, 2")
def q_improvements(spark, d):
    return analysis.improvement_counts(analysis.improvements(adapters.document_notes(spark, d)))


@query(
    f"""{_IMPROVEMENTS}, k AS (SELECT split_part(i, ':', 1) AS k FROM i) SELECT CASE WHEN contains(k, 'required') THEN 'frontmatter' WHEN contains(k, 'description') OR contains(k, 'category') THEN 'metadata' WHEN contains(k, 'tags') THEN 'tags'
  WHEN contains(k, 'content') THEN 'content' ELSE 'other' END AS area, count(*) AS improvements FROM k GROUP BY 1"""
)
def q_improvement_areas(spark, d):
    return analysis.categorised(analysis.improvements(adapters.document_notes(spark, d)))


@query(
    f"""WITH {o.NOTES}, l AS (SELECT path, list_transform(string_split(content, chr(10)), lambda x: trim(x, E' \\n\\t\\r')) AS x FROM notes),
f AS (SELECT path, x, list_position(list_transform(x, lambda y: y <> '' AND NOT starts_with(y, '#')), true) AS i FROM l), g AS (SELECT path, x[i:] AS x FROM f),
h AS (SELECT path, array_to_string(list_filter(x[1:coalesce(nullif(list_position(x, ''), 0) - 1, len(x))], lambda y: NOT starts_with(y, '#')), ' ') AS t FROM g)
SELECT notes.path, CASE WHEN t = '' THEN NULL WHEN length(t) > 150 THEN concat(substring(t, 1, 147), '...') ELSE t END AS description FROM notes LEFT JOIN h USING (path)"""
)
def q_description(spark, d):
    return analysis.descriptions(adapters.document_notes(spark, d)).select("path", "description")


@query(f"WITH {o.META} SELECT * FROM meta")
def q_metadata(spark, d):
    return analysis.metadata(adapters.document_notes(spark, d))


_GAPS = """WITH g AS (SELECT (doc_id % 5 = 0)::INT AS t, (doc_id % 3 = 0)::INT AS i, (doc_id % 7 = 0)::INT AS n, (doc_id % 7 < 2)::INT AS f FROM documents), s AS (SELECT *, t + i + n + f AS k FROM g)"""


@query(f"{_GAPS} SELECT count(*) AS notes, sum(t)::BIGINT AS without_title, sum(i)::BIGINT AS without_id, sum(n)::BIGINT AS without_tags, sum(f)::BIGINT AS few_tags, count(*) FILTER (k >= 3) AS high, count(*) FILTER (k = 2) AS medium, count(*) FILTER (k <= 1) AS low FROM s")
def q_opportunities(spark, d):
    n = F.col("file_id").cast("long")
    lacking = adapters.document_notes(spark, d).select(
        F.when(n % 5 != 0, F.lit("T")).alias("title"), F.when(n % 3 != 0, F.col("fm_id")).alias("fm_id"), F.when(n % 7 == 0, F.array().cast("array<string>")).when(n % 7 == 1, F.array("dir")).otherwise(F.col("tags")).alias("tags")
    )
    return analysis.opportunities(lacking)


# Validation: a fixed schema on documents, with fields that some rows lack or break.


def _fields(spark, d):
    t = adapters.table(spark, d, "documents")
    quoted = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    pairs = F.array(
        F.when(F.col("doc_id") % 5 != 0, F.struct(F.lit("title").alias("k"), quoted(F.col("source")).alias("v"))),
        F.struct(F.lit("id").alias("k"), quoted(F.when(F.col("doc_id") % 3 == 0, F.lpad(F.col("doc_id").cast("string"), 14, "0")).otherwise(F.col("doc_id").cast("string"))).alias("v")),
        F.when(F.col("doc_id") % 4 == 0, F.struct(F.lit("date").alias("k"), F.lit('"2024/1/5"').alias("v"))),
        F.struct(F.lit("tags").alias("k"), F.when(F.col("doc_id") % 7 == 0, F.lit('"one"')).otherwise(F.lit('["one"]')).alias("v")),
    )
    return t.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.map_from_entries(F.array_compact(pairs)).alias("fields"))


_VALID = """WITH v AS (SELECT concat('doc_', doc_id) AS path, CASE WHEN doc_id % 5 = 0 THEN 'title' ELSE '' END AS missing_fields,
  array_to_string(list_filter([CASE WHEN doc_id % 7 = 0 THEN 'tags: expected array, got string' END, CASE WHEN doc_id % 3 <> 0 THEN 'id: does not match ^\\d{14}$' END,
    CASE WHEN doc_id % 4 = 0 THEN 'date: does not match ^\\d{4}-\\d{2}-\\d{2}$' END], lambda x: x IS NOT NULL), '; ') AS invalid_fields FROM documents)"""


@query(f"{_VALID} SELECT path, missing_fields = '' AND invalid_fields = '' AS is_valid, missing_fields, invalid_fields FROM v")
def q_validation(spark, d):
    return joined(validation.validate(_fields(spark, d)), "missing_fields", "invalid_fields").select("path", "is_valid", "missing_fields", "invalid_fields")


@query(
    f"""{_VALID}, w AS (SELECT *, (missing_fields = '' AND invalid_fields = '') AS ok, (missing_fields <> '')::INT AS m, CASE WHEN invalid_fields = '' THEN 0 ELSE len(string_split(invalid_fields, '; ')) END AS i FROM v)
SELECT count(*) AS total, count(*) FILTER (ok) AS valid, count(*) FILTER (NOT ok) AS invalid, sum(m)::BIGINT AS missing_issues, sum(i)::BIGINT AS invalid_issues, round(count(*) FILTER (ok) / count(*)::DOUBLE, 6) AS valid_rate FROM w"""
)
def q_validation_summary(spark, d):
    return rounded(validation.summary(validation.validate(_fields(spark, d))), "valid_rate")


@query(
    """SELECT concat('doc_', doc_id) AS path, 'title' AS field_name, 'add' AS fix_type, '' AS suggested_value FROM documents WHERE doc_id % 5 = 0
UNION ALL SELECT concat('doc_', doc_id), 'date', 'modify', '2024-1-5' FROM documents WHERE doc_id % 4 = 0"""
)
def q_validation_fixes(spark, d):
    rows = _fields(spark, d)
    return validation.fixes(rows, validation.validate(rows), "20240101000000")


# Template mode: documents by turns of three templates, each checked against the rows of its own.

_TEMPLATES = {
    "plain": validation.NOTE_SCHEMA,
    "booksearchtemplate": (validation.Field("title", "string", True), validation.Field("tags", "array"), validation.Field("isbn", "string", True, pattern=validation.PATTERNS["isbn"])),
    "new-fleeing-note": (validation.Field("title", "string", True), validation.Field("id", "string", True, pattern=validation.PATTERNS["id"]), validation.Field("tags", "array"), validation.Field("published", "string", True, "2024-01-01")),
}


def _by_template(spark, d):
    turn = F.regexp_replace("path", "doc_", "").cast("long") % 3
    rows = _fields(spark, d).withColumn("template", F.when(turn == 0, "plain").when(turn == 1, "booksearchtemplate").otherwise("new-fleeing-note"))
    return rows, validation.schema_rows(spark, _TEMPLATES)


_TEMPLATED = r"""WITH d AS (SELECT doc_id, concat('doc_', doc_id) AS path, doc_id % 3 AS k, doc_id % 5 = 0 AS untitled, doc_id % 7 = 0 AS one_tag, doc_id % 4 = 0 AS dated FROM documents),
v AS (SELECT doc_id, path, ['plain', 'booksearchtemplate', 'new-fleeing-note'][k + 1] AS template, k,
  list_filter([CASE WHEN untitled THEN 'title' END, CASE WHEN k = 1 THEN 'isbn' END, CASE WHEN k = 2 THEN 'published' END], lambda x: x IS NOT NULL) AS missing,
  list_filter([CASE WHEN k = 2 THEN 'id: does not match ^\d{14}$' END, CASE WHEN one_tag THEN 'tags: expected array, got string' END, CASE WHEN k = 0 AND dated THEN 'date: does not match ^\d{4}-\d{2}-\d{2}$' END], lambda x: x IS NOT NULL) AS invalid,
  list_filter([CASE WHEN k = 0 THEN 'id is not a time stamp' END, CASE WHEN dated THEN 'date is not a date' END, CASE WHEN k = 1 THEN concat('unexpected fields: ', CASE WHEN dated THEN 'date, ' ELSE '' END, 'id') WHEN k = 2 AND dated THEN 'unexpected fields: date' END,
    CASE WHEN k = 1 THEN 'recommended fields: author, publisher, totalPage' WHEN k = 2 THEN 'recommended fields: category, description' END], lambda x: x IS NOT NULL) AS warnings FROM d)"""


@query(f"{_TEMPLATED} SELECT path, template, len(missing) = 0 AND len(invalid) = 0 AS is_valid, array_to_string(missing, '; ') AS missing_fields, array_to_string(invalid, '; ') AS invalid_fields, array_to_string(warnings, '; ') AS warnings FROM v")
def q_template_validation(spark, d):
    return joined(validation.by_template(*_by_template(spark, d)), "missing_fields", "invalid_fields", "warnings")


@query(
    f"""{_TEMPLATED} SELECT template, count(*) AS total, count(*) FILTER (len(missing) + len(invalid) = 0) AS valid, count(*) FILTER (len(missing) + len(invalid) > 0) AS invalid, count(*) FILTER (len(warnings) > 0) AS with_warnings,
  sum(len(missing))::BIGINT AS missing_issues, sum(len(invalid))::BIGINT AS invalid_issues FROM v GROUP BY ROLLUP (template)"""
)
def q_template_summary(spark, d):
    return validation.template_summary(validation.by_template(*_by_template(spark, d)))


@query(f"{_TEMPLATED} SELECT path, field_name, 'add' AS fix_type, CASE WHEN field_name = 'published' THEN '2024-01-01' END AS suggested_value FROM (SELECT path, unnest(missing) AS field_name FROM v)")
def q_template_fixes(spark, d):
    return validation.template_fixes(*_by_template(spark, d))


# Repair: front matter with values of the wrong type, and with fields that a template asks for and some rows lack.

_Field = validation.Field
TYPED_SCHEMA = (*validation.NOTE_SCHEMA, _Field("rating", "number"), _Field("pages", "integer"))
TEMPLATE = (*validation.NOTE_SCHEMA, _Field("published"), _Field("image"), _Field("description"))


def _map(df: DataFrame, *pairs: tuple) -> DataFrame:
    """(path, fields) from (name, condition, JSON value); a field is there where its condition holds."""
    each = [F.when(there, F.struct(F.lit(k).alias("k"), (v if not isinstance(v, str) else F.lit(v)).alias("v"))) for k, there, v in pairs]
    return df.select(F.concat(F.lit("doc_"), F.col("doc_id").cast("string")).alias("path"), F.map_from_entries(F.array_compact(F.array(*each))).alias("fields"))


def _typed(spark, d):
    n, always = F.col("doc_id"), F.lit(True)
    text = lambda c: F.concat(F.lit('"'), c, F.lit('"'))
    return _map(
        adapters.table(spark, d, "documents"),
        ("title", always, F.when(n % 5 == 0, F.col("n_chars").cast("string")).otherwise(text(F.col("source")))),
        ("id", always, n.cast("string")),
        ("tags", always, F.when(n % 7 == 0, text(F.concat("lang", F.lit(", "), "source"))).otherwise(F.concat(F.lit("["), text(F.col("lang")), F.lit("]")))),
        ("aliases", n % 3 < 2, F.when(n % 3 == 0, '"solo"').otherwise("null")),
        ("publish", always, F.when(n % 2 == 0, '"Yes"').otherwise("0")),
        ("rating", n % 4 < 3, F.when(n % 4 == 0, '"4.5"').when(n % 4 == 1, '"none"').otherwise("3")),
        ("pages", n % 6 < 2, F.when(n % 6 == 0, "12.7").otherwise("8.0")),
    )


_CONVERSIONS = """WITH c AS (SELECT doc_id, 'title' AS field_name, 'integer' AS original_type, 'string' AS converted_type, n_chars::VARCHAR AS original, concat('"', n_chars, '"') AS converted FROM documents WHERE doc_id % 5 = 0
  UNION ALL SELECT doc_id, 'id', 'integer', 'string', doc_id::VARCHAR, concat('"', doc_id, '"') FROM documents
  UNION ALL SELECT doc_id, 'tags', 'string', 'array', concat('"', lang, ', ', source, '"'), concat('["', lang, '","', source, '"]') FROM documents WHERE doc_id % 7 = 0
  UNION ALL SELECT doc_id, 'aliases', 'string', 'array', '"solo"', '["solo"]' FROM documents WHERE doc_id % 3 = 0
  UNION ALL SELECT doc_id, 'publish', CASE WHEN doc_id % 2 = 0 THEN 'string' ELSE 'integer' END, 'boolean', CASE WHEN doc_id % 2 = 0 THEN '"Yes"' ELSE '0' END, (doc_id % 2 = 0)::VARCHAR FROM documents
  UNION ALL SELECT doc_id, 'rating', 'string', 'number', '"4.5"', '4.5' FROM documents WHERE doc_id % 4 = 0
  UNION ALL SELECT doc_id, 'pages', 'number', 'integer', '12.7', '12' FROM documents WHERE doc_id % 6 = 0)"""


@query(f"{_CONVERSIONS} SELECT concat('doc_', doc_id) AS path, * EXCLUDE (doc_id) FROM c")
def q_conversions(spark, d):
    return repair.conversions(_typed(spark, d), TYPED_SCHEMA)


@query(f"{_CONVERSIONS}, k AS (SELECT *, concat(original_type, ' -> ', converted_type) AS conversion FROM c) SELECT conversion, count(*) AS times, count(DISTINCT field_name) AS fields FROM k GROUP BY ROLLUP (conversion)")
def q_conversion_summary(spark, d):
    return repair.conversion_summary(repair.conversions(_typed(spark, d), TYPED_SCHEMA))


@query(
    f"""WITH d AS (SELECT doc_id AS n, doc_id % 3 = 0 AS whole, doc_id % 5 <> 0 OR doc_id % 10 = 0 AS titled FROM documents), a AS (SELECT *, CASE WHEN whole AND titled THEN []::VARCHAR[] ELSE list_sort(list_filter([CASE WHEN n % 5 = 0 THEN 'title' END,
  CASE WHEN NOT whole THEN 'aliases' END, CASE WHEN n % 4 <> 0 THEN 'date' END, 'publish', CASE WHEN NOT whole THEN 'published' END, CASE WHEN NOT whole THEN 'image' END, CASE WHEN NOT whole THEN 'description' END], lambda x: x IS NOT NULL)) END AS added FROM d)
SELECT concat('doc_', n) AS path, array_to_string(added, '; ') AS added, CASE WHEN whole THEN '"p"' WHEN n % 4 = 0 THEN '"2024-01-05"' ELSE '""' END AS published, CASE WHEN whole THEN '"i.png"' ELSE '"{repair.IMAGE}"' END AS image FROM a"""
)
def q_templated(spark, d):
    n, always = F.col("doc_id"), F.lit(True)
    full = n % 3 == 0
    rows = _map(
        adapters.table(spark, d, "documents"),
        ("title", (n % 5 != 0) | (n % 10 == 0), F.when(n % 5 == 0, '""').otherwise('"T"')),
        ("id", always, '"20240101000000"'),
        ("tags", always, "[]"),
        ("date", n % 4 == 0, '"2024-01-05"'),
        ("aliases", full, "[]"),
        ("published", full, '"p"'),
        ("image", full, '"i.png"'),
        ("description", full, '""'),
    )
    done = repair.templated(rows, TEMPLATE)
    return joined(done, "added").select("path", "added", F.col("fields")["published"].alias("published"), F.col("fields")["image"].alias("image"))


# Vectors

_UNIT = "WITH e AS (SELECT vec_id, label, list_transform(embedding, lambda x: x::DOUBLE) AS v FROM embeddings), u AS (SELECT vec_id, label, list_transform(v, lambda x: x / sqrt(list_dot_product(v, v))) AS v FROM e), q AS (SELECT v FROM u WHERE vec_id = 0)"


def _index(spark, d):
    e = adapters.vectors(spark, d)
    return e.withColumn("vector", vectors.unit(F.col("vector")))


def _first(index: DataFrame) -> list[float]:
    return index.where("ordinal = 0").select("vector").first()["vector"]


@query(f"{_UNIT} SELECT vec_id::VARCHAR AS document_id, round(list_dot_product(u.v, q.v), 6) AS similarity FROM u, q ORDER BY list_dot_product(u.v, q.v) DESC, vec_id LIMIT 10")
def q_vector_topk(spark, d):
    index = _index(spark, d)
    return rounded(vectors.search(index, _first(index), 10).select("document_id", "similarity"), "similarity")


@query(f"{_UNIT}, k AS (SELECT vec_id, list_dot_product(u.v, q.v) AS s FROM u, q ORDER BY 2 DESC, 1 LIMIT 10) SELECT vec_id::VARCHAR AS document_id, round(s, 6) AS similarity FROM k WHERE s >= 0.3")
def q_vector_threshold(spark, d):
    index = _index(spark, d)
    return rounded(vectors.search(index, _first(index), 10, 0.3).select("document_id", "similarity"), "similarity")


@query("SELECT count(*) AS total_documents, max(len(embedding))::INT AS dimension, sum(len(embedding) * 4)::BIGINT AS memory_bytes, count(*) AS with_metadata FROM embeddings")
def q_vector_stats(spark, d):
    return vectors.statistics(_index(spark, d))


@query(
    f"""{_UNIT}, m AS (SELECT a.vec_id AS s, b.vec_id AS t, list_dot_product(a.v, b.v) AS x FROM u a JOIN u b ON a.vec_id <> b.vec_id AND a.vec_id % 100 = 0),
r AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY x DESC, t::VARCHAR) AS n FROM m WHERE x >= 0.3) SELECT s::VARCHAR AS document_id, t::VARCHAR AS other_id, round(x, 6) AS similarity FROM r WHERE n <= 5"""
)
def q_semantic_links(spark, d):
    index = _index(spark, d)
    return rounded(vectors.semantic_links(index, index.where("ordinal % 100 = 0"), 5, 0.3), "similarity")


@query(
    """WITH e AS (SELECT vec_id, len(embedding)::INT AS d FROM embeddings) SELECT 1 AS version, count(*) AS documents, max(d) AS dimension FROM e WHERE vec_id % 10 <> 0 UNION ALL SELECT 2, count(*), max(d) FROM e"""
)
def q_saved_index(spark, d):
    """Nine tenths of the vectors saved, then all of them, of which only the last tenth is new; both versions read back."""
    every = _index(spark, d)
    path = f"{spark.conf.get('spark.checkpoint.dir', None) or tempfile.mkdtemp(prefix='notemill-')}/index-{uuid.uuid4().hex}"
    size = F.size("vector")
    made = [index_store.update(spark, path, rows, every.select(size).first()[0]).version for rows in (every.where("ordinal % 10 <> 0"), every)]
    read = [index_store.load(spark, path, v).agg(F.lit(v).alias("version"), F.count("*").alias("documents"), F.max(size).alias("dimension")) for v in made]
    return read[0].unionByName(read[1])


# Enhancement, services, report, events


@query(
    f"""WITH {o.ENHANCED} SELECT path, title, id, array_to_string(tags, '; ') AS tags, array_to_string(aliases, '; ') AS aliases, array_to_string(category, '; ') AS category, description,
  word_count::VARCHAR AS word_count, language, author, date_created, changes::INT AS changes FROM enh"""
)
def q_enhanced(spark, d):
    notes = adapters.document_notes(spark, d)
    done = enhancement.enhanced(notes, tags.frequencies(notes))
    kept = [F.col("fields")[n].alias(n) for n in ("word_count", "language", "author", "date_created")]
    return joined(done.select("path", "title", "id", "tags", "aliases", "category", "description", *kept, F.size("changes").alias("changes")), "tags", "aliases", "category")


@query(
    f"""WITH {o.ENHANCED}, c AS (SELECT unnest([('tags', 'tags', count(*) FILTER (len(k) > 0), 0), ('technical', 'tags', count(*) FILTER (len(technical) > 0), 0), ('metadata', 'author', count(author), 0), ('metadata', 'source', count(source), 0),
  ('metadata', 'date_created', count(date_created), 0), ('metadata', 'project', count(project), 0), ('metadata', 'status', count(status), 0), ('metadata', 'word_count', count(*), 0), ('metadata', 'reading_time', count(*), 0),
  ('metadata', 'language', count(*), 0), ('aliases', 'aliases', count(*) FILTER (named_otherwise), 0), ('required', 'title', count(*) FILTER (untitled), 0), ('required', 'published', count(*), 0), ('required', 'description', count(*), 0),
  ('required', 'aliases', count(*), count(*) FILTER (named_otherwise)), ('required', 'category', count(*), 0), ('content', 'tags', count(*) FILTER (len(by_content) > 0), 0), ('title', 'title', count(*) FILTER (untitled), 0)]) AS r FROM enh)
SELECT r[1] AS step, r[2] AS field, r[3] AS notes, r[4]::BIGINT AS replaced FROM c WHERE r[3] > 0"""
)
def q_enhancement_summary(spark, d):
    notes = adapters.document_notes(spark, d)
    return enhancement.summary(enhancement.enhanced(notes, tags.frequencies(notes)))


# Dates: orders as notes, with the order's day as the file's time and ids of which every other one is a time stamp.


@query(
    """WITH o AS (SELECT concat('order_', o_orderkey) AS path, strftime(o_orderdate, '%Y-%m-%d') AS file, CASE WHEN o_orderkey % 4 < 2 THEN concat(strftime(o_orderdate + INTERVAL 40 DAY, '%Y%m%d'), '101112') WHEN o_orderkey % 4 = 2 THEN '20249999000000' ELSE 'plain' END AS id, o_orderkey % 3 <> 0 AS timed FROM orders)
SELECT path, CASE WHEN timed THEN file ELSE '2024-05-06' END AS created, CASE WHEN timed THEN file END AS modified, CASE WHEN id LIKE '%101112' THEN concat(substring(id, 1, 4), '-', substring(id, 5, 2), '-', substring(id, 7, 2)) WHEN timed THEN file ELSE '2024-05-06' END AS published,
  CASE WHEN timed THEN 'file' ELSE 'clock' END AS created_by, CASE WHEN id LIKE '%101112' THEN 'id' WHEN timed THEN 'file' ELSE 'clock' END AS published_by FROM o"""
)
def q_dates(spark, d):
    key = F.col("o_orderkey")
    stamp = F.concat(F.date_format(F.date_add("o_orderdate", 40), "yyyyMMdd"), F.lit("101112"))
    notes = adapters.table(spark, d, "orders").select(
        F.concat(F.lit("order_"), key.cast("string")).alias("path"),
        F.when(key % 4 < 2, stamp).when(key % 4 == 2, "20249999000000").otherwise("plain").alias("fm_id"),
        F.when(key % 3 != 0, F.col("o_orderdate").cast("timestamp")).alias("modified_at"),
    )
    return enhancement.dates(notes, "20240506070809")


@query()
def q_embedded(spark, d):
    return services.embedded(adapters.document_notes(spark, d)).select("document_id", F.size("vector").alias("dimension"), F.round(vectors.norm(F.col("vector")), 4).alias("length"))


@query(
    f"""WITH {o.NOTES}, t AS (SELECT path, array_to_string(list_filter(string_split(substring(content, 1, 3000), chr(10)), lambda x: trim(x, E' \\n\\t\\r') <> '' AND NOT starts_with(x, '#')), ' ') AS t FROM notes),
u AS (SELECT *, substring(t, 1, 200) AS b, 200 - strpos(reverse(substring(t, 1, 200)), '.') AS stop FROM t)
SELECT path, CASE WHEN length(t) <= 200 THEN t WHEN contains(b, '.') AND stop > 100 THEN substring(b, 1, stop + 1) ELSE concat(b, '...') END AS summary FROM u"""
)
def q_summaries(spark, d):
    return services.summarised(adapters.document_notes(spark, d))


@query(
    f"""WITH {o.LINKS}, c AS (SELECT 'orphans' AS task, count(*) AS issues FROM vault v WHERE path NOT IN (SELECT path FROM wiki UNION SELECT path FROM regular) AND NOT EXISTS (SELECT 1 FROM wiki w WHERE w.target = v.file_id AND w.path <> v.path)
  UNION ALL SELECT 'dead-links', count(*) FROM dead) SELECT count(*) AS tasks, sum(issues)::BIGINT AS issues, round(greatest(0, (1 - least(sum(issues) * 0.01::DOUBLE, 0.5)) * 100)::DOUBLE, 6) AS health_score FROM c"""
)
def q_health(spark, d):
    return rounded(report.health(report.task_counts(adapters.vault(spark, d), ["orphans", "dead-links"])), "health_score")


@query("SELECT date_trunc('hour', ts)::TIMESTAMP AS start, event_type, count(*) AS events, round(sum(value), 6) AS total FROM events GROUP BY 1, 2")
def q_event_windows(spark, d):
    return rounded(index.event_windows(adapters.table(spark, d, "events")), "total")


@query(
    """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER w < INTERVAL 30 MINUTE THEN 0 ELSE 1 END AS fresh FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts)),
s AS (SELECT *, sum(fresh) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS n FROM g)
SELECT user_id, min(ts)::TIMESTAMP AS start, (max(ts) + INTERVAL 30 MINUTE)::TIMESTAMP AS "end", count(*) AS events FROM s GROUP BY user_id, n"""
)
def q_event_sessions(spark, d):
    return index.sessions(adapters.table(spark, d, "events"))


# Japanese and English terms


@query(f"{o.term_matches()} SELECT path, term, matched, kind FROM hits")
def q_term_matches(spark, d):
    return japanese.matches(adapters.document_notes(spark, d))


@query(
    f"""{o.term_matches()}, t AS (SELECT DISTINCT path, tags, CASE WHEN length(term) <= 3 THEN concat('tech-', lower(term)) ELSE lower(term) END AS tag FROM hits)
SELECT path, coalesce(string_agg(tag, '; ' ORDER BY tag) FILTER (tag IS NOT NULL AND NOT list_contains(t.tags, tag)), '') AS tags FROM notes LEFT JOIN t USING (path) GROUP BY path"""
)
def q_technical_tags(spark, d):
    return joined(japanese.technical_tags(adapters.document_notes(spark, d)), "tags")


@query(f"{o.term_matches()} SELECT count(*) AS notes, count(*) FILTER (regexp_matches(content, '[぀-ヿ一-龯]')) AS japanese, count(*) FILTER (regexp_matches(content, '[぀-ヿ一-龯]') AND regexp_matches(content, '[A-Za-z]')) AS mixed, (SELECT count(DISTINCT path) FROM hits) AS technical FROM notes")
def q_japanese_opportunities(spark, d):
    return japanese.opportunities(adapters.document_notes(spark, d))


# Texts of which every third has words in katakana, some with other spellings, and names of a pair in both languages.


@query(
    f"""WITH {o.NOTES}, t AS (SELECT path, CASE WHEN file_id::BIGINT % 3 = 0 THEN concat(content, ' サーバー、ティム カメラ 人工知能') ELSE content END AS content FROM notes),
k AS (SELECT *, lower(content) AS low, len(regexp_extract_all(content, '[぀-ゟ゠-ヿ一-龯]')) > 0 AS ja, len(list_filter(regexp_extract_all(content, '{o.WORDS}'), lambda x: regexp_full_match(x, '[a-zA-Z]+'))) > 0 AS en FROM t),
c AS (SELECT ja, en, len(list_filter(regexp_extract_all(content, '[゠-ヿ]+'), lambda x: {o.has_spellings('x')})) AS katakana, {o.pair_hits('low', 'content')} AS crossed, {o.pair_names('low')} AS named FROM k)
SELECT count(*) AS notes, count(*) FILTER (ja) AS japanese, count(*) FILTER (ja AND en) AS mixed, sum(katakana)::BIGINT AS katakana_variations, sum(crossed)::BIGINT AS cross_references, sum(named)::BIGINT AS technical_terms,
  round(count(*) FILTER (ja) / count(*)::DOUBLE * 100, 6) AS japanese_percentage, round(count(*) FILTER (ja AND en) / count(*)::DOUBLE * 100, 6) AS mixed_percentage FROM c"""
)
def q_linking_opportunities(spark, d):
    notes = adapters.document_notes(spark, d)
    more = F.when(F.col("file_id").cast("long") % 3 == 0, F.concat("content", F.lit(" サーバー、ティム カメラ 人工知能"))).otherwise(F.col("content"))
    return rounded(japanese.linking_opportunities(notes.withColumn("content", more)), "japanese_percentage", "mixed_percentage")


# Titles by turns: an English name, a word with other spellings, a Japanese name, and one without any other.


@query(
    f"""WITH {o.NOTES} SELECT path, CASE file_id::BIGINT % 4 WHEN 0 THEN 'アプリケーションプログラミングインターフェース; エーピーアイ' WHEN 1 THEN 'サウバウ; サバ' WHEN 2 THEN 'AI; ai' ELSE '' END AS aliases FROM notes"""
)
def q_aliases(spark, d):
    turn = F.col("file_id").cast("long") % 4
    titled = adapters.document_notes(spark, d).withColumn("title", F.when(turn == 0, "API").when(turn == 1, "サーバー").when(turn == 2, "人工知能").otherwise("plain"))
    return joined(japanese.aliases(titled), "aliases")


@query(
    f"""WITH {o.NOTES} SELECT path, CASE file_id::BIGINT % 4 WHEN 0 THEN 'アプリケーションプログラミングインターフェース; エーピーアイ' WHEN 1 THEN 'サウバウ; サバ' WHEN 2 THEN 'AI; ai' ELSE '' END AS aliases FROM notes"""
)
def q_aliases_by_rules(spark, d):
    """As q_aliases, with the rules as tables that meet the notes."""
    turn = F.col("file_id").cast("long") % 4
    titled = adapters.document_notes(spark, d).withColumn("title", F.when(turn == 0, "API").when(turn == 1, "サーバー").when(turn == 2, "人工知能").otherwise("plain"))
    return joined(rules.title_aliases(titled, rules.spellings(spark), rules.names(spark)), "aliases")


@query(f"WITH {o.MENTIONS} SELECT path, line_number, column_start, target_file_id, text, CASE WHEN lower(text) <> lower(p.title) THEN text END AS alias FROM mention m JOIN part_notes p ON p.file_id = m.target_file_id".replace("SELECT path, line_number", "SELECT m.path, line_number"))
def q_link_aliases(spark, d):
    titles = adapters.part_notes(spark, d).select(F.col("file_id").alias("target_file_id"), "title")
    found = _mentions(spark, d)[1].join(titles, "target_file_id")
    return found.select("path", "line_number", "column_start", "target_file_id", "text", mentions.best_alias(F.col("text"), F.col("title")).alias("alias"))


# The SQL front end: what other queries ask of operators, asked of views and table functions.


@query(f"WITH {o.LINKS} SELECT source_file, link_text, line_number::INT AS line_number, target FROM dead WHERE link_type = 'wikilink'")
def q_sql_dead_links(spark, d):
    sql.register(spark, adapters.vault(spark, d))
    return spark.sql("SELECT source_file, link_text, line_number, target FROM dead_links_of('wikilink')")


@query(f"{_DEGREES} SELECT fm_id, incoming, outgoing FROM deg WHERE incoming + outgoing = 0 ORDER BY ALL")
def q_sql_orphans(spark, d):
    sql.register(spark, adapters.vault(spark, d))
    return spark.sql("SELECT o.fm_id, o.incoming, o.outgoing FROM orphans o JOIN degrees USING (fm_id) WHERE o.incoming + o.outgoing = 0")


@query(
    f"""WITH e AS (SELECT vec_id, embedding::DOUBLE[] AS v FROM embeddings), a AS (SELECT v AS q FROM e ORDER BY vec_id LIMIT 1),
s AS (SELECT vec_id, list_dot_product(v, q) / sqrt(list_dot_product(q, q)) AS x FROM e, a)
SELECT vec_id::VARCHAR AS document_id, round(x, 6) AS similarity, (row_number() OVER (ORDER BY x DESC, vec_id))::INT AS rank FROM s ORDER BY rank LIMIT 10"""
)
def q_sql_nearest(spark, d):
    index = adapters.vectors(spark, d)
    sql.register(spark, adapters.part_notes(spark, d), index)
    asked = index.orderBy("ordinal").limit(1).first()["vector"]
    return rounded(spark.sql("SELECT * FROM nearest(:asked, 10)", args={"asked": asked}), "similarity")


# Connections of orphans, by tags: the oracle ranks classes of equal tag sets.


@query(
    f"""{_DEGREES}, orphan AS (SELECT fm_id FROM deg WHERE incoming + outgoing = 0), m AS (SELECT file_id, list_sort(list_distinct(tags)) AS s FROM vault), c AS (SELECT s, list_sort(list(file_id))[1:6] AS ids FROM m GROUP BY s),
n AS (SELECT a.s, b.ids, len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s)))::DOUBLE AS x FROM c a JOIN c b ON len(list_intersect(a.s, b.s)) > 0),
r AS (SELECT s, x, unnest(ids) AS target_id FROM n WHERE x >= 0.3), k AS (SELECT *, row_number() OVER (PARTITION BY s ORDER BY x DESC, target_id) AS i FROM r QUALIFY i <= 6),
f AS (SELECT o.fm_id, k.target_id, x AS confidence, row_number() OVER (PARTITION BY o.fm_id ORDER BY x DESC, k.target_id) AS rank FROM orphan o JOIN m ON m.file_id = o.fm_id JOIN k ON k.s = m.s WHERE k.target_id <> o.fm_id)
SELECT fm_id, target_id, round(confidence, 6) AS confidence, rank::INT AS rank FROM f WHERE rank <= 5"""
)
def q_suggest_connections(spark, d):
    notes = adapters.vault(spark, d)
    lonely = graph.degrees(notes, graph.edges(notes)).where("incoming + outgoing = 0")
    found = connections.shared_tags(lonely, notes)
    rank = F.row_number().over(Window.partitionBy("fm_id").orderBy(F.col("confidence").desc(), "target_id"))
    return rounded(found.withColumn("rank", rank).where("rank <= 5").select("fm_id", "target_id", "confidence", "rank"), "confidence")


@query()
def q_connections_by_keywords(spark, d):
    notes = adapters.document_notes(spark, d)
    return rounded(connections.shared_keywords(notes.select("fm_id"), notes), "confidence")


@query(
    f"""{_DEGREES}, lonely AS (SELECT fm_id FROM deg WHERE incoming + outgoing = 0), n AS (SELECT file_id, lower(title) AS low, lower(content) AS c, len(list_filter(regexp_split_to_array(content, '\\s+'), lambda x: x <> '')) AS w FROM vault),
own AS (SELECT * FROM n WHERE file_id IN (SELECT fm_id FROM lonely)), t AS (SELECT DISTINCT low FROM own), u AS (SELECT DISTINCT low FROM n),
m1 AS (SELECT t.low, file_id AS target_id, least(0.8::DOUBLE, (length(c) - length(replace(c, t.low, ''))) / length(t.low) / w::DOUBLE * 100) AS x FROM t JOIN n ON contains(c, t.low)),
there AS (SELECT own.file_id AS fm_id, target_id, x FROM (SELECT * FROM m1 WHERE x > 0.1 QUALIFY row_number() OVER (PARTITION BY low ORDER BY x DESC, target_id) <= 6) JOIN own USING (low)),
m2 AS (SELECT file_id AS fm_id, u.low, least(0.8::DOUBLE, (length(c) - length(replace(c, u.low, ''))) / length(u.low) / w::DOUBLE * 100) AS x FROM own JOIN u ON contains(c, u.low)),
named AS (SELECT low, file_id AS target_id FROM n QUALIFY row_number() OVER (PARTITION BY low ORDER BY file_id) <= 6), here AS (SELECT fm_id, target_id, x FROM m2 JOIN named USING (low) WHERE x > 0.1)
SELECT fm_id, target_id, round(max(x), 6) AS confidence, 'title' AS reason FROM (SELECT * FROM there UNION ALL SELECT * FROM here) WHERE fm_id <> target_id GROUP BY 1, 2"""
)
def q_title_connections(spark, d):
    notes = adapters.vault(spark, d)
    lonely = graph.degrees(notes, graph.edges(notes)).where("incoming + outgoing = 0")
    return rounded(connections.title_mentions(lonely, notes), "confidence")


# Totals of whole runs


@query(f"WITH RECURSIVE {o.CONFLICTS}, kept AS (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY path ORDER BY (conflicts + others > 0)::INT, line_number, column_start) <= 2) SELECT (SELECT count(*) FROM vault) AS files_processed, (SELECT count(DISTINCT path) FROM kept) AS files_with_links_added, (SELECT count(*) FROM kept) AS wikilink_updates, (SELECT sum(conflicts)::BIGINT FROM resolved) AS conflicts_resolved, (SELECT count(*) FROM resolved) - (SELECT count(*) FROM kept) AS candidates_skipped, 0::BIGINT AS files_with_aliases_added, 0::BIGINT AS alias_updates")
def q_link_summary(spark, d):
    notes, found = _mentions(spark, d)
    kept = cut(mentions.resolved(found))
    chosen = mentions.capped(kept, 2)
    return report.link_summary(notes, kept, chosen, mentions.alias_updates(chosen, adapters.part_notes(spark, d)))


@query(f"WITH {o.ENHANCED} SELECT count(*) AS analysed, count(*) FILTER (changes > 0) AS improved, sum(changes)::BIGINT AS improvements, count(*) AS with_metadata FROM enh")
def q_improvement_report(spark, d):
    notes = adapters.document_notes(spark, d)
    done = enhancement.enhanced(notes, tags.frequencies(notes))
    return report.improvement_report(done).select("analysed", "improved", "improvements", "with_metadata")


@query(f"{_IMPROVEMENTS}, n AS (SELECT path, len(i) AS improvements FROM (SELECT path, list(i) AS i FROM (SELECT path, unnest(list_filter([CASE WHEN NOT has_title THEN 1 END, 1, 1, 1, 1, CASE WHEN t THEN 1 END, CASE WHEN a THEN 1 END, CASE WHEN g THEN 1 END, CASE WHEN m THEN 1 END, CASE WHEN s THEN 1 END, CASE WHEN u THEN 1 END], lambda x: x IS NOT NULL)) AS i FROM c) GROUP BY path)) SELECT path, improvements::INT AS improvements FROM n ORDER BY n.improvements DESC, path LIMIT 10")
def q_high_priority(spark, d):
    return report.high_priority(analysis.improvements(adapters.document_notes(spark, d)))


@query(f"{_TAGS} SELECT (SELECT count(*) FROM vault) AS notes, (SELECT count(*) FROM vault WHERE len(tags) > 0) AS tagged, count(*) AS tags, sum(files)::BIGINT AS uses, count(*) FILTER (files = 1) AS single FROM f")
def q_tag_statistics(spark, d):
    return tags.vault_statistics(adapters.vault(spark, d))


@query(f"WITH {o.NOTES} SELECT count(*) AS total, count(*) FILTER (file_id::BIGINT % 3 = 0) AS indexed, count(*) FILTER (file_id::BIGINT % 3 <> 0) AS skipped FROM notes")
def q_indexing_summary(spark, d):
    notes = adapters.document_notes(spark, d)
    return report.indexing_summary(notes, notes.where(F.col("file_id").cast("long") % 3 == 0).select(F.col("file_id").alias("document_id")))
