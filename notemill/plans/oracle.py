"""SQL fragments, for DuckDB, of the views of relational tables as notes."""

from __future__ import annotations

from notemill.functions.dictionaries import ABBREVIATIONS, CATEGORIES, CONSONANTS, CONTENT_TAGS, KEYWORD_TAGS, LONG_VOWELS, PAIRS, TAG_PATTERNS
from notemill.operators.tags import spelled
from notemill.operators.zones import SPAN_ZONES
from notemill.sources.adapters import LINE_SQL

_LINE = LINE_SQL.format(s="VARCHAR").strip()

#: CTEs: order_notes, part_notes and vault with path, file_id, title, tags, content.
VAULT = f"""
items AS MATERIALIZED (SELECT l_orderkey, l_linenumber, {_LINE} AS line FROM lineitem JOIN part ON l_partkey = p_partkey),
fenced AS (SELECT l_orderkey, l_linenumber, CASE
  WHEN l_linenumber = 1 AND l_orderkey % 7 = 0 THEN concat('```', chr(10), line, chr(10), '```')
  WHEN l_linenumber = 2 AND l_orderkey % 11 = 0 THEN concat('```', chr(10), line) ELSE line END AS line FROM items),
order_notes AS MATERIALIZED (SELECT concat('vault/orders/order_', o_orderkey, '.md') AS path, concat('9', lpad(CAST(o_orderkey AS VARCHAR), 13, '0')) AS file_id,
  concat('Order ', o_orderkey) AS title, [o_orderstatus, o_orderpriority] AS tags, concat('order_', o_orderkey) AS stem,
  string_agg(line, chr(10) ORDER BY l_linenumber, line) AS content FROM orders JOIN fenced ON o_orderkey = l_orderkey GROUP BY ALL),
part_notes AS (SELECT concat('vault/parts/part_', p_partkey, '.md') AS path, lpad(CAST(p_partkey AS VARCHAR), 14, '0') AS file_id, p_name AS title,
  [p_brand, p_type] AS tags, concat('part_', p_partkey) AS stem, concat('A part of size ', p_size, '.') AS content FROM part WHERE p_size <= 25),
vault AS MATERIALIZED (SELECT * FROM order_notes UNION ALL SELECT * FROM part_notes)
"""

#: CTEs on top: lines (from 1), wiki links outside template expressions, regular links, definitions.
LINKS = VAULT + r""",
split AS MATERIALIZED (SELECT path, file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM vault),
wiki0 AS (SELECT path, file_id, line_number, line, unnest(regexp_extract_all(line, '\[\[([^|\]]+)(?:\|([^\]]+))?\]\]')) AS hit FROM split WHERE line LIKE '%[[%'),
wiki AS MATERIALIZED (SELECT path, file_id AS src, line_number, regexp_extract(hit, '\[\[([^|\]]+)', 1) AS target, regexp_extract(hit, '\|([^\]]+)\]\]', 1) AS alias, hit FROM wiki0
  WHERE strpos(line, concat('${', hit, '}')) = 0),
regular AS MATERIALIZED (SELECT path, line_number, regexp_extract(hit, '\[([^\]]+)\]\(([^)]+)\)', 1) AS text, regexp_extract(hit, '\[([^\]]+)\]\(([^)]+)\)', 2) AS url FROM
  (SELECT path, line_number, unnest(regexp_extract_all(line, '\[([^\]]+)\]\(([^)]+)\)')) AS hit FROM split)),
definition AS (SELECT path, line_number, regexp_extract(line, '^\[([^|\]]+)\|([^\]]+)\]:\s*(\S+)(?:\s+"([^"]+)")?', ['id', 'alias', 'target', 'title']) AS d FROM split
  WHERE regexp_matches(line, '^\[([^|\]]+)\|([^\]]+)\]:\s*(\S+)')),
links AS (SELECT path, 'wikilink' AS kind, target FROM wiki UNION ALL SELECT path, 'regular_link', url FROM regular UNION ALL SELECT path, 'link_reference_definition', d.target FROM definition),
dead AS (SELECT path AS source_file, hit AS link_text, 'wikilink' AS link_type, line_number, target FROM wiki WHERE target NOT IN (SELECT file_id FROM vault)
  UNION ALL SELECT path, concat('[', text, '](', url, ')'), 'regular_link', line_number, url FROM regular WHERE trim(url) = '')
"""

#: CTE target: what a text in lower case may mean.
TARGETS = VAULT + """,
target AS (SELECT lower(title) AS low, file_id, title AS text, 'title' AS source_type, 1.0::DOUBLE AS confidence FROM part_notes
  UNION ALL SELECT lower(tags[2]), file_id, tags[2], 'alias', 1.0::DOUBLE FROM part_notes WHERE lower(tags[2]) <> lower(title))
"""


def _places(line: str, pattern: str) -> str:
    """Where the hits of a pattern begin and end in a line, each from what stands before it."""
    p = "'" + pattern.replace("'", "''") + "'"
    cut = f"{{'h': regexp_extract_all({line}, {p}), 'g': regexp_split_to_array({line}, {p})}}"
    n = "(coalesce(list_sum(list_transform(c.g[1:i], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(c.h[1:i-1], lambda x: length(x))), 0))"
    return f"flatten(list_transform([{cut}], lambda c: list_transform(range(1, len(c.h) + 1), lambda i: {{'s': {n}, 'e': {n} + length(c.h[i])}})))"


def _zones() -> str:
    """CTE zone, on top of LINKS: every zone of every line, tables included."""
    whole = "SELECT path, line_number, 0 AS column_start, length(line) AS column_end, '{}' AS zone_type FROM fenced_line WHERE {}"
    spans = " UNION ALL ".join(f"SELECT path, line_number, z.s, z.e, '{kind}' FROM (SELECT path, line_number, unnest({_places('line', pattern)}) AS z FROM fenced_line WHERE NOT inside)" for kind, pattern in SPAN_ZONES)
    return f"""fence_count AS (SELECT *, starts_with(trim(line), '```') AS f, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY path ORDER BY line_number) AS upto, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY path) AS total FROM split),
fenced_line AS MATERIALIZED (SELECT path, line_number, line, (upto % 2 = 1) OR f AS inside, CASE WHEN upto % 2 = 1 THEN total > upto ELSE true END AS closed FROM fence_count),
zone AS ({whole.format('code_block', 'inside AND closed')} UNION ALL {whole.format('heading', "NOT inside AND starts_with(trim(line), '# ')")}
  UNION ALL {whole.format('table', "NOT inside AND starts_with(trim(line), '|') AND ends_with(trim(line), '|')")} UNION ALL {spans})"""


ZONES = _zones()


def _spans(line: str) -> str:
    """Where the zones of a line outside fences begin and end, each from what stands before it."""
    each = [_places(line, pattern) for _, pattern in SPAN_ZONES]
    return f"list_concat({each[0]}, {_concat(each[1:])})"


def _concat(each: list[str]) -> str:
    return each[0] if len(each) == 1 else f"list_concat({each[0]}, {_concat(each[1:])})"


def _mentions(content: str) -> str:
    """CTE mention, from CTEs vault and target: places of the targets' texts outside zones."""
    return rf"""
ranked AS (SELECT *, row_number() OVER (PARTITION BY low ORDER BY -confidence, file_id, text, source_type) AS r, count(*) OVER (PARTITION BY low) AS notes FROM target),
named AS MATERIALIZED (SELECT a.low, a.notes, a AS best, b AS second FROM ranked a LEFT JOIN ranked b ON a.low = b.low AND b.r = 2 WHERE a.r = 1),
parts AS (SELECT path, file_id, {content} AS content FROM vault),
cut AS MATERIALIZED (SELECT path, file_id, unnest(string_split(content, chr(10))) AS line, generate_subscripts(string_split(content, chr(10)), 1) AS line_number FROM parts),
fence AS (SELECT *, starts_with(trim(line), '```') AS f, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY path ORDER BY line_number) AS upto, sum(starts_with(trim(line), '```')::INT) OVER (PARTITION BY path) AS total FROM cut),
state AS (SELECT path, file_id, line, line_number, (upto % 2 = 1) OR f AS inside, CASE WHEN upto % 2 = 1 THEN total > upto ELSE true END AS closed FROM fence),
met AS (SELECT s.*, n.*, string_split(lower(line), low) AS pieces, CASE WHEN s.file_id = n.best.file_id THEN n.second ELSE n.best END AS t FROM state s JOIN named n ON contains(lower(line), low)),
placed AS (SELECT *, unnest(range(1, len(pieces))) AS i FROM met WHERE t.file_id IS NOT NULL),
found AS (SELECT *, (list_sum(list_transform(pieces[1:i], lambda x: length(x))) + (i - 1) * length(low))::BIGINT AS s FROM placed),
zoned AS MATERIALIZED (SELECT *, CASE WHEN inside THEN closed WHEN starts_with(trim(line), '# ') OR (starts_with(trim(line), '|') AND ends_with(trim(line), '|')) THEN true
  ELSE len(list_filter({_spans("line")}, lambda z: s >= z.s AND s < z.e)) > 0 END AS barred FROM found
  WHERE NOT regexp_matches(substring(line, s, 1), '[\p{{L}}\p{{N}}_]') AND NOT regexp_matches(substring(line, s + length(low) + 1, 1), '[\p{{L}}\p{{N}}_]')),
mention AS (SELECT low, path, line_number::INT AS line_number, s::INT AS column_start, (s + length(low))::INT AS column_end, substring(line, s + 1, length(low)) AS text, t.file_id AS target_file_id, t.confidence AS confidence,
  t.source_type AS source_type, notes, notes - 1 - (EXISTS (SELECT 1 FROM target x WHERE x.low = zoned.low AND x.file_id = zoned.file_id))::BIGINT AS others FROM zoned WHERE NOT barred)
"""


MENTIONS = f"{TARGETS}, {_mentions('content')}"


def _step(source: str) -> str:
    """One round of the fold: the first candidate left takes all that overlap it, and their best wins."""
    return f"""SELECT path, line_number, list_filter(l, lambda x: NOT (x.s < l[1].e AND l[1].s < x.e)) AS l, list_filter(g, lambda x: x.r = list_max(list_transform(g, lambda y: y.r)))[1] AS won,
  len(g) - 1 AS conflicts, list_sum(list_transform(g, lambda x: x.o)) AS others FROM (SELECT path, line_number, l, list_filter(l, lambda x: x.s < l[1].e AND l[1].s < x.e) AS g FROM {source} WHERE len(l) > 0)"""


#: CTE resolved: the mentions that stay; needs WITH RECURSIVE.
CONFLICTS = f"""{MENTIONS},
held AS (SELECT path, line_number, list({{'s': column_start, 'f': target_file_id, 'e': column_end, 't': text, 'c': confidence, 'st': source_type, 'r': (column_end - column_start) * 10 + confidence * 20, 'o': others}}
  ORDER BY column_start, target_file_id, column_end, text, confidence, source_type) AS l FROM mention GROUP BY 1, 2),
fold AS ({_step("held")} UNION ALL {_step("fold")}),
resolved AS (SELECT path, line_number, won.s AS column_start, won.e AS column_end, won.t AS text, won.f AS target_file_id, won.c AS confidence, won.st AS source_type, conflicts::INT AS conflicts, others::BIGINT AS others FROM fold)
"""

#: CTE rewritten: the notes with their chosen mentions as links; needs WITH RECURSIVE.
REWRITTEN = f"""{CONFLICTS},
chosen AS (SELECT * FROM resolved QUALIFY row_number() OVER (PARTITION BY path ORDER BY (conflicts + others > 0)::INT, line_number, column_start) <= 50),
edits AS (SELECT path, line_number, list({{'s': column_start, 'e': column_end, 'k': concat('[[', target_file_id, '|', text, ']]')}} ORDER BY column_start) AS k FROM chosen GROUP BY 1, 2),
fresh AS (SELECT path, c.line_number, CASE WHEN k IS NULL THEN line ELSE concat(array_to_string(list_transform(range(1, len(k) + 1),
  lambda i: concat(substring(line, coalesce(k[i-1].e, 0) + 1, k[i].s - coalesce(k[i-1].e, 0)), k[i].k)), ''), substring(line, k[len(k)].e + 1)) END AS line FROM cut c LEFT JOIN edits e USING (path, line_number)),
rewritten AS (SELECT path, string_agg(line, chr(10) ORDER BY line_number) AS content, any_value(n)::INT AS applied FROM fresh JOIN (SELECT path, count(*) AS n FROM chosen GROUP BY 1) USING (path) GROUP BY path)
"""


def brand_mentions() -> str:
    """CTE updates: brands as notes named in katakana, whose other spellings stand in the texts."""
    names = "SELECT DISTINCT regexp_replace(p_brand, 'Brand#', '') AS b FROM part"
    spelled = " UNION ALL ".join(f"SELECT concat('{x}', b), concat('brand-', b), concat('{x}', b), '{kind}', {c}::DOUBLE FROM brand" for x, kind, c in (("サーバー", "title", 1.0), ("サバ", "title_variation", 0.9), ("サウバウ", "title_variation", 0.9)))
    content = "replace(content, 'Brand#', 'サバ')"
    return f"""{VAULT}, brand AS ({names}), target(low, file_id, text, source_type, confidence) AS ({spelled}), {_mentions(content)},
updates AS (SELECT target_file_id AS file_id, string_agg(DISTINCT text, '; ') AS new_aliases FROM mention WHERE text <> concat('サーバー', substring(target_file_id, 7)) GROUP BY 1)"""


#: CTE notes: documents as notes.
NOTES = """
notes AS (SELECT concat('vault/', source, '/doc_', doc_id, '.md') AS path, concat('vault/', source) AS dir, concat('doc_', doc_id) AS stem, lpad(CAST(doc_id AS VARCHAR), 14, '0') AS file_id,
  substring(string_split(text, chr(10))[1], 1, 60) AS title, [lang, source] AS tags, text AS content FROM documents)
"""


def norm(x: str) -> str:
    return rf"trim(regexp_replace(regexp_replace(lower({x}), '[^\p{{L}}\p{{N}}\p{{M}}_\s]', '', 'g'), '\s+', ' ', 'g'))"


def word_set(x: str) -> str:
    return f"list_distinct(list_filter(string_split({norm(x)}, ' '), lambda w: w <> ''))"


def main(x: str) -> str:
    return rf"array_to_string(list_filter(list_transform(string_split({x}, chr(10)), lambda l: trim(l)), lambda l: l <> '' AND NOT starts_with(l, '#')), ' ')"


def _hits(x: str, keywords) -> str:
    return " + ".join("(CASE WHEN " + " OR ".join(f"contains({x}, '{s.lower()}')" for s in spelled(k)) + " THEN 1 ELSE 0 END)" for k in keywords)


def tag_suggestions() -> str:
    each = " UNION ALL ".join(f"SELECT path, '{c}' AS category, '{n}' AS pattern, {_hits('low', kw)} AS matched, {w} AS weight FROM lowered" for c, _, n, kw, w in TAG_PATTERNS)
    return f"WITH {NOTES}, lowered AS (SELECT path, lower(content) AS low FROM notes), each AS ({each}), s AS (SELECT path, category, pattern, matched, least(0.95::DOUBLE, matched * 0.2::DOUBLE * weight::DOUBLE) AS c FROM each) SELECT path, category, pattern, matched, round(c, 6) AS confidence FROM s WHERE c > 0.3::DOUBLE"


def categories(x: str) -> str:
    hits = ", ".join("CASE WHEN " + " OR ".join(f"contains({x}, '{k}')" for k in kw) + f" THEN '{n}' END" for n, kw in CATEGORIES)
    return f"list_slice(list_filter([{hits}], lambda c: c IS NOT NULL), 1, 2)"


def content_tag_list(x: str) -> str:
    hits = ", ".join("CASE WHEN " + " OR ".join(f"contains({x}, '{k}')" for k in kw) + f" THEN [{', '.join(repr(t) for t in tags)}] ELSE [] END" for _, kw, tags in CONTENT_TAGS)
    return f"list_sort(list_distinct(flatten([{hits}])))"


def term_matches() -> str:
    def first(names) -> str:
        return "CASE " + " ".join(f"WHEN contains(low, '{n.lower()}') THEN '{n}'" for n in names) + " END"

    each = [f"SELECT path, tags, '{t}' AS term, {first((t, *n))} AS matched, '{k}' AS kind FROM lowered" for k, table in (("pair", PAIRS), ("abbreviation", ABBREVIATIONS)) for t, n in table]
    return f"WITH {NOTES}, lowered AS (SELECT path, tags, lower(content) AS low FROM notes), hits AS (SELECT * FROM ({' UNION ALL '.join(each)}) WHERE matched IS NOT NULL)"


WORDS = r"[\p{L}\p{M}\p{Nd}\p{Pc}]+"


def _metadata() -> str:
    """CTE meta: what the content of a document says of itself, and counts of its words."""
    said = {
        "author": r"(?i)(?:author|著者|writer|written by):\s*([^\n]+)",
        "source": r"(?i)(?:source|出典|from):\s*([^\n]+)",
        "date_created": r"(?i)(?:created|作成日|date):\s*(\d{4}-\d{2}-\d{2})",
        "project": r"(?i)(?:project|プロジェクト):\s*([^\n]+)",
        "status": r"(?i)(?:status|状態):\s*(draft|complete|in-progress|todo)",
    }
    found = ", ".join(f"CASE WHEN regexp_matches(content, '{p}') THEN trim(regexp_extract(content, '{p}', 1), E' \\t\\r\\n') END AS {k}" for k, p in said.items())
    return f"""meta AS (SELECT path, {found}, NULL::VARCHAR AS published, NULL::VARCHAR AS created_time, len(w)::INT AS word_count, greatest(1, len(w) // 200)::INT AS reading_time,
  CASE WHEN ja > en * 2 THEN 'japanese' WHEN en > 10 THEN 'english' ELSE 'mixed' END AS language
  FROM (SELECT *, len(regexp_extract_all(content, '[぀-ゟ゠-ヿ一-龯]')) AS ja, len(list_filter(w, lambda x: regexp_full_match(x, '[a-zA-Z]+'))) AS en FROM (SELECT *, regexp_extract_all(content, '{WORDS}') AS w FROM notes)))"""


def _term_tags(x: str) -> str:
    """The tags of the dictionary's terms in a text, in the dictionary's order; a term of both tables counts once."""
    hit = lambda names: "(" + " OR ".join(f"contains({x}, '{n.lower()}')" for n in names) + ")"
    tag = lambda t: f"'tech-{t.lower()}'" if len(t) <= 3 else f"'{t.lower()}'"
    pairs = {t: hit((t, *n)) for t, n in PAIRS}
    each = [f"CASE WHEN {h} THEN {tag(t)} END" for t, h in pairs.items()]
    each += [f"CASE WHEN {hit((t, *n))}{f' AND NOT {pairs[t]}' if t in pairs else ''} THEN {tag(t)} END" for t, n in ABBREVIATIONS]
    return f"list_filter([{', '.join(each)}], lambda x: x IS NOT NULL)"


def _enhanced() -> str:
    """CTE enh: documents as notes after all steps of their enhancement, with what each step put in."""
    keyword = ", ".join(f"CASE WHEN {' + '.join(f'contains(low, {w!r})::INT' for w in words)} >= 3 THEN [{n!r}, {wide!r}] ELSE [] END" for wide, n, words in KEYWORD_TAGS)
    sure = ", ".join(" + ".join(f"contains(low, {k!r})::INT" for k in kw) for _, kw, _ in CONTENT_TAGS)
    other = " OR ".join(f"contains(low, '{t.lower()}')" + "".join(f" OR contains(content, '{n}')" for n in names) for t, names in PAIRS)
    return f"""{NOTES}, {_metadata()},
lowered AS (SELECT *, lower(content) AS low, coalesce(title, '') AS named FROM notes),
vault_word AS (SELECT tag, unnest(list_distinct(regexp_extract_all(lower(tag), '{WORDS}'))) AS w FROM (SELECT DISTINCT unnest(tags) AS tag FROM notes)),
near AS (SELECT path, list(DISTINCT tag) AS near FROM (SELECT path, unnest(list_distinct(regexp_extract_all(low, '{WORDS}'))) AS w FROM lowered) JOIN vault_word USING (w) GROUP BY path),
s1 AS (SELECT l.*, list_sort(list_distinct(list_filter(flatten([{keyword}, list_transform(list_filter(regexp_extract_all(content, '#({WORDS})', 1), lambda x: length(x) > 2), lambda x: lower(x)), coalesce(near, [])]),
  lambda x: NOT list_contains(tags, x)))) AS k FROM lowered l LEFT JOIN near USING (path)),
s2 AS (SELECT *, list_filter({_term_tags("low")}, lambda x: NOT list_contains(tags, x) AND NOT list_contains(k, x)) AS technical, ({other}) AS named_otherwise,
  {content_tag_list("low")} AS of_content, list_max([{sure}]) >= 3 AS sure FROM s1),
s3 AS (SELECT *, CASE WHEN sure AND len(list_filter(of_content, lambda x: NOT list_contains(tags, x))) > 0 THEN list_filter(of_content, lambda x: NOT list_contains(tags, x) AND NOT list_contains(k, x) AND NOT list_contains(technical, x)) ELSE [] END AS by_content FROM s2),
about_line AS (SELECT path, list_transform(string_split(content, chr(10)), lambda x: trim(x, E' \n\t\r')) AS x FROM notes),
about_from AS (SELECT path, x[list_position(list_transform(x, lambda y: y <> '' AND NOT starts_with(y, '#')), true):] AS x FROM about_line),
about AS (SELECT path, array_to_string(list_filter(x[1:coalesce(nullif(list_position(x, ''), 0) - 1, len(x))], lambda y: NOT starts_with(y, '#')), ' ') AS a FROM about_from),
enh AS (SELECT path, file_id AS id, CASE WHEN trim(named) <> '' THEN named ELSE stem END AS title, flatten([tags, k, technical, by_content]) AS tags, CASE WHEN named <> '' THEN [named] ELSE [] END AS aliases,
  {categories("low")} AS category, CASE WHEN length(coalesce(a, '')) > 150 THEN concat(substring(a, 1, 147), '...') ELSE coalesce(a, '') END AS description, k, technical, by_content, named_otherwise, trim(named) = '' AS untitled,
  word_count, reading_time, language, author, source, date_created, project, status,
  (len(k) > 0)::INT + (len(technical) > 0)::INT + 3 + (author IS NOT NULL)::INT + (source IS NOT NULL)::INT + (date_created IS NOT NULL)::INT + (project IS NOT NULL)::INT + (status IS NOT NULL)::INT
    + named_otherwise::INT + 4 + 2 * (trim(named) = '')::INT + (len(by_content) > 0)::INT AS changes
  FROM s3 JOIN meta USING (path) LEFT JOIN about USING (path))"""


def has_spellings(x: str) -> str:
    """Whether a word in katakana has another spelling or another name."""
    signs = [rule for rule, _ in (*LONG_VOWELS, *CONSONANTS)]
    names = ", ".join(f"'{n}'" for _, names in PAIRS for n in names)
    return "(" + " OR ".join(f"contains({x}, '{s}')" for s in signs) + f" OR {x} IN ({names}))"


def pair_hits(low: str, text: str) -> str:
    """How often a pair's names meet a text: each Japanese name of an English one that stands in it, and each Japanese one that does."""
    each = [f"CASE WHEN contains({low}, '{t.lower()}') THEN {len(names)} ELSE 0 END" for t, names in PAIRS] + [f"contains({text}, '{n}')::INT" for _, names in PAIRS for n in names]
    return "(" + " + ".join(each) + ")"


def pair_names(low: str) -> str:
    """How many English names of pairs stand in a text."""
    return "(" + " + ".join(f"contains({low}, '{t.lower()}')::INT" for t, _ in PAIRS) + ")"


META = f"{NOTES.strip()}, {_metadata()}"
ENHANCED = _enhanced()
