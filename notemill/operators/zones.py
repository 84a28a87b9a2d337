"""Parts of a note where no link may be put: fences, front matter, headings, tables, links, code, templates.

Everything is computed within a note's row; lines meet no shuffle. A fence opens at an odd
fence line and only counts if it is closed. While a fence is open, its lines have no other
zone; lines after an opening that is never closed have none at all.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import scan
from notemill.functions.text import matches, strip
from notemill.operators.links import TEMPLATE_SIGNS, TEMPLATES

# Zone types and their patterns, in the order in which they are recorded.
SPAN_ZONES = (
    ("link_ref_def", r"\[[^\]]+\|[^\]]+\]:\s*\S+"),
    ("url", r"https?://[^\s\)]+"),
    ("html_link", r"<a\s[^>]*>.*?</a>"),
    ("inline_code", r"`[^`]+`"),
    ("wikilink", r"\[\[[^\]]+\]\]"),
    ("regular_link", r"\[(?:[^\[\]]|\[[^\]]*\])*\]\([^)]+\)"),
    *((f"template_{n}", p) for n, p in zip(("variable", "handlebars", "templater", "templater_block"), TEMPLATES, strict=True)),
)

#: A text that every hit of a zone's pattern holds.
SIGNS = {
    "link_ref_def": "]:",
    "url": "://",
    "html_link": "</a>",
    "inline_code": "`",
    "wikilink": "[[",
    "regular_link": "](",
    **dict(zip(("template_variable", "template_handlebars", "template_templater", "template_templater_block"), TEMPLATE_SIGNS, strict=True)),
}


def is_table_row(line: Column) -> Column:
    return strip(line).startswith("|") & strip(line).endswith("|") & (strip(line) != "")


def _spans(line: Column, kind: str, pattern: str) -> Column:
    found = F.transform(matches(line, pattern, SIGNS.get(kind)), lambda m: F.struct(m["start"].alias("column_start"), (m["start"] + F.length(m["hit"])).alias("column_end"), F.lit(kind).alias("zone_type")))
    return F.when(F.contains(line, F.lit(SIGNS[kind])), found).otherwise(F.array().cast("array<struct<column_start:int,column_end:int,zone_type:string>>")) if kind in SIGNS else found


def fenced_lines(notes: DataFrame, *carried: str) -> DataFrame:
    """(path, line_number, line, state): state is fenced, unclosed, front, open or plain."""
    texts = F.split("content", "\n", -1)
    index = F.sequence(F.lit(0), F.size("lines") - 1)
    fences = F.filter(index, lambda i: strip(F.get("lines", i)).startswith("```"))
    base = notes.select("path", *carried, texts.alias("lines")).withColumn("fences", fences)
    # Front matter: from a first line of --- to the next one; open to the end if there is none.
    rule = F.get(F.filter(F.sequence(F.lit(1), F.greatest(F.size("lines") - 1, F.lit(1))), lambda i: strip(F.get("lines", i)) == "---"), F.lit(0))
    front = F.when(strip(F.get("lines", F.lit(0))) == "---", F.coalesce(rule, F.size("lines")))
    base = base.withColumn("front", F.coalesce(front, F.lit(-1)))
    each = base.select("path", *carried, "fences", "front", F.size("lines").alias("n"), F.posexplode("lines").alias("i", "line"))
    before = F.size(F.filter("fences", lambda x: x < F.col("i")))
    total = F.size("fences")
    on_fence = F.array_contains("fences", F.col("i"))
    # A line is inside if an odd number of fences came before it (a closing fence line included).
    inside = (before % 2 == 1) | (on_fence & (before % 2 == 0))
    closed = F.when(before % 2 == 1, total > before).otherwise(total > before + 1)
    in_front = (F.col("i") <= F.col("front")) & (F.col("front") < F.col("n"))
    state = F.when(inside, F.when(closed, "fenced").otherwise("unclosed")).when(in_front, "front").when(F.col("front") >= F.col("n"), "open").otherwise("plain")
    return each.select("path", *carried, (F.col("i") + 1).alias("line_number"), "line", state.alias("state"))


def line_zones(line: Column, state: Column, tables: bool = False, custom: list[str] | None = None) -> Column:
    """array<struct<column_start, column_end, zone_type>> of a line in its state."""
    width = F.length(line)
    whole = lambda kind: F.array(F.struct(F.lit(0).alias("column_start"), width.alias("column_end"), F.lit(kind).alias("zone_type")))
    none = F.array().cast("array<struct<column_start:int,column_end:int,zone_type:string>>")
    spans = [_spans(line, k, p) for k, p in (*SPAN_ZONES, *(("custom", f"(?iu){p}") for p in custom or ()))]
    heading = F.when(strip(line).startswith("# "), whole("heading")).otherwise(none)
    row = F.when(is_table_row(line), whole("table")).otherwise(none) if tables else none
    plain = F.concat(heading, row, *spans)
    return F.when(state == "fenced", whole("code_block")).when(state == "front", whole("frontmatter")).when(state == "plain", plain).otherwise(none)


def zones(notes: DataFrame, tables: bool = False, custom: list[str] | None = None) -> DataFrame:
    """(path, line_number, column_start, column_end, zone_type): one row for each zone and line it covers.

    A note is read once, in Arrow batches; custom patterns are Java's, so with them the lines are searched by expressions.
    """
    if not custom:
        return notes.select("path", "content").mapInArrow(_zone_batches(tables), "path string, line_number int, column_start int, column_end int, zone_type string")
    each = fenced_lines(notes)
    found = line_zones(F.col("line"), F.col("state"), tables, custom)
    return each.select("path", "line_number", F.explode(found).alias("z")).select("path", "line_number", "z.column_start", "z.column_end", "z.zone_type")


def scanned() -> list[tuple[str, str, re.Pattern]]:
    """(zone type, sign, pattern) of SPAN_ZONES for scan.spans."""
    return [(k, SIGNS[k], scan.compiled(p)) for k, p in SPAN_ZONES]


def _zone_batches(tables: bool):
    def found(content: str) -> Iterator[tuple]:
        lines = content.split("\n")
        for i, (line, state) in enumerate(zip(lines, scan.states(content, lines), strict=True)):
            for start, end, kind in scan.spans(line, state, tables, kinds):
                yield i + 1, start, end, kind

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.in_parts(batches):
            yield scan.rows(batch, found, ["path"], schema)

    kinds = scanned()
    schema = pa.schema([("path", pa.string()), ("line_number", pa.int32()), ("column_start", pa.int32()), ("column_end", pa.int32()), ("zone_type", pa.string())])
    return of


def outside(candidates: DataFrame, zones: DataFrame) -> DataFrame:
    """The candidates whose start column is in no zone of its line."""
    z = zones.select("path", "line_number", F.col("column_start").alias("zs"), F.col("column_end").alias("ze"))
    c = candidates.alias("c")
    same = (F.col("c.path") == z["path"]) & (F.col("c.line_number") == z["line_number"])
    return c.join(z, same & (F.col("c.column_start") >= F.col("zs")) & (F.col("c.column_start") < F.col("ze")), "left_anti")
