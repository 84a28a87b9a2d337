"""Links of notes: extraction, dead links with suggestions, density."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from notemill.functions import scan
from notemill.functions.text import BLANKS, body_without_rules, let, matches, strip

# The link grammars of Markdown notes.
WIKI = r"\[\[([^|\]]+)(?:\|([^\]]+))?\]\]"
REGULAR = r"\[([^\]]+)\]\(([^)]+)\)"
DEFINITION = r'^\[([^|\]]+)\|([^\]]+)\]:\s*([^\s]+)(?:\s+"([^"]+)")?'
TEMPLATES = (r"\$\{[^}]*\}", r"\{\{[^}]*\}\}", r"<%[^%]*%>", r"<%\*.*?\*%>")
#: What every expression of the template at the same place holds.
TEMPLATE_SIGNS = ("${", "{{", "<%", "<%*")
LINK_TYPES = ("wikilink", "regular_link", "link_reference_definition")


def lines(notes: DataFrame, *carried: str) -> DataFrame:
    """(path, line_number, line): the lines of each body, from 1; carried columns of the note stand behind path."""
    each = notes.select("path", *carried, F.posexplode(F.split("content", "\n", -1)).alias("n", "line"))
    return each.select("path", *carried, (F.col("n") + 1).alias("line_number"), "line")


def template_spans(line):
    """array<struct<start, hit>> of template expressions in a line; most lines have no opening sign and are left at that."""
    opens = F.contains(line, F.lit("{")) | F.contains(line, F.lit("<%"))
    return F.when(opens, F.concat(*[matches(line, p, s) for p, s in zip(TEMPLATES, TEMPLATE_SIGNS, strict=True)])).otherwise(F.array().cast("array<struct<start:int,hit:string>>"))


def wiki_parts(hit: Column) -> tuple[Column, Column]:
    """Target and alias of a hit of WIKI, cut at the first bar; an alias that is not there is empty."""
    inner = F.substring(hit, F.lit(3), F.length(hit) - 4)
    target = F.substring_index(inner, "|", 1)
    return strip(target), strip(F.substring(inner, F.length(target) + 2, F.length(hit)))


def regular_parts(hit: Column) -> tuple[Column, Column]:
    """Text and address of a hit of REGULAR, cut at the first closing bracket."""
    text = F.substring_index(F.substring(hit, F.lit(2), F.length(hit)), "]", 1)
    return text, F.substring(hit, F.length(text) + 4, F.length(hit) - F.length(text) - 4)


def outside_templates(line: Column) -> Column:
    """array<struct<start, hit>> of the wiki links of a line that do not start in a template expression."""
    inside = lambda m, z: F.exists(z, lambda x: (m["start"] >= x["start"]) & (m["start"] < x["start"] + F.length(x["hit"])))
    return let(template_spans(line), lambda z: let(matches(line, WIKI, "[["), lambda w: F.when(F.size(z) == 0, w).otherwise(F.filter(w, lambda m: ~inside(m, z)))))


def wikilinks(notes: DataFrame, *carried: str) -> DataFrame:
    """(path, line_number, column_start, column_end, target, alias): wiki links that do not start in a template expression."""
    found = lines(notes, *carried).where(F.contains("line", F.lit("[["))).select("path", *carried, "line_number", F.explode(outside_templates(F.col("line"))).alias("m"))
    target, alias = wiki_parts(F.col("m.hit"))
    return found.select(
        "path",
        *carried,
        "line_number",
        F.col("m.start").alias("column_start"),
        (F.col("m.start") + F.length("m.hit")).alias("column_end"),
        target.alias("target"),
        F.when(alias != "", alias).alias("alias"),
    )


def regular_links(notes: DataFrame) -> DataFrame:
    """(path, line_number, text, url)."""
    found = lines(notes).where(F.contains("line", F.lit("]("))).select("path", "line_number", F.explode(F.regexp_extract_all("line", F.lit(REGULAR), F.lit(0))).alias("m"))
    text, url = regular_parts(F.col("m"))
    return found.select("path", "line_number", text.alias("text"), url.alias("url"))


def definitions(notes: DataFrame) -> DataFrame:
    """(path, line_number, id, alias, target, title): at most one a line."""
    line = strip(F.col("line"))
    part = lambda k: F.regexp_extract(line, DEFINITION, k)
    return lines(notes).where(line.rlike(DEFINITION)).select("path", "line_number", part(1).alias("id"), part(2).alias("alias"), part(3).alias("target"), part(4).alias("title"))


def line_links(line: Column, kinds: Sequence[str] = LINK_TYPES) -> Column:
    """array<struct<kind, target, text, alias>> of all links of a line; alias is null where the link has none."""
    one = lambda kind, target, text, alias: F.struct(F.lit(kind).alias("kind"), target.alias("target"), text.alias("text"), alias.alias("alias"))

    def wiki(m: Column) -> Column:
        target, alias = wiki_parts(m["hit"])
        return let(F.struct(target.alias("t"), F.when(alias != "", alias).alias("a")), lambda x: one("wikilink", x["t"], F.coalesce(x["a"], x["t"]), x["a"]))

    none = F.array().cast("array<struct<kind:string,target:string,text:string,alias:string>>")

    def regular(m: Column) -> Column:
        text, url = regular_parts(m)
        return one("regular_link", url, text, F.lit(None).cast("string"))

    bare = strip(line)
    definition = one("link_reference_definition", F.regexp_extract(bare, DEFINITION, 3), F.regexp_extract(bare, DEFINITION, 2), F.regexp_extract(bare, DEFINITION, 2))
    found = {
        "wikilink": F.when(F.contains(line, F.lit("[[")), F.transform(outside_templates(line), wiki)).otherwise(none),
        "regular_link": F.when(F.contains(line, F.lit("](")), F.transform(F.regexp_extract_all(line, F.lit(REGULAR), F.lit(0)), regular)).otherwise(none),
        "link_reference_definition": F.when(F.contains(line, F.lit("]:")) & bare.rlike(DEFINITION), F.array(definition)).otherwise(none),
    }
    return F.concat(*[found[k] for k in kinds])


def all_links(notes: DataFrame, kinds: Sequence[str] = LINK_TYPES, *carried: str) -> DataFrame:
    """(path, kind, target, text, line_number, alias) of the kinds asked for, from one pass over the lines in Arrow batches."""
    read = notes.select("path", *carried, "content")
    types = dict(read.dtypes)
    columns = [*((c, types[c]) for c in ("path", *carried)), ("kind", "string"), ("target", "string"), ("text", "string"), ("line_number", "int"), ("alias", "string")]
    return read.mapInArrow(_link_batches(tuple(kinds), ["path", *carried]), ", ".join(f"`{n}` {t}" for n, t in columns))


def _link_batches(kinds: Sequence[str], carried: list[str]):
    wiki, regular, definition = map(scan.compiled, (WIKI, REGULAR, DEFINITION))
    templates = [(sign, scan.compiled(p)) for sign, p in zip(TEMPLATE_SIGNS, TEMPLATES, strict=True)]

    def wikis(line: str) -> Iterator[tuple]:
        spans = [m.span() for sign, p in templates if sign in line for m in p.finditer(line)]
        for m in wiki.finditer(line):
            if not any(start <= m.start() < end for start, end in spans):
                target, alias = m[1].strip(BLANKS), (m[2] or "").strip(BLANKS) or None
                yield "wikilink", target, target if alias is None else alias, alias

    def of_line(line: str) -> Iterator[tuple]:
        if "wikilink" in kinds and "[[" in line:
            yield from wikis(line)
        if "regular_link" in kinds and "](" in line:
            yield from (("regular_link", m[2], m[1], None) for m in regular.finditer(line))
        if "link_reference_definition" in kinds and "]:" in line and (m := definition.search(line.strip(BLANKS))):
            yield "link_reference_definition", m[3], m[2], m[2]

    def found(content: str) -> Iterator[tuple]:
        if "[" in content:
            for i, line in enumerate(content.split("\n")):
                if "[" in line:
                    for kind, target, text, alias in of_line(line):
                        yield kind, target, text, i + 1, alias

    def of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in scan.in_parts(batches):
            fields = [("kind", pa.string()), ("target", pa.string()), ("text", pa.string()), ("line_number", pa.int32()), ("alias", pa.string())]
            yield scan.rows(batch, found, carried, pa.schema([*((c, batch.schema.field(c).type) for c in carried), *fields]))

    return of


def registry(notes: DataFrame) -> DataFrame:
    """(file_id, title, aliases, path): one row for each id, the last path winning."""
    last = F.row_number().over(Window.partitionBy("file_id").orderBy(F.col("path").desc()))
    return notes.where("file_id IS NOT NULL").select("file_id", "title", "aliases", "path", last.alias("r")).where("r = 1").drop("r")


def dead_links(notes: DataFrame, known: DataFrame | None = None) -> DataFrame:
    """(source_file, link_text, link_type, line_number, target): wiki links without a note and links without an address.

    Both kinds come from one pass. Links without an address meet no id; they are dealt by
    their note, so that they do not all wait in one task.
    """
    known = (notes.where("file_id IS NOT NULL") if known is None else known).select(F.col("file_id").alias("key"), F.lit(True).alias("known")).distinct()
    wiki = F.col("kind") == "wikilink"
    found = all_links(notes, ["wikilink", "regular_link"]).where(wiki | (strip(F.col("target")) == ""))
    found = found.withColumn("key", F.when(wiki, F.col("target")).otherwise(F.col("path"))).join(known, "key", "left").where(~wiki | F.col("known").isNull())
    as_wiki = F.concat(F.lit("[["), "target", F.when(F.col("alias").isNotNull(), F.concat(F.lit("|"), "alias")).otherwise(""), F.lit("]]"))
    text = F.when(wiki, as_wiki).otherwise(F.concat(F.lit("["), "text", F.lit("]("), "target", F.lit(")")))
    return found.select(F.col("path").alias("source_file"), text.alias("link_text"), F.col("kind").alias("link_type"), "line_number", "target")


def suggestions(dead: DataFrame, known: DataFrame, most: int = 3) -> DataFrame:
    """dead with suggested_fixes: the first ids, in order, that share the target's first four characters.

    Ids are ranked once for each prefix and cut to the first few before the join, so a
    frequent prefix multiplies nothing. One more than asked for is kept: the target itself
    is never suggested.
    """
    ids = known.select("file_id").distinct().where(F.length("file_id") >= 4).withColumn("prefix", F.substring("file_id", 1, 4))
    first = F.row_number().over(Window.partitionBy("prefix").orderBy("file_id"))
    ids = ids.withColumn("r", first).where(F.col("r") <= most + 1).groupBy("prefix").agg(F.array_sort(F.collect_list("file_id")).alias("ids"))
    wiki = (F.col("link_type") == "wikilink") & (F.length("target") >= 4)
    joined = dead.withColumn("prefix", F.when(wiki, F.substring("target", 1, 4))).join(ids, "prefix", "left")
    near = F.slice(F.filter(F.coalesce("ids", F.array().cast("array<string>")), lambda x: x != F.col("target")), 1, most)
    fixes = F.transform(near, lambda x: F.concat(F.lit("Did you mean '"), x, F.lit("'?")))
    return joined.select(*dead.columns, fixes.alias("suggested_fixes"))


def checked_types(types: list[str] | None) -> list[str]:
    """The link types asked for; an unknown one is an error."""
    unknown = set(types or ()) - set(LINK_TYPES)
    if unknown:
        raise ValueError(f"unknown link types: {sorted(unknown)}; there are {', '.join(LINK_TYPES)}")
    return list(types or LINK_TYPES)


def selected(dead: DataFrame, types: list[str] | None = None, only_with_suggestions: bool = False, sort_by: str = "file", limit: int | None = None) -> DataFrame:
    """Filter, sort by file, type or target, and limit; all orders are total."""
    orders = {"file": ["source_file", "line_number"], "type": ["link_type", "source_file", "line_number"], "target": ["target", "source_file", "line_number"]}
    if sort_by not in orders:
        raise ValueError(f"sort_by must be one of {', '.join(orders)}")
    out = dead.where(F.col("link_type").isin(checked_types(types)))
    if only_with_suggestions:
        out = out.where(F.size("suggested_fixes") > 0)
    out = out.orderBy(*orders[sort_by], "link_type", "target", "link_text")
    return out if limit is None else out.limit(limit)


def density(notes: DataFrame) -> DataFrame:
    """(path, words, wiki_links, regular_links, definitions, total_links, unique_targets, density): links for each 100 words.

    All is counted within a note's row; nothing is shuffled.
    """
    body = body_without_rules(F.col("content"))
    words = F.size(F.filter(F.split(body, r"(?U)\s+"), lambda w: w != ""))
    kinds = F.flatten(F.transform(F.filter(F.split("content", "\n", -1), lambda x: F.contains(x, F.lit("["))), lambda x: F.transform(line_links(x), lambda m: F.struct(m["kind"].alias("kind"), m["target"].alias("target")))))
    of = lambda kind: F.size(F.filter("l", lambda m: m["kind"] == kind)).cast("long")
    counted = notes.select("path", words.alias("words"), kinds.alias("l"))
    total = F.size("l").cast("long")
    return counted.select(
        "path",
        "words",
        of("wikilink").alias("wiki_links"),
        of("regular_link").alias("regular_links"),
        of("link_reference_definition").alias("definitions"),
        F.size(F.array_distinct(F.transform("l", lambda m: m["target"]))).cast("long").alias("unique_targets"),
        total.alias("total_links"),
        F.when(F.col("words") > 0, total / F.col("words") * 100).otherwise(0.0).alias("density"),
    )
