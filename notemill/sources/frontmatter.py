"""Front matter: splitting, parsing, normalising, and writing it back.

Splitting is an expression. Only the YAML between the rules needs Python; it is parsed in
Arrow batches, one small string a note. Values travel as JSON in a map, so that a key that
is absent and one that is null stay different.
"""

from __future__ import annotations

import datetime
import json
import re
from collections.abc import Iterator
from typing import Any

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The delimiters, and the keys that stand for others.
SPLIT = r"(?s)^(?:---|\+\+\+)\s*\n(.*?)\n(?:---|\+\+\+)\s*\n"
TEMPLATE_SYNTAX = re.compile(r"<%.*?%>|\{\{.*?\}\}", re.DOTALL)
SYNONYMS = {
    "tag": "tags",
    "tags": "tags",
    "category": "category",
    "categories": "category",
    "alias": "aliases",
    "aliases": "aliases",
    "aka": "aliases",
    "created": "date",
    "created_date": "date",
    "creation_date": "date",
    "date": "date",
    "public": "publish",
    "publish": "publish",
}
LISTS = ("tags", "aliases")
TRUE_WORDS = {"true", "yes", "1"}


def header(raw: Column) -> Column:
    """The text between the rules; empty without front matter."""
    return F.regexp_extract(raw, SPLIT, 1)


def body(raw: Column) -> Column:
    """What follows the front matter; the whole text without it."""
    return F.regexp_replace(raw, SPLIT, "")


def normalised(data: dict[str, Any]) -> dict[str, Any]:
    """Synonymous keys merged; tags and aliases as lists without repeats; publish as a boolean; no null description."""
    out: dict[str, Any] = {}
    for key, value in data.items():
        name = SYNONYMS.get(key.lower().strip(), key)
        if name in LISTS:
            values = value if isinstance(value, list) else [] if value is None else [value]
            before = out.get(name) or []
            out[name] = [*dict.fromkeys(x for x in (*before, *values) if x is not None)]
        elif name == "publish" and isinstance(value, str):
            out[name] = value.lower() in TRUE_WORDS
        elif name == "description" and value is None:
            out[name] = ""
        else:
            out[name] = value
    return out


def _plain(value: Any) -> Any:
    if isinstance(value, datetime.date):
        return value.isoformat()
    if isinstance(value, list):
        return [_plain(v) for v in value]
    if isinstance(value, dict):
        return {str(k): _plain(v) for k, v in value.items()}
    return value


def coerced(data: dict[str, Any]) -> dict[str, Any]:
    """The types that notes have: ids, titles and dates are strings, a date in publish means true."""
    out = dict(data)
    if "id" in out and out["id"] is not None:
        out["id"] = str(out["id"])
    if isinstance(out.get("title"), list):
        out["title"] = out["title"][0] if out["title"] else None
    if isinstance(out.get("publish"), datetime.date):
        out["publish"] = True
    return {k: _plain(v) for k, v in out.items()}


def parse(text: str | None) -> dict[str, str]:
    """A header to {key: JSON}; what is no mapping with string keys, or no YAML, is empty."""
    import yaml

    if not text:
        return {}
    try:
        data = yaml.safe_load(TEMPLATE_SYNTAX.sub("", text))
    except (yaml.YAMLError, ValueError):
        return {}
    if not isinstance(data, dict) or not all(isinstance(k, str) for k in data):
        return {}
    return {k: json.dumps(v, ensure_ascii=False, default=str) for k, v in coerced(normalised(data)).items()}


def parsed(rows: DataFrame) -> DataFrame:
    """rows (path, raw) to (path, raw, fields map<string,string>), with modified_at where the rows have it."""
    kind = pa.map_(pa.string(), pa.string())
    kept = ["path", "raw", *[c for c in rows.columns if c == "modified_at"]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            fields = pa.array([list(parse(h.as_py()).items()) for h in b.column(len(kept))], kind)
            yield pa.RecordBatch.from_arrays([*b.columns[: len(kept)], fields], names=[*kept, "fields"])

    stamped = ", modified_at timestamp" if len(kept) > 2 else ""
    return rows.select(*kept, header(F.col("raw")).alias("header")).mapInArrow(run, f"path string, raw string{stamped}, fields map<string,string>")


def _text(name: str) -> Column:
    v = F.col("fields")[name]
    return F.when(v.startswith('"'), F.from_json(F.concat(F.lit('{"v":'), v, F.lit("}")), "v string")["v"]).when(v != "null", v)


def _list(name: str) -> Column:
    return F.coalesce(F.from_json(F.col("fields")[name], "array<string>"), F.array().cast("array<string>"))


def as_notes(rows: DataFrame) -> DataFrame:
    """(path, raw, fields) to notes with the columns of the adapters, raw and fields, and modified_at where the rows have it."""
    name = F.substring_index("path", "/", -1)
    stem = F.regexp_replace(name, r"\.[^.]*$", "")
    fm_id = F.when(_text("id") != "", _text("id"))
    return rows.select(
        "path",
        F.regexp_replace("path", "/[^/]*$", "").alias("dir"),
        stem.alias("stem"),
        F.concat(F.lit("."), F.lower(F.substring_index(name, ".", -1))).alias("ext"),
        F.coalesce(fm_id, F.when(stem.rlike("^[0-9]{14}$"), stem)).alias("file_id"),
        fm_id.alias("fm_id"),
        _text("title").alias("title"),
        _list("aliases").alias("aliases"),
        _list("tags").alias("tags"),
        F.array_sort(F.map_keys("fields")).alias("present_keys"),
        body(F.col("raw")).alias("content"),
        "raw",
        "fields",
        *[c for c in rows.columns if c == "modified_at"],
    )


# Writing

_SPECIAL = r"[:\[\]{}|>#&*!%@`]"


def needs_quotes(value: Column, name: str) -> Column:
    """image always; id only for special characters; else special characters, words that YAML reads, and numbers."""
    if name == "image":
        return F.lit(True)
    if name == "id":
        return value.rlike(_SPECIAL)
    word = F.lower(value).isin("true", "false", "null", "yes", "no", "on", "off")
    return value.rlike(_SPECIAL) | word | value.rlike(r"^\s*[+-]?(?:[0-9](?:_?[0-9])*\.?[0-9]*(?:[eE][+-]?[0-9]+)?|\.[0-9]+(?:[eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))\s*$")


def written_line(name: str, value: Column) -> Column:
    """One line of front matter for a JSON value."""
    quoted = lambda v: F.when(needs_quotes(v, name), F.concat(F.lit("'"), v, F.lit("'"))).otherwise(v)
    items = F.from_json(value, "array<string>")
    text = F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]
    key = F.lit(f"{name}:")
    return (
        F.when(value.isNull() | value.isin("null", '""'), key)
        .when(value == "[]", F.lit(f"{name}: []"))
        .when(value.startswith("["), F.concat(F.lit(f"{name}: ["), F.array_join(F.transform(items, quoted), ","), F.lit("]")))
        .when(value.startswith('"'), F.concat(F.lit(f"{name}: "), quoted(text)))
        .otherwise(F.concat(F.lit(f"{name}: "), value))
    )


def written(fields: Column, names: list[str]) -> Column:
    """A front-matter block of the fields that are there, in the order of names."""
    lines = F.array_compact(F.array(*[F.when(F.map_contains_key(fields, n), written_line(n, fields[n])) for n in names]))
    return F.concat(F.lit("---\n"), F.array_join(lines, "\n"), F.lit("\n---\n"))


def with_body(raw: Column, new_body: Column) -> Column:
    """A file's text with a new body behind its front matter as it was."""
    return F.concat(F.regexp_extract(raw, SPLIT, 0), new_body)


def with_fields(raw: Column, fields: Column, order: list[str]) -> Column:
    """A file's text with its front matter written again: the fields in order first, then the others by name."""
    names = F.filter(F.array(*[F.lit(n) for n in order]), lambda n: F.map_contains_key(fields, n))
    rest = F.array_sort(F.array_except(F.map_keys(fields), names))
    known = F.array_compact(F.array(*[F.when(F.map_contains_key(fields, n), written_line(n, fields[n])) for n in order]))
    others = F.transform(rest, lambda n: any_line(n, F.element_at(fields, n)))
    return F.concat(F.lit("---\n"), F.array_join(F.concat(known, others), "\n"), F.lit("\n---\n"), body(raw))


def any_line(name: Column, value: Column) -> Column:
    """One line of front matter for a field that no schema knows: its JSON, which YAML reads too."""
    return F.concat(name, F.lit(": "), F.coalesce(value, F.lit("null")))
