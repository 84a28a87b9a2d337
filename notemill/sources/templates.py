"""Schemas inferred from template notes. Templates are few and small; this runs on the driver."""

from __future__ import annotations

import os
import re
from collections.abc import Mapping
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.operators.validation import PATTERNS, Field
from notemill.sources.frontmatter import SPLIT

# Where templates live, what their variables mean, which directories they stand for.
DIRECTORIES = ("900_TemplaterNotes", "903_BookSearchTemplates", "Templates", "templates")
MAPPING = {"100_FleetingNotes": "new-fleeing-note", "104_Books": "booksearchtemplate", "Books": "booksearchtemplate", "FleetingNotes": "new-fleeing-note", "Notes": "new-fleeing-note"}
FALLBACK = "new-fleeing-note"
GENERATED = ("creation_date", "cursor", "title")


def variable(name: str, header: str) -> str | None:
    """What a template fills a field with: the inside of <% %>, else of {{ }}."""
    for opening, inside, closing in ((r"<%", r"[^>]+", r"%>"), (r"\"?\{\{", r"[^}]+", r"\}\}")):
        if m := re.search(rf"{re.escape(name)}:\s*{opening}({inside}){closing}", header):
            return m[1].strip()
    return None


def kind_of(name: str, value: Any, filled: str | None) -> str:
    if filled is not None:
        return "date" if "creation_date" in filled.lower() and "YYYYMMDDHHmmss" not in filled else "string"
    if value is None and name in ("tags", "aliases"):
        return "array"
    if isinstance(value, bool) or (isinstance(value, str) and value.lower() in ("true", "false")):
        return "boolean"
    if isinstance(value, int) or (isinstance(value, str) and value.isdigit()):
        return "integer"
    return "number" if isinstance(value, float) else "array" if isinstance(value, list) else "string"


def field(name: str, value: Any, header: str) -> Field:
    """title and id, and what a template generates except published, are required; only asset paths are defaults."""
    filled = variable(name, header)
    generated = filled is not None and any(g in filled.lower() for g in GENERATED)
    kind = kind_of(name, value, filled)
    asset = isinstance(value, str) and value.startswith(("../../assets/", "assets/")) and not generated
    checked = kind == "string" or (name == "date" and kind == "date")
    return Field(name, kind, name in ("title", "id") or (generated and name != "published"), value if asset else None, PATTERNS.get(name) if checked else None)


def schema(raw: str) -> tuple[Field, ...] | None:
    """A template's fields in order; None if its front matter is no YAML as it stands."""
    import yaml

    m = re.match(SPLIT, raw)
    if not m:
        return None
    try:
        data = yaml.safe_load(m[1])
    except (yaml.YAMLError, ValueError):
        return None
    return tuple(field(str(k), v, m[1]) for k, v in data.items()) if isinstance(data, dict) else None


def schemas(raws: Mapping[str, str]) -> dict[str, tuple[Field, ...]]:
    """{template: fields} of {template: text}; those that cannot be read are left out."""
    return {name: s for name, raw in sorted(raws.items()) if (s := schema(raw)) is not None}


def template_of(directory: Column, keys: Column) -> Column:
    """A note's template: by a directory's name, by part of one, by the fields it has, else the fallback."""
    parts = F.split(directory, "/")
    exact = F.lit(None).cast("string")
    part = F.lit(None).cast("string")
    for name, template in reversed(MAPPING.items()):
        exact = F.when(F.array_contains(parts, name), template).otherwise(exact)
        low = name.lower()
        part = F.when(_partly(parts, low), template).otherwise(part)
    strong = lambda names: sum((F.array_contains(keys, n).cast("int") * 3 for n in names), F.lit(0))
    book, note = strong(("isbn", "isbn13", "author", "publisher")), strong(("published", "category", "description"))
    by_fields = F.when((book > 0) & (book >= note), "booksearchtemplate").when(note > 0, FALLBACK)
    return F.coalesce(exact, part, by_fields, F.lit(FALLBACK))


def _partly(parts: Column, name: str) -> Column:
    return F.exists(parts, lambda p: (p != "") & (F.lower(p).contains(name) | F.contains(F.lit(name), F.lower(p))))


def scan(notes: DataFrame) -> dict[str, str]:
    """{template: text} of notes (path, raw) that stand directly in one of DIRECTORIES. Templates are few and small; they are read on the driver."""
    parts = F.split("path", "/")
    parent = F.get(parts, F.size(parts) - 2)
    found = notes.where(parent.isin(*DIRECTORIES)).select("path", "raw").orderBy("path").collect()
    return {r["path"].rsplit("/", 1)[1].rsplit(".", 1)[0]: r["raw"] for r in found}


def in_templates(notes: DataFrame) -> Column:
    """Whether a note is a template itself."""
    parts = F.split(notes["path"], "/")
    return F.coalesce(F.get(parts, F.size(parts) - 2).isin(*DIRECTORIES), F.lit(False))


def assigned(notes: DataFrame) -> DataFrame:
    """notes with the column template, without the templates themselves."""
    return notes.where(~in_templates(notes)).withColumn("template", template_of(F.col("dir"), F.col("present_keys")))


def single(path: str) -> tuple[Field, ...]:
    """The schema of one template file; a path that is missing, no file, no Markdown or unreadable is an error of its own."""
    if not os.path.exists(path):
        raise FileNotFoundError(f"there is no template {path}")
    if not os.path.isfile(path):
        raise ValueError(f"{path} is not a file")
    if not path.lower().endswith(".md"):
        raise ValueError(f"{path} is not a Markdown file")
    with open(path, encoding="utf-8") as f:
        found = schema(f.read())
    if found is None:
        raise ValueError(f"{path} has no front matter that can be read")
    return found
