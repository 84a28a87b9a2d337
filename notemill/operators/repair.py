"""Front matter brought to a schema: types converted, missing fields of a template added, files written again.

Values travel as JSON texts in a map, as in validation. Conversions follow one fixed rule
for each kind of field; a value that a rule cannot read (text for a number) stays as it is.
Nothing here shuffles: every note is repaired within its row.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.text import let, strip
from notemill.operators.validation import NOTE_SCHEMA, Field, json_type
from notemill.sources.frontmatter import with_fields

# Words that mean yes, the fields that a complete note has, and the picture of a note without one.
YES = ("true", "yes", "1", "on")
ESSENTIAL = ("title", "aliases", "tags", "id", "published", "image", "description")
IMAGE = "../../assets/images/svg/undraw/undraw_scrum_board.svg"
EMPTY = {"array": "[]", "boolean": "false", "integer": "0", "number": "0.0"}


def unquoted(value: Column) -> Column:
    """The text of a JSON string."""
    return F.from_json(F.concat(F.lit('{"v":'), value, F.lit("}")), "v string")["v"]


def quoted(text: Column) -> Column:
    """A text as JSON."""
    made = F.to_json(F.array(text))
    return F.substring(made, F.lit(2), F.length(made) - 2)


def _entries(schema: Sequence[Field]) -> Column:
    """array<struct<key, original, converted>> of a note's fields; converted is as the schema wants it. Null, what cannot be read, and fields without a schema stay."""
    kinds = F.create_map(*[F.lit(x) for f in schema for x in (f.name, f.kind)])

    def change(x: Column) -> Column:
        v, kind, text, want = x["v"], x["kind"], x["text"], x["want"]
        parts = F.filter(F.transform(F.split(text, ","), lambda i: F.trim(i)), lambda i: i != "")
        listed = F.array_join(F.transform(F.from_json(v, "array<string>"), lambda i: F.coalesce(i, F.lit("None"))), ", ")
        to_list = F.when(kind != "string", F.concat(F.lit("["), v, F.lit("]"))).when(F.contains(text, F.lit(",")), F.to_json(parts)).when(strip(text) == "", F.lit("[]")).otherwise(F.to_json(F.array(text)))
        yes = F.when(kind == "string", F.lower(text).isin(*YES)).when(kind.isin("integer", "number"), F.coalesce(v.try_cast("double") != 0, F.lit(True))).otherwise(~F.trim(v).isin("[]", "{}"))
        whole = F.when(kind == "string", F.trim(text).try_cast("long")).when(kind == "number", v.try_cast("double").cast("long")).cast("string")
        return (
            F.when((x["key"] == "id") & (kind == "integer"), quoted(v))
            .when((want == "string") & (kind != "string"), quoted(F.when(kind == "array", listed).otherwise(v)))
            .when((want == "array") & (kind != "array"), to_list)
            .when((want == "boolean") & (kind != "boolean"), yes.cast("string"))
            .when((want == "integer") & ~kind.isin("integer", "boolean"), whole)
            .when((want == "number") & (kind == "string"), F.trim(text).try_cast("double").cast("string"))
        )

    def one(e: Column) -> Column:
        known = F.struct(e["key"].alias("key"), e["value"].alias("v"), json_type(e["value"]).alias("kind"), F.when(e["value"].startswith('"'), unquoted(e["value"])).alias("text"), F.try_element_at(kinds, e["key"]).alias("want"))
        return let(known, lambda x: F.struct(x["key"].alias("key"), x["v"].alias("original"), F.when(x["kind"] == "null", x["v"]).otherwise(F.coalesce(change(x), x["v"])).alias("converted")))

    return F.transform(F.map_entries("fields"), one)


def convert(rows: DataFrame, schema: Sequence[Field] = NOTE_SCHEMA) -> DataFrame:
    """rows (path, fields) with fields as the schema wants them; fields that it does not know stay."""
    return rows.withColumn("fields", F.map_from_entries(F.transform(_entries(schema), lambda e: F.struct(e["key"], e["converted"]))))


def conversions(rows: DataFrame, schema: Sequence[Field] = NOTE_SCHEMA) -> DataFrame:
    """(path, field_name, original_type, converted_type, original, converted): each value that a conversion changes. Equal numbers are no change."""
    changed = F.filter(_entries(schema), lambda e: ~F.coalesce(e["original"] == e["converted"], F.lit(True)))
    found = rows.select("path", F.explode(changed).alias("c")).select("path", "c.*")
    typed = found.select("path", F.col("key").alias("field_name"), json_type(F.col("original")).alias("original_type"), json_type(F.col("converted")).alias("converted_type"), "original", "converted")
    numbers = F.col("original_type").isin("integer", "number") & F.col("converted_type").isin("integer", "number")
    return typed.where(~(numbers & F.coalesce(F.col("original").try_cast("double") == F.col("converted").try_cast("double"), F.lit(False))))


def conversion_summary(conversions: DataFrame, top: int | None = None) -> DataFrame:
    """(conversion, times, fields): how often each type became another, and in how many fields; conversion null is all of them. The most common first where top is given."""
    kind = F.concat("original_type", F.lit(" -> "), "converted_type")
    counts = conversions.select(kind.alias("conversion"), "field_name").rollup("conversion").agg(F.count("*").alias("times"), F.count_distinct("field_name").alias("fields"))
    return counts if top is None else counts.where("conversion IS NOT NULL").orderBy(F.col("times").desc(), "conversion").limit(top)


def safe_default(field: Field, fields: Column) -> Column:
    """What a missing field is given: the schema's default; for published the date; else an empty value of its kind."""
    if field.default is not None:
        return quoted(F.lit(str(field.default)))
    plain = F.lit(EMPTY[field.kind]) if field.kind in EMPTY else quoted(F.lit(IMAGE if field.name == "image" else ""))
    if field.name != "published":
        return plain
    there = F.map_contains_key(fields, "date") & ~json_type(fields["date"]).isin("null") & (strip(F.coalesce(F.when(json_type(fields["date"]) == "string", unquoted(fields["date"])).otherwise(fields["date"]), F.lit(""))) != "")
    return F.when(there, fields["date"]).otherwise(plain)


def templated(rows: DataFrame, schema: Sequence[Field]) -> DataFrame:
    """rows (path, fields) with fields, and added array<string>: what a template asks for and the note lacks.

    A note that has all ESSENTIAL fields of the template stays as it is. In others missing
    fields are added, and required ones that are null or blank are filled where there is
    something to fill them with; nothing else is overwritten.
    """
    f = F.col("fields")
    lacking = [~F.map_contains_key(f, x.name) for x in schema if x.name in ESSENTIAL]
    incomplete = lacking[0] if lacking else F.lit(False)
    for one in lacking[1:]:
        incomplete = incomplete | one
    entries = []
    for x in schema:
        value = f[x.name]
        blank = (json_type(value) == "null") | ((json_type(value) == "string") & (strip(F.coalesce(unquoted(value), F.lit(""))) == ""))
        wanted = ~F.map_contains_key(f, x.name) | (F.lit(x.required) & blank)
        entries.append(F.when(incomplete & wanted, F.struct(F.lit(x.name).alias("key"), safe_default(x, f).alias("value"))))
    made = rows.withColumn("_added", F.array_compact(F.array(*entries)))
    fresh = F.map_from_entries("_added")
    kept = F.map_filter(f, lambda k, _: ~F.map_contains_key(fresh, k))
    return made.withColumn("fields", F.map_concat(kept, fresh)).withColumn("added", F.array_sort(F.transform("_added", lambda e: e["key"]))).drop("_added")


def repaired(rows: DataFrame, schema: Sequence[Field] = NOTE_SCHEMA) -> DataFrame:
    """rows (path, fields, ...) converted, then completed by the schema."""
    return templated(convert(rows, schema), schema)


def rewritten_files(notes: DataFrame, schema: Sequence[Field] = NOTE_SCHEMA) -> DataFrame:
    """notes (path, raw, fields) to (path, raw) of the notes whose front matter changes, written with the repaired fields."""
    done = repaired(notes.select("path", "raw", "fields", F.col("fields").alias("before")), schema)
    entries = lambda m: F.array_sort(F.map_entries(m))
    return done.where(entries("fields") != entries("before")).select("path", with_fields(F.col("raw"), F.col("fields"), [f.name for f in schema]).alias("raw"))

