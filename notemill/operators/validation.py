"""Front-matter validation against a schema: missing and invalid fields, cross-field warnings, fixes, summary."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Field:
    """A schema's field. kind: string, array, boolean, integer, number, date or datetime."""

    name: str
    kind: str = "string"
    required: bool = False
    default: str | None = None
    pattern: str | None = None


#: The schema of a plain note and the patterns of well-known fields.
PATTERNS = {"id": r"^\d{14}$", "date": r"^\d{4}-\d{2}-\d{2}$", "isbn": r"^\d{13}$", "isbn13": r"^\d{13}$"}
NOTE_SCHEMA = (
    Field("title", "string", True),
    Field("aliases", "array"),
    Field("tags", "array"),
    Field("id", "string", True, pattern=PATTERNS["id"]),
    Field("date", "string", pattern=PATTERNS["date"]),
    Field("publish", "boolean"),
)

#: The fields that a template's notes had better have.
RECOMMENDED = {"booksearchtemplate": ("author", "publisher", "totalPage"), "new-fleeing-note": ("description", "category")}

#: Kinds that a JSON value of a type satisfies; true and false count as numbers too.
_TYPES = {"string": ("string",), "date": ("string",), "datetime": ("string",), "array": ("array",), "boolean": ("boolean",), "integer": ("integer", "boolean"), "number": ("integer", "number", "boolean")}


def json_type(value: Column) -> Column:
    """string, array, object, boolean, integer, number or null of a JSON text."""
    v = F.trim(value)
    return (
        F.when(v.isNull() | (v == "null"), "null")
        .when(v.startswith('"'), "string")
        .when(v.startswith("["), "array")
        .when(v.startswith("{"), "object")
        .when(v.isin("true", "false"), "boolean")
        .when(v.rlike(r"^-?\d+$"), "integer")
        .otherwise("number")
    )


def _falsy(value: Column) -> Column:
    return value.isNull() | F.trim(value).isin("null", '""', "[]", "{}", "false", "0", "0.0")


def validate(rows: DataFrame, schema: Sequence[Field] = NOTE_SCHEMA) -> DataFrame:
    """rows (path, fields map<string,string> of JSON values) to (path, is_valid, missing_fields, invalid_fields, warnings).

    A required field is missing if its key is absent or its value falsy (false counts for a
    boolean). A wrong type hides the pattern check. Warnings do not count against validity.
    """
    f = F.col("fields")
    value = lambda n: f[n]
    missing, invalid = [], []
    for field in schema:
        v = value(field.name)
        if field.required:
            gone = ~F.map_contains_key(f, field.name) | (v.isNull() if field.kind == "boolean" else _falsy(v))
            missing.append(F.when(gone, F.lit(field.name)))
        there = F.map_contains_key(f, field.name) & (json_type(v) != "null")
        wrong = ~json_type(v).isin(*_TYPES[field.kind])
        found = F.when(there & wrong, F.concat(F.lit(f"{field.name}: expected {field.kind}, got "), json_type(v)))
        if field.pattern:
            text = F.regexp_replace(v, '^"|"$', "")
            found = found.when(there & ~text.rlike(field.pattern), F.lit(f"{field.name}: does not match {field.pattern}"))
        invalid.append(found)
    names = F.array(*[F.lit(x.name) for x in schema])
    out = rows.select("path", F.array_compact(F.array(*missing)).alias("missing_fields"), F.array_compact(F.array(*invalid)).alias("invalid_fields"), _warnings(f, names).alias("warnings"))
    return out.withColumn("is_valid", (F.size("missing_fields") == 0) & (F.size("invalid_fields") == 0)).select("path", "is_valid", "missing_fields", "invalid_fields", "warnings")


def _warnings(f: Column, names: Column, recommended: Column | None = None) -> Column:
    """array<string> for fields that do not fit each other, that the schema does not know, and that are recommended and absent."""
    text = lambda n: F.regexp_replace(f[n], '^"|"$', "")
    bad_id = F.map_contains_key(f, "id") & text("id").rlike(r"^\d{14}$") & F.try_to_timestamp(text("id"), F.lit("yyyyMMddHHmmss")).isNull()
    doubled = F.map_contains_key(f, "aliases") & F.coalesce(F.array_contains(F.from_json(f["aliases"], "array<string>"), text("title")), F.lit(False))
    bad_date = F.map_contains_key(f, "date") & F.try_to_timestamp(text("date"), F.lit("yyyy-M-d")).isNull()
    listed = lambda words, kind: F.when(F.size(words) > 0, F.concat(F.lit(kind), F.array_join(F.array_sort(words), ", ")))
    said = [
        F.when(bad_id, F.lit("id is not a time stamp")),
        F.when(doubled, F.lit("title is among the aliases")),
        F.when(bad_date, F.lit("date is not a date")),
        listed(F.array_except(F.map_keys(f), names), "unexpected fields: "),
    ]
    if recommended is not None:
        said.append(listed(F.array_except(recommended, F.map_keys(f)), "recommended fields: "))
    return F.array_compact(F.array(*said))


# Template mode: the schemas are a table, and each note is checked against the rows of its own template.

SCHEMA_ROWS = "template string, position int, name string, kind string, required boolean, default string, pattern string"


def schema_rows(spark: SparkSession, schemas: Mapping[str, Sequence[Field]]) -> DataFrame:
    """(template, position, name, kind, required, default, pattern): the fields of each template in order."""
    rows = [(template, i, x.name, x.kind, x.required, None if x.default is None else str(x.default), x.pattern) for template, fields in sorted(schemas.items()) for i, x in enumerate(fields)]
    return spark.createDataFrame(rows, SCHEMA_ROWS)


def _with_schema(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """rows (path, fields, template) with schema array<struct<name, kind, required, default, pattern>> of their template; null without one.

    One row a template meets the notes, so it is the notes' size that counts.
    """
    one = F.struct("position", "name", "kind", "required", "default", "pattern")
    return rows.join(schemas.groupBy("template").agg(F.array_sort(F.collect_list(one)).alias("schema")), "template", "left")


def _gone(f: Column, x: Column) -> Column:
    """Whether a required field is absent or falsy (false counts for a boolean)."""
    v = F.try_element_at(f, x["name"])
    return x["required"] & (~F.map_contains_key(f, x["name"]) | F.when(x["kind"] == "boolean", v.isNull()).otherwise(_falsy(v)))


def _fits(found: Column, kind: Column) -> Column:
    """Whether a JSON type satisfies a kind of field."""
    allowed = F.create_map(*[y for k, names in _TYPES.items() for y in (F.lit(k), F.array(*[F.lit(n) for n in names]))])
    return F.array_contains(F.try_element_at(allowed, kind), found)


def by_template(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """rows (path, fields, template) and schemas (SCHEMA_ROWS) to (path, template, is_valid, missing_fields, invalid_fields, warnings).

    The rules are those of validate, with the recommended fields among the warnings. A note
    whose template has no schema is not valid and says so.
    """
    f, schema = F.col("fields"), F.col("schema")

    def invalid(x: Column) -> Column:
        v = F.try_element_at(f, x["name"])
        found, there = json_type(v), F.map_contains_key(f, x["name"]) & (json_type(v) != "null")
        text = F.regexp_replace(v, '^"|"$', "")
        return F.when(there & ~_fits(found, x["kind"]), F.concat(x["name"], F.lit(": expected "), x["kind"], F.lit(", got "), found)).when(
            there & x["pattern"].isNotNull() & ~F.coalesce(F.regexp_like(text, x["pattern"]), F.lit(True)), F.concat(x["name"], F.lit(": does not match "), x["pattern"])
        )

    wanted = F.coalesce(F.try_element_at(F.create_map(*[y for k, names in RECOMMENDED.items() for y in (F.lit(k), F.array(*[F.lit(n) for n in names]))]), F.col("template")), F.array().cast("array<string>"))
    known = schema.isNotNull()
    none = F.array().cast("array<string>")
    out = _with_schema(rows.select("path", "fields", "template"), schemas).select(
        "path",
        "template",
        known.alias("known"),
        F.when(known, F.transform(F.filter(schema, lambda x: _gone(f, x)), lambda x: x["name"])).otherwise(none).alias("missing_fields"),
        F.when(known, F.array_compact(F.transform(schema, invalid))).otherwise(none).alias("invalid_fields"),
        F.when(known, _warnings(f, F.transform(schema, lambda x: x["name"]), wanted)).otherwise(F.array(F.concat(F.lit("no schema of "), F.coalesce("template", F.lit("no template"))))).alias("warnings"),
    )
    valid = F.col("known") & (F.size("missing_fields") == 0) & (F.size("invalid_fields") == 0)
    return out.select("path", "template", valid.alias("is_valid"), "missing_fields", "invalid_fields", "warnings")


def template_fixes(rows: DataFrame, schemas: DataFrame) -> DataFrame:
    """(path, field_name, fix_type, suggested_value): the default of each missing required field; add where the key is absent, else modify. The value is null without a default."""
    f = F.col("fields")
    one = lambda x: F.struct(x["name"].alias("field_name"), F.when(F.map_contains_key(f, x["name"]), "modify").otherwise("add").alias("fix_type"), x["default"].alias("suggested_value"))
    found = _with_schema(rows.select("path", "fields", "template"), schemas)
    return found.select("path", F.explode(F.transform(F.filter("schema", lambda x: _gone(f, x)), one)).alias("x")).select("path", "x.*")


def template_summary(validated: DataFrame) -> DataFrame:
    """(template, total, valid, invalid, with_warnings, missing_issues, invalid_issues): a row a template, and one for all (template null)."""
    issues = lambda c: F.coalesce(F.sum(F.size(c)), F.lit(0))
    return validated.rollup("template").agg(
        F.count("*").alias("total"),
        F.count_if("is_valid").alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.count_if(F.size("warnings") > 0).alias("with_warnings"),
        issues("missing_fields").alias("missing_issues"),
        issues("invalid_fields").alias("invalid_issues"),
    )


def fixed_date(text: Column) -> Column:
    """Y/M/D, M/D/Y and Y.M.D written with hyphens, without padding; else null."""
    ymd, mdy, dots = r"^(\d{4})/(\d{1,2})/(\d{1,2})$", r"^(\d{1,2})/(\d{1,2})/(\d{4})$", r"^(\d{4})\.(\d{1,2})\.(\d{1,2})$"
    return F.when(text.rlike(ymd), F.regexp_replace(text, ymd, "$1-$2-$3")).when(text.rlike(mdy), F.regexp_replace(text, mdy, "$3-$1-$2")).when(text.rlike(dots), F.regexp_replace(text, dots, "$1-$2-$3"))


def fixed_id(text: Column) -> Column:
    """The digits, if there are 14; else null."""
    digits = F.regexp_replace(text, r"\D", "")
    return F.when(F.length(digits) == 14, digits)


def cleaned_list(values: Column, lower: bool = False) -> Column:
    """Trimmed, without blanks and repeats, in order; tags also in lower case."""
    kept = F.filter(F.transform(values, lambda x: F.lower(F.trim(x)) if lower else F.trim(x)), lambda x: x != "")
    return F.array_distinct(kept)


def fixes(rows: DataFrame, validated: DataFrame, as_of: str, schema: Sequence[Field] = NOTE_SCHEMA) -> DataFrame:
    """(path, field_name, fix_type, suggested_value): defaults for missing fields and repairs of id, date, aliases and tags."""
    joined = rows.join(validated.select("path", "missing_fields"), "path")
    default = {"id": F.lit(as_of), "date": F.lit(f"{as_of[:4]}-{as_of[4:6]}-{as_of[6:8]}")}
    f = F.col("fields")
    text = lambda n: F.regexp_replace(f[n], '^"|"$', "")
    one = lambda name, kind, v: F.struct(F.lit(name).alias("field_name"), F.lit(kind).alias("fix_type"), v.cast("string").alias("suggested_value"))
    found = [F.when(F.array_contains("missing_fields", x.name), one(x.name, "add", F.lit(x.default) if x.default else default.get(x.name, F.lit("[]" if x.kind == "array" else "")))) for x in schema if x.required]
    found.append(F.when(~text("id").rlike(PATTERNS["id"]) & fixed_id(text("id")).isNotNull(), one("id", "modify", fixed_id(text("id")))))
    found.append(F.when(~text("date").rlike(PATTERNS["date"]) & fixed_date(text("date")).isNotNull(), one("date", "modify", fixed_date(text("date")))))
    for name, lower in (("aliases", False), ("tags", True)):
        values = F.from_json(f[name], "array<string>")
        found.append(F.when(values.isNotNull() & (cleaned_list(values, lower) != values), one(name, "modify", F.to_json(cleaned_list(values, lower)))))
    return joined.select("path", F.explode(F.array_compact(F.array(*found))).alias("x")).select("path", "x.*")


def summary(validated: DataFrame) -> DataFrame:
    """(total, valid, invalid, missing_issues, invalid_issues, valid_rate)."""
    n = F.count("*")
    valid = F.count_if("is_valid")
    return validated.agg(
        n.alias("total"),
        valid.alias("valid"),
        F.count_if(~F.col("is_valid")).alias("invalid"),
        F.coalesce(F.sum(F.size("missing_fields")), F.lit(0)).alias("missing_issues"),
        F.coalesce(F.sum(F.size("invalid_fields")), F.lit(0)).alias("invalid_issues"),
        F.when(n > 0, valid / n).otherwise(0.0).alias("valid_rate"),
    )


def most_missing(validated: DataFrame, top: int = 5) -> DataFrame:
    """(field, notes): the fields missing most often."""
    return validated.select(F.explode("missing_fields").alias("field")).groupBy("field").agg(F.count("*").alias("notes")).orderBy(F.col("notes").desc(), "field").limit(top)
