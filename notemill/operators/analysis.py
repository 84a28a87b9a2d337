"""Note analysis: what a note lacks, its quality score, suggested tags, category and metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import facts
from notemill.functions.dictionaries import CATEGORIES, CONTENT_TAGS, METADATA, REQUIRED_FIELDS
from notemill.functions.text import description, jaccard, let, normalised, strip, words

# What each kind of improvement takes off the score, and how sure it is.
PENALTIES = {"missing_required_field": 0.25, "missing_tags": 0.15, "missing_description": 0.15, "missing_category": 0.1, "filename_mismatch": 0.1, "incomplete_content": 0.3, "placeholder_content": 0.25}


def category(content: Column) -> Column:
    """array<string>: the first two categories with a keyword in the text."""

    def of(low: Column) -> Column:
        hits = [F.when(_any([F.contains(low, F.lit(k)) for k in keywords]), F.lit(name)) for name, keywords in CATEGORIES]
        return F.slice(F.array_compact(F.array(*hits)), 1, 2)

    return let(F.lower(content), of)


def content_tags(content: Column) -> Column:
    """struct<tags array<string>, confidence>: the tags of all groups with keywords in the text, as sure as the best group (0.3 a keyword, at most 0.9)."""

    def of(low: Column) -> Column:
        groups = []
        for _, keywords, tags in CONTENT_TAGS:
            n: Column = F.lit(0)
            for k in keywords:
                n = n + F.when(F.contains(low, F.lit(k)), 1).otherwise(0)
            groups.append(F.struct(n.alias("n"), F.array(*[F.lit(t) for t in tags]).alias("tags")))
        return F.filter(F.array(*groups), lambda g: g["n"] > 0)

    def summed(hit: Column) -> Column:
        tags = F.array_sort(F.array_distinct(F.flatten(F.transform(hit, lambda g: g["tags"]))))
        best = F.coalesce(F.array_max(F.transform(hit, lambda g: F.least(F.lit(0.9), g["n"] * F.lit(0.3)))), F.lit(0.0))
        return F.struct(tags.alias("tags"), best.alias("confidence"))

    return let(let(F.lower(content), of), summed)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def improvements(notes: DataFrame) -> DataFrame:
    """notes with improvements array<struct<improvement_type, field_name, confidence>>, in the fixed order of the checks.

    Fields that a view of the notes does not have count as missing.
    """
    return checked(facts.read(notes, "checks")).drop("facts")


def checked(notes: DataFrame) -> DataFrame:
    """The improvements of notes whose contents were read for their checks (facts.read)."""
    said = F.col("facts.checks")
    one = lambda kind, field, sure: F.struct(F.lit(kind).alias("improvement_type"), F.lit(field).alias("field_name"), F.lit(sure).alias("confidence"))
    has = {"title": strip(F.coalesce("title", F.lit(""))) != "", "aliases": F.size("aliases") > 0, "tags": F.size("tags") > 0, "id": F.coalesce("fm_id", F.lit("")) != ""}
    for name in ("published", "description", "category"):
        kind = dict(notes.dtypes).get(name)
        has[name] = F.lit(False) if kind is None else (F.coalesce(F.size(name), F.lit(0)) > 0) if kind.startswith("array") else strip(F.coalesce(name, F.lit(""))) != ""
    required = [F.when(~has[f], one("missing_required_field", f, 0.9)) for f in REQUIRED_FIELDS]
    fresh = lambda s: F.when(F.size(F.array_except(s["tags"], "tags")) > 0, F.struct(F.lit("missing_tags").alias("improvement_type"), F.lit("tags").alias("field_name"), s["confidence"].alias("confidence")))
    tags = fresh(said)
    about = F.when(~has["description"] & said["description"].isNotNull(), one("missing_description", "description", 0.7))
    kind = F.when(~has["category"] & (F.size(said["categories"]) > 0), one("missing_category", "category", 0.7))
    a, b = normalised(F.col("stem")), normalised(F.col("title"))
    differs = has["title"] & ~F.col("stem").rlike("^[0-9]{14}$") & (a != b) & (jaccard(words(F.col("stem")), words(F.col("title"))) < 0.5)
    name = F.when(differs, one("filename_mismatch", "title", 0.6))
    short = F.when(said["short"], one("incomplete_content", "content", 0.8))
    unfinished = F.when(said["unfinished"], one("placeholder_content", "content", 0.9))
    return notes.withColumn("improvements", F.array_compact(F.array(*required, tags, about, kind, name, short, unfinished)))


def quality(analysed: DataFrame) -> DataFrame:
    """(path, improvements_found, quality_score): 1 less the penalties, between 0 and 1."""
    taken = F.aggregate("improvements", F.lit(1.0), lambda a, i: a - _penalty(i["improvement_type"]))
    return analysed.select("path", F.size("improvements").alias("improvements_found"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), taken)).alias("quality_score"))


def _penalty(kind: Column) -> Column:
    out: Column = F.lit(0.0)
    for name, value in PENALTIES.items():
        out = F.when(kind == name, value).otherwise(out)
    return out


def _each(analysed: DataFrame) -> DataFrame:
    """(i): one row for each improvement; from a plain explode Spark infers a filter that makes the improvements twice."""
    return analysed.select(F.explode_outer("improvements").alias("i")).where("i IS NOT NULL")


def improvement_counts(analysed: DataFrame) -> DataFrame:
    """(improvement_type, field_name, notes)."""
    return _each(analysed).groupBy("i.improvement_type", "i.field_name").agg(F.count("*").alias("notes"))


def categorised(analysed: DataFrame) -> DataFrame:
    """(area, improvements): frontmatter, metadata, tags, content or other by the kind's name, the first that fits."""
    kind = F.col("i.improvement_type")
    area = F.when(kind.contains("required") | kind.contains("frontmatter"), "frontmatter").when(kind.contains("description") | kind.contains("category"), "metadata").when(kind.contains("tags"), "tags")
    area = area.when(kind.contains("content"), "content").otherwise("other")
    return _each(analysed).groupBy(area.alias("area")).agg(F.count("*").alias("improvements"))


def metadata(notes: DataFrame) -> DataFrame:
    """(path, author, source, date_created, project, status, published, created_time, word_count, reading_time, language).

    date_created is the file's day (column modified_at, where there is one) if the content names none.
    """
    return facts.read(notes, "meta", "words").select("path", *stated(notes))


def counted(content: Column) -> Column:
    """struct<word_count, reading_time, language> of a text, by expressions: for texts whose words facts.read leaves open."""
    n = F.regexp_count(content, F.lit(r"(?U)\b\w+\b"))
    ja, en = F.regexp_count(content, F.lit("[぀-ゟ゠-ヿ一-龯]")), F.regexp_count(content, F.lit(r"\b[a-zA-Z]+\b"))
    language = F.when(ja > en * 2, "japanese").when(en > 10, "english").otherwise("mixed")
    return F.struct(n.alias("word_count"), F.greatest(F.lit(1), F.floor(n / 200).cast("int")).alias("reading_time"), language.alias("language"))


def stated(notes: DataFrame) -> list[Column]:
    """The columns of metadata, of notes whose contents were read for meta and words (facts.read)."""
    day = F.date_format("modified_at", "yyyy-MM-dd") if "modified_at" in notes.columns else F.lit(None).cast("string")
    said = {k: F.col("facts.meta")[k] for k in METADATA}
    found = [(F.coalesce(v, day) if k == "date_created" else v).alias(k) for k, v in said.items()]
    read = F.col("facts.words")
    words = F.when(read.isNotNull(), F.struct(*[read[n].alias(n) for n in ("word_count", "reading_time", "language")])).otherwise(counted(F.col("content")))
    stamp = F.when(F.col("stem").rlike("^[0-9]{14}$"), F.try_to_timestamp("stem", F.lit("yyyyMMddHHmmss")))
    return [*found, F.date_format(stamp, "yyyy-MM-dd").alias("published"), F.date_format(stamp, "yyyy-MM-dd HH:mm:ss").alias("created_time"), *[words[n].alias(n) for n in ("word_count", "reading_time", "language")]]


def descriptions(notes: DataFrame) -> DataFrame:
    """(path, description, categories)."""
    return notes.select("path", description(F.col("content")).alias("description"), category(F.col("content")).alias("categories"))


def opportunities(notes: DataFrame) -> DataFrame:
    """(notes, without_title, without_id, without_tags, few_tags, high, medium, low): what enhancing could add, by number of gaps."""
    gaps = [(F.coalesce("title", F.lit("")) == ""), F.coalesce("fm_id", F.lit("")) == "", F.size("tags") == 0]
    total = sum((g.cast("int") for g in gaps[1:]), gaps[0].cast("int")) + (F.size("tags") < 2).cast("int")
    return notes.agg(
        F.count("*").alias("notes"),
        F.count_if(gaps[0]).alias("without_title"),
        F.count_if(gaps[1]).alias("without_id"),
        F.count_if(gaps[2]).alias("without_tags"),
        F.count_if(F.size("tags") < 2).alias("few_tags"),
        F.count_if(total >= 3).alias("high"),
        F.count_if(total == 2).alias("medium"),
        F.count_if(total <= 1).alias("low"),
    )
