"""Enhanced front matter: a fixed order of steps over a note's fields, each on what the ones before it left.

The state of a note is a map of its text fields and its lists of tags, aliases and
categories; the log has an entry for every value that a step put in, with how sure it is
and whether it replaced another. All steps work within the note's row, on what one reading
of its content found (functions/facts). Only the tags of the vault, where they are more than
FEW, meet the notes in a join, by the words that tags and contents share.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions import facts
from notemill.functions.dictionaries import KEYWORD_TAGS, METADATA
from notemill.functions.facts import KEYWORDS
from notemill.functions.text import let
from notemill.operators.analysis import checked, stated
from notemill.operators.japanese import other_aliases

WORD = r"(?U)\w+"
# Fixed value: the confidence from which improvements are applied.
SURE = 0.7
#: Up to so many tags by their words are looked up within a note's row; more meet the notes' words in a join.
FEW = 256
LISTS = ("tags", "aliases", "category")
ENTRY = "array<struct<step:string,field:string,value:string,confidence:double,overwrote:boolean>>"
#: What the list of changes says of each step before the field's name.
LABELS = {"tags": "intelligent ", "technical": "technical ", "metadata": "metadata ", "dates": "date ", "aliases": "cross-language ", "suggested": "suggested ", "required": "required field ", "content": "content-based ", "id": "", "title": ""}
#: The fields of metadata in the order in which they are put in.
METADATA_FIELDS = (*METADATA, "published", "created_time", "word_count", "reading_time", "language")


def _none() -> Column:
    return F.array().cast("array<string>")


def hashtags(content: Column) -> Column:
    """The hashtags of more than two characters, in lower case, sorted."""
    found = F.filter(F.regexp_extract_all(content, F.lit(r"(?U)#(\w+)"), F.lit(1)), lambda t: F.length(t) > 2)
    return F.array_sort(F.array_distinct(F.transform(found, F.lower)))


def keyword_tags(content: Column) -> Column:
    """array<string>: the groups with KEYWORDS or more of their words in the text, and the wider groups of these."""

    def of(low: Column) -> Column:
        each = []
        for wide, narrow, words in KEYWORD_TAGS:
            n = sum((F.contains(low, F.lit(w)).cast("int") for w in words[1:]), F.contains(low, F.lit(words[0])).cast("int"))
            each.append(F.when(n >= KEYWORDS, F.array(F.lit(narrow), F.lit(wide))))
        return F.array_distinct(F.flatten(F.array_compact(F.array(*each))))

    return let(F.lower(content), of)


def _words(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.lower(text), F.lit(WORD), F.lit(0)))


def _by_word(vault_tags: DataFrame) -> DataFrame:
    return vault_tags.select(F.explode(_words(F.col("tag"))).alias("w"), "tag")


def _few_tags(vault_tags: DataFrame, few: int) -> dict[str, list[str]] | None:
    """The tags by their words as a table of the driver, where they are few."""
    known = _by_word(vault_tags).distinct().limit(few + 1).collect()
    table: dict[str, list[str]] = {}
    for w, tag in sorted(known):
        table.setdefault(w, []).append(tag)
    return table if len(known) <= few else None


def _looked_up(content: Column, near: dict[str, list[str]]) -> Column:
    """The tags of the table's words that stand in a text, by expressions: for texts whose words facts.read leaves open."""
    if not near:
        return _none()
    table = F.create_map(*[x for w, found in near.items() for x in (F.lit(w), F.array(*[F.lit(t) for t in found]))])
    return F.array_distinct(F.flatten(F.transform(F.filter(_words(content), lambda w: w.isin(list(near))), lambda w: table[w])))


def near_tags(notes: DataFrame, vault_tags: DataFrame) -> DataFrame:
    """(path, near): the tags of the vault that share a word with the note's content.

    The tags of a word are gathered once, however many notes hold it, so a note meets one
    row for each of its words that is a tag's.
    """
    of_word = _by_word(vault_tags).groupBy("w").agg(F.array_sort(F.collect_set("tag")).alias("tags"))
    held = notes.select("path", F.explode(_words(F.col("content"))).alias("w"))
    return held.join(of_word, "w").groupBy("path").agg(F.array_distinct(F.flatten(F.collect_list("tags"))).alias("near"))


def dates(notes: DataFrame, as_of: str | None = None) -> DataFrame:
    """(path, created, modified, published, created_by, published_by): days from the file's time and the id.

    The file's time is the column modified_at, where the notes have it (Spark knows no other
    time of a file). published is the day that an id of 14 digits begins with, else created.
    Where there is no file time, created and published are the day of as_of
    (yyyyMMddHHmmss), if that is given, and modified is null. _by is id, file or clock.
    """
    return notes.select("path", *_days(notes, as_of))


def _days(notes: DataFrame, as_of: str | None) -> list[Column]:
    """The columns of dates."""
    stamp = F.date_format("modified_at", "yyyy-MM-dd") if "modified_at" in notes.columns else F.lit(None).cast("string")
    clock = F.lit(None).cast("string") if as_of is None else F.lit(f"{as_of[:4]}-{as_of[4:6]}-{as_of[6:8]}")
    day = F.date_format(F.try_to_timestamp(F.substring("fm_id", 1, 8), F.lit("yyyyMMdd")), "yyyy-MM-dd")
    by_id = F.when(F.col("fm_id").rlike("^[0-9]{14}$") & ~F.col("fm_id").startswith("0000"), day)
    created, kind = F.coalesce(stamp, clock), F.when(stamp.isNotNull(), "file").when(clock.isNotNull(), "clock")
    return [
        created.alias("created"),
        stamp.alias("modified"),
        F.coalesce(by_id, created).alias("published"),
        kind.alias("created_by"),
        F.when(by_id.isNotNull(), "id").otherwise(kind).alias("published_by"),
    ]


def _text(value: Column) -> Column:
    """The text of a JSON value."""
    return F.get_json_object(F.concat(F.lit('{"v":'), value, F.lit("}")), "$.v")


def _prepared(notes: DataFrame) -> DataFrame:
    """Notes that were read (facts.read) with what the steps ask of them: texts map<string,string>, the lists, and the improvements of the analysis."""
    own = F.map_from_entries(F.filter(F.array(F.struct(F.lit("title").alias("k"), F.col("title").alias("v")), F.struct(F.lit("id").alias("k"), F.col("fm_id").alias("v"))), lambda x: x["v"].isNotNull()))
    kinds = dict(notes.dtypes)
    if "fields" in kinds:
        others = F.map_filter(F.col("fields"), lambda k, v: ~k.isin("title", "id", *LISTS))
        own = F.map_concat(own, F.transform_values(others, lambda k, v: _text(v)))
        kept = _text(F.col("fields")["category"])
        categories = F.when(kept.startswith("["), F.from_json(kept, "array<string>")).when(kept != "", F.array(kept))
        said = {name: _text(F.col("fields")[name]) for name in ("published", "description")}
        notes = notes.withColumns(said | {"category": F.coalesce(categories, _none())})
    elif "category" not in kinds:
        notes = notes.withColumn("category", _none())
    return checked(notes).withColumns({c: F.coalesce(c, _none()) for c in LISTS} | {"texts": own})


PROPOSAL = "struct<step:string,field:string,value:string,list:array<string>,confidence:double,rule:string>"
# Rules of a proposal: what is missing is filled in, a list is added to, or whatever is there is replaced.
FILL, ADD, REPLACE = "fill", "add", "replace"


def _proposal(step: str, field: str, value: Column, rule: str, confidence: Column | float | None = None) -> Column:
    """A value for a field (a list for LISTS); null is none."""
    sure = confidence if isinstance(confidence, Column) else F.lit(confidence).cast("double")
    text, listed = (F.lit(None).cast("string"), value) if field in LISTS else (value.cast("string"), F.lit(None).cast("array<string>"))
    made = F.struct(F.lit(step).alias("step"), F.lit(field).alias("field"), text.alias("value"), listed.alias("list"), sure.alias("confidence"), F.lit(rule).alias("rule"))
    return F.when(value.isNotNull(), made.cast(PROPOSAL))


def _missing(kind: str, name: str) -> Column:
    """Whether the analysis of the note as it came asks for a field surely enough."""
    return F.exists("improvements", lambda i: (i["improvement_type"] == kind) & (i["field_name"] == name) & (i["confidence"] >= SURE))


def _folded(texts: Column, lists: Column, proposals: Column) -> Column:
    """struct<texts, lists, log>: the proposals taken in one by one, each on the state that those before it left."""
    start = F.struct(texts.alias("texts"), lists.alias("lists"), F.array().cast(ENTRY).alias("log"))

    def step(state: Column, p: Column) -> Column:
        listed = p["list"].isNotNull()
        text, own = F.coalesce(F.try_element_at(state["texts"], p["field"]), F.lit("")), F.coalesce(F.try_element_at(state["lists"], p["field"]), _none())
        there = F.when(listed, F.size(own) > 0).otherwise(text != "")
        fresh = F.when(p["rule"] == ADD, F.array_except(p["list"], own)).otherwise(p["list"])
        goes = (p["rule"] == REPLACE) | F.when(p["rule"] == ADD, F.size(fresh) > 0).otherwise(~there)
        entry = F.array(F.struct(p["step"].alias("step"), p["field"].alias("field"), F.when(listed, F.array_join(fresh, ", ")).otherwise(p["value"]).alias("value"), p["confidence"].alias("confidence"), ((p["rule"] == REPLACE) & there).alias("overwrote")))
        rest = lambda m: F.map_filter(m, lambda k, _: k != p["field"])
        with_text = F.map_concat(rest(state["texts"]), F.create_map(p["field"], p["value"]))
        with_list = F.map_concat(rest(state["lists"]), F.create_map(p["field"], F.when(p["rule"] == ADD, F.concat(own, fresh)).otherwise(fresh)))
        taken = F.struct(F.when(listed, state["texts"]).otherwise(with_text).alias("texts"), F.when(listed, with_list).otherwise(state["lists"]).alias("lists"), F.concat(state["log"], entry).alias("log"))
        return F.when(goes, taken).otherwise(state)

    return F.aggregate(proposals, start, step)


def enhanced(notes: DataFrame, vault_tags: DataFrame | None = None, suggested: DataFrame | None = None, as_of: str | None = None, few: int = FEW) -> DataFrame:
    """(path, title, id, tags, aliases, category, description, fields, changes, log) of each note after all steps.

    In order: 1 tags of keywords, hashtags and the vault; 2 technical tags; 3 metadata of
    the content; 4 dates; 5 aliases in the other language; 6 what a service suggests, as
    (path, tags, aliases, description); 7 the improvements of the analysis that are sure
    enough, of which required fields replace what steps before have put in; 8 id; 9 title.
    Dates and ids without a source take as_of (yyyyMMddHHmmss), where it is given.
    """
    content, title = F.col("content"), F.coalesce("title", F.lit(""))
    table = None if vault_tags is None else _few_tags(vault_tags, few)
    state = _prepared(facts.read(notes, "checks", "names", "meta", "words", near=table))
    state = state.withColumns({"meta": F.struct(*stated(notes)), "days": F.struct(*_days(notes, as_of)[:3])})
    words, names, checks = F.col("facts.words"), F.col("facts.names"), F.col("facts.checks")
    tagged = F.array_union(F.coalesce(names["keyword_tags"], _none()), F.when(words.isNotNull(), words["hashtags"]).otherwise(hashtags(content)))
    if table is not None:
        tagged = F.array_union(tagged, F.when(words.isNotNull(), words["near"]).otherwise(F.coalesce(_looked_up(content, table), _none())))
    elif vault_tags is not None:
        state = state.join(near_tags(notes, vault_tags), "path", "left")
        tagged = F.array_union(tagged, F.coalesce("near", _none()))
    others = other_aliases(F.coalesce(names["other_names"], _none()), F.col("title"), F.col("aliases"))
    state = state.withColumns({"tagged": F.array_sort(tagged), "terms": F.coalesce(names["terms"], _none()), "others": others, "about": checks["description"], "kinds": F.coalesce(checks["categories"], _none()), "sure": checks})
    asked = lambda name: _missing("missing_required_field", name)
    stamp = F.coalesce(F.date_format("modified_at", "yyyy-MM-dd"), F.lit("")) if "modified_at" in state.columns else F.lit("")
    proposals = [_proposal("tags", "tags", F.col("tagged"), ADD), _proposal("technical", "tags", F.col("terms"), ADD)]
    proposals += [_proposal("metadata", n, F.col("meta")[n], FILL) for n in METADATA_FIELDS]
    proposals += [_proposal("dates", n, F.col("days")[n], FILL) for n in ("created", "modified", "published")]
    proposals.append(_proposal("aliases", "aliases", F.col("others"), ADD))
    if suggested is not None:
        state = state.join(suggested.select("path", F.struct("tags", "aliases", "description").alias("said")), "path", "left")
        proposals += [_proposal("suggested", n, F.col("said")[n], ADD) for n in ("tags", "aliases")]
        proposals.append(_proposal("suggested", "description", F.when(F.col("said.description") != "", F.col("said.description")), FILL))
    required = {"title": F.lit(""), "id": F.lit(""), "published": stamp, "description": F.coalesce("about", F.lit("")), "aliases": F.when(title != "", F.array(title)).otherwise(_none()), "tags": _none(), "category": F.col("kinds")}
    proposals += [_proposal("required", n, F.when(asked(n), v), REPLACE, 0.9) for n, v in required.items()]
    proposals += [
        _proposal("content", "tags", F.when(_missing("missing_tags", "tags"), F.col("sure.tags")), ADD, F.col("sure.confidence")),
        _proposal("content", "description", F.when(_missing("missing_description", "description"), F.col("about")), FILL, 0.7),
        _proposal("content", "category", F.when(_missing("missing_category", "category"), F.col("kinds")), FILL, 0.7),
        _proposal("id", "id", F.coalesce("file_id", F.lit(as_of).cast("string")), FILL),
        _proposal("title", "title", F.when(F.col("stem").rlike("^[0-9]{14}$"), F.concat(F.lit("Note "), F.substring("stem", 1, 8))).otherwise(F.col("stem")), FILL),
    ]
    lists = F.create_map(*[x for c in LISTS for x in (F.lit(c), F.col(c))])
    done = state.select("path", F.col("texts"), lists.alias("lists"), F.array_compact(F.array(*proposals)).alias("proposals"))
    done = done.select("path", _folded(F.col("texts"), F.col("lists"), F.col("proposals")).alias("s"))
    labels = F.create_map(*[F.lit(x) for pair in LABELS.items() for x in pair])
    changes = F.transform("s.log", lambda e: F.concat(F.lit("Added "), labels[e["step"]], e["field"], F.lit(": "), e["value"]))
    text, listed = (lambda n: F.col("s.texts")[n].alias(n)), (lambda n: F.col("s.lists")[n].alias(n))
    return done.select("path", text("title"), text("id"), *[listed(n) for n in LISTS], text("description"), F.col("s.texts").alias("fields"), changes.alias("changes"), F.col("s.log").alias("log"))


def summary(enhanced: DataFrame) -> DataFrame:
    """(step, field, notes, replaced): how many notes each step changed in each field, and in how many it replaced a value.

    From a plain explode Spark would infer a filter for which it makes the whole log twice.
    """
    each = enhanced.select(F.explode_outer("log").alias("e")).where("e IS NOT NULL").select("e.step", "e.field", "e.overwrote")
    return each.groupBy("step", "field").agg(F.count("*").alias("notes"), F.count_if("overwrote").alias("replaced"))


def written_fields(enhanced: DataFrame) -> DataFrame:
    """(path, fields map<string,string> of JSON): the enhanced front matter as templates and sinks write it."""
    quoted = F.transform_values(F.col("fields"), lambda k, v: F.to_json(F.struct(v.alias("v"))))
    texts = F.transform_values(quoted, lambda k, v: F.regexp_extract(v, r'(?s)^\{"v":(.*)\}$', 1))
    lists = F.map_from_arrays(F.array(*[F.lit(c) for c in LISTS]), F.array(*[F.to_json(F.col(c)) for c in LISTS]))
    return enhanced.select("path", F.map_concat(texts, lists).alias("fields"))
