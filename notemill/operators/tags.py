"""Tags: frequencies, co-occurrence, pattern suggestions, related tags."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from notemill.functions.dictionaries import CONSONANTS, LONG_VOWELS, TAG_PATTERNS


def note_tags(notes: DataFrame) -> DataFrame:
    """(path, tag): each note's tags once."""
    return notes.select("path", F.explode(F.array_distinct("tags")).alias("tag"))


def frequencies(notes: DataFrame, top: int | None = None) -> DataFrame:
    """(tag, files); the most frequent first where top is given."""
    out = note_tags(notes).groupBy("tag").agg(F.count("*").alias("files"))
    return out if top is None else out.orderBy(F.col("files").desc(), "tag").limit(top)


def cooccurrence(notes: DataFrame) -> DataFrame:
    """(tag, other, together, strength): strength = together / files of tag.

    Pairs are made within each note's row from its own few tags, so no join multiplies.
    """
    pair = F.flatten(F.transform("t", lambda a: F.transform(F.filter("t", lambda b: b != a), lambda b: F.struct(a.alias("tag"), b.alias("other")))))
    together = notes.select(F.array_distinct("tags").alias("t")).select(F.explode(pair).alias("p")).groupBy("p.tag", "p.other").agg(F.count("*").alias("together"))
    return together.join(frequencies(notes), "tag").select("tag", "other", "together", (F.col("together") / F.col("files")).alias("strength"))


def related(pairs: DataFrame, tag: str | None = None, least: float = 0.3) -> DataFrame:
    """(tag, other, strength) of at least so much, strongest first."""
    out = pairs.where(F.col("strength") >= least)
    if tag is not None:
        out = out.where(F.col("tag") == tag)
    return out.select("tag", "other", "strength").orderBy("tag", F.col("strength").desc(), "other")


def related_for_notes(notes: DataFrame, pairs: DataFrame, least: float = 0.3) -> DataFrame:
    """(path, other, strength): tags related to a note's own that it does not have."""
    have = note_tags(notes)
    found = have.join(pairs.where(F.col("strength") >= least), "tag").groupBy("path", "other").agg(F.max("strength").alias("strength"))
    return found.join(have.withColumnRenamed("tag", "other"), ["path", "other"], "left_anti")


def rare(notes: DataFrame) -> DataFrame:
    """(tag): tags of a single note."""
    return frequencies(notes).where("files = 1").select("tag")


def spelled(word: str) -> list[str]:
    """A word and its other spellings: each rule is applied alone to all its places."""
    found = {word}
    for rule, others in (*LONG_VOWELS, *CONSONANTS):
        found |= {word.replace(rule, o) for o in others if rule in word}
    return sorted(found)


def suggestions(notes: DataFrame, patterns: Sequence[tuple] = TAG_PATTERNS, least: float = 0.3) -> DataFrame:
    """(path, category, pattern, matched, confidence): keywords, in any spelling, that the text contains.

    The patterns are literals of the plan, so a text is read once and nothing is joined.
    """
    low = F.col("low")

    def one(category: str, _priority: int, name: str, keywords: Sequence[str], weight: float) -> Column:
        hits: Column = F.lit(0)
        for k in keywords:
            hits = hits + F.when(_any([low.contains(s.lower()) for s in spelled(k)]), 1).otherwise(0)
        return F.struct(F.lit(category).alias("category"), F.lit(name).alias("pattern"), hits.alias("matched"), F.least(F.lit(0.95), hits * F.lit(0.2) * F.lit(weight)).alias("confidence"))

    lowered = notes.select("path", F.lower("content").alias("low"))
    found = lowered.select("path", F.explode(F.array(*[one(*p) for p in patterns])).alias("s")).select("path", "s.*")
    return found.where(F.col("confidence") > least)


def _any(conditions: list[Column]) -> Column:
    out = conditions[0]
    for c in conditions[1:]:
        out = out | c
    return out


def search(query: str, patterns: Sequence[tuple] = TAG_PATTERNS) -> list[tuple]:
    """Patterns whose name or a keyword holds the query."""
    q = query.lower()
    return [p for p in patterns if q in p[2].lower() or any(q in k.lower() for k in p[3])]


def add_pattern(patterns: Sequence[tuple], category: str, name: str, keywords: Sequence[str], weight: float = 1.0, priority: int = 5) -> tuple[tuple, ...]:
    """A catalogue with one more pattern; (category, name) must be new and the weight between 0 and 2."""
    if not 0 <= weight <= 2 or not keywords:
        raise ValueError("a pattern needs keywords and a weight between 0 and 2")
    if any(p[:1] + p[2:3] == (category, name) for p in patterns):
        raise ValueError(f"{category}/{name} is there already")
    return (*patterns, (category, priority, name, tuple(keywords), weight))


def remove_pattern(patterns: Sequence[tuple], category: str, name: str) -> tuple[tuple, ...]:
    return tuple(p for p in patterns if (p[0], p[2]) != (category, name))


def update_pattern(patterns: Sequence[tuple], category: str, name: str, keywords: Sequence[str] | None = None, weight: float | None = None) -> tuple[tuple, ...]:
    """The catalogue with other keywords or another weight for a pattern that it has; an unknown one is an error."""
    if not any((p[0], p[2]) == (category, name) for p in patterns):
        raise ValueError(f"{category}/{name} is unknown")
    if keywords is not None and not keywords or weight is not None and not 0 <= weight <= 2:
        raise ValueError("a pattern needs keywords and a weight between 0 and 2")
    changed = lambda p: (p[0], p[1], p[2], tuple(p[3] if keywords is None else keywords), p[4] if weight is None else weight)
    return tuple(changed(p) if (p[0], p[2]) == (category, name) else p for p in patterns)


def listed(patterns: Sequence[tuple] = TAG_PATTERNS, category: str | None = None) -> list[tuple]:
    """The patterns, of one category where it is named, those of the highest priority first."""
    return sorted((p for p in patterns if category is None or p[0] == category), key=lambda p: -p[1])


def merged(patterns: Sequence[tuple], others: Sequence[tuple]) -> tuple[tuple, ...]:
    """Both catalogues; where both have a category and name the other one's pattern counts, and a category keeps its priority."""
    known = {p[0]: p[1] for p in patterns}
    found = {(p[0], p[2]): p for p in patterns}
    for category, priority, name, keywords, weight in others:
        found[category, name] = (category, known.setdefault(category, priority), name, tuple(keywords), weight)
    return tuple(found.values())


def as_json(patterns: Sequence[tuple] = TAG_PATTERNS) -> str:
    """A catalogue as JSON: counts, and the patterns of each category."""
    categories: dict[str, dict] = {}
    for category, priority, name, keywords, weight in patterns:
        categories.setdefault(category, {"priority": priority, "patterns": []})["patterns"].append({"tag": name, "keywords": list(keywords), "confidence_weight": weight})
    return json.dumps({"metadata": {"total_categories": len(categories), "total_patterns": len(patterns)}, "categories": categories}, ensure_ascii=False, indent=2)


def from_json(text: str) -> tuple[tuple, ...]:
    """A catalogue from JSON as as_json writes it; a priority that is missing is 5, a weight 1."""
    return tuple((c, d.get("priority", 5), p["tag"], tuple(p["keywords"]), float(p.get("confidence_weight", 1.0))) for c, d in json.loads(text)["categories"].items() for p in d.get("patterns", ()))


def with_status(suggested: DataFrame, notes: DataFrame, least: float = 0.3) -> DataFrame:
    """suggested (path, pattern, confidence, ...) of at least so much, with status: Current where the note has the tag, else New."""
    have = notes.select("path", "tags")
    status = F.when(F.array_contains("tags", F.col("pattern")), "Current").otherwise("New")
    return suggested.where(F.col("confidence") >= least).join(have, "path").withColumn("status", status).drop("tags")


def vault_statistics(notes: DataFrame) -> DataFrame:
    """(notes, tagged, tags, uses, single): how many notes, how many with tags, different tags, uses of tags, and tags of a single note."""
    counted = notes.agg(F.count("*").alias("notes"), F.count_if(F.size("tags") > 0).alias("tagged"))
    of_tags = frequencies(notes).agg(F.count("*").alias("tags"), F.coalesce(F.sum("files"), F.lit(0)).alias("uses"), F.count_if(F.col("files") == 1).alias("single"))
    return counted.crossJoin(of_tags)  # one row each
