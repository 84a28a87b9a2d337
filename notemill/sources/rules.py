"""Word rules as files and tables: spellings, names in the other language, keywords of one's own.

A file (YAML) is small and is read and written on the driver. What it says becomes tables
that meet the notes when a query runs, so a changed file changes the result without a
change of code.
"""

from __future__ import annotations

import os
import shutil
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.functions.dictionaries import CONSONANTS, LONG_VOWELS, PAIRS

# The sections of a file.
SPELLINGS, NAMES, OWN = ("long_vowel_patterns", "consonant_patterns"), "english_japanese_pairs", "user_defined_keywords"


def defaults() -> dict[str, Any]:
    """What holds without a file."""
    made = {section: {rule: list(others) for rule, others in table} for section, table in zip(SPELLINGS, (LONG_VOWELS, CONSONANTS), strict=True)}
    return made | {NAMES: {term: {"japanese": list(names)} for term, names in PAIRS}}


def load(path: str | None = None) -> dict[str, Any]:
    """The sections of a file, else the defaults; a file that holds no sections is an error."""
    import yaml

    if path is None or not os.path.isfile(path):
        return defaults()
    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    if not isinstance(data, dict):
        raise ValueError(f"{path} holds no rules")
    return data


def _store(data: dict[str, Any], path: str) -> None:
    import yaml

    with open(f"{path}.part", "w", encoding="utf-8") as f:
        yaml.safe_dump(data, f, allow_unicode=True, default_flow_style=False, sort_keys=False)
    os.replace(f"{path}.part", path)


def add(path: str, section: str, original: str, others: list[str]) -> None:
    """Puts a rule into a section of a file; what the section had for the original goes."""
    data = load(path)
    section_of = data.get(section) or {}
    section_of[original] = others
    _store(data | {section: section_of}, path)


def add_keywords(path: str, words: list[str], category: str = "custom") -> None:
    """Puts words into a category of one's own, each once."""
    data = load(path)
    own = data.get(OWN) or {}
    own[category] = list(dict.fromkeys([*(own.get(category) or ()), *words]))
    _store(data | {OWN: own}, path)


def export(path: str, to: str) -> bool:
    """Copies a file of rules; False if there is none."""
    if not os.path.isfile(path):
        return False
    shutil.copy2(path, to)
    return True


def take(other: str, path: str) -> bool:
    """Puts another file in a file's place if it holds rules."""
    try:
        if not os.path.isfile(other):
            return False
        load(other)
    except ValueError:
        return False
    shutil.copy2(other, path)
    return True


def spellings(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(written, other): the rules of spelling, in order."""
    data = load(path)
    rows = [(i, rule, other) for i, (rule, other) in enumerate((r, o) for s in SPELLINGS for r, others in (data.get(s) or {}).items() for o in others)]
    return spark.createDataFrame(rows, "place int, written string, other string")


def names(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(term, name): the names in Japanese of English terms, in order."""
    said = load(path).get(NAMES) or {}
    rows = [(i, term, name) for i, (term, name) in enumerate((t, n) for t, d in said.items() for n in ((*d.get("japanese", ()), *d.get("aliases", ())) if isinstance(d, dict) else d))]
    return spark.createDataFrame(rows, "place int, term string, name string")


def keywords(spark: SparkSession, path: str | None = None) -> DataFrame:
    """(category, keyword): the words of one's own."""
    return spark.createDataFrame([(c, w) for c, words in (load(path).get(OWN) or {}).items() for w in words or ()], "category string, keyword string")


def spelled(texts: DataFrame, rules: DataFrame) -> DataFrame:
    """texts (text, ...) with spelled array<string>: the other spellings of each text, every rule applied alone.

    The rules are one row (as many as their file has), which meets every text.
    """
    table = rules.agg(F.array_sort(F.collect_list(F.struct("place", "written", "other"))).alias("rules"))
    fits = F.filter("rules", lambda r: F.contains(F.col("text"), r["written"]))
    made = F.array_distinct(F.transform(fits, lambda r: F.replace(F.col("text"), r["written"], r["other"])))
    return texts.crossJoin(F.broadcast(table)).withColumn("spelled", F.filter(made, lambda v: (v != F.col("text")) & (v != ""))).drop("rules")


def title_aliases(notes: DataFrame, spelling_rules: DataFrame, name_rules: DataFrame) -> DataFrame:
    """(path, aliases): other spellings of each title and its names in the other language, as the tables of rules say."""
    titled = notes.where("title IS NOT NULL").select("path", F.col("title").alias("text"), "aliases")
    english = name_rules.groupBy(F.upper("term").alias("key")).agg(F.collect_set("name").alias("found"))
    japanese = name_rules.select(F.col("name").alias("key"), F.explode(F.array(F.lower("term"), "term")).alias("f")).groupBy("key").agg(F.collect_set("f").alias("other"))
    joined = spelled(titled, spelling_rules).join(english, F.upper("text") == english["key"], "left").drop("key").join(japanese, F.col("text") == japanese["key"], "left").drop("key")
    none = F.array().cast("array<string>")
    found = F.array_distinct(F.concat("spelled", F.when(F.col("found").isNotNull(), F.col("found")).otherwise(F.coalesce("other", none))))
    return joined.select("path", F.array_sort(F.array_except(found, F.concat("aliases", F.array("text")))).alias("aliases"))
