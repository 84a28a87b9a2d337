"""Pluggable text services: embedding, summaries and metadata as Arrow batches over a callable.

A service is a function from a list of texts to a list of results, so a model can work in
batches. The defaults need no network: a hashing embedder and an extractive summariser.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, FloatType, StringType

DIMENSION = 384
Embedder = Callable[[list[str]], list[list[float]]]
Writer = Callable[[list[str]], list[str]]


def hashing_embedder(dimension: int = DIMENSION) -> Embedder:
    """Words vote on signed components by their hash; vectors have length 1, a blank text is an error."""

    def embed(texts: list[str]) -> list[list[float]]:
        out = []
        for text in texts:
            if not text.strip():
                raise ValueError("nothing to embed")
            v = [0.0] * dimension
            for w in re.findall(r"\w+", text.lower()):
                h = int.from_bytes(hashlib.blake2b(w.encode(), digest_size=8).digest(), "little")
                v[h % dimension] += 1.0 if h >> 63 else -1.0
            n = math.sqrt(sum(x * x for x in v)) or 1.0
            out.append([x / n for x in v])
        return out

    return embed


def cut(text: str, length: int) -> str:
    """At most so many characters: up to the last full stop if it is past the half, else with an ellipsis."""
    if len(text) <= length:
        return text
    short = text[:length]
    stop = short.rfind(".")
    return short[: stop + 1] if stop > length // 2 else f"{short}..."


def extractive_summariser(length: int = 200, read: int = 3000) -> Writer:
    """The beginning of the prose among the first characters."""
    return lambda texts: [cut(" ".join(line for t in [t[:read]] for line in t.split("\n") if line.strip() and not line.startswith("#")), length) for t in texts]


def embedding_text(title: Column, tags: Column, content: Column, most: int = 3000) -> Column:
    """Title, tags and the body up to so many characters, with blank lines between."""
    body = F.when(F.length(content) > most, F.concat(F.substring(content, 1, most), F.lit("..."))).otherwise(content)
    return F.concat_ws("\n\n", F.when(title != "", F.concat(F.lit("Title: "), title)), F.when(F.size(tags) > 0, F.concat(F.lit("Tags: "), F.array_join(tags, ", "))), F.when(F.trim(body) != "", body))


def mapped(column: Column, service: Callable[[list[str]], list], kind) -> Column:
    """The service's results for a text column, batch by batch; null stays null."""

    @F.pandas_udf(kind)
    def run(batches: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for texts in batches:
            there = texts.notna()
            out = pd.Series([None] * len(texts), dtype=object)
            if there.any():
                out[there.to_numpy()] = pd.Series(service(texts[there].tolist()), dtype=object).to_numpy()
            yield out

    return run(column)


def embedded(notes: DataFrame, embedder: Embedder | None = None) -> DataFrame:
    """(document_id, vector, metadata, ordinal) of notes with a text; ordinal is the hash of the path, so any order is the same."""
    text = embedding_text(F.coalesce("title", F.lit("")), F.col("tags"), F.col("content"))
    rows = notes.where(F.trim("content") != "").select(F.coalesce("file_id", "path").alias("document_id"), text.alias("t"), F.create_map(F.lit("path"), "path", F.lit("title"), "title", F.lit("tags"), F.array_join("tags", ", ")).alias("metadata"), F.xxhash64("path").alias("ordinal"))
    return rows.select("document_id", mapped(F.col("t"), embedder or hashing_embedder(), ArrayType(FloatType())).cast("array<double>").alias("vector"), "metadata", "ordinal")


def summarised(notes: DataFrame, writer: Writer | None = None) -> DataFrame:
    """(path, summary)."""
    return notes.select("path", mapped(F.col("content"), writer or extractive_summariser(), StringType()).alias("summary"))


def sections(answer: Column, names: list[str], by_line: bool = False) -> Column:
    """struct of what stands behind each NAME: of a service's answer, up to the next one; by_line: up to the next line that begins with any."""
    ends = r"\n[A-Z_]+:" if by_line else "|".join(f"{n}:" for n in names)
    return F.struct(*[F.trim(F.regexp_extract(answer, rf"(?is){n}:\s*(.*?)\s*(?=(?-i:{ends})|\z)", 1)).alias(n.lower()) for n in names])


def listed(section: Column) -> Column:
    """A section's items, cut at commas, without blanks."""
    return F.filter(F.transform(F.split(section, ","), lambda x: F.trim(x)), lambda x: x != "")


def concept_confidence(concept: Column, content: Column, stands: float = 0.3) -> Column:
    """0.5, and more for a concept that stands in the text (0.1 in the other dialect), is longer than ten characters, or looks technical; at most 1."""
    more = lambda there, x: F.when(there, x).otherwise(0.0)
    technical = concept.rlike(r"\p{Lu}") | F.contains(concept, F.lit("_")) | F.contains(concept, F.lit("-"))
    return F.least(F.lit(1.0), F.lit(0.5) + more(F.contains(F.lower(content), F.lower(concept)), stands) + more(F.length(concept) > 10, 0.1) + more(technical, 0.1))


def concepts(notes: DataFrame, writer: Writer, most: int = 5, read: int = 2000) -> DataFrame:
    """(path, concept, confidence): up to so many concepts of each note, from a service that answers CONCEPTS: a, b."""
    text = F.substring("content", 1, read)
    asked = notes.select("path", "content", mapped(text, writer, StringType()).alias("answer"))
    found = asked.select("path", "content", F.explode(F.slice(listed(sections(F.col("answer"), ["CONCEPTS"], True)["concepts"]), 1, most)).alias("concept"))
    return found.select("path", "concept", concept_confidence(F.col("concept"), F.col("content")).alias("confidence"))


def suggested_metadata(notes: DataFrame, writer: Writer, read: int = 2000) -> DataFrame:
    """(path, tags, aliases, description) from a service that answers TAGS:, ALIASES: and DESCRIPTION: lines."""
    s = sections(F.col("answer"), ["TAGS", "ALIASES", "DESCRIPTION"], True)
    asked = notes.select("path", mapped(F.substring("content", 1, read), writer, StringType()).alias("answer")).select("path", s.alias("s"))
    return asked.select("path", listed(F.col("s.tags")).alias("tags"), listed(F.col("s.aliases")).alias("aliases"), F.when(F.col("s.description") != "", F.col("s.description")).alias("description"))


def _score(answer: Column, name: str) -> Column:
    """A section as a number between 0 and 1; what is no number is 0.5."""
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.coalesce(sections(answer, [name], True)[name.lower()].try_cast("double"), F.lit(0.5))))


def relationships(pairs: DataFrame, writer: Writer, read: int = 1500) -> DataFrame:
    """pairs (a, b, text_a, text_b) to (a, b, relationship, confidence): what a service says two texts are to each other."""
    asked = F.concat(F.lit("FIRST: "), F.substring("text_a", 1, read), F.lit("\nSECOND: "), F.substring("text_b", 1, read))
    answer = pairs.select("a", "b", mapped(asked, writer, StringType()).alias("answer"))
    return answer.select("a", "b", sections(F.col("answer"), ["RELATIONSHIP"], True)["relationship"].alias("relationship"), _score(F.col("answer"), "CONFIDENCE").alias("confidence"))


def context_matches(pairs: DataFrame, writer: Writer, read: int = 800) -> DataFrame:
    """pairs (a, b, text_a, text_b) to (a, b, score): how well a link's surroundings fit its target."""
    asked = F.concat(F.lit("CONTEXT: "), F.substring("text_a", 1, read), F.lit("\nTARGET: "), F.substring("text_b", 1, read))
    answer = pairs.select("a", "b", mapped(asked, writer, StringType()).alias("answer"))
    return answer.select("a", "b", _score(F.col("answer"), "SCORE").alias("score"))


def disambiguated(choices: DataFrame, writer: Writer, read: int = 500) -> DataFrame:
    """choices (key, text, target_id, target_text) to (key, target_id, score, rank): the targets of each key, the best first, ties by id."""
    scored = context_matches(choices.select(F.col("key").alias("a"), F.col("target_id").alias("b"), F.col("text").alias("text_a"), F.col("target_text").alias("text_b")), writer, read)
    rank = F.row_number().over(Window.partitionBy("a").orderBy(F.col("score").desc(), "b"))
    return scored.select(F.col("a").alias("key"), F.col("b").alias("target_id"), "score", rank.alias("rank"))


def agreement(score: Column, dimension: int) -> Column:
    """How far a similarity can be trusted: mostly itself, a little the dimension."""
    return F.least(F.lit(1.0), F.abs(score) * 0.8 + F.lit(0.2 * min(1.0, dimension / 1000)))
