"""Corpus statistics: files, front-matter fields, links, contents."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def file_statistics(notes: DataFrame) -> DataFrame:
    """(extension, total_files, with_frontmatter, with_id): one row an extension and one, extension null, for all."""
    counts = [F.count("*").alias("total_files"), F.count_if(F.size("present_keys") > 0).alias("with_frontmatter"), F.count_if(F.col("file_id").isNotNull()).alias("with_id")]
    return notes.rollup("ext").agg(*counts).withColumnRenamed("ext", "extension")


def field_distribution(notes: DataFrame, top: int | None = None) -> DataFrame:
    """(field, files): how many notes have each front-matter key; the most common first where top is given."""
    out = notes.select(F.explode("present_keys").alias("field")).groupBy("field").agg(F.count("*").alias("files"))
    return out if top is None else out.orderBy(F.col("files").desc(), "field").limit(top)


def link_statistics(links: DataFrame, notes: DataFrame) -> DataFrame:
    """(kind, total, files, average): average over all notes; kind null is the grand total."""
    n = notes.agg(F.count("*").alias("n"))
    out = links.rollup("kind").agg(F.count("*").alias("total"), F.count_distinct("path").alias("files"))
    return out.crossJoin(F.broadcast(n)).select("kind", "total", "files", (F.col("total") / F.greatest("n", F.lit(1))).alias("average"))


def content_statistics(notes: DataFrame) -> DataFrame:
    """(total_length, average_length, max_length, min_length), zeros for no notes."""
    n = F.length("content")
    zero = lambda c, name: F.coalesce(c, F.lit(0)).alias(name)
    return notes.agg(zero(F.sum(n), "total_length"), zero(F.avg(n), "average_length"), zero(F.max(n), "max_length"), zero(F.min(n), "min_length"))


def dead_link_totals(dead: DataFrame) -> DataFrame:
    """(link_type, dead, files): by type; null for all."""
    return dead.rollup("link_type").agg(F.count("*").alias("dead"), F.count_distinct("source_file").alias("files"))
