"""A directory of Markdown files as notes, read by Spark's file source."""

from __future__ import annotations

import fnmatch
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.session import ship
from notemill.sources import frontmatter

INCLUDE = ("**/*.md",)
EXCLUDE = ("**/.obsidian/**", "**/node_modules/**", "**/.git/**")


def matches(relative: Column, pattern: str) -> Column:
    """Whether a relative path fits a pattern: **/x/** is any directory or file called x, else a glob whose * crosses slashes."""
    middle = pattern[3:-3]
    if pattern.startswith("**/") and pattern.endswith("/**") and "/" not in middle:
        return F.array_contains(F.split(relative, "/"), middle)
    glob = fnmatch.translate(pattern[3:] if pattern.startswith("**/") else pattern)
    java = glob.replace(r"\Z", r"\z").replace("(?>", "(?:")
    return relative.rlike(f"^(?:.*/)?{java}" if pattern.startswith("**/") else f"^{java}")


def files(spark: SparkSession, root: str, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    """(path, raw, modified_at): the Markdown files below a directory. Names are tested before contents are read."""
    ship(spark)
    listed = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    path = F.regexp_replace(F.col("path"), "^file:/+", "/")
    base = root.rstrip("/")
    relative = F.substring(path, len(base) + 2, 10_000)
    wanted = F.lower(path).endswith(".md")
    kept = F.lit(False)
    for p in include:
        kept = kept | matches(relative, p)
    for p in exclude:
        kept = kept & ~matches(relative, p)
    return listed.where(wanted & kept).select(path.alias("path"), F.col("content").cast("string").alias("raw"), F.col("modificationTime").alias("modified_at")).dropDuplicates(["path"])


def notes(spark: SparkSession, root: str, include: Sequence[str] = INCLUDE, exclude: Sequence[str] = EXCLUDE) -> DataFrame:
    return frontmatter.as_notes(frontmatter.parsed(files(spark, root, include, exclude)))
