"""The maintenance report: issues of each task and a health score."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators import analysis, graph, links, similarity

TASKS = ("organize", "duplicates", "orphans", "dead-links")


def checked_tasks(tasks: list[str] | None) -> list[str]:
    unknown = set(tasks or ()) - set(TASKS)
    if unknown:
        raise ValueError(f"unknown tasks: {sorted(unknown)}; there are {', '.join(TASKS)}")
    return [t for t in TASKS if t in (tasks or TASKS)]


def task_counts(notes: DataFrame, tasks: list[str] | None = None, threshold: float = 0.7) -> DataFrame:
    """(task, issues): one row for each task."""
    found = {
        "organize": lambda: analysis.improvements(notes).where(F.size("improvements") > 0),
        "duplicates": lambda: similarity.duplicates(notes, threshold),
        "orphans": lambda: graph.unlinked(notes),
        "dead-links": lambda: links.dead_links(notes),
    }
    rows = [found[t]().agg(F.count("*").alias("issues")).select(F.lit(t).alias("task"), "issues") for t in checked_tasks(tasks)]
    return reduce(DataFrame.unionByName, rows)


def health(counts: DataFrame, failed: int = 0) -> DataFrame:
    """(tasks, issues, health_score): the share of tasks done, less a hundredth for each issue and at most a half, of 100."""
    done = F.count("*")
    score = done / (done + failed) - F.least(F.coalesce(F.sum("issues"), F.lit(0)) * F.lit(0.01), F.lit(0.5))
    return counts.agg(done.alias("tasks"), F.coalesce(F.sum("issues"), F.lit(0)).alias("issues"), F.greatest(F.lit(0.0), score * 100).alias("health_score"))


def improved(enhanced: DataFrame) -> DataFrame:
    """(path, improvements, frontmatter, metadata, tags): how many changes each note got, and whether any names the area."""
    names = lambda word: F.exists("changes", lambda c: F.contains(F.lower(c), F.lit(word))).alias(word if word != "tag" else "tags")
    return enhanced.select("path", F.size("changes").alias("improvements"), names("frontmatter"), names("metadata"), names("tag"))


def improvement_report(enhanced: DataFrame) -> DataFrame:
    """(analysed, improved, improvements, with_frontmatter, with_metadata, with_tags): the totals of an organising run."""
    each = improved(enhanced)
    return each.agg(
        F.count("*").alias("analysed"),
        F.count_if(F.col("improvements") > 0).alias("improved"),
        F.coalesce(F.sum("improvements"), F.lit(0)).alias("improvements"),
        F.count_if("frontmatter").alias("with_frontmatter"),
        F.count_if("metadata").alias("with_metadata"),
        F.count_if("tags").alias("with_tags"),
    )


def high_priority(analysed: DataFrame, most: int = 10) -> DataFrame:
    """(path, improvements): the notes with most improvements, ties by path."""
    return analysed.select("path", F.size("improvements").alias("improvements")).where("improvements > 0").orderBy(F.col("improvements").desc(), "path").limit(most)


def link_summary(notes: DataFrame, candidates: DataFrame, chosen: DataFrame, aliases: DataFrame) -> DataFrame:
    """(files_processed, files_with_links_added, wikilink_updates, conflicts_resolved, candidates_skipped, files_with_aliases_added, alias_updates): the totals of an auto-link run, one row.

    candidates are those after conflicts, chosen the capped ones, aliases (file_id, new_aliases).
    """
    processed = notes.agg(F.count("*").alias("files_processed"))
    links = chosen.agg(F.count_distinct("path").alias("files_with_links_added"), F.count("*").alias("wikilink_updates"))
    conflicts = candidates.agg(F.coalesce(F.sum("conflicts"), F.lit(0)).alias("conflicts_resolved"), F.count("*").alias("_n"))
    fresh = aliases.agg(F.count("*").alias("files_with_aliases_added"), F.coalesce(F.sum(F.size("new_aliases")), F.lit(0)).alias("alias_updates"))
    every = processed.crossJoin(links).crossJoin(conflicts).crossJoin(fresh)  # one row each
    return every.withColumn("candidates_skipped", F.col("_n") - F.col("wikilink_updates")).drop("_n")


def indexing_summary(notes: DataFrame, index: DataFrame) -> DataFrame:
    """(total, indexed, skipped): notes, those with a vector in the index, and the others."""
    known = index.select(F.col("document_id").alias("key"), F.lit(True).alias("known")).distinct()
    met = notes.select(F.coalesce("file_id", "path").alias("key")).join(known, "key", "left")
    return met.agg(F.count("*").alias("total"), F.count("known").alias("indexed"), F.count_if(F.col("known").isNull()).alias("skipped"))


def task_details(notes: DataFrame, task: str, most: int = 20, threshold: float = 0.7) -> DataFrame:
    """The first few findings of a task, in a total order: the rows behind its count."""
    (name,) = checked_tasks([task])
    if name == "organize":
        return high_priority(analysis.improvements(notes), most)
    if name == "duplicates":
        return similarity.duplicates(notes, threshold).orderBy(F.col("confidence").desc(), "a", "b").limit(most)
    if name == "orphans":
        return graph.unlinked(notes).orderBy("path").limit(most)
    return links.selected(links.dead_links(notes), limit=most)
