"""The link graph: edges, degrees, the two orphan rules."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators.links import all_links, line_links


def edges(notes: DataFrame) -> DataFrame:
    """(src, dst): wiki links between notes with front-matter ids; loops and parallel links stay."""
    ids = notes.where("fm_id IS NOT NULL")
    known = ids.select(F.col("fm_id").alias("dst")).distinct()
    return all_links(ids, ["wikilink"], "fm_id").select(F.col("fm_id").alias("src"), F.col("target").alias("dst")).join(known, "dst", "left_semi").select("src", "dst")


def degrees(notes: DataFrame, edges: DataFrame) -> DataFrame:
    """(fm_id, incoming, outgoing) of every note with a front-matter id."""
    end = lambda c, i, o: F.struct(F.col(c).alias("fm_id"), F.lit(i).alias("i"), F.lit(o).alias("o"))
    each = edges.select(F.explode(F.array(end("src", 0, 1), end("dst", 1, 0))).alias("e")).select("e.*")
    counted = each.groupBy("fm_id").agg(F.sum("i").alias("incoming"), F.sum("o").alias("outgoing"))
    ids = notes.where("fm_id IS NOT NULL").select("fm_id").distinct()
    zero = lambda c: F.coalesce(c, F.lit(0).cast("long")).alias(c)
    return ids.join(counted, "fm_id", "left").select("fm_id", zero("incoming"), zero("outgoing"))


def isolation(degree, notes):
    """1 for no link, else 1 - min(1, degree / max(2, a twentieth of the notes))."""
    return F.when(degree == 0, F.lit(1.0)).otherwise(1 - F.least(F.lit(1.0), degree / F.greatest(F.lit(2.0), notes * F.lit(0.05))))


def orphans(notes: DataFrame, degrees: DataFrame) -> DataFrame:
    """(fm_id, incoming, outgoing, isolation): notes with no link, or with one and isolation of 0.7 or more."""
    n = notes.agg(F.count("*").cast("double").alias("n"))
    degree = F.col("incoming") + F.col("outgoing")
    out = degrees.crossJoin(F.broadcast(n)).select("fm_id", "incoming", "outgoing", isolation(degree, F.col("n")).alias("isolation"))
    return out.where((degree == 0) | ((degree <= 1) & (F.col("isolation") >= 0.7)))


def most_isolated(orphans: DataFrame) -> DataFrame:
    """The orphans in order, the most isolated first."""
    return orphans.orderBy(F.col("isolation").desc(), "fm_id")


def unlinked(notes: DataFrame, wikilinks: DataFrame | None = None, regular: DataFrame | None = None) -> DataFrame:
    """(path, file_id): the maintenance rule; no wiki or regular link out, and no wiki link in from another note.

    Without tables of links those of the notes count; whether a note has any is told within its row.
    """
    rest = notes.where("file_id IS NOT NULL")
    if wikilinks is None or regular is None:
        wikilinks = all_links(notes, ["wikilink"])
        linked = lambda x: F.contains(x, F.lit("[")) & (F.size(line_links(x, ["wikilink", "regular_link"])) > 0)
        rest = rest.where(~F.coalesce(F.exists(F.split("content", "\n", -1), linked), F.lit(False))).select("path", "file_id")
    else:
        out = wikilinks.select("path").unionByName(regular.select("path")).distinct()
        rest = rest.select("path", "file_id").join(out, "path", "left_anti")
    # Of the notes that link to a target two are enough: another one than the note itself is the first or the last.
    into = wikilinks.groupBy(F.col("target").alias("file_id")).agg(F.min("path").alias("first"), F.max("path").alias("last"))
    alone = F.col("first").isNull() | ((F.col("first") == F.col("path")) & (F.col("last") == F.col("path")))
    return rest.join(into, "file_id", "left").where(alone).select("path", "file_id")
