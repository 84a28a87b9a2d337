"""Results as files: notes written back, with backups, and reports as JSON or CSV."""

from __future__ import annotations

import os
import shutil
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from notemill.session import cut


def backup_name(path: str, stamp: str) -> str:
    return f"{os.path.splitext(path)[0]}.backup_{stamp}.bak"


SAVED = "path string, status string, message string"


def saved(rows: DataFrame, stamp: str | None = None) -> DataFrame:
    """Writes rows (path, raw) to their files, each partition its own, and gives (path, status, message) of each.

    status is applied, skipped (the file has this text already, or there is none to write)
    or error, with what the system said; an error stops no other file. A file is written
    beside its place and moved there, and with a stamp its old text is kept as a backup,
    once; so a task that is run again finds its files whole and skips them. The files must
    be reachable from the executors. Rows are written when the result is read: read it once.
    """

    def one(path: str, raw: str | None) -> tuple[str, str | None]:
        if raw is None:
            return "skipped", "no text"
        if os.path.exists(path):
            with open(path, encoding="utf-8", newline="") as f:
                if f.read() == raw:
                    return "skipped", "unchanged"
            if stamp and not os.path.exists(backup_name(path, stamp)):
                shutil.copy2(path, backup_name(path, stamp))
        part = f"{path}.part{os.getpid()}"
        with open(part, "w", encoding="utf-8", newline="") as f:
            f.write(raw)
        os.replace(part, path)
        return "applied", None

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            done = []
            for path, raw in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                try:
                    done.append((path, *one(path, raw)))
                except (OSError, ValueError, TypeError) as e:
                    done.append((path, "error", f"{type(e).__name__}: {e}"))
            yield pa.RecordBatch.from_arrays([pa.array([d[i] for d in done], pa.string()) for i in range(3)], names=["path", "status", "message"])

    return rows.select("path", "raw").mapInArrow(write, SAVED)


def save_notes(rows: DataFrame, stamp: str | None = None) -> DataFrame:
    """saved(), done at once: the statuses are kept as a checkpoint and can be read again. Where files failed, the statuses say so."""
    return cut(saved(rows, stamp))


def save_totals(statuses: DataFrame) -> DataFrame:
    """(files, applied, skipped, errors, success_rate): how a run of writing went; the rate is of those that were to change."""
    n = {s: F.count_if(F.col("status") == s) for s in ("applied", "skipped", "error")}
    tried = n["applied"] + n["error"]
    return statuses.agg(F.count("*").alias("files"), n["applied"].alias("applied"), n["skipped"].alias("skipped"), n["error"].alias("errors"), F.when(tried > 0, n["applied"] / tried).otherwise(1.0).alias("success_rate"))


def restore(path: str, backup: str) -> None:
    """Puts a backup back; a missing one is an error."""
    if not os.path.exists(backup):
        raise FileNotFoundError(backup)
    shutil.copy2(backup, path)


def copy_vault(root: str, stamp: str) -> str:
    """A copy of a whole directory beside it."""
    return shutil.copytree(root, f"{root.rstrip('/')}_backup_{stamp}")


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_csv(df: DataFrame, path: str) -> None:
    """Lists are joined by '; '. An empty result writes nothing."""
    if df.isEmpty():
        return
    lists = [f.name for f in df.schema if isinstance(f.dataType, ArrayType)]
    df.withColumns({n: F.array_join(F.col(n).cast("array<string>"), "; ") for n in lists}).write.mode("overwrite").option("header", "true").csv(path)


def write_index(index: DataFrame, path: str) -> None:
    """A vector index as Parquet, dealt by document."""
    index.repartition("document_id").write.mode("overwrite").parquet(path)


def summary_files(summaries: DataFrame, folder: str, most: int) -> DataFrame:
    """(path, raw) of a Markdown file for each (path, summary), named after its note; saved() writes them."""
    name = F.substring_index("path", "/", -1)
    lines = ["# Summary of {n}", "", "**Source:** {p}", "**Generated:** notemill summarize", f"**Max Length:** {most} characters", "", "## Summary", "", "{s}", ""]
    parts = [F.lit(x) if "{" not in x else F.concat(F.lit(x.split("{")[0]), {"n": name, "p": F.col("path"), "s": F.col("summary")}[x.split("{")[1][0]]) for x in lines]
    return summaries.select(F.concat(F.lit(f"{folder.rstrip('/')}/"), F.regexp_replace(name, r"\.[^.]*$", ""), F.lit(".summary.md")).alias("path"), F.array_join(F.array(*parts), "\n").alias("raw"))


def write_report(totals: DataFrame, details: DataFrame, path: str) -> None:
    """A report as two folders of JSON: one row of totals, and a row a note."""
    write_json(totals, f"{path.rstrip('/')}/summary")
    write_json(details, f"{path.rstrip('/')}/details")
