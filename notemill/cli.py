"""Command line over a directory of notes: python -m notemill.cli COMMAND VAULT [options]."""

from __future__ import annotations

import argparse
import json
import os
import sys
import time

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from notemill.operators import analysis, connections, enhancement, graph, links, mentions, repair, report, services, similarity, stats, tags, validation, vectors
from notemill.session import cut, local_session
from notemill.sources import frontmatter, index_store, sinks, templates, vault


def show(df: DataFrame, args: argparse.Namespace) -> None:
    """The result as a folder of JSON or CSV where --output is given, else on the console; the console's tables are cut at --limit."""
    if args.output:
        (sinks.write_csv if args.format == "csv" else sinks.write_json)(df, args.output)
    elif args.format == "json":
        print(json.dumps([json.loads(r) for r in df.toJSON().take(args.limit)], ensure_ascii=False, indent=2))
    else:
        df.show(args.limit, truncate=80)


def analyze(notes: DataFrame, args: argparse.Namespace) -> None:
    for df in (stats.file_statistics(notes), stats.field_distribution(notes, 10), stats.link_statistics(links.all_links(notes), notes), stats.content_statistics(notes)):
        show(df, args)


def written(rows: DataFrame, args: argparse.Namespace) -> None:
    """Writes rows (path, raw), where --execute says so, and shows how it went."""
    if args.execute:
        done = sinks.save_notes(rows, args.stamp)
        show(done.where("status <> 'skipped'"), args)
        show(sinks.save_totals(done), args)


def validate(notes: DataFrame, args: argparse.Namespace) -> None:
    """Against one template (--template FILE), or each note against the one of its folder and fields where the vault has templates, else the plain note's schema."""
    schemas = {"plain": validation.NOTE_SCHEMA}
    own = notes.where(~templates.in_templates(notes)).withColumn("template", F.lit("plain"))
    if args.template:
        schemas = {"plain": templates.single(args.template)}
        own = own.where(F.col("path") != os.path.abspath(args.template))
    elif found := templates.schemas(templates.scan(notes)):
        schemas, own = found, templates.assigned(notes)
    done = validation.by_template(own, validation.schema_rows(notes.sparkSession, schemas))
    show(done, args)
    show(validation.template_summary(done), args)
    for template, schema in schemas.items():
        written(repair.rewritten_files(own.where(F.col("template") == template), schema), args)


def dead_links(notes: DataFrame, args: argparse.Namespace) -> None:
    known = links.registry(notes)
    found = links.suggestions(links.dead_links(notes, known), known)
    show(links.selected(found, args.link_type, args.only_with_suggestions, args.sort_by), args)


def auto_link(notes: DataFrame, args: argparse.Namespace) -> None:
    found = mentions.candidates(notes, mentions.targets(notes), args.exclude_tables, args.exclude_content)
    chosen = mentions.capped(mentions.resolved(found), args.max_links)
    if args.target:
        chosen = chosen.where(F.col("path").isin(args.target))
    changed = mentions.rewritten(notes, chosen)
    show(changed.select("path", "applied"), args)
    show(mentions.alias_updates(chosen, notes), args)
    if args.execute:
        rows = changed.select("path", F.col("content").alias("new")).join(notes.select("path", "raw"), "path")
        written(rows.select("path", frontmatter.with_body(F.col("raw"), F.col("new")).alias("raw")), args)


def organize(notes: DataFrame, args: argparse.Namespace) -> None:
    done = analysis.improvements(notes)
    show(analysis.quality(done).orderBy("quality_score", "path"), args)
    show(analysis.categorised(done), args)
    better = enhancement.enhanced(notes, tags.frequencies(notes), as_of=args.stamp.replace("_", ""))
    show(better.select("path", "tags", "title", "changes"), args)
    show(enhancement.summary(better), args)
    if args.report:
        sinks.write_report(report.improvement_report(better), better.select("path", F.size("changes").alias("improvements"), "changes"), args.report)
    fresh = enhancement.written_fields(better).withColumnRenamed("fields", "new").join(notes.select("path", "raw"), "path")
    written(fresh.select("path", frontmatter.with_fields(F.col("raw"), F.col("new"), [f.name for f in validation.NOTE_SCHEMA]).alias("raw")), args)
    if args.detect_duplicates:
        show(similarity.merge_strategy(similarity.duplicates(notes, args.threshold)), args)


def maintain(notes: DataFrame, args: argparse.Namespace) -> None:
    counts = report.task_counts(notes, args.task, args.threshold)
    show(counts, args)
    show(report.health(counts), args)
    edges = graph.edges(notes)
    show(connections.suggestions(graph.orphans(notes, graph.degrees(notes, edges)), notes, edges), args)


def summarize(notes: DataFrame, args: argparse.Namespace) -> None:
    chosen = notes.where(F.col("path").isin(args.target)) if args.target else notes
    made = services.summarised(chosen, services.extractive_summariser(args.max_length))
    if args.markdown:
        os.makedirs(args.markdown, exist_ok=True)
        show(sinks.save_notes(sinks.summary_files(made, args.markdown, args.max_length)), args)
    else:
        show(made, args)


def index(notes: DataFrame, args: argparse.Namespace) -> None:
    made = services.embedded(notes)
    if args.output:
        spark = notes.sparkSession
        gone = index_store.load(spark, args.output).join(made, "document_id", "left_anti") if index_store.saved(spark, args.output) else None
        print(index_store.update(spark, args.output, made, len(services.hashing_embedder()(["text"])[0]), gone))
    else:
        show(vectors.statistics(made), args)


def ask(notes: DataFrame, args: argparse.Namespace) -> None:
    question = services.hashing_embedder()([args.question])[0]
    known = index_store.load(notes.sparkSession, args.index) if args.index else services.embedded(notes)
    hits = vectors.search(known, question, args.max_docs, args.threshold)
    if hits.isEmpty():
        print("No relevant documents.")
    else:
        show(vectors.retrieval_context(hits), args)


def tag_report(notes: DataFrame, args: argparse.Namespace) -> None:
    if args.search:
        for p in tags.search(args.search):
            print(f"{p[0]}/{p[2]}: {', '.join(p[3])}")
        return
    show(tags.frequencies(notes, 50), args)
    show(tags.related(tags.cooccurrence(notes), args.related), args)
    show(tags.suggestions(notes, least=args.threshold).orderBy("path", F.col("confidence").desc(), "pattern"), args)


COMMANDS = {
    "analyze": analyze,
    "validate-frontmatter": validate,
    "detect-dead-links": dead_links,
    "auto-link": auto_link,
    "organize": organize,
    "maintain": maintain,
    "summarize": summarize,
    "index": index,
    "ask": ask,
    "tags": tag_report,
}


def parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="notemill", description=__doc__)
    p.add_argument("command", choices=COMMANDS)
    p.add_argument("vault")
    p.add_argument("question", nargs="?", default="", help="for ask")
    p.add_argument("--include", action="append")
    p.add_argument("--exclude", action="append")
    p.add_argument("--format", choices=("console", "json", "csv"), default="console")
    p.add_argument("--output")
    p.add_argument("--limit", type=int, default=20)
    p.add_argument("--execute", action="store_true", help="write changes; without it nothing is changed")
    p.add_argument("--stamp", default=time.strftime("%Y%m%d_%H%M%S"), help="marks the backups")
    p.add_argument("--link-type", action="append")
    p.add_argument("--only-with-suggestions", action="store_true")
    p.add_argument("--sort-by", default="file")
    p.add_argument("--exclude-tables", action="store_true")
    p.add_argument("--exclude-content", action="append")
    p.add_argument("--max-links", type=int, default=50)
    p.add_argument("--target", action="append")
    p.add_argument("--template", help="a template file for validate-frontmatter")
    p.add_argument("--detect-duplicates", action="store_true")
    p.add_argument("--threshold", type=float)
    p.add_argument("--task", action="append")
    p.add_argument("--max-length", type=int, default=200)
    p.add_argument("--markdown", help="a folder for summaries as Markdown files")
    p.add_argument("--report", help="a folder for the report of organize")
    p.add_argument("--index", help="a saved index for ask")
    p.add_argument("--max-docs", type=int, default=5)
    p.add_argument("--search")
    p.add_argument("--related")
    return p


#: The threshold of each command where --threshold is not given.
THRESHOLDS = {"ask": 0.3, "tags": 0.3}


def main(argv: list[str] | None = None) -> int:
    args = parser().parse_args(argv)
    if args.threshold is None:
        args.threshold = THRESHOLDS.get(args.command, 0.7)
    links.checked_types(args.link_type)
    report.checked_tasks(args.task)
    # Commands read the notes several times; files are read and parsed once.
    notes = cut(vault.notes(local_session("*"), args.vault, args.include or vault.INCLUDE, args.exclude or vault.EXCLUDE))
    COMMANDS[args.command](notes, args)
    return 0


if __name__ == "__main__":
    sys.exit(main())
