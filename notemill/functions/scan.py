"""Lines, zones, links and mentions of notes, for Arrow batches: each note is cut into lines once.

The same rules as the column expressions in operators/links, zones and mentions, whose lambdas Spark
interprets for every line. A note's texts are looked for here only where note and text are ASCII; what
letters beyond it equal each other without regard to case is left to those expressions.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import pyarrow as pa

from notemill.functions.text import BLANKS

Span = tuple[int, int, str]


def compiled(pattern: str) -> re.Pattern:
    r"""A pattern of this package with Java's meaning: \s is ASCII white space, and a dot ends at any line terminator."""
    return re.compile(pattern.replace(".*?", "[^\n\r\x85\u2028\u2029]*?"), re.ASCII)


def states(content: str, lines: list[str]) -> list[str]:
    """fenced, unclosed, front, open or plain for each line, see zones.fenced_lines."""
    n = len(lines)
    if "```" not in content and "---" not in content:
        return ["plain"] * n
    fence = [x.strip(BLANKS).startswith("```") for x in lines]
    front = -1
    if lines[0].strip(BLANKS) == "---":
        front = next((i for i in range(1, n) if lines[i].strip(BLANKS) == "---"), n)
    total, before, out = sum(fence), 0, []
    for i in range(n):
        if before % 2 or fence[i]:
            out.append("fenced" if total > before + (before + 1) % 2 else "unclosed")
        else:
            out.append("front" if i <= front < n else "open" if front >= n else "plain")
        before += fence[i]
    return out


def spans(line: str, state: str, tables: bool, kinds: list[tuple[str, str, re.Pattern]]) -> list[Span]:
    """The zones of a line in its state; kinds are (zone type, a text that every hit holds, pattern)."""
    if state != "plain":
        kind = {"fenced": "code_block", "front": "frontmatter"}.get(state)
        return [(0, len(line), kind)] if kind else []
    bare = line.strip(BLANKS)
    out = [(0, len(line), "heading")] if bare.startswith("# ") else []
    if tables and bare.startswith("|") and bare.endswith("|"):
        out.append((0, len(line), "table"))
    for kind, sign, pattern in kinds:
        if sign in line:
            out += [(*m.span(), kind) for m in pattern.finditer(line)]
    return out


def mask(spans: list[Span]) -> bytearray:
    """1 for each place that a span covers, up to the last span's end: the work grows with the number and length of the spans."""
    out, reached = bytearray(max((end for _, end, _ in spans), default=0)), 0
    for start, end, _ in sorted(spans):
        if end > reached:
            out[max(start, reached) : end] = b"\x01" * (end - max(start, reached))
            reached = end
    return out


def rows(batch: pa.RecordBatch, found: Callable[[str], Iterator[tuple]], carried: list[str], schema: pa.Schema) -> pa.RecordBatch:
    """The rows that found gives for each content that is not null, behind the carried columns of its note."""
    at, out = [], []
    for i, content in enumerate(batch.column("content").to_pylist()):
        if content is not None:
            for row in found(content):
                at.append(i)
                out.append(row)
    take = pa.array(at, pa.int64())
    made = zip(*out, strict=True) if out else [()] * (len(schema) - len(carried))
    return pa.RecordBatch.from_arrays([*(batch.column(c).take(take) for c in carried), *(pa.array(v, f.type) for v, f in zip(made, list(schema)[len(carried) :], strict=True))], names=schema.names)


def in_parts(batches: Iterator[pa.RecordBatch], size: int = 1024) -> Iterator[pa.RecordBatch]:
    """Small batches, so that the rows made from one stay few."""
    for batch in batches:
        for at in range(0, batch.num_rows, size):
            yield batch.slice(at, size)
