"""Text expressions shared by the operators. All are built-in functions, no UDF."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Numbers that are added up at a time by sums_before.
RUN = 256
#: Hits of a line whose places are summed up one by one; for so few that is faster than runs.
FEW = 16
#: What (?U)\\s matches: white space of any script.
BLANKS = "\t\n\x0b\x0c\r \x85\xa0\u1680" + "".join(map(chr, range(0x2000, 0x200B))) + "\u2028\u2029\u202f\u205f\u3000"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value) with value computed once for each row, however often body uses it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def strip(x: Column) -> Column:
    """Both ends without white space of any script, as str.strip; a text whose first and last character are none is left at that."""
    firm = lambda c: ~F.contains(F.lit(BLANKS), c)
    return F.when(firm(F.substring(x, 1, 1)) & firm(F.substring(x, -1, 1)), x).otherwise(_ends_cut(x))


def _ends_cut(x: Column) -> Column:
    return F.regexp_replace(x, r"(?U)^\s+|\s+$", "")


def literal(x: str) -> str:
    """A string as SQL writes it."""
    return "'" + x.replace("\\", "\\\\").replace("'", "\\'") + "'"


def worded(body: str, **columns: Column) -> Column:
    """An expression in SQL over columns by name.

    Deep expressions are written in SQL: in Python each of their parts is a call to the JVM,
    and building them takes longer than running them on a small table.
    """
    fields = F.struct(*[c.alias(n) for n, c in columns.items()])
    return F.get(F.call_function("transform", F.array(fields), F.expr(f"it -> {body}")), F.lit(0))


def _bound(name: str, value: str, body: str) -> str:
    return f"transform(array({value}), {name} -> {body})[0]"


def _sums_before(sizes: str, joined: str = "sum + n") -> str:
    total = lambda x: f"aggregate({x}, 0, (sum, n) -> {joined})"
    runs = f"transform(sequence(0, int(size(s) div {RUN})), r -> {total(f'slice(s, r * {RUN} + 1, {RUN})')})"
    before = _bound("t", runs, f"transform(t, (x, r) -> {total('slice(t, 1, r)')})")
    within = total(f"slice(s, int(i div {RUN}) * {RUN} + 1, i % {RUN})")
    each = f"transform(s, (x, i) -> {_bound('sum', f'b[int(i div {RUN})]', _bound('n', within, joined))})"
    return _bound("s", sizes, _bound("b", before, each))


def sums_before(sizes: Column) -> Column:
    """array<int>: for each size the sum of all before it.

    Sums are made over runs of RUN sizes first, so the work grows with their number and not
    with its square, and no array is copied while it grows.
    """
    return worded(_sums_before("it.sizes"), sizes=sizes)


def covered(spans: Column) -> Column:
    """array<string>: 1 for each place of a line that a span array<struct<column_start int, column_end int, ...>> covers, else 0, up to the last span's end.

    Spans are laid one behind the other in the order of their starts, each from where the
    furthest of those before it ends, so the work grows with their number and length.
    """
    ends = _sums_before("transform(z, x -> x.column_end)", "greatest(sum, n)")
    laid = "concat(repeat('0', x.column_start - m[i]), repeat('1', x.column_end - greatest(x.column_start, m[i])))"
    mask = _bound("z", "array_sort(it.spans)", _bound("m", ends, f"array_join(transform(z, (x, i) -> {laid}), '')"))
    return worded(f"split({mask}, '')", spans=spans)


def matches(text: Column, pattern: str | Column, sign: str | None = None) -> Column:
    """array<struct<start int, hit string>>: where a pattern that never matches the empty string hits, in code points.

    What stands between the hits gives their places. sign is a text that every hit holds; a
    text without it is not searched. A pattern with a sign must not look at what is around
    its hits (no anchor, boundary or look-around): then a hit is the first place of its text
    behind the hit before it, so few hits are found without cutting the line.
    """
    p = literal(pattern) if isinstance(pattern, str) else "it.pattern"
    none = "CAST(array() AS array<struct<start:int,hit:string>>)"
    places = "transform(m.hits, (h, i) -> struct(at[i] + m.gaps[i] AS start, h AS hit))"
    placed = _bound("at", _sums_before("transform(m.hits, (h, i) -> m.gaps[i] + length(h))"), places)
    sums = "transform(m.hits, (h, i) -> struct(m.gaps[i] + aggregate(slice(z, 1, i), 0, (sum, n) -> sum + n) AS start, h AS hit))"
    few = _bound("z", "transform(m.hits, (h, i) -> m.gaps[i] + length(h))", sums)
    cut = f"struct(hits, transform(split(it.text, {p}, -1), g -> length(g)) AS gaps)"
    several = _bound("m", cut, f"IF(size(hits) <= {FEW}, {few}, {placed})")
    alone = "array(struct(locate(hits[0], it.text) - 1 AS start, hits[0] AS hit))" if sign else f"array(struct(length(split(it.text, {p}, 2)[0]) AS start, hits[0] AS hit))"
    found = _bound("hits", f"regexp_extract_all(it.text, {p}, 0)", f"CASE size(hits) WHEN 0 THEN {none} WHEN 1 THEN {alone} ELSE {several} END")
    if sign:
        step = "(a, h) -> array_append(a, struct(locate(h, it.text, IF(size(a) = 0, 1, a[size(a) - 1].start + length(a[size(a) - 1].hit) + 1)) - 1 AS start, h AS hit))"
        found = found.replace(several, f"IF(size(hits) <= {FEW}, aggregate(hits, {none}, {step}), {several})")
    hits = worded(found, text=text, **({} if isinstance(pattern, str) else {"pattern": pattern}))
    return hits if sign is None else F.when(F.contains(text, F.lit(sign)), hits).otherwise(F.expr(none))


def normalised(text: Column) -> Column:
    """Lower case, without punctuation, white space folded."""
    return _ends_cut(F.regexp_replace(F.regexp_replace(F.lower(text), r"(?U)[^\w\s]", ""), r"(?U)\s+", " "))


def words(text: Column) -> Column:
    """The distinct words of a normalised text."""
    return F.array_distinct(F.filter(F.split(normalised(text), " "), lambda w: w != ""))


def jaccard(a: Column, b: Column) -> Column:
    """Of two sets as arrays; 0 if either is empty."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _shared(s["a"], s["b"], lambda x, y: F.size(F.array_union(x, y))))


def overlap(a: Column, b: Column) -> Column:
    """Overlap coefficient, which is also the larger of it and Jaccard; 0 if either is empty."""
    return let(F.struct(a.alias("a"), b.alias("b")), lambda s: _shared(s["a"], s["b"], lambda x, y: F.least(F.size(x), F.size(y))))


def _shared(a: Column, b: Column, whole: Callable[[Column, Column], Column]) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(F.size(F.array_intersect(a, b)) / whole(a, b))


def main_content(text: Column) -> Column:
    """The lines that are neither blank nor headings, joined by spaces."""
    lines = F.transform(F.split(text, "\n"), strip)
    return F.array_join(F.filter(lines, lambda x: (x != "") & ~x.startswith("#")), " ")


def body_without_rules(text: Column) -> Column:
    """The body after front matter, where every --- line goes (kept text starts after the first pair, or at once without one)."""
    is_rule = lambda x: strip(x) == "---"

    def kept(lines: Column) -> Column:
        rules = F.filter(F.transform(lines, lambda x, i: F.when(is_rule(x), i)), lambda i: i.isNotNull())
        between = lambda i, r: F.coalesce((i > F.get(r, F.lit(0))) & (i < F.coalesce(F.get(r, F.lit(1)), i + 1)), F.lit(False))
        return let(rules, lambda r: F.filter(lines, lambda x, i: ~is_rule(x) & ~between(i, r)))

    return F.array_join(let(F.split(text, "\n"), kept), "\n")


def description(text: Column) -> Column:
    """The first paragraph without headings, cut to 147 characters and an ellipsis beyond 150; null if there is none."""
    start = F.struct(F.lit("").alias("text"), F.lit(False).alias("done"))

    def step(a: Column, raw: Column) -> Column:
        x = strip(raw)
        grown = F.concat(a["text"], x, F.lit(" "))
        return (
            F.when(a["done"], a)
            .when(x == "", F.struct(a["text"].alias("text"), (a["text"] != "").alias("done")))
            .when(x.startswith("#"), a)
            .otherwise(F.struct(grown.alias("text"), (F.length(grown) > 200).alias("done")))
        )

    first = strip(F.aggregate(F.split(text, "\n"), start, step)["text"])
    return F.when(first == "", F.lit(None).cast("string")).when(F.length(first) > 150, F.concat(F.substring(first, 1, 147), F.lit("..."))).otherwise(first)
