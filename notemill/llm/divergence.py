"""Divergence between the sources of a language, by systolic rotation.

Every (lang, source) group has a smoothed share p of each kept term of its lang, in
billionths, and f = floor((p - q)^2 / q) is how far p lies from q at one term. A pair's
value is f summed over all kept terms, from either side; a term's is f against the lang.

1. Each task sums the terms of its own documents by group before one shuffle, by lang and
   term, in which the counts of a term meet: a term is kept if 3 documents of its lang
   hold it. A source with a large part of all rows is a few rows a term and task.
2. The terms of a lang are dealt into slices of about SLICE_ROWS counts, as f is summed
   term by term. In a slice each group is one compressed vector of its counted terms.
3. In a slice the groups live in blocks of RESIDENTS. The partition of a block keeps its
   groups as arrays while the vectors of other blocks come by in the order of the rounds
   of a round-robin tournament: every two blocks meet once, in one of their partitions,
   and a meeting gives the value of both directions. Only one visitor is unpacked at a
   time. A group's absent terms all have one share, so they are not walked: a meeting
   costs the terms that residents and visitor count, not all that are kept.
4. What slices give for a pair is summed. The terms of a group are ranked by a heap in
   each slice, and the best of the slices by a window.

All arithmetic is on whole numbers; shares come from a long division, so counts may be as
large as (groups x terms) lets 64 bits hold a thousandfold total.

Defined cases: a null text, lang or source is the empty one; a group without terms has
pairs (with value 0 if its lang keeps none) and no term rows; a lang of one source has no
pairs; equal values rank by the item's UTF-8 bytes; repeated rows count as often as they
occur; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import heapq
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from notemill.session import cut

#: Documents of a lang that must hold a term.
LEAST_DOCS = 3
#: Ranks of terms that are returned.
TERM_RANKS = 200
SCALE_STEPS, SCALE_STEP = 3, 1000  # shares are in billionths
#: About so many counts are in a slice (more where a lang has more than an eighth as many groups).
SLICE_ROWS = 1 << 14
#: Groups of a block.
RESIDENTS = 8
#: Bytes of a text that are taken into terms at once, and different terms that a task holds.
PIECE = 1 << 22
HELD = 300_000

#: Letters and all bytes beyond ASCII belong to terms, A to Z as a to z; other bytes become blanks.
_TERMS = bytes(b + 32 if 65 <= b <= 90 else b if 97 <= b <= 122 or b >= 128 else 32 for b in range(256))


def terms(text: str) -> Iterator[list[bytes]]:
    """The terms of a text, a piece at a time."""
    data = text.encode().translate(_TERMS)
    at = 0
    while len(data) - at > PIECE and (end := data.find(b" ", at + PIECE)) >= 0:
        yield data[at:end].split()
        at = end
    yield data[at:].split()


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(lang, source, term, n, docs) of a task's documents, and a row without term for each group."""
    groups: dict[tuple, tuple[Counter, Counter]] = {}

    def given() -> pa.RecordBatch:
        rows = []
        for (lang, source), (n, docs) in groups.items():
            rows.append((lang, source, None, 0, 0))
            rows += [(lang, source, t, c, docs[t]) for t, c in n.items()]
        groups.clear()
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 5
        return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.string(), pa.string(), pa.binary(), pa.int64(), pa.int64()), strict=True)], names=["lang", "source", "term", "n", "docs"])

    held = 0
    for batch in batches:
        for lang, source, text in zip(*(batch.column(i) for i in range(3)), strict=True):
            n, docs = groups.setdefault((lang.as_py(), source.as_py()), (Counter(), Counter()))
            before, seen = len(n), set()
            for found in terms(text.as_py()):
                n.update(found)
                seen.update(found)
            docs.update(seen)
            held += len(n) - before
            if held > HELD:
                yield given()
                held = 0
    yield given()


def counted(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, total, lead): kept terms of each group, with the lang's total and one leading row a term; and a row without term for each group."""
    texts = docs.select(*[F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c) for c in ("lang", "source", "text")])
    partial = texts.mapInArrow(_count, "lang string, source string, term binary, n long, docs long")
    summed = partial.repartition("lang", "term").groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))
    met = Window.partitionBy("lang", "term")
    rows = summed.withColumns({"in_docs": F.sum("docs").over(met), "total": F.sum("n").over(met), "nth": F.row_number().over(met.orderBy("source"))})
    lead = F.when(F.col("term").isNotNull() & (F.col("nth") == 1), 1).otherwise(0)
    return rows.where((F.col("in_docs") >= LEAST_DOCS) | F.col("term").isNull()).select("lang", "source", "term", "n", "total", lead.alias("lead"))


def sized(counts: DataFrame) -> DataFrame:
    """(lang, source, g, m, lang_m, slices, blocks) of each group: its number, what its shares and its lang's are parts of, how its lang is divided."""
    each = counts.groupBy("lang", "source").agg(F.sum("n").alias("n"), F.sum("lead").alias("leads"), F.count("term").alias("rows"))
    lang = Window.partitionBy("lang")
    g = F.row_number().over(lang.orderBy("source")) - 1
    all_of = lambda c: F.sum(c).over(lang)
    many = F.count("*").over(lang)
    return each.select(
        "lang",
        "source",
        g.cast("int").alias("g"),
        (F.col("n") + all_of("leads")).alias("m"),
        (all_of("n") + all_of("leads")).alias("lang_m"),
        F.greatest(F.ceil(all_of("rows") / F.greatest(F.lit(SLICE_ROWS), 8 * many)), F.lit(1)).cast("int").alias("slices"),
        F.ceil(many / RESIDENTS).cast("int").alias("blocks"),
    )


def shares(n: np.ndarray, m: np.ndarray | int) -> np.ndarray:
    """1 + floor(10^9 (n + 1) / m) by long division."""
    quotient, rest = (n + 1) // m, (n + 1) % m
    for _ in range(SCALE_STEPS):
        rest = rest * SCALE_STEP
        quotient = quotient * SCALE_STEP + rest // m
        rest %= m
    return quotient + 1


def apart(p: np.ndarray, q: np.ndarray) -> np.ndarray:
    return (p - q) * (p - q) // q


def packed(places: np.ndarray, n: np.ndarray) -> bytes:
    """A vector as zlib bytes: steps between its places, then its counts."""
    return zlib.compress(np.concatenate((np.diff(places, prepend=0), n)).astype(np.int64).tobytes(), 1)


def unpacked(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(zlib.decompress(data), dtype=np.int64).reshape(2, -1)
    return np.cumsum(both[0]), both[1]


#: A vector of a slice (terms: how many the slice holds), or a ranked term (item and value).
_VECTORS = "lang string, slice int, g int, blocks int, terms long, m long, vector binary, item binary, value long"
_ARROW = pa.schema([("lang", pa.string()), ("slice", pa.int32()), ("g", pa.int32()), ("blocks", pa.int32()), ("terms", pa.int64()), ("m", pa.int64()), ("vector", pa.binary()), ("item", pa.binary()), ("value", pa.int64())])


def _slice_vectors(key: tuple, table: pa.Table) -> pa.Table:
    """The vectors and the best terms of each group in a slice."""
    lang, part = (k.as_py() for k in key)
    heads = {h["g"]: h for h in table.filter(pc.is_null(table["term"])).select(["g", "m", "lang_m", "blocks"]).to_pylist()}
    rows = table.filter(pc.is_valid(table["term"]))
    coded = rows["term"].combine_chunks().dictionary_encode()
    names = coded.dictionary.to_pylist()
    place, g, n, total = (np.asarray(c, dtype=np.int64) for c in (coded.indices, rows["g"], rows["n"], rows["total"]))
    order = np.lexsort((place, g))
    place, g, n, total = place[order], g[order], n[order], total[order]
    out: dict[str, list] = {name: [] for name in _ARROW.names}
    for own in sorted(heads):
        head = heads[own]
        lo, hi = np.searchsorted(g, own), np.searchsorted(g, own, side="right")
        row = dict.fromkeys(_ARROW.names) | {"lang": lang, "slice": part, "g": own}
        made = [row | {"blocks": head["blocks"], "terms": len(names), "m": head["m"], "vector": packed(place[lo:hi], n[lo:hi])}]
        if hi > lo:
            p, q = shares(n[lo:hi], head["m"]), shares(total[lo:hi], head["lang_m"])
            above = np.flatnonzero(p > q)
            values = apart(p[above], q[above])
            best = heapq.nsmallest(TERM_RANKS, zip((-values).tolist(), (names[i] for i in place[lo:hi][above].tolist()), strict=True))
            made += [row | {"item": item, "value": -value} for value, item in best]
        for r in made:
            for name, values_of in out.items():
                values_of.append(r[name])
    return pa.table(out, schema=_ARROW)


def slice_vectors(counts: DataFrame, groups: DataFrame) -> DataFrame:
    """The rows of _VECTORS: each group's vector in each slice of its lang, and its best terms there."""
    entries = (
        counts.where("term is not null")
        .join(groups, ["lang", "source"])
        .select("lang", F.pmod(F.xxhash64("term"), F.col("slices")).cast("int").alias("slice"), "g", "term", "n", "total", *[F.lit(None).cast(t).alias(c) for c, t in (("m", "long"), ("lang_m", "long"), ("blocks", "int"))])
    )
    heads = groups.select("lang", F.explode(F.sequence(F.lit(0), F.col("slices") - 1)).alias("slice"), "g", *[F.lit(None).cast(t).alias(c) for c, t in (("term", "binary"), ("n", "long"), ("total", "long"))], "m", "lang_m", "blocks")
    return entries.unionByName(heads).groupBy("lang", "slice").applyInArrow(_slice_vectors, _VECTORS)


def meetings(block, blocks):
    """Columns (round, cell) of each partition that a block's vectors go to: home in round 0, then where it is the guest.

    Rounds of the circle method over n + 1 places, n odd: in round r the blocks a and b
    below n meet if a + b is r modulo n, and the one that would meet itself meets block n
    (a block that is not there is a bye). The lower block is the host where a + b is even.
    """
    n = blocks - 1 + blocks % 2
    home = F.array(F.struct(F.lit(0).alias("round"), block.alias("cell")))

    def opponent(r):
        other = F.pmod(r - block, n)
        last = F.pmod(r * F.floor((n + 1) / 2).cast("int"), n)  # the block that is half of r
        return F.when(block == n, last).when(other == block, n).otherwise(other).cast("int")

    rounds = F.transform(F.sequence(F.lit(1), F.greatest(n, F.lit(1))), lambda r: F.struct(r.alias("round"), opponent(r).alias("cell")))
    guest = lambda m: (m["cell"] < blocks) & (m["cell"] != block) & ((m["cell"] < block) == ((m["cell"] + block) % 2 == 0))
    return F.explode(F.concat(home, F.filter(rounds, guest)))


class _Block:
    """The groups of a block in one slice, as arrays, and what their meetings give."""

    def __init__(self, n_terms: int):
        self.n_terms = n_terms
        self.g: list[int] = []
        self.m: list[int] = []
        self.vectors: list[tuple[np.ndarray, np.ndarray]] = []
        self.ready = False

    def add(self, g: int, m: int, data: bytes) -> list[tuple[int, int, int]]:
        """Takes in a group, which meets those that are here."""
        out = self.meet(g, m, data) if self.g else []
        places, n = unpacked(data)
        self.g.append(g)
        self.m.append(max(m, 1))
        self.vectors.append((places, shares(n, max(m, 1))))
        self.ready = False
        return out

    def _lay_out(self) -> None:
        self.places = np.concatenate([v[0] for v in self.vectors])
        self.p = np.concatenate([v[1] for v in self.vectors])
        self.size = np.array([len(v[0]) for v in self.vectors], dtype=np.int64)
        self.owner = np.repeat(np.arange(len(self.size)), self.size)
        self.absent = shares(np.zeros(len(self.m), dtype=np.int64), np.array(self.m, dtype=np.int64))
        self.ready = True

    def _sums(self, values: np.ndarray, of: np.ndarray) -> np.ndarray:
        out = np.zeros(len(self.g), dtype=np.int64)
        np.add.at(out, of, values)
        return out

    def meet(self, g: int, m: int, data: bytes) -> list[tuple[int, int, int]]:
        """(of, against, value) in both directions for the visitor and each resident."""
        if not self.ready:
            self._lay_out()
        places, n = unpacked(data)
        m = max(m, 1)
        q = shares(n, m)
        q0 = int(shares(np.zeros(1, dtype=np.int64), m)[0])
        dense, held = np.full(self.n_terms, q0, dtype=np.int64), np.zeros(self.n_terms, dtype=bool)
        dense[places], held[places] = q, True
        other, both = dense[self.places], held[self.places]
        common = self.owner[both]
        in_both = np.bincount(common, minlength=len(self.g))
        in_none = self.n_terms - self.size - len(places) + in_both
        levels, times = np.unique(q, return_counts=True)
        p0 = self.absent
        results = []
        for f in (apart, lambda a, b: apart(b, a)):  # the resident's share is p, then q
            # Terms of the resident; those of the visitor as if the resident had none of them, less those it has; the rest.
            value = self._sums(f(self.p, other), self.owner)
            value += (f(p0[:, None], levels[None, :]) * times).sum(axis=1)
            value -= self._sums(f(p0[common], other[both]), common)
            value += in_none * f(p0, np.int64(q0))
            results.append(value.tolist())
        return [row for r, of, against in zip(self.g, *results, strict=True) for row in ((r, g, of), (g, r, against))]


def _meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows in the order of their partition (lang, slice, cell) and round: residents first, then the visitors one by one."""
    at, block = None, None
    for batch in batches:
        langs, rows = [], []
        for lang, part, cell, turn, g, n_terms, m, data in zip(*(c.to_pylist() for c in batch.columns), strict=True):
            if (lang, part, cell) != at:
                at, block = (lang, part, cell), _Block(n_terms)
            found = block.meet(g, m, data) if turn else block.add(g, m, data)
            rows += found
            langs += [lang] * len(found)
        columns = list(zip(*rows, strict=True)) if rows else [[]] * 3
        yield pa.RecordBatch.from_arrays([pa.array(langs, pa.string()), pa.array(columns[0], pa.int32()), pa.array(columns[1], pa.int32()), pa.array(columns[2], pa.int64())], names=["lang", "g", "h", "value"])


def rotated(vectors: DataFrame) -> DataFrame:
    """(lang, g, h, value): how far group g lies from group h, for all pairs of a lang."""
    block = F.floor(F.col("g") / RESIDENTS).cast("int")
    visits = vectors.where("vector is not null").withColumn("visit", meetings(block, F.col("blocks")))
    cells = visits.select("lang", "slice", F.col("visit.cell").alias("cell"), F.col("visit.round").alias("round"), "g", "terms", "m", "vector")
    placed = cells.repartition("lang", "slice", "cell").sortWithinPartitions("lang", "slice", "cell", "round", "g")
    return placed.mapInArrow(_meet, "lang string, g int, h int, value long").groupBy("lang", "g", "h").agg(F.sum("value").alias("value"))


def audit_documents(docs: DataFrame) -> DataFrame:
    """(lang, source, part, item, value, rank): each source's distance from the others of its lang, and the terms that set it apart from the lang."""
    counts = cut(counted(docs))
    groups = sized(counts)
    vectors = cut(slice_vectors(counts, groups))
    names = groups.select("lang", "g", "source")
    pairs = rotated(vectors).join(names, ["lang", "g"]).join(names.select("lang", F.col("g").alias("h"), F.col("source").alias("item")), ["lang", "h"]).select("lang", "source", F.lit("pair").alias("part"), "item", "value")
    found = vectors.where("item is not null").join(names, ["lang", "g"]).select("lang", "source", F.lit("term").alias("part"), F.col("item").cast("string").alias("item"), "value")
    ranks = Window.partitionBy("lang", "source", "part").orderBy(F.desc("value"), "item")
    ranked = lambda rows: rows.withColumn("rank", F.row_number().over(ranks))
    return ranked(pairs).unionByName(ranked(found).where(F.col("rank") <= TERM_RANKS))


#: The same in SQL, over the whole matrix of groups and kept terms.
SQL = r"""
WITH docs AS (SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS text FROM documents),
found AS (SELECT id, lang, source, unnest(regexp_extract_all(text, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM docs),
kept AS (SELECT lang, term, count(*) AS n FROM found GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
sources AS (SELECT DISTINCT lang, source FROM docs),
counts AS (SELECT lang, source, term, count(*) AS n FROM found GROUP BY lang, source, term),
matrix AS (SELECT s.lang, s.source, k.term, coalesce(c.n, 0) AS n FROM sources s JOIN kept k ON s.lang = k.lang LEFT JOIN counts c ON c.lang = s.lang AND c.source = s.source AND c.term = k.term),
totals AS (SELECT lang, source, sum(n) + count(*) AS m FROM matrix GROUP BY lang, source),
p AS (SELECT x.lang, x.source, x.term, x.n, (1 + 1000000000::HUGEINT * (x.n + 1) // t.m)::BIGINT AS p FROM matrix x JOIN totals t ON x.lang = t.lang AND x.source = t.source),
q AS (SELECT lang, term, (1 + 1000000000::HUGEINT * (n + 1) // (sum(n) OVER (PARTITION BY lang) + count(*) OVER (PARTITION BY lang)))::BIGINT AS q FROM kept),
sums AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
parts AS (
    SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(s.value, 0)::BIGINT AS value
    FROM sources a JOIN sources b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN sums s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
    UNION ALL SELECT p.lang, p.source, 'term', p.term, ((p.p - q.q) * (p.p - q.q) // q.q)::BIGINT FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.n > 0 AND p.p > q.q)
SELECT lang, source, part, item, value, (row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item))::INTEGER AS rank
FROM parts QUALIFY part = 'pair' OR rank <= 200
"""
