"""Packing of documents into sequences by minimum bin slack.

Documents become token ids, with an end id after each. What fills whole sequences is cut
off at once; the rests wait in a pool. A sequence takes the longest rest and then the
multiset of remaining lengths that fills it closest to capacity: a subset-sum table over
the lengths, kept as a bitset, one snapshot for each length used, is run until the
capacity is reached; walking the snapshots back gives how many of each length to take.
A partition's last sequence would stay short; it is cut into sequences whose lengths are
powers of two, which need no padding.

The work is one pass without a shuffle: every partition packs its own documents, and
sequence ids hold the partition's number in their upper bits. A lost task is run again
on the same rows and gives the same ids.

Ids are kept as little-endian 32-bit bytes for each distinct run of non-space characters
(pre-tokenisation never crosses white space, so a text's ids are its runs' ids in order).
The table of runs is emptied when it reaches a bound, so its size does not follow the data.

Defined cases: a null or empty text is the end id alone; repeated rows are packed as
often as they occur; an empty table gives no pieces; other columns are ignored.
"""

from __future__ import annotations

import re
import struct
import zlib
from collections import defaultdict
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import regex
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

CAPACITY = 4096
END_ID = 2
#: Runs remembered in each of a worker's two tables.
RUNS_KEPT = 500_000
#: Rests that wait in a task's pool before they are packed.
POOL = 4096
SEQUENCE_BITS = 36
SCHEMA = "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long"


def _byte_letters() -> dict[int, str]:
    """Byte-level vocabularies write a printable byte as itself and the others, in order, from 256 on."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    table, more = {}, 256
    for byte in range(256):
        if byte not in plain:
            table[byte] = chr(more)
            more += 1
    return table


class Runs(dict):
    """Ids, as bytes, of a run of non-space characters of lower-cased text.

    Runs of plain characters (below U+0250, where composing changes nothing and lower case
    goes character by character) are cut by the tokenizer's own pattern and handed to its
    model; all others, and what may hold a special token, go through the whole tokenizer.
    When the table is full it becomes the old one, and what is still in use comes back from there.
    """

    # The tokenizer's pre-tokenisation pattern and its class of white space.
    PIECES = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|\p{L}+|\p{N}|[^\s\p{L}\p{N}]+")
    SPACE = re.compile("[" + "".join(map(chr, (*range(9, 14), 0x20, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000))) + "]+")
    FAR = re.compile(f"[{chr(0x130)}{chr(0x250)}-{chr(0x10FFFF)}]")
    #: str.split also cuts at these, which the tokenizer keeps.
    SEPARATORS = re.compile(f"[{chr(0x1C)}-{chr(0x1F)}]")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_padding()
        self.tokenizer.no_truncation()
        self.model = self.tokenizer.model
        self.letters = _byte_letters()
        self.old: dict[str, bytes] = {}

    def __missing__(self, run: str) -> bytes:
        value = self.old.get(run)
        if value is None:
            if "<|" in run or self.FAR.search(run):
                ids = self.tokenizer.encode(run, add_special_tokens=False).ids
            else:
                ids = [t.id for p in self.PIECES.findall(run.lower()) for t in self.model.tokenize(p.encode().decode("latin-1").translate(self.letters))]
            value = struct.pack(f"<{len(ids)}I", *ids)
        self[run] = value
        return value

    def ids(self, text: str) -> bytes:
        if len(self) > RUNS_KEPT:
            self.old = dict(self)
            self.clear()
        if "<|" not in text and not self.FAR.search(text):
            text = text.lower()
        runs = self.SPACE.split(text) if self.SEPARATORS.search(text) else text.split()
        return b"".join(map(self.__getitem__, runs))


@lru_cache(maxsize=2)
def runs_of(path: str) -> Runs:
    """A worker's table, kept from task to task."""
    return Runs(path)


def fill(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The multiset of lengths with the greatest sum up to capacity: {length: how many}.

    reach holds bit s if the lengths so far can sum to s. Multiples are added in doubling
    steps; the bitset before each step is kept for the walk back.
    """
    full = (1 << (capacity + 1)) - 1
    reach, steps = 1, []
    for length in sorted(counts, reverse=True):
        left = min(counts[length], capacity // length)
        take = 1
        while left > 0:
            take = min(take, left)
            steps.append((length, take, reach))
            reach = (reach | reach << length * take) & full
            left -= take
            take *= 2
        if reach >> capacity & 1:
            break
    goal = reach.bit_length() - 1
    chosen: dict[int, int] = defaultdict(int)
    for length, take, before in reversed(steps):
        if not before >> goal & 1:
            chosen[length] += take
            goal -= length * take
    return chosen


class Packer:
    """Packs one partition's documents. Pieces leave as they are placed."""

    def __init__(self, capacity: int, first_sequence: int):
        self.capacity, self.sequence = capacity, first_sequence
        self.pool: dict[int, list[tuple]] = defaultdict(list)
        self.waiting = 0
        self.out: list[tuple] = []

    def place(self, pieces: list[tuple]) -> None:
        offset = 0
        for doc_id, start, ids, total in pieces:
            n = len(ids) // 4
            self.out.append((doc_id, start, n, zlib.crc32(ids), total, self.sequence, offset))
            offset += n
        self.sequence += 1

    def add(self, doc_id, ids: bytes) -> None:
        total, step = len(ids) // 4, self.capacity * 4
        whole = total // self.capacity
        for i in range(whole):
            self.place([(doc_id, i * self.capacity, ids[i * step : (i + 1) * step], total)])
        if rest := total - whole * self.capacity:
            self.pool[rest].append((doc_id, whole * self.capacity, ids[whole * step :], total))
            self.waiting += 1
            if self.waiting >= 2 * POOL:
                self.pack(POOL)

    def take(self, length: int) -> tuple:
        group = self.pool[length]
        piece = group.pop()
        if not group:
            del self.pool[length]
        self.waiting -= 1
        return piece

    def pack(self, leave: int) -> None:
        """Fills sequences until at most so many rests wait, or the rests fill none."""
        mass = sum(k * len(v) for k, v in self.pool.items())
        while self.waiting > leave and mass >= self.capacity:
            longest = max(self.pool)
            pieces = [self.take(longest)]
            chosen = fill({k: len(v) for k, v in self.pool.items()}, self.capacity - longest)
            for length, n in chosen.items():
                pieces += [self.take(length) for _ in range(n)]
            used = sum(len(p[2]) // 4 for p in pieces)
            mass -= used
            if used < self.capacity:
                short = self.capacity - used
                # No multiset fills it: cut the last of the open rests that is longer than the gap.
                if longer := [k for k in self.pool if k > short]:
                    doc_id, start, ids, total = self.take(min(longer))
                    pieces.append((doc_id, start, ids[: short * 4], total))
                    self.pool[len(ids) // 4 - short].append((doc_id, start + short, ids[short * 4 :], total))
                    self.waiting += 1
                    mass -= short
            self.place(pieces)

    def finish(self) -> None:
        self.pack(0)
        rest = [p for k in sorted(self.pool, reverse=True) for p in self.pool[k]]
        self.pool.clear()
        left, pieces = sum(len(p[2]) // 4 for p in rest), []
        while left:
            room = 1 << (left.bit_length() - 1)
            left -= room
            while room:
                doc_id, start, ids, total = rest.pop(0)
                n = min(room, len(ids) // 4)
                pieces.append((doc_id, start, ids[: n * 4], total))
                if n * 4 < len(ids):
                    rest.insert(0, (doc_id, start + n, ids[n * 4 :], total))
                room -= n
            self.place(pieces)
            pieces = []


def _as_batch(rows: list[tuple], schema: pa.Schema) -> pa.RecordBatch:
    columns = zip(*rows, strict=True) if rows else [[] for _ in schema]
    return pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(columns, schema, strict=True)], schema=schema)


def _pack_partition(path: str, capacity: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([(c.split()[0], pa.int64()) for c in SCHEMA.split(", ")])
        packer = Packer(capacity, TaskContext.get().partitionId() << SEQUENCE_BITS)
        table, end = runs_of(path), END_ID.to_bytes(4, "little")
        for batch in batches:
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                packer.add(doc_id, table.ids(text.as_py() or "") + end)
                if len(packer.out) >= 20_000:
                    yield _as_batch(packer.out, schema)
                    packer.out = []
        packer.finish()
        yield _as_batch(packer.out, schema)

    return run


def pack_documents(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """One row per piece. A piece's tokens are start to start + length of its document's."""
    if capacity < 1 or capacity & (capacity - 1):
        raise ValueError("the capacity must be a power of two")
    return docs.select(F.col("doc_id").cast("long"), F.coalesce("text", F.lit("")).alias("text")).mapInArrow(_pack_partition(tokenizer_path, capacity), SCHEMA)
