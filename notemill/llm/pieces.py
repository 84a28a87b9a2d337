"""SentencePiece encoding by sampling, and decoding.

A text is written with the space mark for each space and one in front. Its lattice holds
every vocabulary piece at every place where it fits; a character without a piece has one
edge, its bytes. Forward filtering gives, for each position, the log-weight of all
segmentations up to it; backward sampling then draws, from the end, each last piece in
proportion to the segmentations that end with it. That samples whole segmentations
exactly from their distribution. The draws come from a counter-based generator seeded by
the row's key, the place in the text and the position, so a row is segmented alike in
every run, on any executor and beside any other rows.

No piece goes past a space mark that follows another character, or past a line feed, so
the lattice falls into runs that are independent given the text. Runs are filtered once
and sampled all together; the table of filtered runs has a bound and is emptied when it is
reached. The vocabulary is a byte-pair one whose scores are ranks, so a piece of rank r has
log-weight -SHARPNESS * ln(2 + r).

Decoding joins the pieces' bytes, turns marks into spaces and takes the first one off. A
space mark that is part of the text itself is written as its bytes, so every text returns
as it was.

Defined cases: a null or empty text has no pieces and decodes to the empty text; a null
key is seeded like the key 0; repeated rows get equal pieces; an empty table gives an
empty result; other columns are ignored.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

MARK = chr(0x2581)
#: Stands for a mark in the text itself: a lone surrogate, which no valid text holds.
OWN_MARK = chr(0xDFFF)
FIRST_BYTE = 3
LONGEST = 16
#: Few positions end a piece longer than NEAR; sums are scaled each SCALED positions.
NEAR = 6
SCALED = 32
SHARPNESS = 0.5
SEED = 1
#: Filtered positions kept by a worker, and characters sampled together.
POSITIONS_KEPT = 1_400_000
CHARACTERS = 2_000_000
_RUNS = re.compile(f"\n|{MARK}*[^{MARK}\n]+|{MARK}+")
_STEP = np.uint64(0x9E3779B97F4A7C15)


def _mix(x: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
        return x ^ (x >> np.uint64(31))


def _reach(hashes: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Hashes of runs that begin one character earlier."""
    with np.errstate(over="ignore"):
        return (hashes + points + np.uint64(1)) * _STEP ^ (hashes >> np.uint64(29))


class Vocabulary:
    """Pieces by hash of their characters, read from the last to the first."""

    def __init__(self, path: str):
        from sentencepiece import SentencePieceProcessor

        model = SentencePieceProcessor(model_file=path)
        names = [model.id_to_piece(i) for i in range(model.get_piece_size())]
        plain = [i for i in range(len(names)) if not (model.is_byte(i) or model.is_control(i) or model.is_unknown(i) or model.is_unused(i))]
        assert max(len(names[i]) for i in plain) <= LONGEST, "pieces longer than LONGEST"
        assert not any("\n" in names[i] or (MARK in names[i].lstrip(MARK)) for i in plain), "a piece goes past the bounds of a run"
        assert names[FIRST_BYTE] == "<0x00>" and model.is_byte(FIRST_BYTE + 255), "no byte pieces"
        self.bytes = [names[i].replace(MARK, " ").encode() for i in range(len(names))]
        for b in range(256):
            self.bytes[FIRST_BYTE + b] = bytes([b])
        for i in (0, 1, 2):
            self.bytes[i] = b""
        keys = np.array([self.key(names[i]) for i in plain], dtype=np.uint64)
        order = np.argsort(keys)
        self.keys, self.ids = keys[order], np.array(plain, dtype=np.int32)[order]
        assert len(np.unique(self.keys)) == len(self.keys), "two pieces share a hash"
        # Most runs of characters are no piece; their hash's upper bits mostly say so at once.
        self.maybe = np.zeros(1 << 22, dtype=bool)
        self.maybe[(self.keys >> np.uint64(42)).astype(np.int64)] = True
        rank = np.array([-model.get_score(i) for i in range(len(names))], dtype=np.float64)
        self.weight = -SHARPNESS * np.log(2 + np.maximum(rank, 0))
        self.byte_weight = -SHARPNESS * np.log(2.0 + len(names))
        self.chance, self.byte_chance = np.exp(self.weight), float(np.exp(self.byte_weight))

    @staticmethod
    def key(piece: str) -> np.uint64:
        h = np.zeros(1, dtype=np.uint64)
        for c in reversed(piece):
            h = _reach(h, np.array([ord(c)], dtype=np.uint64))
        return h[0]

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """Piece ids of hashes, -1 where there is none."""
        found = np.full(len(hashes), -1, dtype=np.int32)
        maybe = np.flatnonzero(self.maybe[(hashes >> np.uint64(42)).astype(np.int64)])
        asked = hashes[maybe]
        at = np.minimum(np.searchsorted(self.keys, asked), len(self.keys) - 1)
        found[maybe] = np.where(self.keys[at] == asked, self.ids[at], np.int32(-1))
        return found


class Runs(dict):
    """Filtered runs: for each position the cumulated chances of the last piece's length, and the pieces."""

    def __init__(self, vocabulary: Vocabulary):
        super().__init__()
        self.vocabulary = vocabulary
        self.empty()

    def empty(self) -> None:
        self.clear()
        self.fresh: list[str] = []
        self.size = 0
        self.starts, self.lengths = np.empty(0, np.int64), np.empty(0, np.int64)
        self.chances, self.pieces = np.empty((0, LONGEST), np.float32), np.empty((0, LONGEST), np.int32)

    def __missing__(self, run: str) -> int:
        self.fresh.append(run)
        self[run] = index = len(self)
        return index

    def filter_fresh(self) -> None:
        """Forward filtering of the runs met since the last call, all in step, long ones first."""
        if not self.fresh:
            return
        v = self.vocabulary
        lengths = np.array([len(r) for r in self.fresh], dtype=np.int64)
        starts = np.concatenate(([0], np.cumsum(lengths)[:-1]))
        points = np.frombuffer("".join(self.fresh).encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64)
        place = np.arange(len(points)) - np.repeat(starts, lengths)
        pieces = np.full((len(points), LONGEST), -1, dtype=np.int32)
        hashes, at = np.zeros(len(points), dtype=np.uint64), np.arange(len(points))
        for n in range(1, LONGEST + 1):
            at = at[place[at] >= n - 1]
            if not len(at):
                break
            hashes[at] = _reach(hashes[at], points[at - n + 1])
            pieces[at, n - 1] = v.find(hashes[at])
        alone = pieces[:, 0] < 0
        # A character without a piece: one byte is that byte's piece; more bytes are marked by the negative code point.
        single = points[alone].astype(np.int64)
        pieces[alone, 0] = np.where(single < 128, FIRST_BYTE + single, -1 - single)
        known = pieces >= 0
        known[:, 0] = True
        weights = np.zeros(pieces.shape)
        weights[known] = v.chance[np.maximum(pieces[known], 0)]
        weights[alone, 0] = v.byte_chance
        reach = LONGEST - np.argmax(known[:, ::-1], axis=1)
        chances = np.full(pieces.shape, 2.0, dtype=np.float32)
        # Runs of like length are filtered in step. Sums are scaled to 1 at intervals, so that long runs don't vanish.
        order = np.argsort(-lengths, kind="stable")
        bands = [*(np.flatnonzero((lengths[order] > low) & (lengths[order] <= high)) for low, high in ((0, 6), (6, 10), (10, 20), (20, 64))), *([i] for i in np.flatnonzero(lengths[order] > 64))]
        for band in bands:
            runs = order[band]
            if not len(runs):
                continue
            longest = int(lengths[runs[0]])
            active = np.searchsorted(-lengths[runs], -np.arange(1, longest + 1), side="right")
            forward = np.zeros((len(runs), longest + LONGEST))
            forward[:, LONGEST - 1] = 1.0
            for p in range(longest):
                at = starts[runs[: active[p]]] + p
                far = reach[at] > NEAR
                for some, wide in ((slice(None), NEAR), (np.flatnonzero(far), LONGEST)):
                    where = at[some]
                    if not len(where):
                        continue
                    before = forward[: len(at), p + LONGEST - wide : p + LONGEST][some][:, ::-1]
                    summed = np.cumsum(before * weights[where, :wide], axis=1)
                    total = summed[:, -1:]
                    forward[: len(at)][some, p + LONGEST] = total[:, 0]
                    chances[where, :wide] = summed / np.maximum(total, 1e-300)
                if p % SCALED == SCALED - 1:
                    window = forward[: len(at), p + 1 : p + LONGEST + 1]
                    window /= window.max(axis=1, keepdims=True)
        # From the last possible piece on the cumulated chance counts as certain.
        chances[np.arange(LONGEST)[None, :] >= reach[:, None] - 1] = 2.0
        self.starts = np.concatenate((self.starts, starts + self.size))
        self.lengths = np.concatenate((self.lengths, lengths))
        self.chances = np.concatenate((self.chances, chances))
        self.pieces = np.concatenate((self.pieces, pieces))
        self.size += len(points)
        self.fresh = []

    def sample(self, runs: np.ndarray, seeds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(pieces of all runs in order, how many each has), drawn from each run's end backwards."""
        at = self.starts[runs] + self.lengths[runs] - 1
        left = self.lengths[runs].copy()
        alive = np.arange(len(runs))
        counts = np.zeros(len(runs), dtype=np.int64)
        drawn: list[tuple[np.ndarray, np.ndarray]] = []
        while len(alive):
            with np.errstate(over="ignore"):
                u = (_mix(seeds[alive] + left.astype(np.uint64) * _STEP) >> np.uint64(40)).astype(np.float32) / np.float32(1 << 24)
            n = (self.chances[at] <= u[:, None]).sum(axis=1)
            drawn.append((alive, self.pieces[at, n]))
            counts[alive] += 1
            left = left - n - 1
            at = at - n - 1
            on = left > 0
            alive, left, at = alive[on], left[on], at[on]
        ends = np.cumsum(counts)
        out = np.empty(int(ends[-1]) if len(ends) else 0, dtype=np.int32)
        for step, (who, ids) in enumerate(drawn):
            out[ends[who] - 1 - step] = ids
        return out, counts


@lru_cache(maxsize=2)
def runs_of(path: str) -> Runs:
    """A worker's vocabulary and filtered runs, kept from task to task."""
    return Runs(Vocabulary(path))


def _spread(ids: np.ndarray) -> np.ndarray:
    """Turns the marks of characters of several bytes into their byte pieces."""
    out: list[int] = []
    for i in ids.tolist():
        if i >= 0:
            out.append(i)
        else:
            c = -1 - i
            out += [FIRST_BYTE + b for b in (MARK if c == ord(OWN_MARK) else chr(c)).encode()]
    return np.array(out, dtype=np.int32)


def encode(texts: list[str], keys: list[int | None], runs: Runs, seed: int = SEED) -> list[np.ndarray]:
    """The sampled piece ids of each text."""
    if runs.size > POSITIONS_KEPT:
        runs.empty()
    rows = [list(map(runs.__getitem__, _RUNS.findall(MARK + t.replace(MARK, OWN_MARK).replace(" ", MARK)))) if t else [] for t in texts]
    runs.filter_fresh()
    sizes = np.array([len(r) for r in rows], dtype=np.int64)
    flat = np.fromiter((i for r in rows for i in r), dtype=np.int64, count=int(sizes.sum()))
    with np.errstate(over="ignore"):
        rowed = _mix(np.array([(k or 0) & (2**64 - 1) for k in keys], dtype=np.uint64) * _STEP + np.uint64(seed))
        place = np.arange(len(flat)) - np.repeat(np.cumsum(sizes) - sizes, sizes)
        seeds = _mix(np.repeat(rowed, sizes) + place.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))
    ids, counts = runs.sample(flat, seeds)
    ends = np.concatenate(([0], np.cumsum(counts)))[np.concatenate(([0], np.cumsum(sizes)))]
    found = [ids[a:b] for a, b in zip(ends, ends[1:], strict=False)]
    return [_spread(x) if len(x) and x.min() < 0 else x for x in found]


def decode(ids: list[int], vocabulary: Vocabulary) -> str:
    """The text of piece ids."""
    return b"".join(map(vocabulary.bytes.__getitem__, ids))[1:].decode("utf-8", "replace")


def _portions(batch: pa.RecordBatch) -> Iterator[tuple[list, list[str]]]:
    keys, texts, held = [], [], 0
    for key, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
        text = text.as_py() or ""
        keys.append(key)
        texts.append(text)
        held += len(text)
        if held >= CHARACTERS:
            yield keys, texts
            keys, texts, held = [], [], 0
    yield keys, texts


def _encode_batches(path: str, seed: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs = runs_of(path)
        for batch in batches:
            for keys, texts in _portions(batch):
                found = encode(texts, keys, runs, seed)
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in found]))).astype(np.int32)
                values = np.concatenate(found) if found else np.empty(0, np.int32)
                back = [decode(x.tolist(), runs.vocabulary) == t for x, t in zip(found, texts, strict=True)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(keys, pa.int64()), pa.ListArray.from_arrays(pa.array(offsets), pa.array(values, pa.int32())), pa.array(np.diff(offsets).astype(np.int64)), pa.array(back, pa.bool_())],
                    names=["doc_id", "ids", "n_pieces", "lossless"],
                )

    return run


def encode_documents(docs: DataFrame, model_path: str, seed: int = SEED) -> DataFrame:
    """(doc_id, ids array<int>, n_pieces long, lossless boolean): lossless says that the ids decode to the text."""
    return docs.select(F.col("doc_id").cast("long"), "text").mapInArrow(_encode_batches(model_path, seed), "doc_id long, ids array<int>, n_pieces long, lossless boolean")


def decode_documents(encoded: DataFrame, model_path: str) -> DataFrame:
    """(doc_id, text) of (doc_id, ids)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        vocabulary = runs_of(model_path).vocabulary
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([decode(x.as_py() or [], vocabulary) for x in batch.column(1)], pa.string())], names=["doc_id", "text"])

    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(run, "doc_id long, text string")
