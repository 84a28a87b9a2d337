"""Byte-level BPE encoding and decoding with a transducer of the corpus's frequent words.

1. The words of all texts are counted (shuffles of counts that each task has summed
   before). Words that occur often enough for LEXICON_WORDS of them, and no longer than
   LEXICON_BYTES, are merged once and compiled into a minimal acyclic transducer
   (lexicon.py). It is a file in the shared folder that Spark hands to each executor,
   whose workers map it into memory. Its size has the bound of these two parameters.
2. Texts are cut into words where the tokenizer's pattern cuts, for a block of texts at
   once. All words of the block walk through the transducer together, which gives their
   ids; those that it does not hold are merged exactly, by rank and then from the left:
   short ones of one length in step, others over a heap, where n bytes cost n log n. Both give the ids of the tokenizer, whatever is in the lexicon.
3. Decoding joins the bytes of the ids and reads them as UTF-8.

Long texts are cut into pieces of about PIECE characters before a space that follows
another character, where no word crosses; memory follows the block, not the text's words.

Defined cases: a null or empty text has no ids and decodes to the empty text; the strings
of added tokens in a text are these tokens, as in the tokenizer; characters newer than
this Python's Unicode tables, on whose class libraries differ, are cut by the tokenizer's
own rule; decoding passes over null ids and ids without a token, and replaces bytes that
are not UTF-8; repeated rows give equal results; an empty table gives an empty result;
rows without doc_id stay; other columns are ignored.
"""

from __future__ import annotations

import hashlib
import heapq
import json
import re
import sys
import tempfile
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from notemill.llm.lexicon import Lexicon, compiled, gathered
from notemill.llm.packing import _byte_letters
from notemill.session import cut

#: Bound of the lexicon: most words, and most bytes of a word.
LEXICON_WORDS = 1 << 17
LEXICON_BYTES = 64
#: Characters of texts whose words are looked up together, and after which a long text is cut.
BLOCK = 1 << 20
PIECE = 1 << 19
#: Bytes of a word up to which words merge in step; longer ones merge over a heap.
IN_STEP = 64
NEVER = np.iinfo(np.int64).max

# The classes of the tokenizer's pattern for words, and the endings that it cuts off behind an apostrophe.
# The pattern is 's|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+
OTHER, LETTER, NUMBER, SPACE, NEWER = range(5)
ENDINGS = ("s", "t", "m", "d", "re", "ve", "ll")
_EDGE = re.compile(r"(?<=[^\s])(?= )")


@lru_cache(maxsize=1)
def _classes() -> np.ndarray:
    """The class of each code point; NEWER where this Python's tables do not know the character."""
    table = np.zeros(sys.maxunicode + 1, dtype=np.uint8)
    points = "".join(" " if 0xD800 <= c < 0xE000 else chr(c) for c in range(sys.maxunicode + 1))
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        for m in regex.finditer(pattern, points):
            table[m.start() : m.end()] = kind
    unknown = np.array([unicodedata.category(c) == "Cn" for c in points])
    table[unknown] = NEWER
    return table


def word_starts(points: np.ndarray, kinds: np.ndarray, begins: np.ndarray) -> np.ndarray:
    """True where a word starts, for texts in a row that begin at the given places. NEWER must not occur."""
    n = len(points)
    fresh = np.zeros(n + 4, dtype=bool)
    fresh[begins[begins < n]] = True
    fresh[n] = True
    start = fresh[: n + 1].copy()
    start[1:n] |= kinds[1:] != kinds[:-1]
    # The last space before something else stands alone or, a blank, leads the word.
    turn = np.flatnonzero((kinds[:-1] == SPACE) & (kinds[1:] != SPACE) & ~fresh[1:n])
    start[turn] = True
    start[turn + 1] = points[turn] != 32
    at = np.flatnonzero((points == 39) & start[:n])
    padded = np.concatenate((points, np.zeros(2, points.dtype)))
    for ending in ENDINGS:
        size = len(ending)
        fits = np.ones(len(at), dtype=bool)
        for k, c in enumerate(ending, 1):
            fits &= (padded[at + k] == ord(c)) & ~fresh[at + k]
        start[at[fits] + 1] = False
        start[at[fits] + 1 + size] = True
    return start[:n]


class Vocabulary:
    """What a tokenizer's file says: ids of bytes, merges by rank, added tokens, bytes of ids."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        model, self.path = read["model"], path
        ids: dict[str, int] = model["vocab"]
        letters = {b: _byte_letters().get(b, chr(b)) for b in range(256)}
        of_letter = {letter: b for b, letter in letters.items()}
        self.byte_ids = [ids[letters[b]] for b in range(256)]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            self.merges[ids[left], ids[right]] = rank, ids[left + right]
        # The same as arrays: keys in order with the rank of each; the new id of each rank.
        pairs = np.array(list(self.merges), dtype=np.int64).reshape(-1, 2)
        ranks = np.array(list(self.merges.values()), dtype=np.int64).reshape(-1, 2)
        keys = pairs[:, 0] << 32 | pairs[:, 1]
        order = np.argsort(keys)
        self.keys, self.rank_of_key = np.append(keys[order], NEVER), np.append(ranks[order, 0], NEVER)
        self.made = np.zeros(len(model["merges"]) + 1, dtype=np.int64)
        self.made[ranks[:, 0]] = ranks[:, 1]
        self.added: dict[str, int] = {}
        for token in read.get("added_tokens") or ():
            if token["single_word"] or token["lstrip"] or token["rstrip"]:
                raise ValueError("added tokens with conditions on what is beside them are not supported")
            self.added[token["content"]] = token["id"]
        self.added_pattern = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None
        everything = ids | self.added
        token_bytes = [b""] * (max(everything.values(), default=-1) + 1)
        for token, n in everything.items():
            token_bytes[n] = bytes(map(of_letter.__getitem__, token)) if all(c in of_letter for c in token) else token.encode()
        self.token_n = np.array([len(b) for b in token_bytes], dtype=np.int64)
        self.token_at = np.cumsum(self.token_n) - self.token_n
        self.token_pool = np.frombuffer(b"".join(token_bytes), dtype=np.uint8)

    def merged(self, word: bytes) -> list[int]:
        """The ids of a word: always the pair of least rank next, the leftmost of those."""
        ids = [self.byte_ids[b] for b in word]
        n, rule = len(ids), self.merges.get
        after, ahead = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(found[0], i, found[1]) for i, pair in enumerate(zip(ids, ids[1:], strict=False)) if (found := rule(pair))]
        heapq.heapify(heap)
        while heap:
            rank, i, new = heapq.heappop(heap)
            j = after[i]
            if ids[i] < 0 or j >= n or rule((ids[i], ids[j])) != (rank, new):
                continue  # one of the two has been merged meanwhile
            ids[i], ids[j] = new, -1
            after[i] = k = after[j]
            if k < n:
                ahead[k] = i
                if found := rule((new, ids[k])):
                    heapq.heappush(heap, (found[0], i, found[1]))
            if (h := ahead[i]) >= 0 and (found := rule((ids[h], new))):
                heapq.heappush(heap, (found[0], h, found[1]))
        return [i for i in ids if i >= 0]

    def _ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        keys = left << 32 | right
        place = np.searchsorted(self.keys, keys)
        return np.where(self.keys[place] == keys, self.rank_of_key[place], NEVER)

    def merged_all(self, words: list[bytes]) -> list[list[int]]:
        """The ids of many words. Short ones of one length merge in step: each loses one id a time, or is done."""
        out: list[list[int]] = [[]] * len(words)
        by_size: dict[int, list[int]] = {}
        for i, word in enumerate(words):
            by_size.setdefault(len(word), []).append(i)
        table = np.array(self.byte_ids, dtype=np.int64)
        for size, members in by_size.items():
            if size > IN_STEP or len(members) < 4:
                for i in members:
                    out[i] = self.merged(words[i])
                continue
            who = np.array(members)
            ids = table[np.frombuffer(b"".join(words[i] for i in members), dtype=np.uint8)].reshape(len(members), size)
            ranks = self._ranks(ids[:, :-1], ids[:, 1:])
            while size > 1:
                at = ranks.argmin(axis=1)
                least = ranks[np.arange(len(at)), at]
                done = least == NEVER
                if done.any():
                    for i, row in zip(who[done].tolist(), ids[done].tolist(), strict=True):
                        out[i] = row
                    who, ids, ranks, at, least = who[~done], ids[~done], ranks[~done], at[~done], least[~done]
                if not len(who):
                    break
                size -= 1
                row = np.arange(len(who))
                column = np.arange(size)[None, :]
                ids = np.take_along_axis(ids, column + (column > at[:, None]), axis=1)
                ids[row, at] = self.made[least]
                column = column[:, :-1]
                ranks = np.take_along_axis(ranks, column + (column >= at[:, None]), axis=1)
                for side in (at - 1, at):
                    inside = (side >= 0) & (side < size - 1)
                    r, c = row[inside], side[inside]
                    ranks[r, c] = self._ranks(ids[r, c], ids[r, c + 1])
            for i, row in zip(who.tolist(), ids.tolist(), strict=True):
                out[i] = row
        return out

    def decoded(self, ids: np.ndarray) -> str:
        ids = ids[(ids >= 0) & (ids < len(self.token_n))]
        return gathered(self.token_pool, self.token_at[ids], self.token_n[ids]).tobytes().decode("utf-8", "replace")

    def cut(self, texts: list[str]) -> tuple[bytes, np.ndarray, np.ndarray, dict[int, int]]:
        """Cuts texts into words: (all bytes in a row, where words start in them, at which word each text begins, {word: id} of added tokens)."""
        parts: list[str] = []
        owner_at, special, rare = [], {}, {}
        for text in texts:
            owner_at.append(len(parts))
            if self.added_pattern and self.added_pattern.search(text):
                for i, part in enumerate(self.added_pattern.split(text)):
                    if i % 2:
                        special[len(parts)] = self.added[part]
                    if part:
                        parts.append(part)
            elif text:
                parts.append(text)
        sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
        begins = np.cumsum(sizes) - sizes
        joined = "".join(parts)
        spelled = joined.encode()
        if len(spelled) == len(joined):
            points, byte_at = np.frombuffer(spelled, dtype=np.uint8), None
        else:
            points = np.frombuffer(joined.encode("utf-32-le"), dtype="<u4")
            byte_at = np.flatnonzero((np.frombuffer(spelled, dtype=np.uint8) & 0xC0) != 0x80)
        kinds = _classes()[points]
        newer = np.unique(np.searchsorted(begins, np.flatnonzero(kinds == NEWER), side="right") - 1)
        start = word_starts(points, kinds, begins)
        for i in [*newer.tolist(), *special]:
            lo, hi = int(begins[i]), int(begins[i] + sizes[i])
            start[lo + 1 : hi] = False
            if i not in special:
                start[[lo + a for _, (a, _) in _cutter(self.path).pre_tokenize_str(parts[i])]] = True
        word_at = np.flatnonzero(start)
        first = np.searchsorted(word_at, np.append(begins, len(points))[np.array([*owner_at, len(parts)], dtype=np.int64)])
        rare = {int(np.searchsorted(word_at, begins[i])): n for i, n in special.items()}
        return spelled, word_at if byte_at is None else byte_at[word_at], first, rare


@lru_cache(maxsize=2)
def vocabulary(path: str) -> Vocabulary:
    """A worker's, kept from task to task."""
    return Vocabulary(path)


@lru_cache(maxsize=2)
def _cutter(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path).pre_tokenizer


@lru_cache(maxsize=2)
def _lexicon(name: str) -> Lexicon:
    return Lexicon(SparkFiles.get(name))


def cut_pieces(text: str) -> Iterator[str]:
    """A text in pieces of PIECE characters or a little more; no word crosses from one to the next."""
    at = 0
    while len(text) - at > PIECE and (edge := _EDGE.search(text, at + PIECE)):
        yield text[at : edge.start()]
        at = edge.start()
    yield text[at:] if at else text


def encoded(texts: list[str], words: Vocabulary, lexicon: Lexicon) -> tuple[np.ndarray, np.ndarray]:
    """(the ids of all texts in a row, how many each has)."""
    spelled, starts, first, added = words.cut(texts)
    ends = np.append(starts[1:], len(spelled))
    found, counts, pool = lexicon.lookup(np.frombuffer(spelled, dtype=np.uint8), starts, ends)
    counts *= found
    places = np.cumsum(counts) - counts
    found[list(added)] = True
    # Words that the lexicon does not hold: each different one is merged once.
    number: dict[bytes, int] = {}
    unseen = np.flatnonzero(~found)
    codes = [number.setdefault(spelled[a:b], len(number)) for a, b in zip(starts[unseen].tolist(), ends[unseen].tolist(), strict=True)]
    own = [*words.merged_all(list(number)), *([i] for i in added.values())]
    own_n = np.fromiter(map(len, own), dtype=np.int64, count=len(own))
    own_at = np.cumsum(own_n) - own_n + len(pool)
    which = np.concatenate((unseen, np.array(list(added), dtype=np.int64)))
    codes = np.concatenate((np.array(codes, dtype=np.int64), np.arange(len(number), len(own))))
    places[which], counts[which] = own_at[codes], own_n[codes]
    ids = gathered(np.concatenate((pool, np.fromiter((i for x in own for i in x), dtype=np.int64))), places, counts)
    return ids, np.diff(np.concatenate(([0], np.cumsum(counts)))[first])


def _encode(path: str, name: str, decode: bool):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, lexicon = vocabulary(path), _lexicon(name)

        def made(doc_ids: list, ids: np.ndarray, n: np.ndarray) -> pa.RecordBatch:
            ends = np.concatenate(([0], np.cumsum(n)))
            columns = [pa.array(doc_ids, pa.int64()), pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(ids.astype(np.int32)))]
            if decode:
                columns.append(pa.array([words.decoded(ids[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)], pa.string()))
            return pa.RecordBatch.from_arrays(columns, names=["doc_id", "ids", "text"][: len(columns)])

        for batch in batches:
            doc_ids, texts, size = [], [], 0
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                text = text.as_py() or ""
                if len(text) > BLOCK:  # alone, piece by piece
                    ids = np.concatenate([encoded([p], words, lexicon)[0] for p in cut_pieces(text)])
                    yield made([doc_id], ids, np.array([len(ids)]))
                    continue
                doc_ids.append(doc_id)
                texts.append(text)
                size += len(text)
                if size >= BLOCK:
                    yield made(doc_ids, *encoded(texts, words, lexicon))
                    doc_ids, texts, size = [], [], 0
            if doc_ids:
                yield made(doc_ids, *encoded(texts, words, lexicon))

    return run


def _decode(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            texts = []
            for ids in batch.column(1):
                values = ids.values
                texts.append("" if values is None else words.decoded(values.drop_null().to_numpy(zero_copy_only=False).astype(np.int64)))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(texts, pa.string())], names=["doc_id", "ids", "text"])

    return run


def _count(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            spelled, starts, first, added = words.cut([" " + r.as_py() for r in batch.column(0)])
            n = np.repeat(batch.column(1).to_numpy(), np.diff(first)).tolist()
            counts: dict[bytes, int] = {}
            for i, (a, b) in enumerate(zip(starts.tolist(), [*starts[1:].tolist(), len(spelled)], strict=True)):
                if b - a <= LEXICON_BYTES and i not in added:
                    word = spelled[a:b]
                    counts[word] = counts.get(word, 0) + n[i]
            yield pa.RecordBatch.from_arrays([pa.array(list(counts), pa.binary()), pa.array(list(counts.values()), pa.int64())], names=["word", "n"])

    return run


def _merge(path: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = vocabulary(path)
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(words.merged_all(batch.column(0).to_pylist()), pa.list_(pa.int32()))], names=["word", "ids"])

    return run


def _plain(docs: DataFrame) -> DataFrame:
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def word_counts(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(word, n) over all texts: the words, of at most LEXICON_BYTES, of the runs without a blank that occur twice or more.

    Runs are counted by built-in functions, then only different ones are cut into words. A
    run counts as one behind a blank, and one that lies over a piece's end as two; both
    decide nothing but which words the lexicon holds.
    """
    piece = F.explode(F.sequence(F.lit(0), F.floor(F.length("text") / PIECE).cast("int"))).alias("k")
    pieces = _plain(docs).where("text is not null").select("text", piece).select(F.substring("text", F.col("k") * PIECE + 1, F.lit(PIECE)).alias("text"))
    runs = pieces.select(F.explode(F.split("text", " ")).alias("run")).where("run != ''").groupBy("run").agg(F.count("*").alias("n")).where("n > 1")
    return runs.mapInArrow(_count(tokenizer_path), "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))


def frequent(counts: DataFrame, most: int) -> DataFrame:
    """(word): those above the least number of occurrences that at most so many words reach.

    The number comes from a histogram of counts in steps of a sixteenth, a thousand rows
    at the very most, so no task sorts all words.
    """
    step = F.greatest(F.floor(F.log2("n")).cast("int") - 4, F.lit(0))
    rounded = counts.withColumn("n", F.call_function("shiftleft", F.call_function("shiftright", F.col("n"), step), step))
    least, total = None, 0
    for row in rounded.groupBy("n").count().orderBy(F.desc("n")).collect():
        total += row["count"]
        if total > most:
            break
        least = row["n"]
    return rounded.where(F.lit(False) if least is None else F.col("n") >= least).select("word")


def _handed_out(spark: SparkSession, data: bytes) -> str:
    """Writes a file into the shared folder and has Spark bring it to every executor; its name for SparkFiles."""
    name = f"lexicon-{hashlib.sha256(data).hexdigest()[:32]}"
    folder = spark.conf.get("spark.checkpoint.dir", None) or tempfile.mkdtemp(prefix="notemill-")
    place = spark._jvm.org.apache.hadoop.fs.Path(f"{folder}/{name}")
    files = place.getFileSystem(spark._jsc.hadoopConfiguration())
    out = files.create(place, True)
    out.write(bytearray(data))
    out.close()
    spark.sparkContext.addFile(files.makeQualified(place).toString())
    return name


def lexicon_of(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS) -> str:
    """Compiles the frequent words of all texts; the name that SparkFiles knows the transducer by.

    The driver sees at most so many words of at most LEXICON_BYTES.
    """
    words = frequent(cut(word_counts(docs, tokenizer_path)), most).mapInArrow(_merge(tokenizer_path), "word binary, ids array<int>")
    rows = sorted((bytes(r.word), tuple(r.ids)) for r in words.collect())
    return _handed_out(docs.sparkSession, compiled(rows))


def encode_documents(docs: DataFrame, tokenizer_path: str, most: int = LEXICON_WORDS, decode: bool = False) -> DataFrame:
    """(doc_id, ids array<int>): one row for each row of docs; with decode also text, what the ids decode to, in the same pass."""
    schema = "doc_id long, ids array<int>" + ", text string" * decode
    return _plain(docs).mapInArrow(_encode(tokenizer_path, lexicon_of(docs, tokenizer_path, most), decode), schema)


def decode_documents(encoded_docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, ids, text): the text that the ids stand for."""
    return encoded_docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("ids").cast("array<int>").alias("ids")).mapInArrow(_decode(tokenizer_path), "doc_id long, ids array<int>, text string")


def digests(docs: DataFrame, tokenizer_path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) of encoding and decoding each text."""
    return encode_documents(docs, tokenizer_path, decode=True).select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.concat_ws(",", F.col("ids").cast("array<string>")), 256).alias("ids_sha256"),
        F.sha2("text", 256).alias("decoded_sha256"),
    )
