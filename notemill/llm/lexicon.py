"""A minimal acyclic transducer: words in, sequences of ids out.

Words arrive in byte order. As soon as a word leaves the path of the one before it, the
states that it left are final and are replaced by an equal state that is already there,
so common beginnings and common endings are stored once. Ids stand on the arcs, as early
as all words through an arc agree on them; what only the end of a word decides is the
tail of its last state.

The states are laid out as flat arrays of one file, which readers map into memory: every
process of a machine shares the pages. A state's arcs are a bitset of 256 bytes with the
number of arcs before each quarter of it, so an arc is found by a bit count. Many words
walk at once, one byte of each at a time.
"""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np

#: Names, types and order of the arrays in a file; the header holds the length of each.
LAYOUT = (("bits", np.uint64), ("before", np.int64), ("target", np.int64), ("out_at", np.int64), ("final", np.int64), ("tail_at", np.int64), ("pool", np.int64))


class _State:
    __slots__ = ("arcs", "final", "tail")

    def __init__(self) -> None:
        self.arcs: dict[int, list] = {}  # byte: [ids, a state's number or an open state]
        self.final, self.tail = False, ()


def _agreed(a: tuple, b: tuple) -> int:
    n = 0
    for x, y in zip(a, b, strict=False):
        if x != y:
            break
        n += 1
    return n


def compiled(words: Iterable[tuple[bytes, tuple[int, ...]]]) -> bytes:
    """The file of a transducer for (word, ids), the words distinct, not empty and in byte order."""
    known: dict[tuple, int] = {}
    path, last = [_State()], b""

    def close(depth: int) -> None:
        """Gives the open states deeper than depth their numbers."""
        while len(path) - 1 > depth:
            state = path.pop()
            key = (state.final, state.tail, tuple(sorted((byte, ids, to) for byte, (ids, to) in state.arcs.items())))
            path[-1].arcs[last[len(path) - 1]][1] = known.setdefault(key, len(known))

    for word, ids in words:
        if word <= last:
            raise ValueError("words must be distinct, not empty and in byte order")
        depth = _agreed(word, last)
        close(depth)
        for i in range(depth):
            arc, state = path[i].arcs[word[i]], path[i + 1]
            n = _agreed(arc[0], ids)
            if rest := arc[0][n:]:
                for below in state.arcs.values():
                    below[0] = rest + below[0]
                if state.final:
                    state.tail = rest + state.tail
                arc[0] = arc[0][:n]
            ids = ids[n:]
        for byte in word[depth:]:
            path[-1].arcs[byte] = [ids, None]
            path.append(_State())
            ids = ()
        path[-1].final, last = True, word
    close(0)
    root = path[0]
    states = [*known, (root.final, root.tail, tuple(sorted((byte, ids, to) for byte, (ids, to) in root.arcs.items())))]
    return _laid_out(states)


def _laid_out(states: list[tuple]) -> bytes:
    """The arrays of the states; the last is the root."""
    bits, before, target, pool, out_at, tail_at = [], [], [], [], [0], [0]
    tails: list[int] = []
    for _, tail, arcs in states:
        quarters = [0, 0, 0, 0]
        counts = [0, 0, 0, 0]
        for byte, ids, to in arcs:
            quarters[byte >> 6] |= 1 << (byte & 63)
            counts[byte >> 6] += 1
            target.append(to)
            pool += ids
            out_at.append(len(pool))
        bits += quarters
        at = len(target) - len(arcs)
        for n in counts:
            before.append(at)
            at += n
        tails += tail
        tail_at.append(len(tails))
    tail_at = [len(pool) + n for n in tail_at]
    arrays = dict(bits=bits, before=before, target=target, out_at=out_at, final=[int(f) for f, _, _ in states], tail_at=tail_at, pool=pool + tails)
    packed = [np.array(arrays[name], dtype=kind) for name, kind in LAYOUT]
    return np.array([len(a) for a in packed], dtype=np.int64).tobytes() + b"".join(a.tobytes() for a in packed)


def gathered(pool: np.ndarray, at: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The runs pool[at[i] : at[i] + n[i]], one behind the other."""
    ends = np.cumsum(n)
    return pool[np.repeat(at - (ends - n), n) + np.arange(ends[-1] if len(ends) else 0)]


class Lexicon:
    """A transducer's file, mapped into memory."""

    def __init__(self, path: str):
        whole = np.asarray(np.memmap(path, dtype=np.int64, mode="r"))
        at = len(LAYOUT)
        for (name, kind), n in zip(LAYOUT, whole[:at].tolist(), strict=True):
            setattr(self, name, whole[at : at + n].view(kind))
            at += n
        self.root = len(self.final) - 1

    def lookup(self, text: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(which words text[start:end] are in the lexicon, how many ids each has, the ids of those in it in a row)."""
        n = len(starts)
        found = np.zeros(n, dtype=bool)
        who, state, at = np.arange(n), np.full(n, self.root), starts.copy()
        words, froms, counts = [], [], []

        def give(index: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> None:
            some = hi > lo
            words.append(index[some])
            froms.append(lo[some])
            counts.append((hi - lo)[some])

        while len(who):
            byte = text[at].astype(np.int64)
            quarter = state * 4 + (byte >> 6)
            bits, place = self.bits[quarter], (byte & 63).astype(np.uint64)
            there = (bits >> place & np.uint64(1)).astype(bool)
            arc = self.before[quarter] + np.bitwise_count(bits & ((np.uint64(1) << place) - np.uint64(1)))
            who, at, arc = who[there], at[there] + 1, arc[there].astype(np.int64)
            give(who, self.out_at[arc], self.out_at[arc + 1])
            state = self.target[arc]
            done = at == ends[who]
            ending = done & (self.final[state] > 0)
            found[who[ending]] = True
            give(who[ending], self.tail_at[state[ending]], self.tail_at[state[ending] + 1])
            who, at, state = who[~done], at[~done], state[~done]
        word, lo, count = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (words, froms, counts))
        kept = found[word]
        word, lo, count = word[kept], lo[kept], count[kept]
        order = np.argsort(word, kind="stable")  # a word's own outputs stay in the order of its bytes
        return found, np.bincount(word, weights=count, minlength=n).astype(np.int64), gathered(self.pool, lo[order], count[order])
