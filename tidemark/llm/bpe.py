"""Byte-level BPE encoding of a column with a public vocabulary.

Pre-tokenisation uses no regular expression. Code points become classes by one table lookup, each
class is a transition function of a small automaton, and functions compose associatively: all
functions that can arise form a finite monoid, so a prefix scan over a whole batch of texts is a
blocked scan of one-byte element numbers through a composition table. The state before each code
point tells whether a piece begins there. Pieces are looked up in a cache; what isn't there is
merged pair by pair in order of rank. Piece offsets are kept, so ids can be mapped back to text.
"""

from __future__ import annotations

import base64
import heapq
import unicodedata
from collections.abc import Sequence
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Code points handled at once, pieces kept in a worker's cache, longest piece worth caching.
CHUNK = 1 << 20
CACHE = 250_000
CACHED_CHARS = 64
BLOCK = 128

# The suffixes the vocabulary's pattern splits off, and Unicode's White_Space.
ONE_LETTER = "stmd"
TWO_LETTERS = ("re", "ve", "ll")
WHITE_SPACE = [*range(9, 14), 32, 0x85, 0xA0, 0x1680, *range(0x2000, 0x200B), 0x2028, 0x2029, 0x202F, 0x205F, 0x3000]

# Classes of code points in context; 8 more of the same for a text's first code point.
L, N, O, A1, A2, SP_LAST, WS_LAST, WS = range(8)
# States: nothing yet, in letters, digits, others; after a blank that joins what follows; in white
# space; one or two letters of a suffix to come; suffix complete.
START, IN_L, IN_N, IN_O, AFTER_SP, IN_W, C1, C2, END = range(9)


def _step(state: int, cls: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this code point."""
    if cls >= 8:
        return _step(START, cls - 8)
    if cls == L:
        if state in (C1, C2):
            return (END if state == C1 else C1), False
        return IN_L, state not in (IN_L, AFTER_SP)
    if cls == N:
        return IN_N, state not in (IN_N, AFTER_SP)
    if cls == O:
        return IN_O, state not in (IN_O, AFTER_SP)
    if cls in (A1, A2):
        if state in (IN_O, AFTER_SP):
            return IN_O, False
        return (C1 if cls == A1 else C2), True
    if cls == SP_LAST:
        return AFTER_SP, True
    if cls == WS_LAST:
        return IN_W, True
    return IN_W, state != IN_W


class _Scanner:
    """The transition monoid and the scan over it."""

    def __init__(self) -> None:
        identity = tuple(range(9))
        gens = [tuple(_step(s, c)[0] for s in range(9)) for c in range(16)]
        ids, queue = {identity: 0}, [identity]
        for f in queue:
            for g in gens:
                h = tuple(g[x] for x in f)
                if h not in ids:
                    ids[h] = len(ids)
                    queue.append(h)
        for g in gens:
            if g not in ids:
                ids[g] = len(ids)
                queue.append(g)
        n = len(queue)
        self.comp = np.zeros((n, n), np.uint8)
        for a, f in enumerate(queue):
            for b, g in enumerate(queue):
                self.comp[a, b] = ids[tuple(g[x] for x in f)]
        self.size, self.flat = n, self.comp.ravel()
        self.gen = np.array([ids[g] for g in gens], np.uint8)
        self.apply = np.array(queue, np.uint8)
        self.begins = np.array([[_step(s, c)[1] for c in range(16)] for s in range(9)])
        self.table = np.full(0x110000, O, np.uint8)
        for c in range(0x110000):
            k = unicodedata.category(chr(c))[0]
            if k in "LN":
                self.table[c] = L if k == "L" else N
        self.table[WHITE_SPACE] = WS

    def _prefix(self, e: np.ndarray) -> np.ndarray:
        """Composition of e[0..i] for each i."""
        n = len(e)
        if n <= BLOCK:
            out, acc = np.empty_like(e), 0
            for i, x in enumerate(e.tolist()):
                acc = self.comp[acc, x]
                out[i] = acc
            return out
        rows = -(-n // BLOCK)
        x = np.zeros(rows * BLOCK, np.uint8)
        x[:n] = e
        x = np.ascontiguousarray(x.reshape(rows, BLOCK).T)
        for j in range(1, BLOCK):
            x[j] = self.flat[x[j - 1].astype(np.int32) * self.size + x[j]]
        before = np.zeros(rows, np.uint8)
        before[1:] = self._prefix(x[-1])[:-1]
        x = self.flat[before.astype(np.int32) * self.size + x]
        return x.T.ravel()[:n]

    def starts(self, cp: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Positions where pieces begin. cp: code points of all texts; first: positions where texts begin."""
        n = len(cp)
        cls = self.table[cp]
        begin = np.zeros(n + 1, bool)
        begin[first] = True
        begin[n] = True
        white = cls == WS
        last = white.copy()
        last[:-1] &= ~white[1:]
        last &= ~begin[1:]
        cls[last] = WS_LAST
        cls[last & (cp == 32)] = SP_LAST
        quote = np.flatnonzero(cp == 39)
        if len(quote):
            pad = np.concatenate((cp, np.zeros(2, cp.dtype)))
            one, two = pad[quote + 1], pad[quote + 2]
            near = ~begin[np.minimum(quote + 1, n)]
            far = near & ~begin[np.minimum(quote + 2, n)]
            cls[quote[near & np.isin(one, [ord(x) for x in ONE_LETTER])]] = A1
            for a, b in TWO_LETTERS:
                cls[quote[far & (one == ord(a)) & (two == ord(b))]] = A2
        cls[first] += 8
        done = self._prefix(self.gen[cls])
        state = np.zeros(n, np.uint8)
        state[1:] = self.apply[done[:-1], START]
        return np.flatnonzero(self.begins[state, cls])


class Encoder(dict):
    """Vocabulary, scanner and the cache of pieces (the dict itself: piece to ids)."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.scanner = _Scanner()

    def __missing__(self, piece: str) -> tuple[int, ...]:
        ids = self.merge(piece.encode())
        if len(piece) <= CACHED_CHARS:
            if len(self) >= CACHE:
                self.clear()
            self[piece] = ids
        return ids

    def merge(self, b: bytes) -> tuple[int, ...]:
        """Ids of one piece: the adjacent pair of least rank is merged, leftmost first, until none has a rank."""
        ranks = self.ranks
        whole = ranks.get(b)
        if whole is not None:
            return (whole,)
        n = len(b)
        end = list(range(1, n + 1))
        before = list(range(-1, n - 1))
        heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(b[i : i + 2])) is not None]
        heapq.heapify(heap)
        alive = [True] * n
        while heap:
            _, i, stop = heapq.heappop(heap)
            j = end[i] if alive[i] else n
            if j >= n or end[j] != stop:
                continue
            alive[j] = False
            end[i] = stop
            if stop < n:
                before[stop] = i
                r = ranks.get(b[i : end[stop]])
                if r is not None:
                    heapq.heappush(heap, (r, i, end[stop]))
            p = before[i]
            if p >= 0:
                r = ranks.get(b[p:stop])
                if r is not None:
                    heapq.heappush(heap, (r, p, stop))
        return tuple(ranks[b[i : end[i]]] for i in range(n) if alive[i])

    def pieces(self, texts: Sequence[str]) -> tuple[str, np.ndarray, np.ndarray]:
        """All texts joined, where the pieces begin in it, and where the texts begin."""
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        base = np.cumsum(size) - size
        joined = "".join(texts)
        if not joined:
            return joined, np.empty(0, np.int64), base
        cp = np.frombuffer(joined.encode("utf-32-le"), np.uint32)
        return joined, self.scanner.starts(cp, base[size > 0]), base

    def encode_batch(self, texts: Sequence[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Flat ids, ids per text, piece offsets (code points within the text), ids per piece, pieces per text."""
        joined, at, base = self.pieces(texts)
        stops = np.append(at[1:], len(joined)).tolist()
        parts = list(map(self.__getitem__, [joined[a:b] for a, b in zip(at.tolist(), stops)]))
        per_piece = np.fromiter(map(len, parts), np.int32, len(parts))
        flat = np.fromiter(chain.from_iterable(parts), np.int32, int(per_piece.sum()))
        edge = np.searchsorted(at, np.append(base, len(joined)))
        total = np.concatenate(([0], np.cumsum(per_piece)))
        return flat, np.diff(total[edge]), at - np.repeat(base, np.diff(edge)), per_piece, np.diff(edge)


_held: dict[str, Encoder] = {}


def encoder(path: str | None = None) -> Encoder:
    """This process's encoder for the vocabulary file (by default byte_bpe_50k of public_tokenizers)."""
    if path is None:
        import public_tokenizers

        path = public_tokenizers.path("byte_bpe_50k.tiktoken")
    if path not in _held:
        _held[path] = Encoder(path)
    return _held[path]


def _chunks(texts: list[str]):
    """Runs of texts of about CHUNK code points together (a longer text is a run of its own)."""
    run, size = [], 0
    for t in texts:
        if run and size + len(t) > CHUNK:
            yield run
            run, size = [], 0
        run.append(t)
        size += len(t)
    if run:
        yield run


def _lists(sizes: list[np.ndarray], flat: list[np.ndarray]) -> pa.ListArray:
    size = np.concatenate(sizes) if sizes else np.empty(0, np.int64)
    ends = np.concatenate(([0], np.cumsum(size))).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(flat).astype(np.int32) if flat else np.empty(0, np.int32)))


def encode(text: Column, vocabulary: str | None = None) -> Column:
    """``array<int>``: the ids of ``text``, without special tokens (their strings are ordinary text).

    Null, like the empty text, gives the empty list. Texts of any length are encoded whole; rows
    are independent of each other, so repeated rows give repeated results.
    """

    @F.arrow_udf("array<int>")
    def ids(t: pa.Array) -> pa.Array:
        enc, sizes, flat = encoder(vocabulary), [], []
        for run in _chunks(t.fill_null("").to_pylist()):
            f, n, *_ = enc.encode_batch(run)
            sizes.append(n)
            flat.append(f)
        return _lists(sizes, flat)

    return ids(text)


def encode_with_offsets(text: Column, vocabulary: str | None = None) -> Column:
    """Struct of ``ids``, ``piece_at`` (offset of each piece in code points) and ``piece_ids`` (ids of each piece)."""

    @F.arrow_udf("struct<ids:array<int>,piece_at:array<int>,piece_ids:array<int>>")
    def ids(t: pa.Array) -> pa.Array:
        enc, sizes, flat, at, per, count = encoder(vocabulary), [], [], [], [], []
        for run in _chunks(t.fill_null("").to_pylist()):
            f, n, a, p, c = enc.encode_batch(run)
            for xs, x in zip((sizes, flat, at, per, count), (n, f, a, p, c)):
                xs.append(x)
        return pa.StructArray.from_arrays([_lists(sizes, flat), _lists(count, at), _lists(count, per)], ["ids", "piece_at", "piece_ids"])

    return ids(text)


def count_tokens(text: Column, vocabulary: str | None = None) -> Column:
    """``bigint``: the number of ids of ``text``; 0 for null."""

    @F.arrow_udf("bigint")
    def count(t: pa.Array) -> pa.Array:
        enc = encoder(vocabulary)
        n = [enc.encode_batch(run)[1] for run in _chunks(t.fill_null("").to_pylist())]
        return pa.array(np.concatenate(n) if n else np.empty(0, np.int64), pa.int64())

    return count(text)


def decode(ids: Column, vocabulary: str | None = None) -> Column:
    """The text of a list of ids; null gives null, the empty list the empty text."""

    @F.arrow_udf("string")
    def text(t: pa.Array) -> pa.Array:
        enc = encoder(vocabulary)
        if not hasattr(enc, "back"):
            enc.back = {r: b for b, r in enc.ranks.items()}
        return pa.array([None if x is None else b"".join(map(enc.back.__getitem__, x)).decode("utf-8", "replace") for x in t.to_pylist()], pa.string())

    return text(ids)
