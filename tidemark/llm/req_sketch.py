"""Relative-error quantile sketches: relative-rank compactors with protected tails.

A sketch is a stack of compactors. Level h holds values of weight 2**h. A full level is sorted and
only a part at the unprotected end is compacted: every second value moves up a level, so values of
the protected tail keep exact ranks and rank error grows only with the distance from that tail.
Sections double and shrink as a level compacts more often, which makes the error relative to the
rank. Sketches of partitions, days or earlier sketches merge by merging their levels.

Every compaction of weight w at a level moves the rank of a value within what it compacts by -w, 0 or +w, that of a
value beyond it not at all. So the sketch also carries its own guarantee: for each level the number of
compactions and how far towards the protected tail they reached, from which ``rank_error`` gives three standard
deviations as a share of n: of any rank, or of that of a value, which is far less near the protected tail.
Coins are random and alternate: a level's second compaction takes the values that its first would have left.
"""

from __future__ import annotations

import random
import struct
from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

SECTION = 32
PENDING = 1 << 18
#: A task puts out its partial sketches and begins anew when they hold about so many bytes.
HELD_BYTES = 64 << 20


class ReqSketch:
    """Quantile sketch with high accuracy at the upper end (``high=True``) or the lower end."""

    def __init__(self, k: int = SECTION, high: bool = True, seed: object = 0):
        self.k, self.high, self.n = k, high, 0
        self.levels: list[np.ndarray] = [np.empty(0)]
        self.state = [0]
        self.times, self.reach = [0], [-np.inf if high else np.inf]  # compactions of a level, and the value nearest the protected tail in any
        self.coins: dict[int, int] = {}
        self.random = random.Random(repr(seed))

    def _level(self, h: int) -> None:
        if h == len(self.levels):
            self.levels.append(np.empty(0))
            self.state.append(0)
            self.times.append(0)
            self.reach.append(-np.inf if self.high else np.inf)

    def _sections(self, h: int) -> tuple[int, int]:
        """Section size (even) and number of sections of level h after its compactions so far."""
        size, count, past = float(self.k), 3, self.state[h]
        while past >= (1 << (count - 1)) and size > 8:
            size, count = size / 2**0.5, count * 2
        return max(4, 2 * round(size / 2)), count

    def _capacity(self, h: int) -> int:
        size, count = self._sections(h)
        return 2 * size * count

    def add(self, values: np.ndarray) -> None:
        """Adds values; NaN isn't a value."""
        values = np.asarray(values, dtype=np.float64)
        values = values[~np.isnan(values)]
        self.n += len(values)
        self.levels[0] = np.concatenate((self.levels[0], values))
        self._compress()

    def merge(self, other: "ReqSketch") -> None:
        """Merges another sketch's levels into this one."""
        self.n += other.n
        farther = max if self.high else min
        for h, v in enumerate(other.levels):
            self._level(h)
            self.levels[h] = np.concatenate((self.levels[h], v))
            self.state[h] |= other.state[h]
            self.times[h] += other.times[h]
            self.reach[h] = farther(self.reach[h], other.reach[h])
        self._compress()

    def _compress(self) -> None:
        h = 0
        while h < len(self.levels):
            while len(self.levels[h]) > self._capacity(h):
                self._compact(h)
            h += 1

    def _compact(self, h: int) -> None:
        """Halves the part of level h that isn't protected: all beyond capacity, and as many sections as the state asks."""
        size, count = self._sections(h)
        v = np.sort(self.levels[h])
        ones = 0
        while self.state[h] >> ones & 1:
            ones += 1
        keep = max(len(v) - max(len(v) - 2 * size * count, 0) - size * (min(ones, count - 1) + 1), size * count)
        keep += (len(v) - keep) & 1
        if not self.high:
            v = v[::-1]
        out, rest = v[: len(v) - keep], v[len(v) - keep :]
        coin = self.coins.pop(h, None)
        if coin is None:
            coin = self.random.getrandbits(1)
            self.coins[h] = 1 - coin
        self._level(h + 1)
        self.levels[h + 1] = np.concatenate((self.levels[h + 1], out[coin::2]))
        self.levels[h] = rest
        self.state[h] += 1
        self.times[h] += 1
        self.reach[h] = max(self.reach[h], float(out[-1])) if self.high else min(self.reach[h], float(out[-1]))

    def quantile(self, q: float) -> float | None:
        """The least value whose estimated rank is at least q*n; None if empty."""
        if not self.n:
            return None
        v = np.concatenate(self.levels)
        w = np.concatenate([np.full(len(x), 2.0**h) for h, x in enumerate(self.levels)])
        order = np.argsort(v, kind="stable")
        c = np.cumsum(w[order])
        return float(v[order][min(np.searchsorted(c, max(q * c[-1], 1e-9) - 1e-9), len(v) - 1)])

    def rank(self, x: float) -> float:
        """Estimated number of values <= x."""
        return float(sum(2.0**h * np.count_nonzero(v <= x) for h, v in enumerate(self.levels)))

    def rank_error(self, x: float | None = None) -> float:
        """Three standard deviations of the error of the rank of ``x`` (of any value if None), as a share of n; 0 while nothing was compacted there."""
        touched = lambda r: x is None or (x <= r if self.high else x >= r)
        return 3 * sum(t * 4.0**h for h, (t, r) in enumerate(zip(self.times, self.reach)) if t and touched(r)) ** 0.5 / self.n if self.n else 0.0

    @property
    def bytes(self) -> int:
        """About what the sketch holds in memory."""
        return 1024 + sum(96 + 8 * len(v) for v in self.levels)

    def to_bytes(self) -> bytes:
        head = struct.pack("<HBqH", self.k, self.high, self.n, len(self.levels))
        return head + b"".join(struct.pack("<qqdi", s, t, r, len(v)) for s, t, r, v in zip(self.state, self.times, self.reach, self.levels)) + b"".join(v.tobytes() for v in self.levels)

    @classmethod
    def from_bytes(cls, b: bytes, seed: object = 0) -> "ReqSketch":
        k, high, n, count = struct.unpack_from("<HBqH", b)
        s = cls(k, bool(high), seed)
        at, each = struct.calcsize("<HBqH"), struct.calcsize("<qqdi")
        head = [struct.unpack_from("<qqdi", b, at + each * i) for i in range(count)]
        at += each * count
        s.n, s.levels = n, []
        s.state, s.times, s.reach = ([x[i] for x in head] for i in range(3))
        for *_, size in head:
            s.levels.append(np.frombuffer(b, np.float64, size, at))
            at += 8 * size
        return s


def _codes(batch: pa.RecordBatch, groups: int) -> tuple[np.ndarray, list[tuple]]:
    """A group number for each row and the groups' keys (columns 0 to groups-1)."""
    code = np.zeros(batch.num_rows, np.int64)
    for i in range(groups):
        d = batch.column(i).dictionary_encode()
        n = len(d.dictionary) + 1
        # numbered anew after each column, so that many columns of many values don't overflow
        code = np.unique(code * n + d.indices.fill_null(n - 1).to_numpy(zero_copy_only=False), return_inverse=True)[1]
    first = pa.array(np.unique(code, return_index=True)[1])
    keys = list(zip(*[batch.column(i).take(first).to_pylist() for i in range(groups)])) if groups else [()] * len(first)
    return code, keys


def build_sketches(df: DataFrame, group: Sequence[str], value: str, *, k: int = SECTION, high: bool = True, pending_rows: int = PENDING, held_bytes: int = HELD_BYTES) -> DataFrame:
    """Partial sketches: ``group`` columns, ``part``, ``n``, ``sketch`` (binary), several rows a group (one or more a partition).

    Null and NaN values are no values; a group without values has no row. Null group keys form a
    group. A task holds at most ``held_bytes`` of sketches, however many groups it meets, and ``pending_rows`` raw values:
    beyond that it puts out what it has, since partial sketches of a group merge.
    ``df`` may have any other columns.
    """
    slim = df.where(F.col(value).isNotNull()).select(*group, F.col(value).cast("double").alias("__v"))
    fields = [slim.schema[g] for g in group]
    out = T.StructType([*fields, T.StructField("part", T.IntegerType()), T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())])
    width = len(group)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part = TaskContext.get().partitionId()
        held: dict[tuple, ReqSketch] = {}
        raw: dict[tuple, list[np.ndarray]] = {}
        pending = 0

        def flush() -> None:
            for key, xs in raw.items():
                s = held.get(key)
                if s is None:
                    s = held[key] = ReqSketch(k, high, (key, part))
                s.add(np.concatenate(xs))
            raw.clear()

        def put(schema: pa.Schema) -> Iterator[pa.RecordBatch]:
            rows = [(key, s) for key, s in held.items() if s.n]
            if rows:
                cols = [pa.array([key[i] for key, _ in rows], schema.field(i).type) for i in range(width)]
                cols += [pa.array([part] * len(rows), pa.int32()), pa.array([s.n for _, s in rows], pa.int64()), pa.array([s.to_bytes() for _, s in rows], pa.binary())]
                yield pa.RecordBatch.from_arrays(cols, names=[*group, "part", "n", "sketch"])
            held.clear()

        schema = None
        for b in batches:
            schema = b.schema
            if not b.num_rows:
                continue
            inv, keys = _codes(b, width)
            order = np.argsort(inv, kind="stable")
            v = b.column(width).to_numpy(zero_copy_only=False)[order]
            ends = np.searchsorted(inv[order], np.arange(len(keys) + 1))
            for i, key in enumerate(keys):
                raw.setdefault(key, []).append(v[ends[i] : ends[i + 1]])
            pending += b.num_rows
            if pending >= pending_rows:
                flush()
                pending = 0
                if sum(s.bytes for s in held.values()) > held_bytes:
                    yield from put(schema)
        flush()
        yield from put(schema)

    return slim.mapInArrow(build, out)


def merge_sketches(sketches: DataFrame, group: Sequence[str], *, fan: int = 64) -> DataFrame:
    """One row a group: ``group``, ``n``, ``sketch``. Merges in two rounds, so no task gets more than parts/``fan`` sketches of a group."""
    fields = [sketches.schema[g] for g in group]
    tail = [T.StructField("n", T.LongType()), T.StructField("sketch", T.BinaryType())]
    part = T.StructField("part", T.IntegerType())

    def merger(names: list[str]):
        def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            """Rows come sorted by ``names``: a key's sketches follow each other."""
            last, total, done = None, None, []
            for b in batches:
                cols = [b.column(i).to_pylist() for i in range(len(names))]
                for *key, raw in zip(*cols, b.column(len(names)).to_pylist()):
                    s = ReqSketch.from_bytes(raw, key)
                    if total is not None and key == last:
                        total.merge(s)
                        continue
                    if total is not None:
                        done.append((last, total))
                    last, total = key, s
                types = [b.schema.field(i).type for i in range(len(names))]
                if len(done) >= 1000:
                    yield batch(done, types)
                    done = []
            if total is not None:
                yield batch([*done, (last, total)], types)

        def batch(rows: list, types: list) -> pa.RecordBatch:
            cols = [pa.array([key[i] for key, _ in rows], t) for i, t in enumerate(types)]
            return pa.RecordBatch.from_arrays([*cols, pa.array([s.n for _, s in rows], pa.int64()), pa.array([s.to_bytes() for _, s in rows], pa.binary())], names=[*names, "n", "sketch"])

        return merge

    first = sketches.select(*group, F.pmod(F.col("part"), F.lit(fan)).alias("slot"), F.col("part").alias("__order"), "sketch").withColumnRenamed("slot", "part")
    first = first.repartition(*group, "part").sortWithinPartitions(*group, "part", "__order").select(*group, "part", "sketch")
    first = first.mapInArrow(merger([*group, "part"]), T.StructType([*fields, part, *tail]))
    second = first.repartition(*group).sortWithinPartitions(*group, "part").select(*group, "sketch")
    return second.mapInArrow(merger(list(group)), T.StructType([*fields, *tail]))


def quantiles(sketches: DataFrame, qs: Sequence[float]) -> Column:
    """Array of the quantiles ``qs`` of column ``sketch``."""
    qs = list(qs)

    @F.pandas_udf("array<double>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: [ReqSketch.from_bytes(b).quantile(q) for q in qs])

    return read(sketches["sketch"])


def quantile_errors(sketches: DataFrame, qs: Sequence[float]) -> Column:
    """For each of the quantiles ``qs`` the sketch's own bound of the error of its rank, as a share of n."""
    qs = list(qs)

    @F.pandas_udf("array<double>")
    def read(s: pd.Series) -> pd.Series:
        return s.map(lambda b: [(k := ReqSketch.from_bytes(b)).rank_error(k.quantile(q)) for q in qs])

    return read(sketches["sketch"])
