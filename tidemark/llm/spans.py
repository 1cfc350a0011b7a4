"""Long exact spans shared between records, over a compacted De Bruijn graph of text slices.

Tokens and edges. Minimiser anchors cut every text into slices; where two texts agree, their
anchors agree. An edge runs from one anchor's gram to the next one's, so it is a k-mer of slices
with its text. With grams of GRAM and windows of WINDOW code points, GRAM + 2 * WINDOW <= min_run,
any common run of ``min_run`` code points holds a whole edge of both texts (see ``_check``).

Compaction. Edges that two records hold are kept. An edge all of whose occurrences go on to the
same next edge, which always comes from it, joins it in one path (found by a self-join of the edge
table). A run of ``min_run`` code points around an edge goes on for half of what the edge lacks, to its left or to its right;
so edges are kept only where they agree with another record that far on one side. A path that holds ``min_run`` code points is one span
for all its records; of a shorter one every window of ``min_run`` code points around it may be shared.

Verification. Those windows are read at their coordinates in the source texts, as 128-bit hashes,
and records meet on equal windows. Windows that are held by the same set of records are one class,
so records are paired once a class, not once a window.

Rows in every shuffle are linear in the text; only the pairs asked for can be more.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.joins import counted
from tidemark.tables import checkpoint

MIN_RUN = 200
GRAM = 32
WINDOW = 84
CHUNK = 1 << 20

_BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93)
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _check(min_run: int) -> None:
    """A run has min_run - GRAM + 1 grams; two disjoint windows of them give two anchors both texts choose, so one edge."""
    if GRAM + 2 * WINDOW > min_run:
        raise ValueError(f"min_run must be at least {GRAM + 2 * WINDOW}")


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _power(base: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of base and of its inverse modulo 2**64."""
    held = _powers.get(base)
    if held is None or len(held[0]) <= n:
        both = []
        for b in (base, pow(base, -1, 1 << 64)):
            x = np.full(n + 1, b, np.uint64)
            x[0] = 1
            both.append(np.multiply.accumulate(x))
        held = _powers[base] = (both[0], both[1])
    return held


class _Text:
    """Code points of several texts joined, with hashes of any of their substrings."""

    def __init__(self, texts: list[str]):
        size = np.fromiter(map(len, texts), np.int64, len(texts))
        self.end = np.cumsum(size)
        self.first = self.end - size
        self.cp = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
        self.sums: dict[int, np.ndarray] = {}

    def hash(self, start: np.ndarray, stop: np.ndarray, base: int = _BASES[0]) -> np.ndarray:
        up, down = _power(base, len(self.cp) + 1)
        s = self.sums.get(base)
        if s is None:
            c = _mix(self.cp.astype(np.uint64) + np.uint64(base & 0xFFFFFFFF))
            s = self.sums[base] = np.concatenate((np.zeros(1, np.uint64), np.cumsum(c * up[: len(c)], dtype=np.uint64)))
        return _mix((s[stop] - s[start]) * down[start] + (stop - start).astype(np.uint64))

    def edges(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Text number, start, stop and hash (int64) of every edge, in order."""
        n = len(self.cp)
        none = np.empty(0, np.int64)
        if n < GRAM + WINDOW:
            return none, none, none, none
        at = np.arange(n - GRAM + 1)
        bits = np.uint64(max(1, n.bit_length()))
        key = (self.hash(at, at + GRAM) >> bits << bits) | at.astype(np.uint64)
        width = 1
        while width * 2 <= WINDOW:
            key = np.minimum(key[:-width], key[width:])
            width *= 2
        if width < WINDOW:
            key = np.minimum(key[: -(WINDOW - width)], key[WINDOW - width :])
        doc = np.searchsorted(self.end, np.arange(len(key)), side="right")
        whole = np.arange(len(key)) + WINDOW + GRAM - 1 <= self.end[doc]
        anchors = np.unique(key[whole] & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)
        if len(anchors) < 2:
            return none, none, none, none
        of = np.searchsorted(self.end, anchors, side="right")
        same = of[1:] == of[:-1]
        a, b = anchors[:-1][same], anchors[1:][same] + GRAM
        return of[:-1][same], a, b, self.hash(a, b).view(np.int64)


def _runs(ids: list, texts: list[str], *more: list) -> Iterator[tuple]:
    """Rows in runs of about CHUNK code points."""
    at, size = 0, 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > CHUNK:
            yield tuple(x[at:i] for x in (ids, texts, *more))
            at, size = i, 0
        size += len(t)
    if at < len(texts):
        yield tuple(x[at:] for x in (ids, texts, *more))


def _edge_rows(min_run: int):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import pandas as pd

        for batch in batches:
            for ids, texts in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                of, _, _, h = _Text(texts).edges()
                if not len(h):
                    continue
                nxt, prv = np.zeros_like(h), np.zeros_like(h)
                same = of[1:] == of[:-1]
                nxt[:-1][same] = h[1:][same]
                prv[1:][same] = h[:-1][same]
                t = pd.DataFrame({"doc": np.asarray(ids, np.int64)[of], "edge": h, "prev": prv, "next": nxt}).drop_duplicates()
                yield pa.RecordBatch.from_pandas(t, preserve_index=False)

    return rows


def _side_rows(min_run: int):
    """Each edge of each text with hashes of it and what is beside it: ``l`` to the left, ``r`` to the right (0 where the text ends before)."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, texts in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                t = _Text(texts)
                of, a, b, h = t.edges()
                if not len(h):
                    continue
                more = np.maximum(min_run - (b - a) + 1, 0) // 2
                left, right = a - more >= t.first[of], b + more <= t.end[of]
                sides = [np.where(ok, t.hash(np.where(ok, x, a), np.where(ok, y, b)).view(np.int64), 0) for ok, x, y in ((left, a - more, b), (right, a, b + more))]
                yield pa.RecordBatch.from_arrays([pa.array(np.asarray(ids, np.int64)[of]), pa.array(h), *map(pa.array, sides)], names=["doc", "edge", "l", "r"])

    return rows


def _window_starts(n: int, a: np.ndarray, b: np.ndarray, linked: np.ndarray, min_run: int, every: bool) -> np.ndarray:
    """Starts of the windows to read in a text of n code points: a, b, linked are those of its repeated edges in order."""
    if not every:
        head = np.ones(len(a), bool)
        head[1:] = ~linked[:-1]
        tail = np.append(head[1:], True)
        a, b = a[head], b[tail]
        long = b - a >= min_run
        lo, hi = np.where(long, a, b - min_run), a
    else:
        lo, hi = b - min_run, a
    lo, hi = np.maximum(lo, 0), np.minimum(hi, n - min_run)
    mark = np.zeros(n + 2, np.int32)
    good = lo <= hi
    np.add.at(mark, lo[good], 1)
    np.add.at(mark, hi[good] + 1, -1)
    return np.flatnonzero(np.cumsum(mark) > 0)


def _window_rows(min_run: int, every: bool):
    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            known = [(np.asarray([x["edge"] for x in r], np.int64), np.asarray([x["linked"] for x in r], bool)) for r in batch.column(2).to_pylist()]
            for ids, texts, marks in _runs(batch.column(0).to_pylist(), batch.column(1).to_pylist(), known):
                t = _Text(texts)
                of, a, b, h = t.edges()
                cut = np.searchsorted(of, np.arange(len(texts) + 1))
                docs, starts = [], []
                for i, (edge, linked) in enumerate(marks):
                    s = slice(cut[i], cut[i + 1])
                    order = np.argsort(edge)
                    at = order[np.minimum(np.searchsorted(edge, h[s], sorter=order), len(edge) - 1)]
                    rep = edge[at] == h[s]
                    # a link counts only where the next edge of this text follows at once
                    go = linked[at][rep] & np.append(np.diff(np.flatnonzero(rep)) == 1, False)
                    w = _window_starts(len(texts[i]), a[s][rep] - t.first[i], b[s][rep] - t.first[i], go, min_run, every)
                    docs.append(np.full(len(w), ids[i], np.int64))
                    starts.append(w + t.first[i])
                d, w = np.concatenate(docs), np.concatenate(starts)
                if not len(w):
                    continue
                k1, k2 = (t.hash(w, w + min_run, x).view(np.int64) for x in _BASES)
                if every:
                    pos = w - t.first[np.searchsorted(t.end, w, side="right")]
                    yield pa.RecordBatch.from_arrays([pa.array(k1), pa.array(k2), pa.array(d), pa.array(pos)], names=["k1", "k2", "doc", "pos"])
                else:
                    order = np.lexsort((k2, k1, d))
                    d, k1, k2 = d[order], k1[order], k2[order]
                    new = np.append(True, (np.diff(d) != 0) | (k1[1:] != k1[:-1]) | (k2[1:] != k2[:-1]))
                    yield pa.RecordBatch.from_arrays([pa.array(k1[new]), pa.array(k2[new]), pa.array(d[new])], names=["k1", "k2", "doc"])

    return rows


def _texts(df: DataFrame, doc_id: str, text: str, min_run: int) -> DataFrame:
    return df.select(F.col(doc_id).cast("bigint").alias("doc"), F.col(text).alias("text")).where(F.col("doc").isNotNull() & (F.length("text") >= min_run))


def repeated_paths(docs: DataFrame, min_run: int) -> DataFrame:
    """Edges in which a record may share a run, by record: ``doc``, ``edges``: ``edge``, ``linked`` (it goes on to its one next edge within a nonbranching path).

    Two records that share a run of ``min_run`` code points both keep every edge that lies in it.
    """
    edges = docs.mapInArrow(_edge_rows(min_run), "doc bigint, edge bigint, prev bigint, next bigint")
    held = edges.groupBy("edge").agg(
        F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.min("prev").alias("p0"), F.max("prev").alias("p1"), F.min("next").alias("n0"), F.max("next").alias("n1")
    ).where("d0 < d1")
    held = checkpoint(held.select("edge", "p0", "p1", "n0", "n1"))  # few; read three times below
    one_next = held.where("n0 = n1 and n0 <> 0").select(F.col("edge"), F.col("n0").alias("to"))
    one_prev = held.where("p0 = p1 and p0 <> 0").select(F.col("edge").alias("to"), F.col("p0").alias("edge"))
    links = one_next.join(one_prev, ["edge", "to"]).select("edge", F.lit(True).alias("linked"))
    flags = counted(checkpoint(held.select("edge").join(links, "edge", "left").select("edge", F.coalesce("linked", F.lit(False)).alias("linked"))))
    near = docs.mapInArrow(_side_rows(min_run), "doc bigint, edge bigint, l bigint, r bigint").join(flags, "edge")
    sides = checkpoint(near.select("doc", "edge", "linked", F.explode(F.array("l", "r")).alias("side")).where("side <> 0"))  # of repeated edges only
    twice = sides.groupBy("side").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("side")
    return sides.join(counted(checkpoint(twice)), "side").groupBy("doc").agg(F.collect_set(F.struct("edge", "linked")).alias("edges"))


def _windows(df: DataFrame, doc_id: str, text: str, min_run: int, every: bool) -> DataFrame:
    _check(min_run)
    docs = _texts(df, doc_id, text, min_run)
    marks = checkpoint(repeated_paths(docs, min_run))
    # only texts that may share a run are shuffled
    few = docs.join(counted(marks.select("doc")), "doc", "left_semi")
    rows = few.join(marks, "doc").select("doc", "text", "edges").mapInArrow(_window_rows(min_run, every), "k1 bigint, k2 bigint, doc bigint" + ", pos bigint" * every)
    return checkpoint(rows)  # of those stretches only; read twice


def shared_classes(df: DataFrame, doc_id: str, text: str, min_run: int = MIN_RUN) -> DataFrame:
    """Membership: ``k1``, ``k2`` (class), ``doc``; the records of a class hold one identical run of ``min_run`` code points.

    Every two records with such a run in common are in a class together. Null ids, null texts and
    texts shorter than ``min_run`` are in none. Several rows of one id are one record.
    """
    windows = _windows(df, doc_id, text, min_run, False)
    held = windows.groupBy("k1", "k2").agg(
        F.min("doc").alias("d0"), F.max("doc").alias("d1"), F.count(F.lit(1)).alias("n"), F.bit_xor(F.xxhash64("doc")).alias("x"), F.bit_xor(F.xxhash64("doc", F.lit(1))).alias("y")
    ).where("d0 < d1")
    keys = checkpoint(held.groupBy("d0", "d1", "n", "x", "y").agg(F.min(F.struct("k1", "k2")).alias("k")).select("k.k1", "k.k2"))  # one row a class
    return windows.join(counted(keys), ["k1", "k2"]).select("k1", "k2", "doc")


def shared_pairs(df: DataFrame, doc_id: str, text: str, min_run: int = MIN_RUN) -> DataFrame:
    """``doc_id_a`` < ``doc_id_b``: records with an identical run of at least ``min_run`` code points in common."""
    c = shared_classes(df, doc_id, text, min_run)
    a, b = c.select("k1", "k2", F.col("doc").alias("doc_id_a")), c.select("k1", "k2", F.col("doc").alias("doc_id_b"))
    return a.join(b, ["k1", "k2"]).where("doc_id_a < doc_id_b").select("doc_id_a", "doc_id_b").distinct()


def shared_amount(df: DataFrame, doc_id: str, text: str, min_run: int = MIN_RUN) -> DataFrame:
    """Per record ``doc``: ``chars``, ``shared_chars`` (code points in runs of ``min_run`` or more held by another record), ``share``.

    Null and empty texts have 0 of 0 and share 0. Of several rows of one id the longest text counts.
    """
    windows = _windows(df, doc_id, text, min_run, True)
    keys = windows.groupBy("k1", "k2").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("k1", "k2")

    hit = windows.join(keys, ["k1", "k2"], "left_semi").select("doc", "pos").distinct()
    gap = F.col("pos") - F.lag("pos").over(Window.partitionBy("doc").orderBy("pos"))
    shared = hit.select("doc", F.least(F.coalesce(gap, F.lit(min_run)), F.lit(min_run)).alias("more")).groupBy("doc").agg(F.sum("more").alias("shared_chars"))
    sizes = df.where(F.col(doc_id).isNotNull()).groupBy(F.col(doc_id).cast("bigint").alias("doc")).agg(F.coalesce(F.max(F.length(text)), F.lit(0)).cast("bigint").alias("chars"))
    out = sizes.join(shared, "doc", "left").select("doc", "chars", F.coalesce("shared_chars", F.lit(0)).cast("bigint").alias("shared_chars"))
    return out.withColumn("share", F.when(F.col("chars") > 0, F.col("shared_chars") / F.col("chars")).otherwise(F.lit(0.0)))


def shared_spans(df: DataFrame, doc_id: str, text: str, min_run: int = MIN_RUN) -> DataFrame:
    """Spans of ``min_run`` or more code points that several records hold: ``doc``, ``start`` (from 0), ``length``, ``span_id``,
    ``stretch_start``, ``stretch_length``.

    Rows of one ``span_id`` are all places of one text, in two records at least; ``span_id`` is the hash of its first ``min_run``
    code points, which no other span has. A span goes on for as long as every place of it goes on alike, so a
    run that further records hold a part of comes as several spans, neighbours sharing ``min_run`` - 1 code points. A
    stretch is the whole unbroken part of the record in such spans. Every window of ``min_run`` code points that two records hold
    is in one span at each of its places. Of several texts of one id the longest counts (then the greatest). Rows are linear in the text.
    """
    one = _texts(df, doc_id, text, min_run).groupBy("doc").agg(F.max(F.struct(F.length("text").alias("n"), "text")).alias("t")).select("doc", "t.text")
    windows = _windows(one, "doc", "text", min_run, True)
    keys = windows.groupBy("k1", "k2").agg(F.min("doc").alias("d0"), F.max("doc").alias("d1")).where("d0 < d1").select("k1", "k2")
    hit = windows.join(keys, ["k1", "k2"], "left_semi")
    order = Window.partitionBy("doc").orderBy("pos")
    key = F.struct("k1", "k2")
    side = lambda f, step: F.when(f("pos").over(order) == F.col("pos") + step, f(key).over(order))
    placed = checkpoint(hit.select("doc", "pos", "k1", "k2", side(F.lag, -1).alias("prev"), side(F.lead, 1).alias("next")))
    alike = lambda c: (F.count(c) == F.count(F.lit(1))) & (F.min(c) == F.max(c))
    ways = placed.groupBy("k1", "k2").agg(F.coalesce(alike("prev"), F.lit(False)).alias("from_one"), F.coalesce(alike("next"), F.lit(False)).alias("to_one"))
    at = placed.join(ways, ["k1", "k2"])
    joined = F.coalesce(F.col("prev").isNotNull() & F.col("from_one") & F.lag("to_one").over(order), F.lit(False))
    marked = at.select("doc", "pos", "k1", "k2", F.when(~joined, F.col("pos")).alias("head"), F.when(F.col("prev").isNull(), F.col("pos")).alias("first"))
    upto = order.rowsBetween(Window.unboundedPreceding, 0)
    runs = marked.select("doc", "pos", "k1", "k2", F.max("head").over(upto).alias("start"), F.max("first").over(upto).alias("stretch_start"))
    spans = runs.groupBy("doc", "start", "stretch_start").agg(
        (F.max("pos") - F.col("start") + min_run).alias("length"), F.max(F.when(F.col("pos") == F.col("start"), F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")]))).alias("span_id")
    )
    whole = F.max(F.col("start") + F.col("length")).over(Window.partitionBy("doc", "stretch_start"))
    return spans.select("doc", "start", "length", "span_id", "stretch_start", (whole - F.col("stretch_start")).alias("stretch_length"))
