"""Schemas that drift between files: changes reported, everything read into one table.

Each file's schema is a graph: dotted leaf paths, their name tokens, their types and the nesting
between parents and children. Between consecutive files of a feed, similarity flooding propagates
match scores over the product of both graphs until they settle. Consistent correspondences are selected from them: a removed and
an added path that are each other's best match, then the same among the paths left; only these are checked against the values
of records that both files hold. Renames so confirmed give each path one name per feed, under which values are cast to
one type and united.

Schema graphs (as wide as a schema, not as long as a file) are all that one task holds.
"""

from __future__ import annotations

import re
from collections.abc import Iterator, Sequence
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tidemark.operators.shred import Number, read_json, write_json
from tidemark.tables import by_key, checkpoint

ROUNDS = 10_000
#: Scores within this share of the best are as good.
TIE = 1e-6
SETTLED = 1e-6
FLOOR = 0.05
EVIDENCE = 5


def canonical_number(text: str) -> str:
    """Equal numbers have equal texts: 1, 1.0 and 10e-1 are all 1."""
    try:
        i = int(text)
        return str(i)
    except ValueError:
        f = float(text)
        return str(int(f)) if f.is_integer() and abs(f) < 2**53 else repr(f)


def _text(v) -> str:
    """JSON text that equal values share."""
    return write_json(v, canonical_number, sort=True)


def leaves_of(record: dict) -> list[tuple[str, str, str]]:
    """(dotted path, type, value as text) of every leaf that isn't null; arrays are leaves, empty objects have none."""
    out, stack = [], [("", record)]
    while stack:
        at, o = stack.pop()
        for k, v in o.items():
            path = f"{at}.{k}" if at else k
            if v is None:
                continue
            if isinstance(v, dict):
                stack.append((path, v))
            elif isinstance(v, bool):
                out.append((path, "boolean", "true" if v else "false"))
            elif isinstance(v, Number):
                out.append((path, "number", canonical_number(v)))
            elif isinstance(v, list):
                out.append((path, "array", _text(v)))
            else:
                out.append((path, "string", v))
    return out


def read_leaves(lines: DataFrame, feed: str, file_no: str, line_no: str, payload: str, identities: Sequence[str]) -> DataFrame:
    """One row a leaf: ``feed``, ``file_no``, ``line_no``, ``record`` (identity), ``path``, ``kind``, ``value``.

    Lines that are no JSON object (unreadable, blank, null) are skipped. A record's identity is the
    first of the top-level fields ``identities`` that isn't null, with its name; without any it is null.
    """
    one = lines.select(F.col(feed).cast("string").alias("feed"), F.col(file_no).cast("int").alias("file_no"), F.col(line_no).cast("int").alias("line_no"), F.col(payload).cast("string").alias("payload")).where(F.col("payload").isNotNull())
    names = list(identities)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, record, found = [], [], []
            for i, text in enumerate(b.column(3).to_pylist()):
                try:
                    v = read_json(text)
                except ValueError:
                    continue
                if not isinstance(v, dict):
                    continue
                key = next((f"{k}:{_text(v[k]) if isinstance(v[k], (list, dict)) else v[k]}" for k in names if v.get(k) is not None), None)
                ls = leaves_of(v)
                at += [i] * len(ls)
                record += [key] * len(ls)
                found += ls
            if found:
                idx = pa.array(at)
                cols = [pa.array(c, pa.string()) for c in zip(*found)]
                yield pa.RecordBatch.from_arrays([*[b.column(k).take(idx) for k in range(3)], pa.array(record, pa.string()), *cols], names=["feed", "file_no", "line_no", "record", "path", "kind", "value"])

    return one.mapInArrow(rows, "feed string, file_no int, line_no int, record string, path string, kind string, value string")


@lru_cache(maxsize=1 << 16)
def _grams(name: str) -> frozenset:
    low = f"  {name.lower()} "
    return frozenset(low[i : i + 3] for i in range(len(name) + 1))


@lru_cache(maxsize=1 << 16)
def _tokens(name: str) -> set[str]:
    return {t.lower() for t in re.findall(r"[A-Z]?[a-z]+|[A-Z]+|\d+", name)} or {name}


@lru_cache(maxsize=1 << 18)
def _likeness(a: str, b: str) -> float:
    """Initial similarity of two names: shared tokens and shared letter triples."""
    ta, tb = _tokens(a), _tokens(b)
    ga, gb = _grams(a), _grams(b)
    return max(FLOOR, len(ta & tb) / len(ta | tb), len(ga & gb) / max(1, len(ga | gb)))


def flood(old: dict[str, set[str]], new: dict[str, set[str]]) -> dict[tuple[str, str], float]:
    """Match scores of all (old leaf, new leaf), by similarity flooding.

    Nodes of a schema graph: its paths (inner ones too) and its types. Edges: child of, and has type.
    A pair of nodes of both graphs passes its score to the pairs one edge further, shared equally
    among the neighbours over edges of one label; scores start from name likeness and are scaled to 1.
    Rounds go on until no score moves by SETTLED; ArithmeticError if ROUNDS don't suffice.
    """

    def graph(paths: dict[str, set[str]]) -> tuple[list[str], list[tuple[str, str, str]]]:
        nodes, edges = {"": None}, []
        for p, kinds in paths.items():
            parts = p.split(".")
            for i in range(1, len(parts) + 1):
                q, up = ".".join(parts[:i]), ".".join(parts[: i - 1])
                if q not in nodes:
                    nodes[q] = None
                    edges.append((up, "child", q))
            for k in kinds:
                nodes[f"\x00{k}"] = None
                edges.append((p, "type", f"\x00{k}"))
        return list(nodes), edges

    (na, ea), (nb, eb) = graph(old), graph(new)
    ia, ib = {n: i for i, n in enumerate(na)}, {n: i for i, n in enumerate(nb)}
    start = np.zeros((len(na), len(nb)))
    for a in na:
        for b in nb:
            if a[:1] == b[:1] == "\x00":
                start[ia[a], ib[b]] = float(a == b)
            elif not (a[:1] == "\x00" or b[:1] == "\x00"):
                start[ia[a], ib[b]] = 1.0 if a == b else _likeness(a.rpartition(".")[2], b.rpartition(".")[2])
    # flows of one edge label, both ways, as matrices: score' = P_a^T score P_b over shares of neighbours
    flows = []
    for label in ("child", "type"):
        for way in (0, 1):
            ma, mb = np.zeros((len(na), len(na))), np.zeros((len(nb), len(nb)))
            for m, e, idx in ((ma, ea, ia), (mb, eb, ib)):
                for x, lab, y in e:
                    if lab == label:
                        s, t = (x, y) if way == 0 else (y, x)
                        m[idx[s], idx[t]] = 1
                m /= np.maximum(m.sum(1, keepdims=True), 1)
            flows.append((ma, mb))
    score = start.copy()
    for _ in range(ROUNDS):
        nxt = start + score + sum(ma.T @ (start + score) @ mb for ma, mb in flows)
        nxt /= nxt.max() or 1
        delta, score = np.abs(nxt - score).max(), nxt
        if delta < SETTLED:
            return {(a, b): float(score[ia[a], ib[b]]) for a in old for b in new}
    raise ArithmeticError(f"the scores have not settled after {ROUNDS} rounds")


_CANDIDATE = "feed string, file_no int, old_path string, new_path string, score double"


def select_pairs(score: np.ndarray) -> np.ndarray:
    """The consistent (row, column) correspondences: pairs that are each other's best, then the same among the rows and columns left, and so on. Ties are kept."""
    chosen = np.zeros(score.shape, bool)
    left = score.astype(float)
    while left.size and left.max() > 0:
        best = (left > 0) & (left >= left.max(1, keepdims=True) * (1 - TIE)) & (left >= left.max(0, keepdims=True) * (1 - TIE))
        chosen |= best
        left = np.where(best.any(1, keepdims=True) | best.any(0, keepdims=True), 0, left)
    return chosen


def _candidates(p: pd.DataFrame) -> pd.DataFrame:
    """Scored (removed, added) pairs of two consecutive files' schemas, with whether flooding selects them."""
    old = {r.path: set(r.old) for r in p.itertuples() if r.old is not None}
    new = {r.path: set(r.new) for r in p.itertuples() if r.new is not None}
    gone, come = sorted(set(old) - set(new)), sorted(set(new) - set(old))
    scores = flood(old, new) if gone and come else {}
    best = select_pairs(np.array([[scores[a, b] for b in come] for a in gone])) if scores else None
    rows = [(p["feed"].iloc[0], p["file_no"].iloc[0], a, b, scores[a, b], bool(best[i, j])) for i, a in enumerate(gone) for j, b in enumerate(come) if scores]
    return pd.DataFrame(rows, columns=["feed", "file_no", "old_path", "new_path", "score", "selected"])


def _consistent(p: pd.DataFrame) -> pd.DataFrame:
    """Confirmed pairs in alphabetical order, each path used once."""
    gone, come, rows = set(), set(), []
    for r in p.sort_values(["old_path", "new_path"]).itertuples(index=False):
        if r.old_path not in gone and r.new_path not in come:
            gone.add(r.old_path)
            come.add(r.new_path)
            rows.append(r)
    return pd.DataFrame(rows, columns=p.columns)


def path_changes(leaves: DataFrame, files: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``path``, ``old``, ``new`` (sorted type lists, null if the path isn't there) against the file before."""
    paths = leaves.groupBy("feed", "file_no", "path").agg(F.array_sort(F.collect_set("kind")).alias("kinds"))
    sides = paths.select("feed", "path", "kinds", F.explode(F.array(F.struct(F.col("file_no").alias("t"), F.lit(True).alias("now")), F.struct((F.col("file_no") + 1).alias("t"), F.lit(False).alias("now")))).alias("s"))
    both = files.select("feed", F.explode(F.array(F.col("file_no"), F.col("file_no") + 1)).alias("t")).groupBy("feed", "t").count().where("count = 2").select("feed", "t")
    merged = sides.groupBy("feed", F.col("s.t").alias("t"), "path").agg(F.max(F.when(~F.col("s.now"), F.col("kinds"))).alias("old"), F.max(F.when(F.col("s.now"), F.col("kinds"))).alias("new"))
    return merged.join(both, ["feed", "t"], "left_semi").withColumnRenamed("t", "file_no")


def candidates(changes: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``old_path``, ``new_path``, ``score``, ``selected`` of every removed and added path of ``path_changes``."""
    # only pairs of files that miss and gain paths have candidates
    pair = Window.partitionBy("feed", "file_no")
    torn = by_key(changes, "feed", "file_no").withColumn("torn", F.max(F.col("old").isNull()).over(pair) & F.max(F.col("new").isNull()).over(pair)).where("torn").drop("torn")
    return torn.groupBy("feed", "file_no").applyInPandas(_candidates, f"{_CANDIDATE}, selected boolean")


def schema_changes(leaves: DataFrame, files: DataFrame, evidence: int = EVIDENCE, every: bool = False) -> DataFrame:
    """``feed``, ``file_no``, ``change`` (removed, added, retyped, renamed), ``old_path``, ``new_path``, ``score``.

    ``leaves`` as of ``read_leaves``, ``files``: distinct ``feed``, ``file_no``. A file is compared with the one numbered one less,
    if that exists. A pair that flooding selects is confirmed as renamed if at least ``evidence`` records of both
    files have both values and all are equal in type and value. ``every``: all pairs are checked, whatever their scores
    (the exact way, at the cost of comparing values of every two changed paths). An empty input gives no rows.
    """
    changes = checkpoint(path_changes(leaves, files))  # as wide as schemas; read twice
    scored = candidates(changes)
    scored = scored if every else scored.where("selected")
    sides = scored.select("feed", "file_no", "old_path", "new_path", "score", F.explode(F.array(F.struct((F.col("file_no") - 1).alias("f"), F.col("old_path").alias("path"), F.lit(False).alias("now")), F.struct(F.col("file_no").alias("f"), F.col("new_path").alias("path"), F.lit(True).alias("now")))).alias("s"))
    wanted = sides.select("feed", F.col("s.f").alias("f"), F.col("s.path").alias("path"), F.col("s.now").alias("now"), F.col("file_no").alias("t"), "old_path", "new_path", "score")
    held = leaves.where(F.col("record").isNotNull()).select("feed", F.col("file_no").alias("f"), "path", "record", F.xxhash64("kind", "value").alias("h"))
    met = held.join(wanted, ["feed", "f", "path"]).groupBy("feed", "t", "old_path", "new_path", "score", "record").agg(
        F.min("h").alias("lo"), F.max("h").alias("hi"), F.max("now").alias("now"), F.min("now").alias("was")
    )
    sure = met.where(F.col("now") & ~F.col("was")).groupBy("feed", "t", "old_path", "new_path", "score").agg(F.count(F.lit(1)).alias("n"), F.min(F.col("lo") == F.col("hi")).alias("same"))
    sure = sure.where((F.col("n") >= evidence) & F.col("same")).select("feed", F.col("t").alias("file_no"), "old_path", "new_path", "score")
    renamed = checkpoint(by_key(sure, "feed", "file_no").groupBy("feed", "file_no").applyInPandas(_consistent, _CANDIDATE))
    used = renamed.select("feed", "file_no", F.explode(F.array("old_path", "new_path")).alias("path")).withColumn("used", F.lit(True))
    kind = F.when(F.col("new").isNull(), "removed").when(F.col("old").isNull(), "added").otherwise("retyped")
    rest = changes.where("old is null or new is null or old <> new").join(used, ["feed", "file_no", "path"], "left").where("used is null").select(
        "feed", "file_no", kind.alias("change"), F.when(F.col("old").isNull(), "").otherwise(F.col("path")).alias("old_path"), F.when(F.col("new").isNull(), "").otherwise(F.col("path")).alias("new_path"), F.lit(None).cast("double").alias("score")
    )
    return rest.unionByName(renamed.select("feed", "file_no", F.lit("renamed").alias("change"), "old_path", "new_path", "score"))


def canonical_names(leaves: DataFrame, changes: DataFrame) -> DataFrame:
    """``feed``, ``file_no``, ``path``, ``name``: the last name that each path of each file came to have by renames.

    Only paths that a rename of the feed names are looked at together; any other keeps its name. Where a file holds a path by
    the name that another of its paths comes to have later, that older path is another field and gets a name
    of its own, with the number of its last file.
    """
    paths = leaves.select("feed", "file_no", "path").distinct()
    moves = changes.where("change = 'renamed'").select("feed", "file_no", "old_path", "new_path")
    moved = moves.select("feed", F.explode(F.array("old_path", "new_path")).alias("path")).distinct()
    mine = paths.join(moved, ["feed", "path"], "left_semi")
    events = mine.select("feed", "file_no", "path", F.lit(None).cast("string").alias("to")).unionByName(moves.select("feed", "file_no", F.col("old_path").alias("path"), F.col("new_path").alias("to")))

    def name(p: pd.DataFrame) -> pd.DataFrame:
        ahead: dict[str, str] = {}
        rows = []
        for no, g in sorted(p.groupby("file_no"), key=lambda x: -x[0]):
            held = sorted(g[g["to"].isna()]["path"], key=lambda x: (ahead.get(x, x) == x, x))
            taken = set()
            for path in held:
                if ahead.get(path, path) in taken:
                    ahead[path] = f"{path}@{no}"
                taken.add(ahead.get(path, path))
                rows.append((g["feed"].iloc[0], no, path, ahead.get(path, path)))
            # a rename into this file carries names back to the files before it; its old path was no longer in this one
            ahead |= {r.path: ahead.get(r.to, r.to) for r in g[g["to"].notna()].itertuples()}
        return pd.DataFrame(rows, columns=["feed", "file_no", "path", "name"])

    named = events.groupBy("feed").applyInPandas(name, "feed string, file_no int, path string, name string")
    return paths.join(named, ["feed", "file_no", "path"], "left").select("feed", "file_no", "path", F.coalesce("name", "path").alias("name"))


def unite(leaves: DataFrame, changes: DataFrame) -> DataFrame:
    """One consistent table: ``feed``, ``file_no``, ``line_no``, ``fields`` (name to value), ``kinds`` (name to the type it is cast to), ``record`` (JSON object of the cast values).

    A name whose values have one type in all files of a feed keeps it; one with several is cast to string. ``fields`` holds the values
    as text, ``record`` as what they are cast to. Repeated lines
    stay as they are; a line number that occurs twice in a file is one record, its greatest values standing.
    """
    named = leaves.join(canonical_names(leaves, changes), ["feed", "file_no", "path"])
    kinds = named.groupBy("feed", "name").agg(F.when(F.min("kind") == F.max("kind"), F.min("kind")).otherwise(F.lit("string")).alias("cast_to"))
    cells = named.groupBy("feed", "file_no", "line_no", "name").agg(F.max("value").alias("value")).join(kinds, ["feed", "name"])
    entry = F.array_sort(F.collect_list(F.struct("name", "value", "cast_to")))
    rows = cells.groupBy("feed", "file_no", "line_no").agg(entry.alias("e"))
    pick = lambda f: F.map_from_entries(F.transform("e", lambda x: F.struct(x["name"], x[f])))
    quoted = lambda x: F.regexp_extract(F.to_json(F.array(x)), r"(?s)^\[(.*)\]$", 1)
    typed = F.transform("e", lambda x: F.concat(quoted(x["name"]), F.lit(":"), F.when(x["cast_to"] == "string", quoted(x["value"])).otherwise(x["value"])))
    return rows.select("feed", "file_no", "line_no", pick("value").alias("fields"), pick("cast_to").alias("kinds"), F.concat(F.lit("{"), F.array_join(typed, ","), F.lit("}")).alias("record"))
