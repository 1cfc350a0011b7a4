"""Deeply nested JSON records as flat, related tables, by Dewey labels.

Every node of a record's tree gets the label of its path of ordinals from the root (position of a
field in its object, position of an element in its array). A node's parent is its label cut by one,
so links between tables need no keys of their own; nodes are grouped into tables by schema path.
Parsing is one pass in Arrow batches; the only shuffle is the one that counts repeated rows once.

Reading, labelling and writing go by explicit stacks, so no depth of nesting is refused.
"""

from __future__ import annotations

import json
import re
from collections.abc import Callable, Iterator, Sequence
from functools import lru_cache
from json.decoder import scanstring

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: A batch is put out when its nodes hold about so many characters and ordinals.
FLUSH = 1 << 22


class Number(str):
    """A JSON number as it is written."""


def _refuse(name: str):
    raise ValueError(name)


_SPACE = re.compile(r"[ \t\n\r]*")
_NUMBER = re.compile(r"-?(?:0|[1-9][0-9]*)(?:\.[0-9]+)?(?:[eE][-+]?[0-9]+)?")
_WORDS = {"t": ("true", True), "f": ("false", False), "n": ("null", None)}


def _read_deep(s: str):
    """``read_json`` for a text of any depth."""
    skip = lambda i: _SPACE.match(s, i).end()
    open_, keys = [], []

    def key(i: int) -> int:
        """Reads a field's name at ``i`` and returns where its value may begin."""
        i = skip(i)
        if s[i : i + 1] != '"':
            raise ValueError("no field name")
        name, i = scanstring(s, i + 1)
        i = skip(i)
        if s[i : i + 1] != ":":
            raise ValueError("no colon")
        keys.append(name)
        return i + 1

    at = 0
    while True:
        at = skip(at)
        c = s[at : at + 1]
        if c in ("[", "{") and c:
            end, empty = ("]", []) if c == "[" else ("}", {})
            at = skip(at + 1)
            if s[at : at + 1] != end:
                open_.append(empty)
                if c == "{":
                    at = key(at)
                continue
            value, at = empty, at + 1
        elif c == '"':
            value, at = scanstring(s, at + 1)
        elif c in _WORDS:
            word, value = _WORDS[c]
            if not s.startswith(word, at):
                raise ValueError("no value")
            at += len(word)
        else:
            m = _NUMBER.match(s, at)
            if m is None:
                raise ValueError("no value")
            value, at = Number(m[0]), m.end()
        while True:  # a value is complete
            at = skip(at)
            if not open_:
                if at != len(s):
                    raise ValueError("text goes on")
                return value
            c = s[at : at + 1]
            at += 1
            if isinstance(open_[-1], list):
                open_[-1].append(value)
                end = "]"
            else:
                open_[-1][keys.pop()] = value
                end = "}"
            if c == ",":
                if end == "}":
                    at = key(at)
                break
            if c != end:
                raise ValueError("not closed")
            value = open_.pop()


def read_json(raw: str | None):
    """The value of a JSON text of any depth with numbers as written; ValueError if it is none (NaN and Infinity aren't JSON)."""
    if raw is None:
        raise ValueError("null")
    try:
        return json.loads(raw, parse_int=Number, parse_float=Number, parse_constant=_refuse)
    except RecursionError:
        return _read_deep(raw)


def _as_number(v: str) -> str:
    return json.dumps(json.loads(v))


def write_json(v, number: Callable[[str], str] = _as_number, sort: bool = False) -> str:
    """Compact JSON of a value of ``read_json``, of any depth. ``number`` writes a number; ``sort``: fields by name."""
    out, stack = [], [(v, True)]
    while stack:
        x, is_value = stack.pop()
        if not is_value:
            out.append(x)
        elif isinstance(x, Number):
            out.append(number(x))
        elif isinstance(x, (list, dict)):
            many = isinstance(x, dict)
            todo = [("{" if many else "[", False)]
            for i, e in enumerate(sorted(x.items()) if many and sort else x.items() if many else x):
                lead = "," if i else ""
                if many:
                    todo += [(f"{lead}{json.dumps(e[0], ensure_ascii=False)}:", False), (e[1], True)]
                else:
                    todo += [(lead, False), (e, True)]
            todo.append(("}" if many else "]", False))
            stack += reversed(todo)
        else:
            out.append(json.dumps(x, ensure_ascii=False))
    return "".join(out)


_KINDS = {type(None): "null", bool: "boolean", Number: "number", str: "string", list: "array", dict: "object"}


@lru_cache(maxsize=64)
def prefixes(paths: frozenset) -> frozenset:
    """The paths above (and of) ``paths``: outside of them nothing wanted can be."""
    return frozenset(x for p in paths for x in ("", *[p[:i] for i, c in enumerate(p) if c in ".["], p))


def label_nodes(record, arrays: frozenset, texts: frozenset, wanted: frozenset | None) -> Iterator[tuple]:
    """(label, path, kind, value, element) of every wanted node of a record; of all of them, if ``wanted`` is None, objects and arrays have no value."""
    above = None if wanted is None else prefixes(wanted)
    stack = [(record, "", (), False)]
    while stack:
        v, path, label, element = stack.pop()
        if path in texts and type(v) is str:
            try:
                v = read_json(v)
            except ValueError:
                pass
        if not element and path in arrays and v is not None and not isinstance(v, list):
            v = [v]
        kind = _KINDS[type(v)]
        if wanted is None or path in wanted:
            if kind in ("array", "object"):
                value = write_json(v) if element and wanted is not None else None
            else:
                value = None if v is None else str(v).lower() if isinstance(v, bool) else str(v)
            yield label, path, kind, value, element
        if kind == "array":
            below = f"{path}[]" if element else path
            if above is None or below in above:
                stack += [(x, below, (*label, i), True) for i, x in enumerate(v)]
        elif kind == "object":
            for i, (k, x) in enumerate(v.items()):
                below = f"{path}.{k}" if path else k
                if above is None or below in above:
                    stack.append((x, below, (*label, i), False))


def shred(df: DataFrame, record_id: str, raw: str, *, arrays: Sequence[str] = (), texts: Sequence[str] = (), paths: Sequence[str] | None = None, flush: int = FLUSH) -> DataFrame:
    """Nodes: ``record_id``, ``label`` (array<int>), ``path``, ``kind``, ``value`` (text), ``element`` (of an array).

    ``arrays``: paths where an array is usual; a single value there counts as an array of one, so
    labels of a path have one depth. ``texts``: paths whose value may be JSON text, read as what it
    says. ``paths``: the paths wanted (all if None). Elements that are null are nodes of kind null
    and keep their position; numbers are given as written; an object or array within a wanted array
    is given as compact JSON (not if all paths are wanted: its own nodes say what it holds). Null, empty and unreadable texts
    give nothing, like a scalar at the root. A task holds nodes of about ``flush`` characters and ordinals beside the record. No depth is refused; labels are as long as a node is deep.
    Rows equal in id and text count once; rows of one id with different texts are read each.
    """
    one = df.select(F.col(record_id).alias("record_id"), F.col(raw).cast("string").alias("raw")).where(F.col("raw").isNotNull()).distinct()
    schema = T.StructType(
        [T.StructField("record_id", one.schema["record_id"].dataType), T.StructField("label", T.ArrayType(T.IntegerType())), T.StructField("path", T.StringType()), T.StructField("kind", T.StringType()), T.StructField("value", T.StringType()), T.StructField("element", T.BooleanType())]
    )
    a, t, w = frozenset(arrays), frozenset(texts), None if paths is None else frozenset(paths)

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            of, found, held = [], [], 0

            def put() -> pa.RecordBatch:
                cols = list(zip(*found))
                return pa.RecordBatch.from_arrays(
                    [b.column(0).take(pa.array(of, pa.int64())), pa.array(cols[0], pa.list_(pa.int32())), *[pa.array(c, pa.string()) for c in cols[1:4]], pa.array(cols[4], pa.bool_())],
                    names=["record_id", "label", "path", "kind", "value", "element"],
                )

            for i, text in enumerate(b.column(1).to_pylist()):
                try:
                    v = read_json(text)
                except ValueError:
                    continue
                if isinstance(v, (dict, list)):
                    for node in label_nodes(v, a, t, w):
                        of.append(i)
                        found.append(node)
                        held += len(node[0]) + len(node[1]) + len(node[3] or "")
                        if held >= flush:
                            yield put()
                            of, found, held = [], [], 0
            if found:
                yield put()

    return one.mapInArrow(rows, schema)


def parent_label(label):
    """The label of the parent: the label cut by one; the root's parent is null."""
    return F.when(F.size(label) > 0, F.slice(label, 1, F.greatest(F.size(label) - 1, F.lit(0))))


def table_of(nodes: DataFrame, path: str) -> DataFrame:
    """The table of one schema path: ``record_id``, ``label``, ``parent`` (label of the parent node), ``kind``, ``value``."""
    return nodes.where(F.col("path") == path).select("record_id", "label", parent_label(F.col("label")).alias("parent"), "kind", "value")
