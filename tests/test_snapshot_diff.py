import random

import pytest
from pyspark.sql import functions as F

from tidemark.operators.snapshot_diff import snapshot_changes

SCHEMA = "s int, k string, at int, a string, b string, __rows int, change string"
NULL = "~"


def run(spark, data, **kw):
    df = spark.createDataFrame([(*x, 1, "c") for x in data], SCHEMA)
    h = lambda c: F.xxhash64(F.coalesce(c, F.lit(NULL)))
    got = snapshot_changes(df, "s", F.col("k"), {"a": h("a"), "b": h("b")}, latest_by=["at"], **kw)
    return sorted(tuple(r) for r in got.collect())


def brute(data):
    one = {}
    for s, k, at, a, b in data:
        if s is not None and k is not None and ((s, k) not in one or (one[s, k][0] or -1) < (at or -1)):
            one[s, k] = (at, a, b)
    nums, out = {s for s, *_ in data if s is not None}, []
    for t in nums:
        if t - 1 not in nums:
            continue
        now, was = ({k: v for (s, k), v in one.items() if s == x} for x in (t, t - 1))
        out += [(t, k, "added") for k in now.keys() - was.keys()] + [(t, k, "removed") for k in was.keys() - now.keys()]
        for k in now.keys() & was.keys():
            out += [(t, k, n) for n, i in (("a", 1), ("b", 2)) if now[k][i] != was[k][i]]
    return sorted(out)


def sample():
    r = random.Random(5)
    return [(s, f"k{k}", 10 * s + r.randint(0, 1) * 0, r.choice(["x", None]) if r.random() < 0.2 else "x", r.choice("pq") if r.random() < 0.1 else "p") for s in (1, 2, 3, 5, 6) for k in range(300) if r.random() < 0.9]


@pytest.mark.parametrize("kw", [{}, {"buckets": 1, "chunk_rows": 4}, {"buckets": 3, "chunk_rows": 1000}])
def test_equals_brute_force_for_any_chunking(spark, kw):
    data = sample()
    want = brute(data)
    assert run(spark, data, **kw) == want and len(want) > 100
    assert run(spark, data + data, **kw) == want


def test_nulls_latest_and_gaps(spark):
    data = [(1, "k", 1, "x", "p"), (1, "k", 2, None, "p"), (2, "k", 3, "x", None), (2, None, 3, "x", "p"), (None, "z", 1, "x", "p"), (4, "n", 1, "x", "p")]
    assert run(spark, data) == [(2, "k", "a"), (2, "k", "b")]


def test_equal_snapshots_and_empty(spark):
    assert run(spark, [(s, f"k{i}", 1, "x", "p") for s in (1, 2) for i in range(50)]) == []
    assert run(spark, []) == []
