from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.history import load_versions, merge_history, version_history
from tidemark.tables import checkpoint

T0 = datetime(2026, 1, 1)
SCHEMA = "k string, at timestamp, got timestamp, id bigint, v string, valid_from string, __b int"


def rows(*xs):
    return [(k, None if d is None else T0 + timedelta(hours=d), T0 + timedelta(hours=g), i, v, "x", 1) for i, (k, d, g, v) in enumerate(xs)]


def history(spark, data, **kw):
    df = spark.createDataFrame(data, SCHEMA)
    h = version_history(df, ["k"], "at", F.xxhash64(F.coalesce("v", F.lit("~"))), latest_by=["got", "id"], **kw)
    return sorted((r.k or "", r.valid_from, r.valid_to) for r in h.collect())


def brute(data):
    best = {}
    for k, at, got, i, v, *_ in data:
        if at is not None and ((k, at) not in best or best[k, at][0] < (got, i)):
            best[k, at] = ((got, i), v)
    out = []
    for k in {k for k, _ in best}:
        seq = sorted((at, v[1]) for (kk, at), v in best.items() if kk == k)
        starts = [at for j, (at, v) in enumerate(seq) if j == 0 or v != seq[j - 1][1]]
        out += [(k or "", a, b) for a, b in zip(starts, [*starts[1:], None])]
    return sorted(out, key=str)


def sample(n=400):
    import random

    r = random.Random(3)
    hot = [("hot", r.randint(0, 900), r.randint(0, 2000), r.choice("ab")) for _ in range(n // 2)]
    return rows(*hot, *[(r.choice(["x", "y", None]), r.choice([None, *range(0, 900, 7)]), r.randint(0, 2000), r.choice(["a", "b", None])) for _ in range(n // 2)])


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_equals_brute_force_for_any_load(spark, seconds):
    data = sample()
    assert sorted(history(spark, data, load_seconds=seconds), key=str) == brute(data)


def test_ties_corrections_and_repeats(spark):
    data = rows(("a", 1, 1, "x"), ("a", 1, 5, "y"), ("a", 1, 5, "z"), ("a", 2, 2, "z"), ("a", 3, 3, "q"))
    got = history(spark, data)
    assert [h[1].hour for h in got] == [1, 3] and got[0][2].hour == 3 and got[1][2] is None
    assert history(spark, data + data) == got


def test_empty(spark):
    assert history(spark, []) == []


def test_merge_equals_whole_with_late_rows(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    how = {"keys": ["k"], "ts": "at", "attr_hash": F.xxhash64(F.coalesce("v", F.lit("~"))), "latest_by": ["got", "id"]}
    cut = F.lit(T0 + timedelta(hours=1200))
    merged = merge_history(version_history(df.where(F.col("got") < cut), **how), df.where(F.col("got") >= cut), df, **how)
    whole = version_history(df, **how)
    key = lambda r: str((r.k, r.valid_from, r.valid_to, r.version_hash, r.last_seen))
    assert sorted(map(key, merged.collect())) == sorted(map(key, whole.collect()))


@pytest.mark.parametrize("hours", [1, 900, 1900])
def test_merge_at_any_cut_and_of_three_batches(spark, hours):
    df = spark.createDataFrame(sample(200), SCHEMA)
    how = {"keys": ["k"], "ts": "at", "attr_hash": F.xxhash64(F.coalesce("v", F.lit("~"))), "latest_by": ["got", "id"]}
    a, b = F.lit(T0 + timedelta(hours=hours)), F.lit(T0 + timedelta(hours=hours + 300))
    key = lambda r: str((r.k, r.valid_from, r.valid_to, r.version_hash, r.last_seen))
    h = checkpoint(merge_history(None, df.where(F.col("got") < a), None, **how))
    h = checkpoint(merge_history(h, df.where((F.col("got") >= a) & (F.col("got") < b)), df.where(F.col("got") < b), **how))
    h = merge_history(h, df.where(F.col("got") >= b), df, **how)
    assert sorted(map(key, h.collect())) == sorted(map(key, version_history(df, **how).collect()))


def test_a_late_row_replays_only_from_the_version_before_it(spark):
    data = rows(*[("a", 24 * i, 24 * i, "xy"[i // 5 % 2]) for i in range(40)])
    df = spark.createDataFrame(data, SCHEMA)
    how = {"keys": ["k"], "ts": "at", "attr_hash": F.xxhash64("v"), "latest_by": ["got", "id"]}
    late = spark.createDataFrame([("a", T0 + timedelta(hours=24 * 31 + 1), T0 + timedelta(hours=2000), 99, "q", "x", 1)], SCHEMA)
    stored = version_history(df, **how)
    # rows before the version open at the late instant aren't read again: they may be gone from the log
    short = df.where(F.col("at") >= F.lit(T0 + timedelta(hours=24 * 25))).union(late)
    key = lambda r: str((r.k, r.valid_from, r.valid_to, r.version_hash, r.last_seen))
    assert sorted(map(key, merge_history(stored, late, short, **how).collect())) == sorted(map(key, version_history(df.union(late), **how).collect()))


def test_the_merge_decides_the_versions(spark):
    df = spark.createDataFrame(rows(*[("a", 24 * i, i, "x") for i in range(10)]), SCHEMA)
    local = load_versions(df, ["k"], "at", F.xxhash64("v"))
    assert local.where("__n = 1").count() == 10  # every load alone would begin a version
    assert version_history(df, ["k"], "at", F.xxhash64("v")).count() == 1
