import numpy as np
import pytest
from pyspark.sql import functions as F

from tidemark.llm.req_sketch import ReqSketch, build_sketches, merge_sketches, quantile_errors, quantiles


@pytest.mark.parametrize("order", ["random", "sorted", "reversed"])
@pytest.mark.parametrize("high", [True, False])
def test_rank_error_is_relative_to_the_protected_tail(order, high):
    n = 200_000
    v = np.arange(n, dtype=float)
    if order == "random":
        np.random.default_rng(1).shuffle(v)
    if order == "reversed":
        v = v[::-1]
    s = ReqSketch(high=high)
    for part in np.array_split(v, 50):
        s.add(part)
    assert sum(map(len, s.levels)) < n / 25
    for q in (0.001, 0.01, 0.1, 0.5, 0.9, 0.99, 0.999):
        tail = (1 - q) if high else q
        off = abs(s.quantile(q) / n - q)
        bound = s.rank_error(s.quantile(q))
        assert off <= bound + 1.5 / n and bound <= s.rank_error() and off <= 0.02 * tail + 1e-4, (q, off, bound)
    # the bound itself is multiplicative near the protected tail
    assert all(s.rank_error(s.quantile(1 - t if high else t)) <= 0.1 * t + 1e-4 for t in (0.001, 0.01, 0.1, 0.5))


def test_merging_in_any_shape_keeps_the_bound():
    r = np.random.default_rng(2)
    v = r.exponential(1000, 120_000)
    parts = []
    for x in np.array_split(v, 64):
        s = ReqSketch()
        s.add(x)
        parts.append(ReqSketch.from_bytes(s.to_bytes()))
    while len(parts) > 1:
        a, b = parts.pop(0), parts.pop(0)
        a.merge(b)
        parts.append(a)
    s, sv = parts[0], np.sort(v)
    assert s.n == len(v) and s.rank_error() < 0.03
    for q in (0.25, 0.5, 0.9, 0.99):
        assert abs(np.searchsorted(sv, s.quantile(q)) / len(v) - q) <= s.rank_error(s.quantile(q)) + 1.5 / len(v)


def test_small_sketches_are_exact():
    s = ReqSketch()
    s.add(np.array([3.0, 1.0, np.nan, 2.0]))
    assert s.n == 3 and s.quantile(0.5) == 2.0 and s.quantile(1) == 3.0 and s.quantile(0) == 1.0 and s.rank_error() == 0
    assert ReqSketch().quantile(0.5) is None and ReqSketch().rank_error() == 0 and ReqSketch().rank_error(1.0) == 0


def test_groups_partitions_and_days(spark):
    data = [("a", None, d, float(i)) for d in range(3) for i in range(1000)] + [(None, "x", 1, 5.0)] * 4 + [("b", "x", 1, None), ("b", "y", 2, float("nan"))]
    df = spark.createDataFrame(data, "g string, h string, day int, v double").repartition(5)
    whole = merge_sketches(build_sketches(df, ["g", "h"], "v"), ["g", "h"], fan=2)
    got = {(r.g, r.h): (r.n, r.q[0], r.e) for r in whole.select("g", "h", "n", quantiles(whole, [0.5]).alias("q"), quantile_errors(whole, [0.5])[0].alias("e")).collect()}
    assert set(got) == {("a", None), (None, "x")} and got[None, "x"] == (4, 5.0, 0.0)
    assert got["a", None][0] == 3000 and abs(got["a", None][1] - 500) < 10
    days = merge_sketches(build_sketches(df, ["g", "h", "day"], "v"), ["g", "h", "day"]).withColumn("part", F.col("day"))
    again = merge_sketches(days, ["g", "h"])
    assert {(r.g, r.h): r.n for r in again.collect()} == {("a", None): 3000, (None, "x"): 4}


def test_empty_table(spark):
    df = spark.createDataFrame([], "g string, v double")
    assert merge_sketches(build_sketches(df, ["g"], "v"), ["g"]).count() == 0


def test_a_task_holds_few_bytes_however_many_groups(spark):
    df = spark.range(50_000).selectExpr("id % 700 as g", "cast(id % 5000 as double) as v").coalesce(1).where("v < 5000")
    parts = build_sketches(df, ["g"], "v", pending_rows=100, held_bytes=20_000)
    assert parts.count() > 2 * 700  # put out in several goes
    whole = merge_sketches(parts, ["g"])
    assert {(r.g, r.n) for r in whole.select("g", "n").collect()} == {(i, len(range(i, 50_000, 700))) for i in range(700)}


def test_coins_alternate_and_bytes_keep_the_bound():
    s = ReqSketch(seed=7)
    s.add(np.random.default_rng(3).random(50_000))
    again = ReqSketch.from_bytes(s.to_bytes())
    assert again.rank_error() == s.rank_error() > 0 and again.rank_error(0.999) == s.rank_error(0.999) < s.rank_error(0.5)
    assert set(s.coins.values()) <= {0, 1} and again.quantile(0.9) == s.quantile(0.9)


def test_many_group_columns_of_many_values(spark):
    cols = [f"((id * {7 * i + 3}) % 997) as g{i}" for i in range(8)]
    df = spark.range(4000).selectExpr(*cols, "cast(id as double) as v")
    names = [f"g{i}" for i in range(8)]
    got = merge_sketches(build_sketches(df, names, "v"), names)
    want = {tuple(r)[:-1]: r[-1] for r in df.groupBy(*names).count().collect()}
    assert {tuple(r[n] for n in names): r.n for r in got.collect()} == want and len(want) == 997
    assert build_sketches(df, [], "v").agg({"n": "sum"}).first()[0] == 4000
