import random

import pytest

from tidemark.llm.top_groups import top_n

SCHEMA = "g string, h string, total int, rk bigint, name string, __g0 int, __bound int"


def brute(data, n):
    out = []
    for key in {(x[0], x[1]) for x in data}:
        own = sorted((x for x in data if (x[0], x[1]) == key), key=lambda x: (x[2] is None, -(x[2] or 0), x[3] is None, x[3] or 0, x[4] is None, x[4] or ""))
        out += [(*x[:5], i + 1) for i, x in enumerate(own[:n])]
    return sorted(out, key=str)


def run(spark, data, n, parts=7):
    df = spark.createDataFrame([(*x, 1, 2) for x in data], SCHEMA).repartition(parts)
    got = top_n(df, ["g", "h"], [("total", True), ("rk", False), ("name", False)], n)
    return sorted(((r.g, r.h, r.total, r.rk, r.name, r.pos) for r in got.collect()), key=str)


def test_hot_group_ties_and_nulls(spark):
    r = random.Random(1)
    data = [("hot", None, r.choice([None, 5, 5, 5, 9]), r.choice([None, 1, 2]), f"n{i}") for i in range(700)]
    data += [(r.choice(["a", "b", None]), r.choice(["x", None]), r.randint(0, 9), r.randint(0, 3), f"m{i}") for i in range(700)]
    assert run(spark, data, 5) == brute(data, 5)
    assert run(spark, data, 1, 1) == brute(data, 1)


def test_more_than_there_are_repeats_and_empty(spark):
    data = [("a", "x", 1, 1, "n")] * 3 + [("b", "x", None, None, None)]
    assert run(spark, data, 10) == brute(data, 10)
    assert run(spark, [], 5) == []


def test_bound_prunes_ties(spark):
    data = [("g", "x", 100, 1, f"{i:05d}") for i in range(5000)]
    assert [x[4] for x in sorted(run(spark, data, 3), key=lambda x: x[5])] == ["00000", "00001", "00002"]


def test_clashing_name_is_refused(spark):
    with pytest.raises(ValueError):
        top_n(spark.createDataFrame([(1, 2)], "g int, pos int"), ["g"], [("pos", True)], 1)


def test_least_numbers_and_maps(spark):
    df = spark.createDataFrame([(1, -(2**63), -(2**31), {"a": 1}), (1, 2**63 - 1, 0, {"b": 2}), (1, None, 5, None), (1, -(2**63), -(2**31), {"a": 2})], "g int, a bigint, b int, m map<string,int>")
    got = [(r.a, r.b) for r in top_n(df, ["g"], [("a", True), ("b", True)], 4).orderBy("pos").collect()]
    assert got == [(2**63 - 1, 0), (-(2**63), -(2**31)), (-(2**63), -(2**31)), (None, 5)]
    d = spark.createDataFrame([(1, 0.5), (1, float("-inf")), (1, None), (1, 7.25)], "g int, a double")
    assert [r.a for r in top_n(d, ["g"], [("a", True)], 3).orderBy("pos").collect()] == [7.25, 0.5, float("-inf")]
