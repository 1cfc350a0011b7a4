import random
from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from tidemark.operators.asof import asof_join
from tidemark.operators.timeline import instants, runs_of, sessions, spaced, with_previous

T0 = datetime(2026, 1, 1)


def data(seed=1, n=400):
    r = random.Random(seed)
    return [(r.choice(["hot", "hot", "hot", "a", None]), None if r.random() < 0.05 else T0 + timedelta(hours=r.randint(0, 300)), r.randint(0, 5), i, r.random() < 0.4) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "k string, at timestamp, got int, id int, up boolean")


def kept(rows):
    one = {}
    for k, at, got, i, up in rows:
        if k is not None and at is not None and ((k, at) not in one or one[k, at][:2] < (got, i)):
            one[k, at] = (got, i, up)
    return sorted((k, at, *v) for (k, at), v in one.items())


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_previous_rows_and_failure_runs(spark, seconds):
    rows = data()
    want, seen, run = [], {}, {}
    for k, at, got, i, up in kept(rows):
        run[k] = 0 if up else run.get(k, 0) + 1
        want.append((k, i, seen.get(k), run[k]))
        seen[k] = i
    one = instants(frame(spark, rows), "k", "at", ["got", "id"], seconds)
    prev = {(r.k, r.id): r.before.id if r.before else None for r in with_previous(one, "k", "at", ["id", "up"]).collect()}
    runs = {(r.k, r.id): r.n for r in runs_of(one, "k", "at", ~F.col("up"), "n").collect()}
    assert prev == {(k, i): b for k, i, b, _ in want} and runs == {(k, i): n for k, i, _, n in want}
    assert with_previous(instants(frame(spark, []), "k", "at", ["got"]), "k", "at", ["id"]).count() == 0


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_asof_join_equals_brute_force(spark, seconds):
    left, right = data(2, 150), data(3, 200)
    want = {}
    for k, at, _, i, _ in left:
        ok = [(b_at, b_id) for b_k, b_at, _, b_id, _ in right if k is not None and at is not None and b_k == k and b_at is not None and b_at <= at]
        want[i] = max(ok)[1] if ok else None
    a, b = frame(spark, left).select("k", F.col("at").alias("t"), "id"), frame(spark, right).select("k", "at", F.col("id").alias("rid"))
    got = {r.id: r.rid for r in asof_join(a, b, ["k"], "t", "at", tie="rid", carry=["rid"], bucket_seconds=seconds).collect()}
    assert got == want


@pytest.mark.parametrize("seconds", [3600, 86_400, 10**9])
def test_sessions_over_buckets(spark, seconds):
    rows = data(5, 300)
    want, last, no = {}, {}, {}
    for k, at, *_ in sorted((x for x in rows if x[0] is not None and x[1] is not None), key=lambda x: (x[0], x[1])):
        if k not in last or (at - last[k]).total_seconds() > 7200:
            no[k] = no.get(k, 0) + 1
        last[k] = at
        n, a, _ = want.get((k, no[k]), (0, at, at))
        want[k, no[k]] = (n + 1, a, at)
    got = {(r.k, r.session_no): (r.n, r.began, r.ended) for r in sessions(frame(spark, rows), "k", "at", 7200, seconds).collect()}
    assert got == want


@pytest.mark.parametrize("bucket", [10, 100, 10**6])
def test_spaced_requests(spark, bucket):
    r = random.Random(9)
    rows = [(r.choice(["hot", "hot", "a", None]), r.choice([None, *range(0, 900, 3)]), i) for i in range(300)]
    want, last = {}, {}
    for k, at, i in sorted((x for x in rows if None not in x), key=lambda x: (x[0], x[1], x[2])):
        last[k] = want[i] = max(at, last[k] + 7) if k in last else at
    got = {x.id: x.start for x in spaced(spark.createDataFrame(rows, "k string, at bigint, id int"), "k", "at", "id", 7, bucket).collect()}
    assert got == want
