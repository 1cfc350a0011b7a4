import random

from pyspark.sql import functions as F

from tidemark.streaming import streams


def brute(rows, limit, seconds):
    out, state = {}, {}
    for at, e, u in sorted(rows):
        end, n = state.get(u, (0, 0))
        if at >= end:
            end, n = at + seconds, 0
        state[u] = (end, n + 1)
        out[e] = n + 1 <= limit
    return out


def test_limiter_over_several_files(spark, tmp_path):
    r = random.Random(8)
    rows = sorted((r.randint(1, 4000), i, r.choice([1, 1, 1, 2, 3])) for i in range(900))
    path = str(tmp_path / "events")
    for part in (rows[:300], rows[300:301], rows[301:]):
        spark.createDataFrame(part, "at bigint, event_id bigint, u bigint").select("event_id", "u", F.timestamp_seconds("at").alias("ts")).coalesce(1).write.mode("append").parquet(path)
    got = streams.run(streams.limited(streams.file_stream(spark, path), "u", limit=3, seconds=60), "append")
    assert {x.event_id: x.allowed for x in got.collect()} == brute(rows, 3, 60)


def test_hourly_counts(spark, tmp_path):
    path = str(tmp_path / "events")
    spark.createDataFrame([(0, "a", 1.0), (3599, "a", 2.0), (3600, "a", 4.0), (10, "b", 1.0)], "at bigint, event_type string, value double").select(F.timestamp_seconds("at").alias("ts"), "event_type", "value").write.parquet(path)
    got = {(r.hour.hour, r.event_type): (r.n, r.total) for r in streams.run(streams.hourly_counts(streams.file_stream(spark, path)), "complete").collect()}
    assert got == {(0, "a"): (2, 3.0), (1, "a"): (1, 4.0), (0, "b"): (1, 1.0)}


def test_failures_reset(spark, tmp_path):
    path = str(tmp_path / "obs")
    ups = [True, False, False, False, True, False]
    spark.createDataFrame([("s", i, i, u) for i, u in enumerate(ups)], "site string, obs_id bigint, at bigint, up boolean").write.parquet(path)
    got = {r.obs_id: (r.failures, r.demoted) for r in streams.run(streams.failure_counter(streams.file_stream(spark, path)), "append").collect()}
    assert [got[i] for i in range(6)] == [(0, False), (1, False), (2, False), (3, True), (0, False), (1, False)]


def test_late_rows_are_left_out_and_sessions_close_once(spark, tmp_path):
    """A row that comes after the watermark has passed its session is dropped; the session comes out once, without it."""
    path = str(tmp_path / "events")
    hour = 3600
    for part in ([("u", 0), ("u", 600)], [("u", 20 * hour)], [("v", 21 * hour)], [("u", 700)], [("w", 40 * hour)]):
        spark.createDataFrame(part, "user_id string, at bigint").select("user_id", F.timestamp_seconds("at").alias("ts"), F.lit(1.0).alias("value")).coalesce(1).write.mode("append").parquet(path)
    import os
    import time

    for i, f in enumerate(sorted((x for x in os.listdir(path) if x.endswith(".parquet")), key=lambda x: os.path.getmtime(f"{path}/{x}"))):
        os.utime(f"{path}/{f}", (time.time() - 1000 + i, time.time() - 1000 + i))
    got = sorted((r.user_id, r.n) for r in streams.run(streams.closed_sessions(streams.file_stream(spark, path, files_per_batch=1)), "append").collect())
    assert got == [("u", 1), ("u", 2), ("v", 1)]  # the late third row of u's first session is in none; w's is still open
