"""Structured Streaming forms: windowed counts with a watermark, and per-key state machines.

Each runs what is available and stops, writing to a folder below the shared checkpoint folder.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.tables import remove, shared_folder

LIMIT, WINDOW_SECONDS = 8, 60


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/stream-{uuid.uuid4().hex}"


def file_stream(spark: SparkSession, path: str, files_per_batch: int | None = None) -> DataFrame:
    """A stream of the parquet file or folder at ``path``, with the schema it has now.

    The path is given as a pattern of itself, since a plain path must be a folder. ``files_per_batch`` bounds a micro-batch, and so
    what the state machines below hold of one key at a time: they put a key's events of one micro-batch in order of time.
    """
    reader = spark.readStream.schema(spark.read.parquet(path).schema)
    reader = reader if files_per_batch is None else reader.option("maxFilesPerTrigger", files_per_batch)
    return reader.parquet(f"{path[:-1]}[{path[-1]}]")


def run(stream: DataFrame, mode: str) -> DataFrame:
    """Runs ``stream`` over all that is available and returns what it put out (the last batch for ``complete``)."""
    spark, folder = stream.sparkSession, _folder(stream.sparkSession)
    out = f"{folder}/out"

    def put(batch: DataFrame, batch_id: int) -> None:
        # one folder a batch: a batch run again after a failure replaces its own output
        batch.write.mode("overwrite").parquet(out if mode == "complete" else f"{out}/batch={batch_id}")

    q = stream.writeStream.outputMode(mode).foreachBatch(put).option("checkpointLocation", f"{folder}/state").trigger(availableNow=True).start()
    q.awaitTermination()
    remove(spark, f"{folder}/state")  # nothing runs on from it
    return spark.read.schema(stream.schema).parquet(out).select(*stream.columns)


def hourly_counts(events: DataFrame) -> DataFrame:
    """``hour``, ``event_type``, ``n`` of a stream with ``ts``; rows over two hours late may be left out in append mode."""
    timed = events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")
    return timed.groupBy(F.window("at", "1 hour"), "event_type").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("hour"), "event_type", "n", "total")


def _timed(events: DataFrame) -> DataFrame:
    return events.withColumn("at", F.col("ts").cast("timestamp")).withWatermark("at", "2 hours")


def closed_sessions(events: DataFrame) -> DataFrame:
    """``user_id``, ``began``, ``ended``, ``n`` of sessions that an hour without events ends; in append mode each comes out once the watermark (two hours behind) has passed its end, and rows later than that are left out."""
    s = _timed(events).groupBy("user_id", F.session_window("at", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"))
    return s.select("user_id", F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n")


def sliding_counts(events: DataFrame) -> DataFrame:
    """``began``, ``n``, ``total`` of two-hour windows every hour; as ``closed_sessions`` for lateness."""
    w = _timed(events).groupBy(F.window("at", "2 hours", "1 hour").alias("w")).agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"))
    return w.select(F.col("w.start").alias("began"), "n", "total")


def limited(events: DataFrame, key: str, limit: int = LIMIT, seconds: int = WINDOW_SECONDS) -> DataFrame:
    """``key``, ``event_id``, ``allowed``: a fixed-window limiter; a window opens with the first event after the former's end.

    State is (window end, events so far). Within a micro-batch a key's events are taken in order of time. Events without a key or a time get no verdict.
    """

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        end, count = state.get if state.exists else (0, 0)
        p = pd.concat(list(chunks)).sort_values(["at", "event_id"])
        verdicts = []
        for at in p["at"].astype("int64"):
            if at >= end:
                end, count = at + seconds * 1_000_000, 0
            count += 1
            verdicts.append(count <= limit)
        state.update((int(end), int(count)))
        yield pd.DataFrame({"caller": p["caller"].to_numpy(), "event_id": p["event_id"].to_numpy(), "allowed": verdicts})

    slim = events.select(F.col(key).cast("bigint").alias("caller"), "event_id", F.unix_micros(F.col("ts").cast("timestamp")).alias("at")).where("caller is not null and at is not null")
    return slim.groupBy("caller").applyInPandasWithState(step, "caller bigint, event_id bigint, allowed boolean", "until bigint, n int", "append", "NoTimeout")


def failure_counter(observations: DataFrame, demote: int = 3) -> DataFrame:
    """``site``, ``obs_id``, ``failures``, ``demoted``: failures in a row per site; a reachable observation resets them."""

    def step(k: tuple, chunks: Iterator[pd.DataFrame], state) -> Iterator[pd.DataFrame]:
        n = state.get[0] if state.exists else 0
        p = pd.concat(list(chunks)).sort_values(["at", "obs_id"])
        runs = []
        for up in p["up"]:
            n = 0 if up else n + 1
            runs.append(n)
        state.update((int(n),))
        yield pd.DataFrame({"site": p["site"].to_numpy(), "obs_id": p["obs_id"].to_numpy(), "failures": runs, "demoted": [x >= demote for x in runs]})

    return observations.groupBy("site").applyInPandasWithState(step, "site string, obs_id bigint, failures int, demoted boolean", "n int", "append", "NoTimeout")
