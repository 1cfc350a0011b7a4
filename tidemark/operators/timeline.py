"""Rows in order of time within a key, without bringing a key into one task.

A key's rows are spread over time buckets: rows are shuffled on (key, bucket), each bucket is sorted by itself, and
what a bucket needs of those before it (the last row, a running count) comes from one summary row a bucket.
So a domain that holds a tenth of all rows costs as many tasks as it has buckets.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKET_SECONDS = 86_400


def instants(df: DataFrame, key: str, ts: str, latest_by: Sequence[str], bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """One row a key and instant (greatest in ``latest_by``, nulls least), with its bucket ``__b``. Rows with a null key or time are left out."""
    # said here, the filters that later joins infer are in all their branches, so they share one exchange
    base = df.withColumn("__b", F.floor(F.unix_timestamp(ts) / bucket_seconds)).where(F.col(key).isNotNull() & F.col("__b").isNotNull())
    at = Window.partitionBy(key, "__b").orderBy(ts, *[F.desc(c) for c in latest_by])
    return base.withColumn("__p", F.lag(ts).over(at)).where(F.col("__p").isNull() | (F.col("__p") != F.col(ts))).drop("__p")


def with_previous(rows: DataFrame, key: str, ts: str, columns: Sequence[str]) -> DataFrame:
    """``rows`` (of ``instants``) with ``before``: a struct of ``ts`` and ``columns`` of the key's row before (null for its first)."""
    state = F.struct(ts, *[c for c in columns if c != ts])
    last = rows.groupBy(key, "__b").agg(F.max_by(state, F.col(ts)).alias("__last"))
    carried = last.select(key, "__b", F.lag("__last").over(Window.partitionBy(key).orderBy("__b")).alias("__carried"))
    local = rows.withColumn("__before", F.lag(state).over(Window.partitionBy(key, "__b").orderBy(ts)))
    return local.join(carried, [key, "__b"]).withColumn("before", F.coalesce("__before", "__carried")).drop("__before", "__carried", "__b")


def runs_of(rows: DataFrame, key: str, ts: str, failed: Column, out: str) -> DataFrame:
    """``rows`` (of ``instants``) with ``out``: how many rows in a row ``failed`` up to and with this one (0 where it did not)."""
    seq = Window.partitionBy(key, "__b").orderBy(ts)
    bad = F.when(F.coalesce(failed, F.lit(False)), 1).otherwise(0)
    marked = rows.withColumn("__bad", bad).withColumn("__run", F.sum(1 - F.col("__bad")).over(seq))
    local = marked.withColumn("__own", F.sum("__bad").over(Window.partitionBy(key, "__b", "__run").orderBy(ts)))
    # per bucket: whether anything succeeded, and how many failures its end carries on
    ends = local.groupBy(key, "__b").agg((F.max("__run") > 0).alias("__any"), F.max_by("__own", ts).alias("__tail"))
    order = Window.partitionBy(key).orderBy("__b")
    ends = ends.withColumn("__since", F.sum(F.col("__any").cast("int")).over(order))
    ends = ends.withColumn("__out", F.sum("__tail").over(Window.partitionBy(key, "__since").orderBy("__b"))).select(key, "__b", F.lag("__out").over(order).alias("__in"))
    whole = F.col("__own") + F.when(F.col("__run") == 0, F.coalesce("__in", F.lit(0))).otherwise(0)
    return local.join(ends, [key, "__b"]).withColumn(out, F.when(F.col("__bad") == 1, whole).otherwise(0)).drop("__b", "__bad", "__run", "__own", "__in")


def sessions(df: DataFrame, key: str, ts: str, gap_seconds: int, bucket_seconds: int = BUCKET_SECONDS) -> DataFrame:
    """``key``, ``session_no`` (from 1), ``n``, ``began``, ``ended``: a session ends where ``gap_seconds`` pass without a row of its key.

    Rows with a null key or time are in none. A session may run over any number of buckets: each knows the last time and the number of sessions begun before it.
    """
    rows = df.select(key, ts).withColumn("__b", F.floor(F.unix_timestamp(ts) / bucket_seconds)).where(F.col(key).isNotNull() & F.col("__b").isNotNull())
    seq, order = Window.partitionBy(key, "__b").orderBy(ts), Window.partitionBy(key).orderBy("__b")
    carried = rows.groupBy(key, "__b").agg(F.max(ts).alias("__last")).select(key, "__b", F.lag("__last").over(order).alias("__before"))
    near = F.unix_timestamp(ts) - F.unix_timestamp(F.coalesce("__prev", "__before")) <= gap_seconds
    marked = rows.withColumn("__prev", F.lag(ts).over(seq)).join(carried, [key, "__b"]).withColumn("__starts", F.when(F.coalesce(near, F.lit(False)), 0).otherwise(1))
    local = marked.withColumn("__own", F.sum("__starts").over(seq))  # by range: rows of one instant are in one session
    # parts of sessions by bucket, then whole ones: one row a bucket and session is all that meets
    parts = local.groupBy(key, "__b", "__own").agg(F.count(F.lit(1)).alias("n"), F.min(ts).alias("began"), F.max(ts).alias("ended"))
    begun = local.groupBy(key, "__b").agg(F.sum("__starts").alias("__in")).withColumn("__past", F.sum("__in").over(order) - F.col("__in")).select(key, "__b", "__past")
    whole = parts.join(begun, [key, "__b"]).withColumn("session_no", F.col("__past") + F.col("__own"))
    return whole.groupBy(key, "session_no").agg(F.sum("n").alias("n"), F.min("began").alias("began"), F.max("ended").alias("ended"))


def spaced(df: DataFrame, key: str, at: str, tie: str, gap: int, bucket: int) -> DataFrame:
    """``df`` with ``start``: when each request may go so that those of a key go in order, each ``gap`` after the one before at least.

    ``at``: when it was wanted, a whole number in the unit of ``gap`` and ``bucket``. The n-th request starts at the greatest of
    ``at - gap * n`` over the requests so far, plus ``gap * n``; greatest and count are carried from bucket to bucket. Rows with a null key or time are left out.
    """
    rows = df.withColumn("__b", F.floor(F.col(at) / bucket)).where(F.col(key).isNotNull() & F.col("__b").isNotNull())
    seq, order = Window.partitionBy(key, "__b").orderBy(at, tie), Window.partitionBy(key).orderBy("__b")
    local = rows.withColumn("__n", F.row_number().over(seq)).withColumn("__slack", F.col(at) - F.col("__n") * gap)
    local = local.withColumn("__own", F.max("__slack").over(seq.rowsBetween(Window.unboundedPreceding, 0)))
    ends = local.groupBy(key, "__b").agg(F.max("__n").alias("__c"), F.max("__slack").alias("__m"))
    ends = ends.withColumn("__past", F.sum("__c").over(order) - F.col("__c")).withColumn("__carried", F.max(F.col("__m") - F.col("__past") * gap).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    out = local.join(ends.select(key, "__b", "__past", "__carried"), [key, "__b"])
    start = F.greatest(F.col("__own") - F.col("__past") * gap, F.col("__carried")) + (F.col("__n") + F.col("__past")) * gap
    return out.withColumn("start", start).drop("__b", "__n", "__slack", "__own", "__past", "__carried")
