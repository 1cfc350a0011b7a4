"""Joins on time and on skewed keys, without comparing all pairs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def asof_join(left: DataFrame, right: DataFrame, keys: Sequence[str], left_ts: str, right_ts: str, *, tie: str, carry: Sequence[str], bucket_seconds: int = 86_400) -> DataFrame:
    """``left`` with the columns ``carry`` of the latest ``right`` row of its keys at or before its time (null if none).

    Both sides are put in one time line per key and time bucket and the last right row is carried forward in it; the last right
    row of the buckets before comes from one summary row a bucket. So there are no pairs, and a hot key is spread over
    its buckets. Times may be whole numbers. Of right rows at one time the greatest ``tie`` stands. Left rows without a time have no right row.
    """
    names = [f"__r{i}" for i in range(len(carry))]
    a = left.select(*[F.col(c).alias(c) for c in left.columns], F.col(left_ts).alias("__at"), F.lit(1).alias("__side"), F.lit(None).cast(right.schema[tie].dataType).alias("__tie"), F.lit(None).cast(f"struct<{', '.join(f'{n}:{right.schema[c].dataType.simpleString()}' for n, c in zip(names, carry))}>").alias("__row"))
    b = right.select(*[F.col(k).alias(k) for k in keys], F.col(right_ts).alias("__at"), F.lit(0).alias("__side"), F.col(tie).alias("__tie"), F.struct(*[F.col(c).alias(n) for n, c in zip(names, carry)]).alias("__row")).where(F.col("__at").isNotNull())
    # one struct of the keys: nulls in it are equal, so the join below keeps the partitioning; null keys meet nothing in the end
    seconds = F.col("__at") if isinstance(left.schema[left_ts].dataType, T.NumericType) else F.unix_timestamp("__at")
    both = a.unionByName(b, allowMissingColumns=True).withColumn("__k", F.struct(*keys)).withColumn("__b", F.coalesce(F.floor(seconds / bucket_seconds), F.lit(-(2**62))))
    line = Window.partitionBy("__k", "__b").orderBy("__at", "__side", "__tie").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    placed = both.withColumn("__last", F.last("__row", ignorenulls=True).over(line))
    # buckets of left rows take the last end before them
    buckets = both.groupBy("__k", "__b").agg(F.max_by(F.when(F.col("__side") == 0, F.col("__row")), F.struct(F.when(F.col("__side") == 0, 1).otherwise(0), "__at", "__tie")).alias("__end"))
    before = Window.partitionBy("__k").orderBy("__b").rowsBetween(Window.unboundedPreceding, -1)
    carried = buckets.select("__k", "__b", F.last("__end", ignorenulls=True).over(before).alias("__carried"))
    out = placed.where("__side = 1").join(carried, ["__k", "__b"])
    found = F.when(F.col("__at").isNotNull(), F.coalesce("__last", "__carried"))
    known = F.lit(True)
    for k in keys:
        known = known & F.col(k).isNotNull()
    return out.withColumn("__found", F.when(known, found)).select(*left.columns, *[F.col(f"__found.{n}").alias(c) for n, c in zip(names, carry)])


def count_before(left: DataFrame, right: DataFrame, row_id: str, keys: Sequence[str], left_ts: str, right_ts: str, seconds: int) -> DataFrame:
    """``row_id``, ``n``: ``right`` rows of equal keys in the ``seconds`` before each left row (its own instant excluded).

    Time is cut in bins as wide as the range, so a left row meets only its own and the former bin.
    """
    us = lambda c: F.unix_micros(F.col(c).cast("timestamp"))
    width = seconds * 1_000_000
    lb = left.select(row_id, *keys, us(left_ts).alias("__l")).withColumn("__bin", F.explode(F.array(F.floor(F.col("__l") / width), F.floor(F.col("__l") / width) - 1)))
    rb = right.select(*keys, us(right_ts).alias("__r")).withColumn("__bin", F.floor(F.col("__r") / width))
    hit = lb.join(rb, [*keys, "__bin"]).where((F.col("__r") < F.col("__l")) & (F.col("__r") >= F.col("__l") - width)).groupBy(row_id).agg(F.count(F.lit(1)).alias("n"))
    return left.select(row_id).join(hit, row_id, "left").select(row_id, F.coalesce("n", F.lit(0)).alias("n"))


def salted_join(big: DataFrame, small: DataFrame, key: str, salts: int) -> DataFrame:
    """Inner join on ``key`` with big rows spread over ``salts`` copies of the small side, by sorting both sides.

    The optimizer's estimate leaves the copies out, so without the hint it may broadcast ``salts`` times what it takes for small.
    """
    a = big.withColumn("__salt", F.pmod(F.xxhash64(*big.columns), F.lit(salts)).cast("int"))
    b = small.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
    return a.join(b.hint("merge"), [key, "__salt"]).drop("__salt")
