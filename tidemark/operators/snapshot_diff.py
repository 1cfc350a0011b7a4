"""What changed between consecutive full snapshots, by content-defined chunks.

Each snapshot is cut into hash buckets, each bucket sorted by key and cut into chunks wherever a
hash of the row's key and content says so; an edit therefore moves no boundary but its own. Only the chunks' digests
are compared between snapshots; chunks with the same digest in the next snapshot are dropped whole, and only rows of
unmatched chunks are joined. Rows travel as a key and one hash for each compared attribute, once to their bucket and, those of
unmatched chunks, once to their key; a chunk is never put together.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

BUCKETS = 4096
CHUNK_ROWS = 4


def snapshot_changes(
    df: DataFrame,
    snapshot: str,
    key: Column,
    attributes: Mapping[str, Column],
    *,
    latest_by: Sequence[str] = (),
    buckets: int = BUCKETS,
    chunk_rows: int = CHUNK_ROWS,
) -> DataFrame:
    """Rows ``snapshot_no``, ``key``, ``change``: ``added``, ``removed`` or the name of a changed attribute.

    ``attributes`` gives for each name a 64-bit hash column of its value (null must hash to a value
    of its own). Within a snapshot the row greatest in ``latest_by`` stands for its key (ties: the
    greatest hashes), so repeated rows count once. A snapshot is compared only with the one
    numbered one less; where that one is missing nothing is reported. Rows with a null key or a
    null snapshot number are left out. ``buckets`` sets how finely a snapshot is spread (rows of a
    snapshot over ``buckets`` should fit a task easily); ``chunk_rows`` is the mean chunk size, best about half the number
    of rows among which one changes from snapshot to snapshot: longer chunks match seldom, shorter ones save no rows more.
    """
    names = list(attributes)
    hs = [f"__h{i}" for i in range(len(names))]
    by = [f"__t{i}" for i in range(len(latest_by))]
    slim = df.select(
        F.col(snapshot).cast("int").alias("__s"), key.alias("__key"), *[F.col(c).alias(a) for c, a in zip(latest_by, by)], *[h.alias(a) for h, a in zip(attributes.values(), hs)]
    ).where(F.col("__s").isNotNull() & F.col("__key").isNotNull())
    # said here, the filter that the join below infers for __b is in both of its branches, so they share one exchange
    slim = slim.withColumn("__b", F.pmod(F.xxhash64("__key"), F.lit(buckets)).cast("int")).where(F.col("__b").isNotNull())
    first = Window.partitionBy("__s", "__b").orderBy("__key", *[F.desc(c) for c in by + hs])
    rows = slim.withColumn("__pk", F.lag("__key").over(first)).where(F.col("__pk").isNull() | (F.col("__pk") != F.col("__key")))
    rows = rows.select("__s", "__b", "__key", *hs, F.xxhash64("__key", *hs).alias("__d"), F.xxhash64(F.lit(7), *reversed(hs), "__key").alias("__e"))
    order = Window.partitionBy("__s", "__b").orderBy("__key")
    rows = rows.withColumn("__chunk", F.sum(F.when(F.pmod("__e", F.lit(chunk_rows)) == 0, 1).otherwise(0)).over(order))
    digests = rows.groupBy("__s", "__b", "__chunk").agg(
        F.count(F.lit(1)).alias("__n"), F.min("__key").alias("__lo"), F.max("__key").alias("__hi"), F.bit_xor("__d").alias("__x"), F.bit_xor("__e").alias("__y")
    )
    # the range and content of a chunk, as one 64-bit hash beside the two checksums of its rows
    digests = digests.select("__s", "__b", "__chunk", F.xxhash64("__lo", "__hi", "__n").alias("__r"), "__x", "__y")
    same = Window.partitionBy("__b", "__r", "__x", "__y").orderBy("__s")
    was = F.coalesce(F.lag("__s").over(same) == F.col("__s") - 1, F.lit(False))
    stays = F.coalesce(F.lead("__s").over(same) == F.col("__s") + 1, F.lit(False))
    seen = digests.select("__s", "__b", "__chunk", (F.when(was, 1).otherwise(0) + F.when(stays, 2).otherwise(0)).cast("byte").alias("__seen"))
    # the verdicts of a bucket's chunks in order: chunk numbers follow each other, so a row finds its own by position
    marks = seen.groupBy("__s", "__b").agg(F.min("__chunk").alias("__from"), F.transform(F.array_sort(F.collect_list(F.struct("__chunk", "__seen"))), lambda x: x["__seen"]).alias("__codes"))
    marked = rows.join(marks, ["__s", "__b"]).withColumn("__seen", F.element_at("__codes", (F.col("__chunk") - F.col("__from") + 1).cast("int"))).where("__seen <> 3")
    side = F.array_compact(F.array(F.when(F.col("__seen").bitwiseAND(1) == 0, F.struct(F.col("__s").alias("t"), F.lit(True).alias("now"))), F.when(F.col("__seen").bitwiseAND(2) == 0, F.struct((F.col("__s") + 1).alias("t"), F.lit(False).alias("now")))))
    sides = marked.select(F.explode(side).alias("__side"), "__key", *hs)
    numbers = df.select(F.col(snapshot).cast("int").alias("__s")).distinct()
    both = numbers.where(F.col("__s").isNotNull()).withColumn("__t", F.explode(F.array(F.col("__s"), F.col("__s") + 1))).groupBy("__t").count().where("count = 2").select("__t")
    flat = sides.select(F.col("__side.t").alias("__t"), F.col("__side.now").alias("__now"), "__key", *hs).join(both, "__t", "left_semi")
    pick = lambda now: F.max(F.when(F.col("__now") == now, F.struct(*hs)))
    pairs = flat.groupBy("__t", "__key").agg(pick(False).alias("__old"), pick(True).alias("__new"))
    change = F.when(F.col("__old").isNull(), F.array(F.lit("added"))).when(F.col("__new").isNull(), F.array(F.lit("removed"))).otherwise(
        F.array_compact(F.array(*[F.when(F.col(f"__old.{h}") != F.col(f"__new.{h}"), F.lit(n)) for n, h in zip(names, hs)]))
    )
    return pairs.select(F.col("__t").alias("snapshot_no"), F.col("__key").alias("key"), F.explode(change).alias("change"))
