"""Exact middle values per group without bringing a group into one task."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

BINS = 1024


def exact_medians(df: DataFrame, group: Sequence[str], value: str, bins: int = BINS) -> DataFrame:
    """``group``, ``n``, ``lo``, ``hi``: both middle values (equal for an odd count) of the non-null values.

    Values are counted first (combined before the shuffle), then placed in equal-width bins; running
    counts go over at most ``bins`` bins of a group and over one bin's distinct values at a time.
    Null group keys form a group; a group without values has no row.
    """
    g = list(group)
    counts = df.where(F.col(value).isNotNull()).groupBy(*g, F.col(value).alias("__v")).agg(F.count(F.lit(1)).alias("__c"))
    whole = Window.partitionBy(*g, "__bin")
    span = counts.groupBy(*[F.col(x).alias(f"__g{x}") for x in g]).agg(F.min("__v").cast("double").alias("__min"), F.max("__v").cast("double").alias("__max"), F.sum("__c").alias("n"))
    on = F.lit(True)
    for x in g:
        on = on & F.col(x).eqNullSafe(F.col(f"__g{x}"))
    share = F.try_divide(F.col("__v").cast("double") - F.col("__min"), F.col("__max") - F.col("__min"))
    placed = counts.join(span, on).withColumn("__bin", F.least(F.floor(F.coalesce(share, F.lit(0.0)) * bins), F.lit(bins - 1))).select(*g, "__v", "__c", "n", "__bin")
    sums = placed.groupBy(*[F.col(x).alias(f"__g{x}") for x in g], F.col("__bin").alias("__gbin")).agg(F.sum("__c").alias("__in"))
    before = sums.withColumn("__before", F.sum("__in").over(Window.partitionBy(*[f"__g{x}" for x in g]).orderBy("__gbin")) - F.col("__in"))
    reached = placed.join(before, on & (F.col("__bin") == F.col("__gbin"))).withColumn("__cum", F.col("__before") + F.sum("__c").over(whole.orderBy("__v")))
    return reached.groupBy(*g).agg(
        F.max("n").alias("n"),
        F.min(F.when(F.col("__cum") >= F.floor((F.col("n") + 1) / 2), F.col("__v"))).alias("lo"),
        F.min(F.when(F.col("__cum") >= F.floor(F.col("n") / 2) + 1, F.col("__v"))).alias("hi"),
    )
