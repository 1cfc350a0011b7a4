"""The N best items of every group, by partition lower bounds.

The N-th best row of any part of a group is a lower bound of the group's N-th best, so the greatest
such bound prunes the group before it is ranked. Parts are the input's partitions: a local
top-N (Spark's window group limit cuts every partition to N rows a group before the exchange)
gives each part's N-th row; their best per group is joined back, rows beyond it are dropped, and
the at most N rows a part that survive are ranked. The order is total (ties run on to the last
sort column and a row hash), so millions of equal scores prune as well as distinct ones.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _ascending(c: Column, kind: T.DataType, descending: bool) -> list[Column]:
    """Sort keys, least first, nulls last, that compare as structs do."""
    if not descending:
        return [c.isNull(), c]
    # ~x is -x - 1: it turns the order of whole numbers and has no overflow
    return [c.isNull(), F.bitwise_not(c) if isinstance(kind, T.IntegralType) else -c]


def top_n(df: DataFrame, group: Sequence[str], order: Sequence[tuple[str, bool]], n: int) -> DataFrame:
    """``df``'s first ``n`` rows of every group, with their position ``pos`` from 1.

    ``order`` lists (column, descending); a descending column must be numeric; nulls come last
    either way. Rows equal in all of ``order`` are told apart by a 128-bit hash of the whole row, so the
    result is the same on every run; identical rows fill positions of their own. Null group keys
    form a group. An input column named ``pos`` would clash and is refused.
    """
    if "pos" in df.columns:
        raise ValueError("a column is already named pos")
    inner = {c: f"c{i}" for i, c in enumerate(df.columns)}  # so that no input name clashes with one used here
    own = df.toDF(*inner.values())
    keys = [f"g{i}" for i in range(len(group))]
    parts = [x for name, desc in order for x in _ascending(F.col(inner[name]), df.schema[name].dataType, desc)]
    names = [f"s{i}" for i in range(len(parts))] + ["h", "i"]
    # maps have no hash: their text stands for them
    hashed = [F.to_json(F.struct(c)) if "map<" in own.schema[c].dataType.simpleString() else F.col(c) for c in own.columns]
    whole = F.struct(*[p.alias(a) for p, a in zip([*parts, F.xxhash64(*hashed), F.xxhash64(F.lit(1), *hashed)], names)])
    rows = own.withColumns({"o": whole, **{k: F.col(inner[g]) for k, g in zip(keys, group)}})
    local = Window.partitionBy("part", *keys).orderBy("o")
    bounds = rows.select(*keys, "o", F.spark_partition_id().alias("part")).withColumn("n", F.row_number().over(local)).where(F.col("n") <= n).where(F.col("n") == n)
    bound = bounds.groupBy(*[F.col(k).alias(f"b{k}") for k in keys]).agg(F.min("o").alias("bound"))
    on = F.lit(True)
    for k in keys:
        on = on & F.col(k).eqNullSafe(F.col(f"b{k}"))
    kept = rows.join(bound, on, "left").where("bound is null or o <= bound").select(*own.columns, *keys, "o")
    ranked = kept.withColumn("pos", F.row_number().over(Window.partitionBy(*keys).orderBy("o"))).where(F.col("pos") <= n)
    return ranked.select(*[F.col(i).alias(c) for c, i in inner.items()], "pos")
