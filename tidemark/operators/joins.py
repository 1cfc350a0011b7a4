"""Joins whose strategy is chosen by what is known of the sides."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

BROADCAST_BYTES = 64 << 20
BROADCAST_ROWS = 500_000


def size_bytes(df: DataFrame) -> int:
    """The optimizer's estimate of the bytes of ``df`` (an upper bound for scans, filters and projections; large where nothing is known)."""
    return int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))


def sized_join(big: DataFrame, small: DataFrame, on: Sequence[str], how: str = "inner", limit: int = BROADCAST_BYTES) -> DataFrame:
    """Joins with ``small`` broadcast if its size is known to be at most ``limit`` bytes, else by sorting both sides, where AQE splits hot keys."""
    return big.join(F.broadcast(small) if size_bytes(small) <= limit else small.hint("merge"), list(on), how)


def counted(stored: DataFrame, limit: int = BROADCAST_ROWS) -> DataFrame:
    """``stored`` (a checkpoint or table of narrow rows, cheap to count) marked for broadcast if it has at most ``limit`` rows, else as it is, for a plain join.

    For sides whose size no estimate knows: the optimizer takes a checkpoint or the result of an Arrow function for huge.
    """
    return F.broadcast(stored) if stored.count() <= limit else stored
