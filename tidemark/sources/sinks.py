"""Sinks without a table format: staged overwrite, sorted lines, bounded log, guarded upsert, write-once seal."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.sources.files import exists

LOG_ROWS = 4000


def _fs(spark: SparkSession, path: str):
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()), p


def _rename(fs, a, b) -> None:
    if not fs.rename(a, b):
        raise OSError(f"cannot rename {a} to {b}")


def recover(spark: SparkSession, path: str) -> None:
    """Ends a ``replace`` of ``path`` that was broken off: the table it had set aside comes back if no new one took its place, else it goes."""
    fs, target = _fs(spark, path)
    old = _fs(spark, f"{path}.old")[1]
    if fs.exists(old):
        if fs.exists(target):
            fs.delete(old, True)
        else:
            _rename(fs, old, target)


def replace(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Overwrites ``path`` by a staged write and two renames; ``df`` may read ``path`` itself.

    At no time is there neither the old table nor the new one: the old is set aside as ``path.old`` until the new has its place, and
    ``recover`` (run first here) ends what a crash between the renames left. A failed write leaves ``path`` as it was.
    """
    spark = df.sparkSession
    recover(spark, path)
    stage = f"{path}.stage-{uuid.uuid4().hex}"
    df.write.format(fmt).save(stage)
    fs, target = _fs(spark, path)
    new, old = _fs(spark, stage)[1], _fs(spark, f"{path}.old")[1]
    if fs.exists(target):
        _rename(fs, target, old)
        try:
            _rename(fs, new, target)
        except OSError:
            _rename(fs, old, target)
            raise
        fs.delete(old, True)
    else:
        _rename(fs, new, target)


def write_sorted_lines(df: DataFrame, path: str, key: str, columns: Sequence[str]) -> None:
    """JSON lines sorted by ``key`` over all files, fields in the order of ``columns`` (derived ones simply aren't listed)."""
    replace(df.select(*columns).orderBy(key), path, "json")


def append_log(df: DataFrame, path: str, newest: str, keep: int = LOG_ROWS) -> None:
    """Appends to a log of at most ``keep`` rows: the newest stay (the cut is the log's definition); it is stored oldest first."""
    spark = df.sparkSession
    both = spark.read.parquet(path).unionByName(df) if exists(spark, path) else df
    rest = [c for c in df.columns if c != newest]
    replace(both.orderBy(F.desc(newest), *rest).limit(keep).orderBy(F.col(newest), *[F.desc(c) for c in rest]), path)


def write_one(df: DataFrame, path: str) -> None:
    """A singleton document (run metadata): ``df`` must have exactly one row."""
    if len(df.take(2)) != 1:
        raise ValueError("a singleton has one row")
    replace(df.coalesce(1), path, "json")


def guarded_upsert(stored: DataFrame, fresh: DataFrame, keys: Sequence[str], size: str, suspect: str, force: bool = False) -> DataFrame:
    """``stored`` with ``fresh`` rows put in by key, unless a stored row that isn't suspect is larger (equal is replaced)."""
    both = stored.withColumn("__new", F.lit(0)).unionByName(fresh.withColumn("__new", F.lit(1)))
    w = Window.partitionBy(*keys)
    held = F.max(F.when((F.col("__new") == 0) & ~F.coalesce(F.col(suspect), F.lit(False)), F.col(size))).over(w)
    offered = F.max(F.when(F.col("__new") == 1, F.col(size))).over(w)
    old_wins = F.coalesce(held > offered, F.lit(False)) & F.lit(not force)
    has_new = F.max("__new").over(w) == 1
    marked = both.withColumn("__keep", F.when(has_new & ~old_wins, F.lit(1)).otherwise(F.lit(0)))
    return marked.where("__new = __keep").drop("__new", "__keep")


def seal(df: DataFrame, path: str) -> bool:
    """Writes once: False, and nothing done, if ``path`` exists."""
    if exists(df.sparkSession, path):
        return False
    df.write.mode("errorifexists").json(path)
    return True


def publish(spark: SparkSession, folder: str, target: str) -> None:
    """Copies a folder's files to ``target``, without those that a write in progress left (``*.tmp``, ``*.stage-*``, ``*.old``)."""
    fs, root = _fs(spark, folder)
    util, conf = spark.sparkContext._jvm.org.apache.hadoop.fs.FileUtil, spark.sparkContext._jsc.hadoopConfiguration()
    to, there = _fs(spark, target)
    to.mkdirs(there)
    for f in fs.listStatus(root):
        name = f.getPath().getName()
        if not (name.endswith((".tmp", ".old")) or ".stage-" in name):
            util.copy(fs, f.getPath(), to, _fs(spark, f"{target}/{name}")[1], False, True, conf)
