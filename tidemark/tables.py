"""Reading the project's tables and naming the folder shared by a cluster."""

from __future__ import annotations

import os
import tempfile

from pyspark.sql import DataFrame, SparkSession


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """The parquet table ``name`` below ``sf_dir``. All queries are defined in UTC."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def stamp(spark: SparkSession, path: str) -> tuple:
    """Size and time of the files at ``path``: differs once the table is written anew."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return tuple(sorted((f.getPath().getName(), f.getLen(), f.getModificationTime()) for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p)))


def shared_folder(spark: SparkSession) -> str:
    """The folder for intermediate data that all executors share: the session's ``spark.checkpoint.dir``.

    Where that is unset, a local temporary folder serves on one machine; on a cluster it is an error.
    """
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if named:
        return named
    if not sc.master.startswith("local"):
        raise RuntimeError("spark.checkpoint.dir must name a folder that all executors share")
    return os.path.join(tempfile.gettempdir(), "tidemark-checkpoints")


def remove(spark: SparkSession, path: str) -> None:
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(p, True)


def checkpoint(df: DataFrame) -> DataFrame:
    """``df`` written to the reliable checkpoint folder and read back, with its lineage cut.

    With ``spark.cleaner.referenceTracking.cleanCheckpoints`` set when the session starts, Spark deletes the files once nothing refers to them.
    """
    sc = df.sparkSession.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(shared_folder(df.sparkSession))
    return df.checkpoint()


def spread(df: DataFrame) -> DataFrame:
    """``df`` in at least as many partitions as there are cores, for steps that cost far more than a shuffle of their input.

    Input that fills the cores already, as any large table does, is left as it is.
    """
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def by_key(df: DataFrame, *keys: str) -> DataFrame:
    """``df`` hashed by ``keys`` into the session's shuffle partitions, a number that AQE doesn't lower.

    For groups of few bytes that each take long: by size alone they would all go to one task.
    """
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)
