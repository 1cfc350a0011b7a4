"""File sources: JSON lines that may be corrupt, single JSON documents, ranked lists, sealed reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T


def exists(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    p = jvm.org.apache.hadoop.fs.Path(path)
    found = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).globStatus(p)
    return found is not None and len(found) > 0


def read_lines(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """JSON lines with an explicit schema; blank and unreadable lines are skipped, a missing path gives no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], schema)
    wide = T.StructType([*schema.fields, T.StructField("__corrupt", T.StringType())])
    rows = spark.read.schema(wide).option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "__corrupt").json(path)
    # all fields of an unreadable line are null; the marker alone can't be queried from the raw file
    return rows.where(F.col("__corrupt").isNull()).select(*schema.fieldNames())


def read_document(spark: SparkSession, path: str, schema: T.StructType, fallback: list | None = None) -> DataFrame:
    """One JSON document (or an array of records); ``fallback`` rows where the file is missing."""
    if not exists(spark, path):
        return spark.createDataFrame(fallback or [], schema)
    return spark.read.schema(schema).option("multiLine", True).json(path)


def read_ranked(spark: SparkSession, path: str, keep, count: int) -> DataFrame:
    """``rank``, ``domain`` of the ``count`` best ranked rows of a CSV for which ``keep(Column)`` holds (the limit is the list's size)."""
    rows = spark.read.schema("rank bigint, domain string").csv(path).where(F.col("rank").isNotNull())
    rows = rows.withColumn("domain", F.lower(F.trim("domain"))).where(keep(F.col("domain")))
    return rows.orderBy("rank", "domain").limit(count)


def read_sealed(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    """Sealed month reports of a folder with their ``month``: a document each, as a file or as ``seal`` writes it; files of other names are ignored, invalid ones give no row."""
    path = f"{folder}/[0-9][0-9][0-9][0-9]-[0-9][0-9].json"
    if not exists(spark, path):
        return spark.createDataFrame([], T.StructType([*schema.fields, T.StructField("month", T.StringType())]))
    rows = spark.read.schema(schema).option("multiLine", True).option("mode", "DROPMALFORMED").json(path)
    return rows.withColumn("month", F.regexp_extract(F.input_file_name(), r"(\d{4}-\d{2})\.json(?:/[^/]*)?$", 1))
