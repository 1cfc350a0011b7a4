"""Round trips through sources and sinks: what is written to the shared folder and read back, against the tables it came from."""

from __future__ import annotations

import uuid
from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.functions import normal
from tidemark.plans.reference import ORACLE as SITE_SQL
from tidemark.plans.sqlkit import query
from tidemark.plans.texts import _NORMAL
from tidemark.sources import files, sinks
from tidemark.tables import checkpoint, remove, shared_folder, table

LOG_ROWS = 500
CORPUS = T.StructType([T.StructField("domain", T.StringType()), T.StructField("site_rank", T.LongType())])


def _in_folder(f: Callable[[SparkSession, str, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    """Runs ``f`` with a folder of its own, keeps the result, and deletes the folder."""

    @wraps(f)
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        folder = f"{shared_folder(spark)}/store-{uuid.uuid4().hex}"
        try:
            return checkpoint(f(spark, sf_dir, folder))
        finally:
            remove(spark, folder)

    return run


def _corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    return query(f"select {_NORMAL} as domain, min(site_rank) as site_rank from @domain_rows where domain is not null group by 1")(spark, sf_dir)


@_in_folder
def stored_lines(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """JSON lines sorted by domain, with unreadable and blank lines beside them, read back; a missing file gives nothing."""
    sinks.write_sorted_lines(_corpus(spark, sf_dir).withColumn("derived", F.lit(1)), f"{folder}/lines", "domain", CORPUS.fieldNames())
    spark.createDataFrame([('{"domain": "x"',), ("",), ("[]x",)], "value string").coalesce(1).write.mode("append").text(f"{folder}/lines")
    return files.read_lines(spark, f"{folder}/lines", CORPUS).unionByName(files.read_lines(spark, f"{folder}/none", CORPUS))


@_in_folder
def stored_document(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A singleton written and read, another that is missing and falls back, and the tree published without what is unfinished."""
    last = table(spark, sf_dir, "observations").agg(F.count(F.lit(1)).alias("n"), F.max("obs_id").alias("last"))
    sinks.write_one(last, f"{folder}/data/meta.json")
    last.write.json(f"{folder}/data/half.tmp")
    sinks.publish(spark, f"{folder}/data", f"{folder}/public")
    schema = T.StructType([T.StructField("n", T.LongType()), T.StructField("last", T.LongType())])
    read = lambda name, back=None: files.read_document(spark, f"{folder}/public/{name}", schema, back).withColumn("name", F.lit(name))
    return read("meta.json").unionByName(read("half.tmp", [(0, None)]))


@_in_folder
def stored_log(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A log of at most LOG_ROWS rows to which the scorings of each vantage are appended in turn; with the place of each row in it."""
    d = table(spark, sf_dir, "domain_rows").select("row_id", "vantage", "scored_at").where("vantage is not null and scored_at is not null").distinct()
    for v in [r.vantage for r in d.select("vantage").distinct().orderBy("vantage").collect()]:  # a handful of vantages, each one append
        sinks.append_log(d.where(F.col("vantage") == v).select("scored_at", "row_id", "vantage"), f"{folder}/log", "scored_at", LOG_ROWS)
    if not files.exists(spark, f"{folder}/log"):
        return d.select("scored_at", "row_id", "vantage", F.lit(0).alias("place")).limit(0)
    # the log is stored in order, oldest first
    return spark.read.parquet(f"{folder}/log").coalesce(1).withColumn("place", F.row_number().over(Window.orderBy(F.monotonically_increasing_id())))


LOG_SQL = f"""with d as (select distinct row_id, vantage, scored_at from domain_rows where vantage is not null and scored_at is not null), k as (select * from d order by scored_at desc, row_id, vantage limit {LOG_ROWS})
  select scored_at, row_id, vantage, cast(row_number() over (order by scored_at, row_id desc, vantage desc) as int) as place from k"""


@_in_folder
def stored_upsert(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """The series of the first loads, upserted with those of the later ones: a larger day that isn't suspect refuses to be replaced."""
    cols = ["feed", "stat_day", "observed", "suspect"]
    order = Window.partitionBy("feed", "stat_day").orderBy(*[F.desc(c) for c in ("load_no", "loaded_at", "observed", "total_domains", "mean_score", "blocking_any_tier1", "suspect")])
    loads = lambda cond: table(spark, sf_dir, "daily_stats").where(cond).withColumn("nth", F.row_number().over(order)).where("nth = 1").select(*cols)
    sinks.replace(loads("load_no <= 4"), f"{folder}/stats")
    stored = spark.read.parquet(f"{folder}/stats")
    sinks.replace(sinks.guarded_upsert(stored, loads("load_no > 4"), ["feed", "stat_day"], "observed", "suspect"), f"{folder}/stats")
    return spark.read.parquet(f"{folder}/stats").select("feed", "stat_day", "observed")


@_in_folder
def stored_seals(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """Months sealed from their trusted days and read back: sealing again changes nothing, files of other names don't count."""
    d = query(SEALED_TEXT)(spark, sf_dir).groupBy("month").agg(F.collect_list(F.struct("feed", "days", "observed")).alias("feeds"))  # a document a month
    months = sorted(r.month for r in d.select("month").collect())
    done = [sinks.seal(d.where(F.col("month") == m).drop("month").coalesce(1), f"{folder}/reports/{m}.json") for m in [*months, *months[:1]]]
    d.write.json(f"{folder}/reports/notes.json")
    own = T.StructType([T.StructField("feed", T.StringType()), T.StructField("days", T.LongType()), T.StructField("observed", T.LongType())])
    read = files.read_sealed(spark, f"{folder}/reports", T.StructType([T.StructField("feeds", T.ArrayType(own))]))
    return read.select("month", F.explode("feeds").alias("f")).select("month", "f.*", F.lit(done[-1] if done else False).alias("sealed_twice"))


SEALED_TEXT = "select feed, month_of(stat_day) as month, count(*) as days, sum(observed) as observed from @daily_stats where not coalesce(suspect, false) and stat_day is not null and feed is not null group by 1, 2"
SEALED_SQL = "select feed, strftime(stat_day, '%Y-%m') as month, count(*) as days, cast(sum(observed) as bigint) as observed, false as sealed_twice from daily_stats where not coalesce(suspect, false) and stat_day is not null and feed is not null group by 1, 2"


@_in_folder
def stored_ranked(spark: SparkSession, sf_dir: str, folder: str) -> DataFrame:
    """A ranked list written as CSV and read back: the 100 best ranked that may enter the index."""
    ranked = _corpus(spark, sf_dir).where("site_rank is not null").select("site_rank", F.upper("domain").alias("domain"))
    ranked.unionByName(spark.createDataFrame([(None, "x.example"), (1, "cdn.first.example"), (2, "")], "site_rank bigint, domain string")).write.csv(f"{folder}/ranked")
    return files.read_ranked(spark, f"{folder}/ranked", normal.is_indexable, 100)


RANKED_SQL = f"""with r as (select {_NORMAL} as domain, min(site_rank) as site_rank from domain_rows where domain is not null group by 1 having min(site_rank) is not null)
  select site_rank as rank, domain from r where length(domain) <= 253 and regexp_matches(domain, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)+$') and len(string_split(domain, '.')) <= 3 and not regexp_matches(domain, '{'|'.join(normal.INFRASTRUCTURE)}')
  order by rank, domain limit 100"""

QUERIES = {"stored_lines": stored_lines, "stored_document": stored_document, "stored_log": stored_log, "stored_upsert": stored_upsert, "stored_seals": stored_seals, "stored_ranked": stored_ranked}
ORACLE = {
    "stored_lines": f"select {_NORMAL} as domain, min(site_rank) as site_rank from domain_rows where domain is not null group by 1",
    "stored_document": "select count(*) as n, max(obs_id) as last, 'meta.json' as name from observations union all select 0, null, 'half.tmp'",
    "stored_log": LOG_SQL,
    "stored_upsert": f"select feed, stat_day, observed from ({SITE_SQL['guarded_upsert']}) q",
    "stored_seals": SEALED_SQL,
    "stored_ranked": RANKED_SQL,
}
