"""Scored sites, derived once for all queries that read them, and what happened to sites over time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.operators.timeline import instants, runs_of, with_previous
from tidemark.plans import texts as t
from tidemark.plans.sqlkit import query
from tidemark.tables import checkpoint, stamp

_held: dict[tuple, DataFrame] = {}


def scored_sites(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The latest observation of every site with its scores and facets, checkpointed on first use.

    The latest row of a site is picked first (a map task sends one row a site), and only that is scored. The result is kept for the
    session and the tables as they are: a table written anew is read anew (by size and time of the files directly in it; after changes
    deeper in a partitioned table call ``reset_sites``, which forgets all).
    """
    key = (spark.sparkContext.applicationId, sf_dir, *[stamp(spark, f"{sf_dir}/{n}.parquet") for n in ("observations", "domain_rows")])
    if key not in _held:
        for old in [k for k in _held if k[:2] == key[:2] or k[0] != key[0]]:
            del _held[old]
        _held[key] = checkpoint(query(t.SCORED_SITES, costly=("observations",))(spark, sf_dir))
    return _held[key]


def reset_sites() -> None:
    """Forgets the scored sites of all tables."""
    _held.clear()


VIEWS = {"scored_sites": scored_sites}


def scored_history(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every observation with its scores, one a site and instant (the last ingested stands), in time buckets."""
    rows = query(f"{t.EACH_TOTAL} select {', '.join(t.HISTORY_COLUMNS)} from each_total", costly=("observations",))(spark, sf_dir)
    return instants(rows, "site", "observed_at", ["ingested_at", "obs_id"])


def change_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What changed at a site between one observation and the next of the same probe and vantage: one pass, up to four kinds a row.

    ``delta``: the score's move (kind ``score`` only); ``newly_blocked`` and ``newly_allowed`` (kind ``access`` only).
    """
    rows = scored_history(spark, sf_dir).select(
        "site", "observed_at", "__b", "vantage", "probe_version", t_flag("reachable").alias("up"), F.array_sort("t1").alias("blocked"), t_flag("llms_txt.present").alias("llms"), t_flag("agents_md.present").alias("agents"), "total"
    )
    w = with_previous(rows, "site", "observed_at", ["vantage", "probe_version", "up", "blocked", "llms", "agents", "total"])
    ok = w.where("before is not null and vantage = before.vantage and probe_version = before.probe_version")
    now, was = F.coalesce("blocked", F.array().cast("array<string>")), F.coalesce("before.blocked", F.array().cast("array<string>"))
    none, text = F.lit(None).cast("int"), F.lit("")
    event = lambda kind, cond, delta=none, a=text, b=text: F.when(cond, F.struct(F.lit(kind).alias("kind"), delta.alias("delta"), a.alias("newly_blocked"), b.alias("newly_allowed")))
    moved = F.col("total") - F.col("before.total")
    events = F.array_compact(
        F.array(
            event("reachability", F.col("up") != F.col("before.up")),
            event("access", now != was, none, F.array_join(F.array_except(now, was), ","), F.array_join(F.array_except(was, now), ",")),
            event("surface", (F.col("llms") != F.col("before.llms")) | (F.col("agents") != F.col("before.agents"))),
            event("score", F.abs(moved) >= 3, moved.cast("int")),
        )
    )
    return ok.select("site", "observed_at", F.explode(events).alias("e")).select("site", "observed_at", "e.*")


def t_flag(c: str):
    return F.coalesce(F.col(c), F.lit(False))


def access_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Tokens newly blocked and newly allowed between a site's reachable observations."""
    rows = query(f"with {t.KEYED} select site, observed_at, ingested_at, obs_id, reachable, {t.s.distinct_lower('tier1_blocked')} as t1 from keyed")(spark, sf_dir)
    one = instants(rows, "site", "observed_at", ["ingested_at", "obs_id"]).where(t_flag("reachable"))
    w = with_previous(one.select("site", "observed_at", "__b", F.coalesce(F.array_sort("t1"), F.array().cast("array<string>")).alias("now")), "site", "observed_at", ["now"])
    was = F.coalesce("before.now", F.array().cast("array<string>"))
    return w.where(F.col("now") != was).select("site", "observed_at", F.array_join(F.array_except("now", was), ",").alias("newly_blocked"), F.array_join(F.array_except(was, "now"), ",").alias("newly_allowed"))


def failure_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row at every failed observation; three demote a site."""
    rows = query(f"with {t.KEYED} select site, observed_at, ingested_at, obs_id, reachable from keyed")(spark, sf_dir)
    one = instants(rows, "site", "observed_at", ["ingested_at", "obs_id"])
    runs = runs_of(one, "site", "observed_at", ~t_flag("reachable"), "failures")
    return runs.where(~t_flag("reachable")).select("site", "observed_at", "failures", (F.col("failures") >= 3).alias("demoted"))
