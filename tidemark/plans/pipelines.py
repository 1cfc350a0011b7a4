"""Queries over sources, run health, detection and streams."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import detect
from tidemark.functions.normal import normal_domain
from tidemark.operators import run_health
from tidemark.plans import sites
from tidemark.plans.extended import _PAGE
from tidemark.plans.reference import TEXTS
from tidemark.plans.sqlkit import duck_text, query
from tidemark.streaming import streams
from tidemark.tables import table


def corpus_records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Records of the raw lines with unreadable lines skipped; repeated rows once."""
    raw = table(spark, sf_dir, "domains_jsonl").select("record_id", "raw").distinct()
    v = raw.select("record_id", F.try_parse_json("raw").alias("v")).where("v is not null")
    get = lambda p, t: F.try_variant_get("v", p, t)
    return v.select("record_id", get("$.domain", "string").alias("domain"), get("$.rank", "bigint").alias("site_rank"), get("$.firstSeen", "string").alias("first_seen"))


RECORDS_SQL = """select record_id, json_extract_string(raw, '$.domain') as domain, cast(json_extract(raw, '$.rank') as bigint) as site_rank, json_extract_string(raw, '$.firstSeen') as first_seen
  from (select distinct record_id, raw from domains_jsonl) r where json_valid(raw) and not regexp_matches(raw, ',\\s*[}\\]]')"""


def reassessed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdict of every feed's days, folded in order; a day's score changes are those of the sites on that day."""
    d = table(spark, sf_dir, "daily_stats")
    last = Window.partitionBy("feed", "stat_day").orderBy(F.desc("load_no"), F.desc("loaded_at"), F.desc("observed"), F.desc("total_domains"), F.desc("mean_score"), F.desc("attempted"), F.desc("succeeded"))
    one = d.withColumn("nth", F.row_number().over(last)).where("nth = 1 and feed is not null and stat_day is not null")
    changes = sites.change_events(spark, sf_dir).where("kind = 'score'").groupBy(F.to_date("observed_at").alias("stat_day")).agg(F.count(F.lit(1)).alias("score_changes"))
    rows = one.join(changes, "stat_day", "left")
    return run_health.reassess(rows.select("feed", F.col("stat_day").alias("day"), "total_domains", "observed", "mean_score", "attempted", "succeeded", F.coalesce("score_changes", F.lit(0)).alias("score_changes")))


#: The fold as a recursion over the days of each feed: ``k`` counts them, t_ is the last trusted day, l_ the run before.
REASSESSED_SQL = f"""with recursive one as (select feed, stat_day, total_domains, observed, mean_score, attempted, succeeded from daily_stats where feed is not null and stat_day is not null
    qualify row_number() over (partition by feed, stat_day order by load_no desc, loaded_at desc, observed desc, total_domains desc, mean_score desc, attempted desc, succeeded desc) = 1),
  ch as (select cast(observed_at as date) as stat_day, count(*) as score_changes from ({duck_text(TEXTS['change_events'])}) c where kind = 'score' group by 1),
  d as (select one.*, coalesce(ch.score_changes, 0) as score_changes, coalesce(observed, 0) as ob, row_number() over (partition by feed order by one.stat_day) as k from one left join ch on ch.stat_day = one.stat_day),
  s(feed, k, observed, mean_score, suspect, baseline_moved, reasons, has_t, t_total, t_observed, t_mean, t_attempted, t_succeeded) as (
    select feed, k, observed, mean_score, sus, moved, why, not sus, case when not sus then total_domains end, case when not sus then ob end, case when not sus then mean_score end, case when not sus then attempted end, case when not sus then succeeded end
    from (select *, false as moved, ob = 0 or score_changes / greatest(ob, 1) > 0.1 as sus, concat_ws(',', case when ob = 0 then 'nothing observed' end, case when ob > 0 and score_changes / ob > 0.1 then 'score changes' end) as why from d where k = 1) a
    union all
    select feed, k, observed, mean_score, sus, moved, why, has_t or not sus, case when sus then t_total else total_domains end, case when sus then t_observed else ob end, case when sus then t_mean else mean_score end, case when sus then t_attempted else attempted end, case when sus then t_succeeded else succeeded end
    from (select *, broken or (drifted and not agree) as sus, drifted and not broken and agree as moved, concat_ws(',', nullif(b_why, ''), nullif(d_why, '')) as why
      from (select *, b_why <> '' as broken, d_why <> '' as drifted from (
        select d.*, s.has_t, s.t_total, s.t_observed, s.t_mean, s.t_attempted, s.t_succeeded,
          concat_ws(',', case when d.ob = 0 then 'nothing observed' end, case when d.ob > 0 and d.score_changes / d.ob > 0.1 then 'score changes' end) as b_why,
          case when s.has_t then concat_ws(',', case when s.t_attempted > 0 and s.t_total > 0 and s.t_observed > 0 and (coalesce(s.t_succeeded, 0) / s.t_attempted - case when d.attempted > 0 then coalesce(d.succeeded, 0) / d.attempted else 0 end) * 100 > 15 then 'reachability' end,
            case when abs(d.ob - s.t_observed) / greatest(1, s.t_observed) > 0.2 then 'population' end, case when s.t_total > 0 and (s.t_total - coalesce(d.total_domains, 0)) / s.t_total > 0.1 then 'shrunk' end, case when abs(d.mean_score - s.t_mean) > 5 then 'mean' end) else '' end as d_why,
          s.suspect and abs(coalesce(s.observed, 0) - d.ob) / greatest(1, coalesce(s.observed, 0)) <= 0.02 and coalesce(abs(s.mean_score - d.mean_score) <= 1.5, s.mean_score is null and d.mean_score is null) as agree
        from s join d on d.feed = s.feed and d.k = s.k + 1) x) y) z)
  select s.feed, d.stat_day as day, s.observed, s.mean_score, s.suspect, s.baseline_moved, s.reasons from s join d on d.feed = s.feed and d.k = s.k"""


def platform_detection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """First matching platform rule of each document's page (marks are put into the pages by id)."""
    pages = query(f"with {_PAGE} select doc_id, concat(html, case doc_id % 4 when 0 then '<link href=\"/wp-content/a.css\">' when 1 then '<script src=\"/_next/static/b.js\"></script>' else '' end) as html from p")(spark, sf_dir)
    return pages.select("doc_id", detect.first_match(detect.PLATFORM_RULES, F.col("html"), window=None).alias("platform"))


DETECTION_SQL = f"""with {duck_text(_PAGE)}, m as (select doc_id, html || case doc_id % 4 when 0 then '<link href="/wp-content/a.css">' when 1 then '<script src="/_next/static/b.js"></script>' else '' end as html from p)
  select doc_id, case {' '.join(f"when regexp_matches(html, '{r.body}') then '{r.id}'" for r in detect.PLATFORM_RULES if r.body)} end as platform from m"""


def refusals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Kinds of refused control answers."""
    o = table(spark, sf_dir, "observations")
    k = detect.refusal_kind(F.col("http_status"), F.col("control.challenged"), F.coalesce("content.ssr_text_length", F.lit(0)), F.coalesce("cloaking.browser_bytes", F.lit(0)))
    return o.groupBy(k.alias("kind")).agg(F.count(F.lit(1)).alias("n"))


REFUSALS_SQL = """select case when http_status = 402 then 'metered' when http_status in (403, 429, 451) then 'refused' when coalesce(control.challenged, false) then 'challenge'
  when http_status < 400 and coalesce(cloaking.browser_bytes, 0) < 5000 and coalesce(content.ssr_text_length, 0) < 100 then 'stub' else 'none' end as kind, count(*) as n from observations group by 1"""


def stream_hourly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windowed counts by Structured Streaming."""
    table(spark, sf_dir, "events")
    return streams.run(streams.hourly_counts(streams.file_stream(spark, f"{sf_dir}/events.parquet")), "complete")


HOURLY_SQL = "select date_trunc('hour', ts) as hour, event_type, count(*) as n, sum(value) as total from events group by 1, 2"


def stream_limited(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts of a fixed-window rate limiter per user, by stateful streaming."""
    table(spark, sf_dir, "events")
    return streams.run(streams.limited(streams.file_stream(spark, f"{sf_dir}/events.parquet"), "user_id"), "append").select("caller", "event_id", "allowed")


#: A window opens with a caller's first event after the end of the one before; eight events of each are allowed.
LIMITED_SQL = f"""with recursive e as (select user_id, event_id, ts, row_number() over (partition by user_id order by ts, event_id) as k from events), w(user_id, began) as (
    select user_id, min(ts) from e group by user_id union all select user_id, nxt from (select w.user_id, (select min(e.ts) from e where e.user_id = w.user_id and e.ts >= w.began + interval {streams.WINDOW_SECONDS} second) as nxt from w) x where nxt is not null),
  j as (select e.*, max(w.began) as began from e join w on w.user_id = e.user_id and w.began <= e.ts group by all)
  select user_id as caller, event_id, row_number() over (partition by user_id, began order by k) <= {streams.LIMIT} as allowed from j"""


def stream_failures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Failures in a row per site, by stateful streaming."""
    table(spark, sf_dir, "observations")
    o = streams.file_stream(spark, f"{sf_dir}/observations.parquet").where("domain is not null and observed_at is not null")
    slim = o.select(normal_domain(F.col("domain")).alias("site"), "obs_id", F.unix_micros("observed_at").alias("at"), F.coalesce("reachable", F.lit(False)).alias("up"))
    return streams.run(streams.failure_counter(slim), "append").select("site", "obs_id", "failures", "demoted")


FAILURES_SQL = """with r as (select regexp_replace(regexp_replace(lower(trim(domain)), '[.]$', ''), '^www[.]', '') as site, obs_id, observed_at, coalesce(reachable, false) as up from observations where domain is not null and observed_at is not null),
  f as (select *, sum(case when up then 1 else 0 end) over (partition by site order by observed_at, obs_id rows unbounded preceding) as run from r),
  g as (select site, obs_id, case when up then 0 else sum(case when up then 0 else 1 end) over (partition by site, run order by observed_at, obs_id rows unbounded preceding) end as failures from f)
  select site, obs_id, failures, failures >= 3 as demoted from g"""

QUERIES = {"corpus_records": corpus_records, "reassessed_series": reassessed_series, "platform_detection": platform_detection, "refusals": refusals, "stream_hourly": stream_hourly, "stream_limited": stream_limited, "stream_failures": stream_failures}
ORACLE = {"reassessed_series": REASSESSED_SQL, "stream_limited": LIMITED_SQL, "corpus_records": RECORDS_SQL, "platform_detection": DETECTION_SQL, "refusals": REFUSALS_SQL, "stream_hourly": HOURLY_SQL, "stream_failures": FAILURES_SQL}
