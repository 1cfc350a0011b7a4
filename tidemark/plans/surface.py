"""Smaller surfaces over sites and feeds, and the engine's join, function and window forms with their strategies."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import normal
from tidemark.functions import scoring as s
from tidemark.operators import joins, timeline
from tidemark.plans import pipelines
from tidemark.plans.batch import ORACLE as BATCH_SQL
from tidemark.plans.batch import daily_record
from tidemark.plans.reference import ORACLE as SITE_SQL
from tidemark.plans.sqlkit import duck_text, query
from tidemark.plans.texts import FULL, _NORMAL
from tidemark.streaming import streams
from tidemark.tables import table

_DIRTY = "select obs_id, case obs_id % 5 when 0 then final_url when 1 then concat('  HTTP://WWW.', upper(coalesce(domain, '')), ':8080/a?b#c ') when 2 then concat(domain, '.') when 3 then concat('ftp+x://', domain, '?q') else domain end as address from @observations"


def normalised_hosts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Addresses as people write them, their hosts, and whether these may enter the index."""
    d = query(_DIRTY)(spark, sf_dir).select("obs_id", normal.normal_host(F.col("address")).alias("host"))
    return d.select("obs_id", "host", F.coalesce(normal.valid_host(F.col("host")), F.lit(False)).alias("valid"), normal.is_indexable(F.col("host")).alias("indexable"), normal.is_indexable(F.col("host"), F.col("obs_id") % 2 == 0).alias("indexable_or_pinned"))


_VALID = "length(host) <= 253 and regexp_matches(host, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$')"
_PLAIN = f"len(string_split(host, '.')) <= 3 and not regexp_matches(host, '{'|'.join(normal.INFRASTRUCTURE)}')"
HOSTS_SQL = f"""with d as ({duck_text(_DIRTY)}), a as (select obs_id, regexp_replace(lower(trim(address)), '^[a-z][a-z0-9+.-]*://', '') as x from d), b as (select obs_id, regexp_replace(regexp_replace(x, '[/?#].*$', ''), ':[0-9]*$', '') as x from a),
  h as (select obs_id, case when ends_with(w, '.') then left(w, length(w) - 1) else w end as host from (select obs_id, case when starts_with(x, 'www.') then substr(x, 5) else x end as w from b) c)
  select obs_id, host, coalesce({_VALID}, false) as valid, coalesce({_VALID} and {_PLAIN}, false) as indexable, coalesce({_VALID} and (obs_id % 2 = 0 or {_PLAIN}), false) as indexable_or_pinned from h"""

_SUBMITTED = """select doc_id, coalesce(nullif(regexp_extract(text, '### Domain[ \\t\\r\\n]+([^ \\t\\r\\n]+)', 1), ''), nullif(trim(regexp_extract(title, '^(Add|Suggest):[ ]*(.*)$', 2)), '')) as wanted
  from (select doc_id, text, case when doc_id % 2 = 0 then concat('Add: ', domain) else 'Add:' end as title from @documents where lower(trim(source)) in ('issue', 'report') and text is not null) t"""


def submissions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Submitted domains (the form's field, else the rest of the title) with what becomes of each: rejected, known already, or added, the first 50 of a run."""
    d = query(_SUBMITTED)(spark, sf_dir).select("doc_id", normal.normal_host(F.col("wanted")).alias("host"))
    known = query(f"select distinct {_NORMAL} as host from @domain_rows where domain is not null")(spark, sf_dir).withColumn("known", F.lit(True))
    h = F.col("host")
    state = F.when(F.coalesce(h, F.lit("")) == "", "missing").when(~normal.valid_host(h), "invalid").when(~normal.is_indexable(h), "infrastructure").when(F.col("known"), "known").otherwise("new")
    rows = joins.sized_join(d, known, ["host"], "left").select("doc_id", "host", state.alias("state"))
    first = rows.where("state = 'new'").groupBy("host").agg(F.min("doc_id").alias("doc_id")).orderBy("doc_id", "host").limit(50).select("doc_id", "host", F.lit(True).alias("added"))
    return rows.join(first, ["doc_id", "host"], "left").select("doc_id", "host", "state", F.coalesce("added", F.lit(False)).alias("added"))


SUBMISSIONS_SQL = f"""with s as ({duck_text(_SUBMITTED)}), h as (select doc_id, regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(wanted)), '^[a-z][a-z0-9+.-]*://', ''), '[/?#].*$', ''), ':[0-9]*$', ''), '^www[.]', ''), '[.]$', '') as host from s),
  k as (select distinct {_NORMAL} as site from domain_rows where domain is not null),
  r as (select doc_id, host, case when coalesce(host, '') = '' then 'missing' when not ({_VALID}) then 'invalid' when not ({_PLAIN}) then 'infrastructure' when host in (select site from k) then 'known' else 'new' end as state from h),
  n as (select host, min(doc_id) as doc_id from r where state = 'new' group by host order by doc_id, host limit 50)
  select r.doc_id, r.host, r.state, n.host is not null as added from r left join n on n.doc_id = r.doc_id and n.host = r.host"""


def record_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The published ratios of the last day, in percent to one decimal; those without a denominator are left out."""
    last = daily_record(spark, sf_dir).orderBy(F.desc("stat_day")).limit(1)
    count = lambda key: F.coalesce(F.regexp_extract("per_posture", f"{key}=([0-9]+)", 1).try_cast("int"), F.lit(0))
    of = {
        "blocking": F.col("blocking_any"), "walled": F.col("blocking_all"), "policy-gap": F.col("policy_gaps"), "llms-txt": F.col("llms_txt"), "agents-md": F.col("agents_md"), "who-decides": count("inherited") + count("absent"), "metered": F.col("payment_required"),
    }
    pct = lambda c: F.floor(c.cast("double") * 1000 / F.nullif(F.col("observed"), F.lit(0)) + 0.5) / 10
    rows = F.array(*[F.struct(F.lit(n).alias("finding"), pct(c).alias("value")) for n, c in of.items()], F.struct(F.lit("mean-score").alias("finding"), F.col("mean_score").alias("value")))
    return last.select("stat_day", F.explode(rows).alias("f")).select("stat_day", "f.*").where("value is not null")


_POSTURE = lambda k: f"coalesce(try_cast(regexp_extract(per_posture, '{k}=([0-9]+)', 1) as int), 0)"
FINDINGS_SQL = f"with d as ({BATCH_SQL['daily_record']}), l as (select * from d order by stat_day desc limit 1) " + " union all ".join(
    f"select stat_day, '{n}' as finding, {v} as value from l where {v} is not null"
    for n, v in {**{n: f"floor(({c}) * cast(1000 as double) / nullif(observed, 0) + 0.5) / 10" for n, c in {"blocking": "blocking_any", "walled": "blocking_all", "policy-gap": "policy_gaps", "llms-txt": "llms_txt", "agents-md": "agents_md", "who-decides": f"{_POSTURE('inherited')} + {_POSTURE('absent')}", "metered": "payment_required"}.items()}, "mean-score": "mean_score"}.items()
)


def series_state(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per feed: its last day, the last trusted one, whether the last is quarantined, and the last day on which a new baseline was accepted."""
    r = pipelines.reassessed_series(spark, sf_dir)
    when = lambda c: F.max(F.when(c, F.col("day")))
    return r.groupBy("feed").agg(F.max("day").alias("last_day"), when(~F.col("suspect")).alias("trusted_day"), F.max_by("suspect", "day").alias("quarantined"), when(F.col("baseline_moved")).alias("moved_day"))


STATE_SQL = f"with r as ({pipelines.REASSESSED_SQL}) select feed, max(day) as last_day, max(day) filter (where not suspect) as trusted_day, arg_max(suspect, day) as quarantined, max(day) filter (where baseline_moved) as moved_day from r group by feed"

SERIES_POINTS = """with d as (select feed, stat_day, max(observed) as observed from @daily_stats where stat_day is not null and feed is not null group by 1, 2), w as (select *, min(observed) over (partition by feed) as lo, max(observed) over (partition by feed) as hi, count(observed) over (partition by feed) as n from d)
  select feed, stat_day, case when hi = lo then 0.5 else cast(observed - lo as double) / (hi - lo) end as height from w where n >= 3 and observed is not null"""
ESCAPED = "select doc_id, replace(replace(replace(replace(left(coalesce(text, ''), 100), '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '\"', '&quot;') as escaped, length(coalesce(text, '')) as size from @documents"
SITEMAP = f"select concat('/site/', site) as loc from (select distinct {_NORMAL} as site from @domain_rows where domain is not null) a union select concat('/platforms/', platform) from @domain_rows where platform is not null union select concat('/networks/', network) from @domain_rows where network is not null union select concat('/reports/', month_of(stat_day)) from @daily_stats where stat_day is not null"
SUMMARY = "select site, observed_at, kind, nth from (select *, row_number() over (order by observed_at desc, site, kind) as nth from ({changes}) c where day_of(observed_at) = (select max(day_of(observed_at)) from ({changes}) m)) x where nth <= 30"


def _orders(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    return table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")


def _by_segment(j: DataFrame) -> DataFrame:
    return j.groupBy("c_mktsegment").agg(F.count(F.lit(1)).alias("n"), F.sum("o_totalprice").alias("total"))


#: Least milliseconds between two requests to one host.
POLITE_MS = 1200


def polite_schedule(spark: SparkSession, sf_dir: str) -> DataFrame:
    """When each probe of a host may start so that the host is left alone for POLITE_MS between two. The wanted times are the observations' times of day, so that they crowd."""
    o = table(spark, sf_dir, "observations").where("domain is not null and observed_at is not null").select("obs_id", normal.normal_domain(F.col("domain")).alias("host"), (F.unix_millis("observed_at") % 3_600_000).alias("wanted")).distinct()
    return timeline.spaced(o, "host", "wanted", "obs_id", POLITE_MS, 600_000).select("obs_id", "host", "wanted", "start")


POLITE_SQL = f"""with o as (select distinct obs_id, {_NORMAL} as host, epoch_ms(observed_at) % 3600000 as wanted from observations where domain is not null and observed_at is not null), n as (select *, row_number() over (partition by host order by wanted, obs_id) as n from o)
  select obs_id, host, wanted, max(wanted - n * {POLITE_MS}) over (partition by host order by wanted, obs_id rows unbounded preceding) + n * {POLITE_MS} as start from n"""

ERRORS = "select kind, count(*) as n from (select case when error is null then 'none' when regexp_like(lower(error), 'timeout|timed out|abort') then 'timeout' when regexp_like(lower(error), 'dns|enotfound|not found') then 'dns' when regexp_like(lower(error), 'reset|refused|closed') then 'connection' when regexp_like(lower(error), 'tls|cert|ssl') then 'tls' else 'other' end as kind from @observations) e group by kind"
SENTENCES = f"{FULL} select site, concat(site, case when total is null then ' could not be scored' else concat(' scores ', cast(total as string), ' of 100 (', grade, ')') end, case when n_blocked = 0 then ', lets every answer agent in' when n_blocked >= {s.TIER1_TOKENS} then ', keeps every answer agent out' else concat(', keeps ', cast(n_blocked as string), ' of {s.TIER1_TOKENS} answer agents out') end, '.') as sentence from scored"


def join_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A sort-merge join by hint."""
    o, c = _orders(spark, sf_dir)
    return _by_segment(o.join(c.hint("merge"), "o_custkey"))


def join_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A shuffled hash join by hint."""
    o, c = _orders(spark, sf_dir)
    return _by_segment(o.join(c.hint("shuffle_hash"), "o_custkey"))


def join_sized(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A join that broadcasts its small side only if its size is known to be small."""
    o, c = _orders(spark, sf_dir)
    return _by_segment(joins.sized_join(o, c, ["o_custkey"]))


SEGMENT_SQL = "select c_mktsegment, count(*) as n, sum(o_totalprice) as total from orders join customer on o_custkey = c_custkey group by c_mktsegment"


def udaf_geometric_mean(spark: SparkSession, sf_dir: str) -> DataFrame:
    """An aggregate function of one's own (grouped Arrow batches). It needs a whole group in one task, so it is given the distinct prices of a priority with their counts."""

    @F.pandas_udf("double")
    def geometric(price: pd.Series, n: pd.Series) -> float:
        import numpy as np

        return float(np.exp((np.log(price) * n).sum() / n.sum()))

    bins = table(spark, sf_dir, "orders").groupBy("o_orderpriority", F.floor(F.col("o_totalprice") / 1000).alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    return bins.groupBy("o_orderpriority").agg(geometric((F.col("bin") * 1000 + 500).cast("double"), F.col("n")).alias("mean"))


UDAF_SQL = "select o_orderpriority, exp(sum(ln(bin * 1000 + 500) * n) / sum(n)) as mean from (select o_orderpriority, floor(o_totalprice / 1000) as bin, count(*) as n from orders group by 1, 2) b group by 1"


@F.udtf(returnType="part_no int, part string")
class NameParts:
    """A table function of one's own: the words of a name with their places."""

    def eval(self, name: str):
        for i, part in enumerate(name.split(" ") if name is not None else ()):
            yield i, part


def udtf_name_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each part's name in words, by a table function in a lateral join."""
    spark.udtf.register("name_parts", NameParts)
    return spark.sql("select p_partkey, t.part_no, t.part from {p} p, lateral name_parts(p.p_name) t", p=table(spark, sf_dir, "part"))


UDTF_SQL = "select p_partkey, cast(i as int) as part_no, w as part from (select p_partkey, unnest(range(0, len(ws))) as i, unnest(ws) as w from (select p_partkey, string_split(p_name, ' ') as ws from part) a) b"


def stream_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user's events (an hour's gap) that the watermark has closed, put out once."""
    table(spark, sf_dir, "events")
    return streams.run(streams.closed_sessions(streams.file_stream(spark, f"{sf_dir}/events.parquet")), "append")


SESSIONS_SQL = """with g as (select user_id, ts, case when ts - lag(ts) over w < interval 1 hour then 0 else 1 end as starts from events window w as (partition by user_id order by ts)), s as (select *, sum(starts) over (partition by user_id order by ts rows unbounded preceding) as k from g)
  select user_id, min(ts) as began, max(ts) + interval 1 hour as ended, count(*) as n from s group by user_id, k having max(ts) + interval 1 hour <= (select max(ts) from events) - interval 2 hour"""


def stream_sliding(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two-hour windows every hour that the watermark has closed, put out once."""
    table(spark, sf_dir, "events")
    return streams.run(streams.sliding_counts(streams.file_stream(spark, f"{sf_dir}/events.parquet")), "append")


SLIDING_SQL = """with w as (select date_trunc('hour', ts) - (interval 1 hour) * k as began, value from events, (values (0), (1)) v(k)) select began, count(*) as n, sum(value) as total from w group by began having began + interval 2 hour <= (select max(ts) from events) - interval 2 hour"""

_CHANGES = "select site, observed_at, kind from @change_events"
QUERIES = {
    "normalised_hosts": normalised_hosts, "submissions": submissions, "record_findings": record_findings, "series_state": series_state, "series_points": query(SERIES_POINTS), "escaped_texts": query(ESCAPED), "sitemap": query(SITEMAP),
    "polite_schedule": polite_schedule, "fetch_errors": query(ERRORS), "site_sentences": query(SENTENCES.replace(FULL, "with scored as (select * from @scored_sites)"), views=pipelines.sites.VIEWS),
    "join_merge": join_merge, "join_hash": join_hash, "join_sized": join_sized, "udaf_geometric_mean": udaf_geometric_mean, "udtf_name_parts": udtf_name_parts, "stream_sessions": stream_sessions, "stream_sliding": stream_sliding,
    "crawl_summary": query(SUMMARY.replace("{changes}", _CHANGES), views={"change_events": pipelines.sites.change_events}),
}
ORACLE = {
    "normalised_hosts": HOSTS_SQL, "submissions": SUBMISSIONS_SQL, "record_findings": FINDINGS_SQL, "series_state": STATE_SQL, "series_points": duck_text(SERIES_POINTS), "escaped_texts": duck_text(ESCAPED), "sitemap": duck_text(SITEMAP),
    "polite_schedule": POLITE_SQL, "fetch_errors": duck_text(ERRORS), "site_sentences": duck_text(SENTENCES),
    "join_merge": SEGMENT_SQL, "join_hash": SEGMENT_SQL, "join_sized": SEGMENT_SQL, "udaf_geometric_mean": UDAF_SQL, "udtf_name_parts": UDTF_SQL, "stream_sessions": SESSIONS_SQL, "stream_sliding": SLIDING_SQL,
    "crawl_summary": duck_text(SUMMARY.replace("{changes}", SITE_SQL["change_events"])),
}
