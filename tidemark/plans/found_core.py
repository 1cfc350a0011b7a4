"""Queries of the general problems 3 to 7, with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions.normal import normal_domain, set_hash, token_set, utc_text
from tidemark.operators import profile, schema_drift, shred
from tidemark.operators.history import merge_history, version_history
from tidemark.operators.snapshot_diff import snapshot_changes
from tidemark.tables import checkpoint, spread, table

#: p3_merged takes what was ingested before this instant as the stored history, the rest as one batch.
MERGE_CUT = "2026-02-15 00:00:00"


def _policy_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "observations").where("reachable and tier1_blocked is not null")
    return o.select(normal_domain(F.col("domain")).alias("domain"), "vantage", "observed_at", "ingested_at", "obs_id", set_hash(token_set(F.col("tier1_blocked"))).alias("tokens_hash"))


def _periods(h: DataFrame) -> DataFrame:
    return h.select("domain", "vantage", utc_text(F.col("valid_from")).alias("valid_from"), F.coalesce(utc_text(F.col("valid_to")), F.lit("")).alias("valid_to"))


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """History of tier1_blocked for every normalised domain and vantage: all daily loads merged into an empty history."""
    return _periods(merge_history(None, _policy_log(spark, sf_dir), None, ["domain", "vantage"], "observed_at", F.col("tokens_hash"), latest_by=["ingested_at", "obs_id"]))


def p3_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same history built in two steps: a stored history, then a merge of what was ingested later."""
    log = _policy_log(spark, sf_dir)
    cut = F.lit(MERGE_CUT).cast("timestamp")
    how = {"keys": ["domain", "vantage"], "ts": "observed_at", "attr_hash": F.col("tokens_hash"), "latest_by": ["ingested_at", "obs_id"]}
    early = F.coalesce(F.col("ingested_at") < cut, F.lit(False))  # rows without a time of ingestion come with the batch
    stored = checkpoint(version_history(log.where(early), **how))  # a stored table: the merge reads it several times
    return _periods(merge_history(stored, log.where(~early), log, **how))


_DOMAIN = "regexp_replace(regexp_replace(lower(trim(domain)), '\\.$', ''), '^www\\.', '')"
_TOKENS = "array_to_string(list_sort(list_distinct(list_transform(list_filter({0}, lambda x: x is not null), lambda x: lower(x)))), chr(1))"

P3_SQL = f"""
with r as (
  select {_DOMAIN} as domain, vantage, observed_at, ingested_at, obs_id, {_TOKENS.format('tier1_blocked')} as toks
  from observations where reachable and tier1_blocked is not null and observed_at is not null),
one as (select * from r qualify row_number() over (partition by domain, vantage, observed_at order by ingested_at desc, obs_id desc) = 1),
chg as (select *, lag(toks) over (partition by domain, vantage order by observed_at) as before,
  row_number() over (partition by domain, vantage order by observed_at) as n from one),
v as (select * from chg where n = 1 or toks is distinct from before)
select domain, vantage, strftime(observed_at at time zone 'UTC', '%Y-%m-%d %H:%M:%S') as valid_from,
  coalesce(strftime(lead(observed_at) over (partition by domain, vantage order by observed_at) at time zone 'UTC', '%Y-%m-%d %H:%M:%S'), '') as valid_to
from v
"""


def p7_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Domains added, removed and changed between consecutive snapshots."""
    s = table(spark, sf_dir, "domain_snapshots")
    llms = F.xxhash64(F.coalesce(F.col("llms_txt.present").cast("string"), F.lit("-")), F.coalesce(F.col("llms_txt.spec_valid").cast("string"), F.lit("-")), set_hash(F.array_sort(F.array_distinct(F.col("llms_txt.issues")))))
    hashes = {"tier1_blocked": set_hash(token_set(F.col("tier1_blocked"))), "llms_txt": llms, "probe_version": F.xxhash64(F.coalesce(F.col("probe_version"), F.lit("\x00")))}
    return snapshot_changes(s, "snapshot_no", normal_domain(F.col("domain")), hashes, latest_by=["observed_at", "delivered_at"]).withColumnRenamed("key", "domain")


P7_SQL = f"""
with r as (
  select snapshot_no, {_DOMAIN} as domain, observed_at, delivered_at, {_TOKENS.format('tier1_blocked')} as t,
    coalesce(cast(llms_txt.present as varchar), '-') || '|' || coalesce(cast(llms_txt.spec_valid as varchar), '-') || '|' ||
    coalesce(array_to_string(list_sort(list_distinct(llms_txt.issues)), chr(1)), '-') as l, probe_version as p
  from domain_snapshots),
one as (select * from r qualify row_number() over (partition by snapshot_no, domain order by observed_at desc, delivered_at desc) = 1),
pairs as (
  select a.snapshot_no as no, a.domain as d, b.domain as was, a.t, b.t as bt, a.l, b.l as bl, a.p, b.p as bp
  from one a left join one b on b.snapshot_no = a.snapshot_no - 1 and b.domain = a.domain),
numbers as (select distinct snapshot_no from domain_snapshots)
select no as snapshot_no, d as domain, 'added' as change from pairs where was is null and no - 1 in (select snapshot_no from numbers)
union all
select b.snapshot_no + 1, b.domain, 'removed' from one b left join one a on a.snapshot_no = b.snapshot_no + 1 and a.domain = b.domain
where a.domain is null and b.snapshot_no + 1 in (select snapshot_no from numbers)
union all select no, d, 'tier1_blocked' from pairs where was is not null and t is distinct from bt
union all select no, d, 'llms_txt' from pairs where was is not null and l is distinct from bl
union all select no, d, 'probe_version' from pairs where was is not null and p is distinct from bp
"""

STATS_RULES = {
    "counts": ("observed", "blocking_any_tier1"),
    "flag": "suspect",
    "texts": "suspect_reasons",
    "pattern": r"[a-z]+:-?[0-9]+(\.[0-9]+)?",
}


def _rules() -> profile.Rules:
    some = F.size("suspect_reasons") > 0
    return profile.Rules(
        **STATS_RULES,
        ranges={
            "observed": (F.col("observed") < 0) | (F.col("observed") > F.col("total_domains")),
            "blocking_any_tier1": (F.col("blocking_any_tier1") < 0) | (F.col("blocking_any_tier1") > F.col("observed")),
        },
        consistency=(F.col("suspect") & ~F.coalesce(some, F.lit(False))) | (~F.col("suspect") & F.coalesce(some, F.lit(False))),
    )


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What is wrong with a load, or differs from the load before."""
    return profile.findings(table(spark, sf_dir, "daily_stats"), ["feed"], "load_no", _rules())


def p4_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Null share, distinct values, range, median and rule violations of the four columns in every load."""
    return profile.describe(table(spark, sf_dir, "daily_stats"), ["feed"], "load_no", _rules())


def p4_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same description of every column of the table, whatever its type."""
    d = table(spark, sf_dir, "daily_stats")
    return profile.describe(d, ["feed"], "load_no", _rules(), [c for c in d.columns if c not in ("feed", "load_no")])


def p4_discrimination(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well a classifier tells a load from the one before, and each column's part in it."""
    return profile.profile(table(spark, sf_dir, "daily_stats"), ["feed"], "load_no", _rules())[2]


P4_SQL = """
with r as (select distinct * from daily_stats),
b as (select feed, load_no, count(*) as n,
  count(*) - count(observed) as u1, count(*) - count(blocking_any_tier1) as u2, count(*) - count(suspect) as u3, count(*) - count(suspect_reasons) as u4,
  min(observed) as lo1, max(observed) as hi1, min(blocking_any_tier1) as lo2, max(blocking_any_tier1) as hi2,
  median(observed) as m1, median(blocking_any_tier1) as m2, count(*) filter (where suspect) as t, count(suspect) as k,
  bool_or(observed < 0 or observed > total_domains) as bad1, bool_or(blocking_any_tier1 < 0 or blocking_any_tier1 > observed) as bad2,
  bool_or(len(list_filter(suspect_reasons, lambda x: not regexp_full_match(x, '[a-z]+:-?[0-9]+(\\.[0-9]+)?'))) > 0) as badp,
  bool_or((suspect and coalesce(len(suspect_reasons), 0) = 0) or (not suspect and coalesce(len(suspect_reasons), 0) > 0)) as badc
  from r group by feed, load_no),
p as (select b.*, a.n as pn, a.u1 as p1, a.u2 as p2, a.u3 as p3, a.u4 as p4, a.lo1 as plo1, a.hi1 as phi1, a.lo2 as plo2, a.hi2 as phi2, a.m1 as pm1, a.m2 as pm2, a.t as pt, a.k as pk
  from b join b a on a.feed = b.feed and a.load_no = b.load_no - 1)
select feed, load_no, 'observed' as column_name, 'value_range' as check_name from b where bad1
union all select feed, load_no, 'blocking_any_tier1', 'value_range' from b where bad2
union all select feed, load_no, 'suspect_reasons', 'pattern' from b where badp
union all select feed, load_no, 'suspect', 'consistency' from b where badc
union all select feed, load_no, 'observed', 'null_rate' from p where abs(u1 * pn - p1 * n) * 10 > n * pn
union all select feed, load_no, 'blocking_any_tier1', 'null_rate' from p where abs(u2 * pn - p2 * n) * 10 > n * pn
union all select feed, load_no, 'suspect', 'null_rate' from p where abs(u3 * pn - p3 * n) * 10 > n * pn
union all select feed, load_no, 'suspect_reasons', 'null_rate' from p where abs(u4 * pn - p4 * n) * 10 > n * pn
union all select feed, load_no, 'observed', 'constant' from p where lo1 = hi1 and plo1 < phi1
union all select feed, load_no, 'blocking_any_tier1', 'constant' from p where lo2 = hi2 and plo2 < phi2
union all select feed, load_no, 'observed', 'shift' from p where abs(m1 - pm1) * 5 > abs(pm1)
union all select feed, load_no, 'blocking_any_tier1', 'shift' from p where abs(m2 - pm2) * 5 > abs(pm2)
union all select feed, load_no, 'suspect', 'shift' from p where k > 0 and pk > 0 and abs(t * pk - pt * k) * 5 > k * pk
"""

_P4_COLUMNS = {
    "observed": ("observed", "observed < 0 or observed > total_domains"),
    "blocking_any_tier1": ("blocking_any_tier1", "blocking_any_tier1 < 0 or blocking_any_tier1 > observed"),
    "suspect": ("cast(suspect as bigint)", "(suspect and coalesce(len(suspect_reasons), 0) = 0) or (not suspect and coalesce(len(suspect_reasons), 0) > 0)"),
    "suspect_reasons": ("len(suspect_reasons)", "len(list_filter(suspect_reasons, lambda x: not regexp_full_match(x, '[a-z]+:-?[0-9]+(\\.[0-9]+)?'))) > 0"),
}

P4_PROFILE_SQL = "with r as (select distinct * from daily_stats where feed is not null and load_no is not null)\n" + "\nunion all ".join(
    f"""select feed, load_no, '{c}' as column_name, count(*) as n, count(*) - count({c}) as nulls, (count(*) - count({c})) / count(*) as null_share, count(distinct {c}) as "distinct",
  min({v}) as least, max({v}) as greatest, cast(median({v}) as double) as median, count(*) filter (where {bad}) as violations from r group by feed, load_no"""
    for c, (v, bad) in _P4_COLUMNS.items()
)

_ALL = {c: f"cast({c} as double)" for c in ("total_domains", "observed", "mean_score", "attempted", "succeeded", "blocking_any_tier1", "blocking_all_tier1", "llms_txt", "agents_md", "policy_gaps")}
_ALL |= {"loaded_at": "cast(floor(epoch(loaded_at)) as double)", "stat_day": "cast(floor(epoch(cast(stat_day as timestamp))) as double)", "suspect": "cast(cast(suspect as bigint) as double)", "suspect_reasons": "cast(len(suspect_reasons) as double)"}
P4_COLUMNS_SQL = "with r as (select distinct * from daily_stats where feed is not null and load_no is not null)\n" + "\nunion all ".join(
    f"""select feed, load_no, '{c}' as column_name, count(*) as n, count(*) - count({c}) as nulls, (count(*) - count({c})) / count(*) as null_share, count(distinct {c}) as "distinct",
  min({v}) as least, max({v}) as greatest, cast(median({v}) as double) as median, count(*) filter (where {_P4_COLUMNS[c][1] if c in _P4_COLUMNS else 'false'}) as violations from r group by feed, load_no"""
    for c, v in _ALL.items()
)


def _feed_leaves(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    lines = table(spark, sf_dir, "feed_lines").select("feed", "file_no", "line_no", "payload")
    leaves = schema_drift.read_leaves(spread(lines), "feed", "file_no", "line_no", "payload", ["day", "domain"])
    leaves = checkpoint(leaves)  # parsed once, read for the schemas and for the values
    return leaves, lines.select("feed", "file_no").distinct()


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fields added, removed, renamed or retyped between consecutive files of a feed."""
    return schema_drift.schema_changes(*_feed_leaves(spark, sf_dir)).drop("score")


def p5_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every removed and added path of consecutive files with its flooding score, and whether it is selected."""
    return schema_drift.candidates(schema_drift.path_changes(*_feed_leaves(spark, sf_dir)))


def p5_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All files of all feeds as one consistent table."""
    leaves, files = _feed_leaves(spark, sf_dir)
    t = schema_drift.unite(leaves, schema_drift.schema_changes(leaves, files))
    return t.select("feed", "file_no", "line_no", "record", F.to_json("kinds").alias("kinds"))


ARRAYS = ["robots.namedTokens", "robots.groups.agents", "robots.groups.disallow", "robots.groups.allow", "structured.jsonLdTypes", "structured.nodes.types", "content.landmarks"]


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Elements of the lists below obs, with the places of their record, parent and own."""
    lines = spread(table(spark, sf_dir, "domains_jsonl").select("record_id", "raw"))
    leaf = [f"obs.{p}" for p in ARRAYS]
    nodes = shred.shred(lines, "record_id", "raw", arrays=["obs", "obs.robots.groups", "obs.structured.nodes", *leaf], texts=["obs"], paths=leaf)
    up = shred.parent_label(F.col("label"))  # the list; the node before it is the group, node or observation
    nested = F.col("path").rlike(r"^obs\.(robots\.groups|structured\.nodes)\.")
    return nodes.where("element and kind <> 'null'").select(
        "record_id",
        F.col("label")[1].alias("obs_no"),
        F.regexp_replace("path", r"^obs\.", "").alias("path"),
        F.when(nested, F.element_at(up, -2)).otherwise(0).alias("parent_pos"),
        F.element_at("label", -1).alias("pos"),
        "value",
    )


def p6_tables(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The flat tables a record gives: for each schema path its nodes, parents, records and empty values."""
    lines = spread(table(spark, sf_dir, "domains_jsonl").select("record_id", "raw"))
    nodes = shred.shred(lines, "record_id", "raw", arrays=["obs", "obs.robots.groups", "obs.structured.nodes", *[f"obs.{p}" for p in ARRAYS]], texts=["obs"])
    t = nodes.withColumn("parent", shred.parent_label(F.col("label")))
    return t.groupBy("path").agg(F.count(F.lit(1)).alias("nodes"), F.count_distinct("record_id", "parent").alias("parents"), F.count_distinct("record_id").alias("records"), F.count_if(F.col("kind") == "null").alias("nulls"))


_READABLE = "json_valid({0}) and not regexp_matches({0}, ',[ \\t\\r\\n]*[}}\\]]')"
_P5_LEAVES = f"""lines as (select feed, file_no, line_no, cast(payload as json) as v from feed_lines where payload is not null and {_READABLE.format('payload')} and json_type(payload) = 'OBJECT'),
  tree as (select l.feed, l.file_no, l.line_no, l.v, t.fullkey, t.type, t.value from lines l, json_tree(l.v) t),
  leaf as (select distinct feed, file_no, coalesce('day:' || json_extract_string(v, '$.day'), 'domain:' || json_extract_string(v, '$.domain')) as record, replace(substr(fullkey, 3), '"', '') as path,
    case when type = 'VARCHAR' then 'string' when type = 'BOOLEAN' then 'boolean' when type = 'ARRAY' then 'array' else 'number' end as kind, case when type in ('VARCHAR', 'BOOLEAN', 'ARRAY') then cast(value as varchar) else cast(cast(value as double) as varchar) end as val
    from tree where type not in ('OBJECT', 'NULL') and not contains(fullkey, '['))"""
P5_SQL = f"""with {_P5_LEAVES}, files as (select distinct feed, file_no from feed_lines), paths as (select feed, file_no, path, list_sort(list_distinct(list(kind))) as kinds from leaf group by 1, 2, 3),
  pairs as (select a.feed, a.file_no from files a join files b on a.feed = b.feed and b.file_no = a.file_no - 1),
  sides as (select p.feed, p.file_no, coalesce(n.path, o.path) as path, o.kinds as old, n.kinds as new from pairs p join (select distinct feed, path from paths) u on u.feed = p.feed
    left join paths n on n.feed = p.feed and n.file_no = p.file_no and n.path = u.path left join paths o on o.feed = p.feed and o.file_no = p.file_no - 1 and o.path = u.path where n.path is not null or o.path is not null),
  gone as (select * from sides where new is null), come as (select * from sides where old is null),
  met as (select g.feed, g.file_no, g.path as old_path, c.path as new_path, a.record, bool_and(a.kind = b.kind and a.val = b.val) as same from gone g join come c on c.feed = g.feed and c.file_no = g.file_no
    join leaf a on a.feed = g.feed and a.file_no = g.file_no - 1 and a.path = g.path join leaf b on b.feed = g.feed and b.file_no = g.file_no and b.path = c.path and b.record = a.record group by all),
  sure as (select feed, file_no, old_path, new_path from met group by all having count(*) >= 5 and bool_and(same)),
  named as (select * from sure qualify row_number() over (partition by feed, file_no, old_path order by new_path) = 1 and row_number() over (partition by feed, file_no, new_path order by old_path) = 1)
  select feed, file_no, 'renamed' as change, old_path, new_path from named
  union all select g.feed, g.file_no, 'removed', g.path, '' from gone g where not exists (select 1 from named n where n.feed = g.feed and n.file_no = g.file_no and n.old_path = g.path)
  union all select c.feed, c.file_no, 'added', '', c.path from come c where not exists (select 1 from named n where n.feed = c.feed and n.file_no = c.file_no and n.new_path = c.path)
  union all select feed, file_no, 'retyped', path, path from sides where old is not null and new is not null and old <> new"""


def _listed(x: str) -> str:
    """A JSON value as a list: an array's elements, nothing for null, else the value alone."""
    return f"case when {x} is null or json_type({x}) = 'NULL' then [] when json_type({x}) = 'ARRAY' then json_extract({x}, '$[*]') else [{x}] end"


def _parsed(x: str) -> str:
    """A JSON value, read as what it says if it is a text that holds JSON."""
    text = f"json_extract_string({x}, '$')"
    return f"case when json_type({x}) = 'VARCHAR' and {_READABLE.format(text)} then cast({text} as json) else {x} end"


_SIMPLE = [p for p in ARRAYS if p.count(".") == 1]
_NESTED = [p for p in ARRAYS if p.count(".") == 2]
_dot = lambda p: "$." + p
P6_SQL = f"""with r as (select distinct record_id, raw from domains_jsonl where raw is not null and {_READABLE.format('raw')}), w as (select record_id, cast(raw as json) as v from r), b as (select record_id, json_extract(v, '$.obs') as v from w where json_type(v) = 'OBJECT'),
  t as (select record_id, {_parsed('v')} as v from b where v is not null), o as (select record_id, {_listed('v')} as vs from t),
  e0 as (select record_id, unnest(range(0, len(vs))) as obs_no, unnest(vs) as v from o), e as (select record_id, obs_no, {_parsed('v')} as v from e0),
  simple as ({' union all '.join(f"select record_id, obs_no, '{p}' as path, 0 as parent_pos, json_extract(v, '{_dot(p)}') as x from e where json_type(v) = 'OBJECT'" for p in _SIMPLE)}),
  up as ({' union all '.join(f"select record_id, obs_no, '{q}' as up, {_listed(f"json_extract(v, '{_dot(q)}')")} as vs from e where json_type(v) = 'OBJECT'" for q in sorted({p.rpartition('.')[0] for p in _NESTED}))}),
  u as (select record_id, obs_no, up, unnest(range(0, len(vs))) as parent_pos, unnest(vs) as v from up),
  nested as ({' union all '.join(f"select record_id, obs_no, '{p}' as path, parent_pos, json_extract(v, '$.{p.rpartition('.')[2]}') as x from u where up = '{p.rpartition('.')[0]}' and json_type(v) = 'OBJECT'" for p in _NESTED)}),
  every as (select *, {_listed('x')} as xs from (select * from simple union all select * from nested) q), f as (select record_id, obs_no, path, parent_pos, unnest(range(0, len(xs))) as pos, unnest(xs) as x from every)
  select record_id, cast(obs_no as int) as obs_no, path, cast(parent_pos as int) as parent_pos, cast(pos as int) as pos, case when json_type(x) in ('ARRAY', 'OBJECT') then cast(x as varchar) else json_extract_string(x, '$') end as value from f where json_type(x) <> 'NULL'"""

QUERIES = {
    "p3_found": p3_found, "p3_merged": p3_merged, "p4_found": p4_found, "p4_profile": p4_profile, "p4_columns": p4_columns, "p4_discrimination": p4_discrimination, "p5_found": p5_found, "p5_candidates": p5_candidates, "p5_table": p5_table,
    "p6_found": p6_found, "p6_tables": p6_tables, "p7_found": p7_found,
}
ORACLE = {"p3_found": P3_SQL, "p3_merged": P3_SQL, "p4_found": P4_SQL, "p4_profile": P4_PROFILE_SQL, "p4_columns": P4_COLUMNS_SQL, "p7_found": P7_SQL, "p5_found": P5_SQL, "p6_found": P6_SQL}
