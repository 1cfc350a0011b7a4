"""Queries over documents (robots rules, link files, markup) and the engine's general surface.

The markup queries wrap each document's text in a page made from its own columns, since the test
tables hold no pages. The last part covers joins, windows, grouping and set forms that a user of a
DataFrame engine expects beyond the site queries.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import html as h
from tidemark.functions import robots
from tidemark.operators import asof, timeline
from tidemark.plans.sqlkit import duck_text, query
from tidemark.tables import table

TEXTS: dict[str, str] = {}
_ROBOTS = "lower(trim(source)) = 'robots_txt' and text is not null"


def _rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").where(_ROBOTS).select("doc_id", "text").distinct()
    return robots.rule_groups(robots.rule_lines(docs, "doc_id", "text"))


def robots_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rule groups of every robots document."""
    join = lambda c: F.array_join(c, "|").alias(c)
    return _rules(spark, sf_dir).select("doc_id", F.col("group_no").cast("bigint").alias("group_no"), join("agents"), join("disallow"), join("allow"))


def _robots_docs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").where(_ROBOTS).select("doc_id").distinct()


def robots_access(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether each registered token may fetch the root of each robots document."""
    return robots.access(_rules(spark, sf_dir), table(spark, sf_dir, "agent_registry"), _robots_docs(spark, sf_dir))


#: A name that no group lists: what is denied to it is denied to all.
UNLISTED = "an-agent-that-no-list-names"


def robots_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per robots document: groups, registered tokens named (in the order of the registry), those denied by tier, use of allow rules, blanket denial."""
    g = _rules(spark, sf_dir)
    agents = F.transform("agents", F.lower)
    star = F.min_by(F.when(F.array_contains(agents, "*"), F.array_contains("disallow", "/")), F.when(F.array_contains(agents, "*"), F.col("group_no")))
    per = g.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("groups"), F.max(F.exists("allow", lambda x: x != "")).alias("uses_allow"), F.coalesce(star, F.lit(False)).alias("star_root"), F.array_distinct(F.flatten(F.collect_list(agents))).alias("names")
    )
    reg = table(spark, sf_dir, "agent_registry").where("token is not null").dropDuplicates(["token"])
    known = reg.agg(F.array_sort(F.collect_list(F.struct("registry_order", "token", "tier")))).scalar()
    d = _robots_docs(spark, sf_dir).join(per, "doc_id", "left").join(robots.verdicts(g), "doc_id", "left").withColumn("known", known)
    pick = lambda cond: F.array_join(F.transform(F.filter("known", cond), lambda t: t["token"]), ",")
    denied = lambda tier: pick(lambda t: (t["tier"] == tier) & ~robots.allowed(F.col("verdicts"), t["token"]))
    return d.select(
        "doc_id",
        F.coalesce("groups", F.lit(0)).alias("groups"),
        F.coalesce("uses_allow", F.lit(False)).alias("uses_allow"),
        (F.coalesce("star_root", F.lit(False)) & ~robots.allowed(F.col("verdicts"), F.lit(UNLISTED))).alias("blanket"),
        F.coalesce(pick(lambda t: F.array_contains("names", F.lower(t["token"]))), F.lit("")).alias("named"),
        denied(1).alias("tier1_denied"),
        denied(2).alias("tier2_denied"),
    )


PROBE = "TansyBot"


def robots_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What each robots document lets the probe do: ``opted-out`` (named and denied: nothing is recorded), ``robots-restricted``
    (denied to all: only the rules are recorded), else ``open``."""
    g = robots.verdicts(_rules(spark, sf_dir))
    v = F.col("verdicts")
    gate = F.when(robots.allowed(v, F.lit(PROBE)), "open").when(F.try_element_at(v, F.lit(PROBE.lower())).isNotNull(), "opted-out").otherwise("robots-restricted")
    return _robots_docs(spark, sf_dir).join(g, "doc_id", "left").select("doc_id", gate.alias("gate"))


_LINES = """l as (select doc_id, pos, lower(trim(split_part(bare, ':', 1))) as field, trim(substr(bare, strpos(bare, ':') + 1)) as value from (
    select doc_id, generate_subscripts(ls, 1) as pos, regexp_replace(unnest(ls), '#.*$', '') as bare from (select doc_id, regexp_split_to_array(text, '\\r?\\n') as ls from documents where """ + _ROBOTS + """) a) b where strpos(bare, ':') > 0),
  m as (select *, case when field = 'user-agent' and coalesce(lag(field) over (partition by doc_id order by pos), '') <> 'user-agent' then 1 else 0 end as starts from l),
  n as (select *, sum(starts) over (partition by doc_id order by pos) as group_no from m),
  g as (select doc_id, cast(group_no as bigint) as group_no, coalesce(list(value order by pos) filter (where field = 'user-agent'), []) as agents, coalesce(list(value order by pos) filter (where field = 'disallow'), []) as disallow, coalesce(list(value order by pos) filter (where field = 'allow'), []) as allow
    from n where group_no > 0 group by doc_id, group_no)"""
_BEST = "coalesce(list_max(list_transform({0}, lambda r: case when r <> '' and starts_with('/', regexp_replace(r, '\\*$', '')) then length(regexp_replace(r, '\\*$', '')) else -1 end)), -1)"
_OK = f"({_BEST.format('disallow')} < 0 or {_BEST.format('allow')} >= {_BEST.format('disallow')})"
ROBOTS_SQL = {
    "robots_groups": f"with {_LINES} select doc_id, group_no, array_to_string(agents, '|') as agents, array_to_string(disallow, '|') as disallow, array_to_string(allow, '|') as allow from g",
    "robots_access": f"""with {_LINES}, j as (select doc_id, group_no, {_OK} as ok, unnest(list_transform(agents, lambda x: lower(x))) as agent from g),
      f as (select doc_id, agent, arg_min(ok, group_no) as ok from j group by doc_id, agent), d as (select distinct doc_id from documents where {_ROBOTS})
      select d.doc_id, a.token, coalesce(x.ok, s.ok, true) as allowed from d cross join agent_registry a left join f x on x.doc_id = d.doc_id and x.agent = lower(a.token) left join f s on s.doc_id = d.doc_id and s.agent = '*'""",
    "robots_summary": f"""with {_LINES}, j as (select doc_id, group_no, {_OK} as ok, list_contains(disallow, '/') as root, unnest(list_transform(agents, lambda x: lower(x))) as agent from g),
      f as (select doc_id, agent, arg_min(ok, group_no) as ok, arg_min(root, group_no) as root from j group by doc_id, agent), d as (select distinct doc_id from documents where {_ROBOTS}),
      s as (select doc_id, count(*) as groups, bool_or(len(list_filter(allow, lambda x: x <> '')) > 0) as uses_allow from g group by doc_id),
      t as (select d.doc_id, a.token, a.tier, a.registry_order, f.agent is not null as named, coalesce(f.ok, star.ok, true) as ok from d join agent_registry a on true
        left join f on f.doc_id = d.doc_id and f.agent = lower(a.token) left join f star on star.doc_id = d.doc_id and star.agent = '*'),
      y as (select doc_id, coalesce(string_agg(token, ',' order by registry_order) filter (where named), '') as named, coalesce(string_agg(token, ',' order by registry_order) filter (where tier = 1 and not ok), '') as tier1_denied,
        coalesce(string_agg(token, ',' order by registry_order) filter (where tier = 2 and not ok), '') as tier2_denied from t group by doc_id)
      select d.doc_id, coalesce(s.groups, 0) as groups, coalesce(s.uses_allow, false) as uses_allow, coalesce(star.root and not star.ok, false) as blanket, y.named, y.tier1_denied, y.tier2_denied
      from d join y on y.doc_id = d.doc_id left join s on s.doc_id = d.doc_id left join f star on star.doc_id = d.doc_id and star.agent = '*'""",
    "robots_gate": f"""with {_LINES}, j as (select doc_id, group_no, {_OK} as ok, unnest(list_transform(agents, lambda x: lower(x))) as agent from g),
      f as (select doc_id, agent, arg_min(ok, group_no) as ok from j group by doc_id, agent), d as (select distinct doc_id from documents where {_ROBOTS})
      select d.doc_id, case when x.ok = false then 'opted-out' when x.ok is null and s.ok = false then 'robots-restricted' else 'open' end as gate
      from d left join f x on x.doc_id = d.doc_id and x.agent = '{PROBE.lower()}' left join f s on s.doc_id = d.doc_id and s.agent = '*'""",
}

TEXTS["robots_directives"] = f"select doc_id, regexp_like(text, '(?im)^[ \\t]*sitemap[ \\t]*:') as sitemap, nullif(regexp_extract(text, '(?im)^[ \\t]*crawl-delay[ \\t]*:[ \\t]*([0-9]+)', 1), '') as delay, nullif(left(regexp_extract(text, '(?im)^[ \\t]*license[ \\t]*:[ \\t]*([^ \\t\\r\\n]+)', 1), 300), '') as licence, length(text) as size from @documents where {_ROBOTS}"
TEXTS["link_file_check"] = """select doc_id, regexp_like(text, '(?m)^#[ \\t]+[^ \\t\\r\\n]') as heading, regexp_like(text, '(?m)^>[ \\t]*[^ \\t\\r\\n]') as summary, regexp_like(text, '(?m)^##[ \\t]+[^ \\t\\r\\n]') as section,
  array_size(regexp_extract_all(text, '(?m)^[ \\t]*-[ \\t]*~[.+][(].+[)]', 0)) as links from @documents where lower(trim(source)) in ('llms_txt', 'agents_md') and text is not null"""
_PAGE = """p as (select doc_id, concat('<!doctype html><html lang="', coalesce(lang, ''), '-XX"><head><title> ', coalesce(domain, ''), ' </title><style>p{color:red}</style><script type="x">var a = "<p>";</script></head><body><!-- ', coalesce(source, ''), ' --><header></header><main><h1>', coalesce(source, ''),
  '</h1><p>', replace(coalesce(text, ''), '<', '&lt;'), '</p><h2>a</h2><h2>b</h2><ul><li>x</li></ul><img src="a" alt="b"><img src="c"></main>', case when doc_id % 3 = 0 then '<footer></footer>' else '' end, case when doc_id % 5 = 0 then '<form action="x"></form>' else '' end, '</body></html>') as html from @documents)"""
TEXTS["page_text"] = f"with {_PAGE} select doc_id, length({h.strip_to_text('html')}) as text_length, floor(length({h.strip_to_text('html')}) * cast(10000 as double) / length(html) + 0.5) / 10000 as text_ratio from p"
TEXTS["page_features"] = f"""with {_PAGE} select doc_id, {h.count_tag('html', 'h1')} as h1, {h.count_tag('html', 'h2')} as h2, {h.count_tag('html', 'ul')} as lists, array_size(regexp_extract_all(html, '(?i)<img[^>]*>', 0)) as images,
  array_size(filter(regexp_extract_all(html, '(?i)<img[^>]*>', 0), x -> regexp_like(x, '(?i)alt="[^"]+"'))) as images_alt, nullif(trim(left(regexp_extract(html, '(?is)<title[^>]*>(.*?)</title>', 1), 300)), '') as title,
  lower(split_part(regexp_extract(html, '(?i)<html[^>]*lang="([^"]*)"', 1), '-', 1)) as lang, {' + '.join(f"case when {h.has('html', f'(?i)<{t}[ >]')} then 1 else 0 end" for t in h.LANDMARKS)} as landmarks, {h.has('html', '(?i)<form[ >]')} as form, {h.has('html', '(?i)noindex')} as noindex from p"""

_HOST = "regexp_replace(regexp_replace(regexp_replace(regexp_replace(lower(trim(regexp_extract(text, '### Domain[ \\t\\r\\n]+([^ \\t\\r\\n]+)', 1))), '^https?://', ''), '[/:].*$', ''), '^www[.]', ''), '[.]$', '')"
_VALID = "length(host) <= 253 and regexp_like(host, '^[a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{0,61}[a-z0-9])?)+$')"
TEXTS["issue_domains"] = f"""with i as (select doc_id, {_HOST} as host from @documents where lower(trim(source)) = 'issue' and text is not null), d as (select distinct domain from @domain_rows)
  select doc_id, host, case when host = '' then 'missing' when not ({_VALID}) then 'invalid' when regexp_like(host, '(^|[.])(cdn|api|static|assets|cache)[.]') then 'infrastructure' end as rejection, d.domain is not null as known from i left join d on i.host = d.domain"""

# general surface
TEXTS["revenue_by_flag"] = "select l_returnflag, l_linestatus, sum(l_quantity) as sum_qty, sum(l_extendedprice * (1 - l_discount)) as revenue, avg(l_discount) as avg_disc, count(*) as n from @lineitem group by l_returnflag, l_linestatus"
TEXTS["star_join"] = "select r_name, sum(l_extendedprice * (1 - l_discount)) as revenue, count(*) as n from @lineitem join @orders on l_orderkey = o_orderkey join @customer on o_custkey = c_custkey join @nation on c_nationkey = n_nationkey join @region on n_regionkey = r_regionkey group by r_name"
TEXTS["join_full_outer"] = "select coalesce(c_custkey, o_custkey) as custkey, count(o_orderkey) as orders, max(c_custkey is not null) as known from @customer full outer join @orders on c_custkey = o_custkey group by 1".replace("max(c_custkey is not null)", "count(distinct c_custkey) > 0")
TEXTS["join_semi"] = "select count(*) as n, sum(c_acctbal) as balance from @customer c where exists (select 1 from @orders o where o.o_custkey = c.c_custkey and o_totalprice > 100000)"
TEXTS["join_anti"] = "select count(*) as n, sum(c_acctbal) as balance from @customer c where not exists (select 1 from @orders o where o.o_custkey = c.c_custkey)"
TEXTS["join_theta_bands"] = "with b as (select explode({bands}) as lo) select lo, count(*) as n, sum(o_totalprice) as total from b join @orders on lo = cast(floor(o_totalprice / 50000) as int) and o_totalprice >= lo * 50000 and o_totalprice < (lo + 1) * 50000 group by lo"
TEXTS["cube"] = "select l_returnflag, l_linestatus, grouping(l_returnflag) as gf, grouping(l_linestatus) as gs, count(*) as n, sum(l_quantity) as qty from @lineitem group by cube (l_returnflag, l_linestatus)"
TEXTS["rollup"] = "select o_orderpriority, o_orderstatus, count(*) as n, sum(o_totalprice) as total from @orders group by rollup (o_orderpriority, o_orderstatus)"
TEXTS["grouping_sets"] = "select o_orderpriority, o_orderstatus, count(*) as n from @orders group by grouping sets ((o_orderpriority), (o_orderstatus), ())"
TEXTS["distinct_aggregates"] = "select l_returnflag, count(distinct l_partkey) as parts, count(distinct l_suppkey) as suppliers, count(*) as n from @lineitem group by l_returnflag"
TEXTS["window_running"] = "select event_id, user_id, sum(value) over (partition by user_id order by ts, event_id rows between unbounded preceding and current row) as running, avg(value) over (partition by user_id order by ts, event_id rows between 2 preceding and current row) as moving from @events"
TEXTS["window_ranks"] = "select o_orderkey, rank() over w as r, dense_rank() over w as d, ntile(4) over (partition by o_custkey order by o_totalprice desc, o_orderkey) as quarter from @orders window w as (partition by o_custkey order by o_orderpriority)"
TEXTS["window_lead_lag"] = "select event_id, lag(value) over w as before, lead(value) over w as after, first_value(value) over w as first from @events window w as (partition by user_id order by ts, event_id)"
TEXTS["tumbling_hours"] = "select event_type, cast(floor(seconds_of(ts) / 3600) as bigint) as hour, count(*) as n, sum(value) as total from @events group by 1, 2"
TEXTS["sessions"] = "with g as (select user_id, ts, event_id, case when seconds_of(ts) - lag(seconds_of(ts)) over (partition by user_id order by ts, event_id) <= 3600 then 0 else 1 end as starts from @events), s as (select *, sum(starts) over (partition by user_id order by ts, event_id) as session_no from g) select user_id, session_no, count(*) as n, min(ts) as began, max(ts) as ended from s group by user_id, session_no"
TEXTS["intersect_all"] = "select l_suppkey from @lineitem where l_quantity > 49 intersect all select s_suppkey as l_suppkey from @supplier"
TEXTS["except_all"] = "select o_custkey from @orders except all select c_custkey as o_custkey from @customer"
TEXTS["union_distinct"] = "select n_name as name from @nation union select r_name from @region"
TEXTS["correlated_max"] = "select o_custkey, o_orderkey from @orders o where o_totalprice = (select max(o_totalprice) from @orders i where i.o_custkey = o.o_custkey)"
TEXTS["pivot_status"] = "select o_orderpriority, sum(case when o_orderstatus = 'F' then o_totalprice end) as f, sum(case when o_orderstatus = 'O' then o_totalprice end) as o, sum(case when o_orderstatus = 'P' then o_totalprice end) as p from @orders group by o_orderpriority"
TEXTS["statistics"] = "select l_returnflag, stddev_samp(l_extendedprice) as sd, var_pop(l_quantity) as vp, corr(l_quantity, l_extendedprice) as c, median(l_quantity) as med from @lineitem group by l_returnflag"
TEXTS["string_functions"] = "select n_nationkey, upper(n_name) as u, left(n_name, 3) as l3, replace(n_name, 'A', '_') as r, length(n_name) as n, concat_ws('-', n_name, cast(n_regionkey as string)) as c, lpad(n_name, 12, '.') as p from @nation"
TEXTS["vector_norms"] = "select vec_id, label, sqrt(aggregate_squares(embedding)) as norm from @embeddings"
TEXTS["recursive_series"] = "with recursive r(n, f) as (select 1, cast(1 as bigint) union all select n + 1, f * (n + 1) from r where n < 15) select n, f from r"


def events_json(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sum of a field of the JSON property column, by type."""
    e = table(spark, sf_dir, "events")
    k = F.try_variant_get(F.try_parse_json("props"), "$.k", "int")
    return e.groupBy("event_type").agg(F.sum(k).alias("total"), F.count(k).alias("n"))


def asof_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each observation with the score that stood when it was made."""
    o = table(spark, sf_dir, "observations").select("obs_id", "domain", "vantage", "observed_at").where("domain is not null and observed_at is not null").dropDuplicates(["obs_id"])
    d = table(spark, sf_dir, "domain_rows").select("domain", "vantage", "scored_at", "row_id", F.col("score.total").alias("total")).dropDuplicates(["row_id"])
    return asof.asof_join(o, d, ["domain", "vantage"], "observed_at", "scored_at", tie="row_id", carry=["row_id", "total"]).select("obs_id", "row_id", "total")


ASOF_SQL = """with o as (select distinct on (obs_id) obs_id, domain, vantage, observed_at from observations where domain is not null and observed_at is not null order by obs_id, ingested_at),
  d as (select distinct domain, vantage, scored_at, row_id, score.total as total from domain_rows),
  j as (select o.obs_id, d.row_id, d.total, row_number() over (partition by o.obs_id order by d.scored_at desc, d.row_id desc) as nth from o left join d on o.domain = d.domain and o.vantage = d.vantage and d.scored_at <= o.observed_at)
  select obs_id, row_id, total from j where nth = 1"""


def range_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events counted in the hour before each purchase of the same user, by binned range join."""
    e = table(spark, sf_dir, "events")
    buys = e.where("event_type = 'purchase'").select("event_id", "user_id", "ts")
    return asof.count_before(buys, e.select("user_id", F.col("ts").alias("at")), "event_id", ["user_id"], "ts", "at", 3600)


RANGE_SQL = "select b.event_id, count(e.event_id) as n from events b left join events e on e.user_id = b.user_id and e.ts < b.ts and e.ts >= b.ts - interval 1 hour where b.event_type = 'purchase' group by b.event_id"


def structured_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Types and author marks of the linked-data blocks of each document's page.

    A block's root, the items of a root array and of ``@graph`` are nodes; nothing deeper is. Blocks that are no JSON
    are skipped. The pages carry a block by id: a graph, an array, one that is malformed, or none.
    """
    block = F.coalesce(*[F.when(F.col("doc_id") % 4 == k, F.lit(f'<script type="application/ld+json">{v}</script>')) for k, v in _BLOCKS.items()], F.lit(""))
    pages = query(f"with {_PAGE} select doc_id, html from p")(spark, sf_dir).select("doc_id", F.concat("html", block).alias("html"))
    raw = pages.select("doc_id", F.explode(F.regexp_extract_all("html", F.lit("(?is)<script[^>]+type=.application/ld.json.[^>]*>(.*?)</script>"), 1)).alias("raw"))
    v = raw.select("doc_id", F.try_parse_json(F.trim("raw")).alias("v")).where("v is not null")
    items = lambda c, path: F.coalesce(F.try_variant_get(c, path, "array<variant>"), F.array())
    roots = v.select("doc_id", F.explode(F.concat(items("v", "$"), F.array("v"))).alias("node"))
    nodes = roots.select("doc_id", F.explode(F.concat(F.array("node"), items("node", '$["@graph"]'))).alias("node"))
    one = F.try_variant_get("node", '$["@type"]', "string")
    types = F.coalesce(F.try_variant_get("node", '$["@type"]', "array<string>"), F.when(one.isNotNull(), F.array(one)), F.array().cast("array<string>"))
    author = F.coalesce(F.try_variant_get("node", "$.author", "string"), F.lit(""))
    each = nodes.select("doc_id", types.alias("types"), (~author.isin("", "[]", "null")).alias("author"))
    return each.groupBy("doc_id").agg(F.array_join(F.array_sort(F.array_distinct(F.flatten(F.collect_list("types")))), ",").alias("types"), F.max("author").alias("has_author"))


_BLOCKS = {0: '{"@graph": [{"@type": "Organization"}, {"@type": ["WebSite", "Thing"], "author": {"name": "x"}}]}', 1: '[{"@type": "Article", "author": ""}, {"part": {"@type": "Hidden"}}]', 2: '{"@type": "Broken",'}
TYPES_SQL = f"""with b as (select doc_id, case doc_id % 4 {' '.join(f"when {k} then '{v}'" for k, v in _BLOCKS.items())} end as v from documents), ok as (select doc_id, cast(v as json) as v from b where json_valid(v)),
  root as (select doc_id, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') else [v] end) as v from ok), nodes as (select doc_id, unnest([v] || coalesce(json_extract(v, '$."@graph"[*]'), [])) as node from root),
  t as (select doc_id, node, case when json_type(node, '$."@type"') = 'ARRAY' then json_extract_string(node, '$."@type"[*]') when json_type(node, '$."@type"') = 'VARCHAR' then [json_extract_string(node, '$."@type"')] else [] end as types from nodes)
  select doc_id, array_to_string(list_sort(list_distinct(flatten(list(types)))), ',') as types, bool_or(coalesce(json_extract_string(node, '$.author'), '') not in ('', '[]', 'null')) as has_author from t group by doc_id"""


def approximate_aggregates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sketch-based distinct counts and percentiles (no exact counterpart)."""
    l = table(spark, sf_dir, "lineitem")  # noqa: E741
    return l.groupBy("l_returnflag").agg(F.approx_count_distinct("l_partkey").alias("parts"), F.percentile_approx("l_extendedprice", 0.5).alias("median"))


def salted_skew_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Observations per registered domain row through a join whose hot keys are salted.

    Domain rows are counted before the join, so an observation meets one row and a domain hot on both sides makes no pairs.
    """
    o = table(spark, sf_dir, "observations").select("domain", "obs_id").where("domain is not null")
    d = table(spark, sf_dir, "domain_rows").select("domain", "row_id").where("domain is not null").distinct()
    rows = d.groupBy("domain").agg(F.count(F.lit(1)).alias("rows"))
    return asof.salted_join(o, rows, "domain", 16).groupBy("domain").agg(F.sum("rows").alias("n"))


SALTED_SQL = "select o.domain, count(*) as n from observations o join (select distinct domain, row_id from domain_rows) d on o.domain = d.domain group by o.domain"

def sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of every user's events, an hour's gap between them."""
    return timeline.sessions(table(spark, sf_dir, "events"), "user_id", "ts", 3600)


_FORMS = {"~[": ("\\\\[", "\\["), "{bands}": ("sequence(0, 9)", "range(0, 10)"), "aggregate_squares(embedding)": ("aggregate(embedding, cast(0 as double), (a, x) -> a + cast(x as double) * x)", "list_sum(list_transform(embedding, lambda x: cast(x as double) * x))")}
QUERIES = {"structured_types": structured_types, "robots_groups": robots_groups, "robots_access": robots_access, "robots_summary": robots_summary, "robots_gate": robots_gate, "events_json": events_json, "asof_scores": asof_scores, "range_events": range_events, "approximate_aggregates": approximate_aggregates, "salted_skew_join": salted_skew_join}
ORACLE = {**ROBOTS_SQL, "structured_types": TYPES_SQL, "events_json": "select event_type, sum(cast(json_extract(props, '$.k') as int)) as total, count(json_extract(props, '$.k')) as n from events group by event_type", "asof_scores": ASOF_SQL, "range_events": RANGE_SQL, "salted_skew_join": SALTED_SQL}
for _name, _text in TEXTS.items():
    _a, _b = _text, _text
    for _k, (_s, _d) in _FORMS.items():
        _a, _b = _a.replace(_k, _s), _b.replace(_k, _d)
    QUERIES[_name], ORACLE[_name] = query(_a), duck_text(_b)
_ratio = TEXTS["page_text"].replace(h.strip_to_text("html"), h.strip_to_text("html", ", 'g'"))
ORACLE["page_text"] = duck_text(_ratio)
QUERIES["sessions"] = sessions
