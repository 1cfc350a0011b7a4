"""Batches over the sites' history: the figures of every day, one crawl's outcome and gate, seeds, month reports and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions import scoring as s
from tidemark.operators.timeline import runs_of
from tidemark.plans import sites
from tidemark.plans.reference import ORACLE as SITE_SQL
from tidemark.plans.sqlkit import duck_text, query
from tidemark.plans.texts import COMPARABLE, FULL, MIN_COHORT, PAST, SERIES, TOKEN, _NORMAL
from tidemark.tables import checkpoint, table

CRAWL_DAY = "2026-03-01"
DEMOTE = 3

_flag = sites.t_flag
_or0 = lambda c: F.coalesce(F.col(c), F.lit(0))


def _half_up(c: Column, digits: int) -> Column:
    return F.floor(c * 10**digits + 0.5) / 10**digits


def daily_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All figures of every day in one row, from one pass over the scored history.

    Maps are texts ``key=count`` (``key=count/blocking`` for the stack) in the order of the key, of the registry for tokens, which are
    zero-filled like the ten bands. Signals are null where no record of the day looked for them.
    """
    reg = table(spark, sf_dir, "agent_registry").where("token is not null").dropDuplicates(["token"])
    roles = reg.agg(F.map_from_entries(F.collect_list(F.struct(F.lower("token"), "agent_role")))).scalar()
    known = reg.agg(F.transform(F.array_sort(F.collect_list(F.struct("registry_order", "token"))), lambda t: t["token"])).scalar()
    assistants = reg.where("tier = 1 and agent_role = 'assistant'").agg(F.count(F.lit(1))).scalar()
    h = sites.scored_history(spark, sf_dir).withColumns({"roles": roles, "assistants": assistants})
    blocked = F.coalesce("t1", F.array().cast("array<string>"))
    of = F.array_distinct(F.transform(blocked, lambda x: F.coalesce(F.try_element_at("roles", x), F.lit("unknown"))))
    archetype = (
        F.when(F.expr(s.METERED), "metered").when(~_flag("robots.present"), "undeclared").when(F.col("n_blocked") == 0, "open").when(F.col("n_blocked") >= s.TIER1_TOKENS, "walled")
        .when(of == F.array(F.lit("training")), "no-training").when(~F.array_contains(of, "assistant") & (F.col("assistants") > 0), "assistant-only").otherwise("selective")
    )
    seen, some = F.col("total").isNotNull(), F.col("n_blocked") > 0
    denied, status = F.coalesce(F.array_contains("t1", TOKEN.lower()), F.lit(False)), F.coalesce("cloaking.bot_status", F.lit(0))
    both = F.array_distinct(F.concat(blocked, F.coalesce("t2", F.array().cast("array<string>"))))
    item = lambda kind, key, hit=F.lit(0): F.struct(F.lit(kind).alias("kind"), key.cast("string").alias("key"), hit.cast("int").alias("hit"))
    items = F.array_compact(
        F.concat(
            F.array(
                item("day", F.lit("")), F.when(seen & F.col("stack.platform").isNotNull(), item("platform", F.col("stack.platform"), some)), F.when(seen & F.col("stack.network").isNotNull(), item("network", F.col("stack.network"), some)),
                F.when(seen, item("posture", F.col("posture"))), F.when(seen, item("archetype", archetype)), F.when(F.expr(COMPARABLE), item("band", F.least(F.lit(9), F.floor(F.col("total") / 10).cast("int")))),
            ),
            F.transform(both, lambda t: item("bot", t)),
        )
    )
    looked = seen & F.col("signals").isNotNull()
    flags = {
        "observed": seen, "blocking_any": seen & some, "blocking_all": seen & (F.col("n_blocked") >= s.TIER1_TOKENS), "llms_txt": seen & _flag("llms_txt.present"), "agents_md": seen & _flag("agents_md.present"), "refused": seen & _flag("cloaking.detected"),
        "payment_required": F.expr(s.METERED), "succeeded": _flag("reachable"), "policy_gaps": seen & F.col("gap"), "open_honest": seen & ~denied & ~F.col("gap"), "blocked_honest": seen & denied & (status >= 400),
        "declared_only": seen & denied & _flag("cloaking.tested") & (status > 0) & (status < 400), "signals_observed": looked, "declared_licence": looked & (F.col("signals.license_url").isNotNull() | _flag("signals.license_link")),
        "content_signal": looked & (F.coalesce("signals.content_signal", F.lit("")) != ""), "agent_card": looked & _flag("signals.agent_card"), "dateline": looked & _flag("signals.date_published"), "authorship": looked & _flag("signals.has_author"),
    }
    rows = h.select(F.to_date("observed_at").alias("stat_day"), "total", *[c.alias(n) for n, c in flags.items()], F.explode(items).alias("i"))
    whole = F.col("i.kind") == "day"
    counts = rows.groupBy("stat_day", F.col("i.kind").alias("kind"), F.col("i.key").alias("key")).agg(F.count(F.lit(1)).alias("n"), F.sum("i.hit").alias("hit"), F.sum(F.when(whole, F.col("total"))).alias("points"), *[F.count_if(whole & F.col(c)).alias(c) for c in flags])
    said = lambda kind, text: F.array_join(F.array_sort(F.collect_list(F.when(F.col("kind") == kind, text))), ",")
    one = lambda c: F.max(F.when(F.col("kind") == "day", F.col(c)))
    held = lambda kind: F.map_from_entries(F.collect_list(F.when(F.col("kind") == kind, F.struct("key", "n"))))
    pair, share = F.concat("key", F.lit("="), "n"), F.concat("key", F.lit("="), "n", F.lit("/"), "hit")
    days = counts.groupBy("stat_day").agg(
        one("n").alias("total_domains"), one("points").alias("points"), *[one(c).alias(c) for c in flags],
        held("bot").alias("bots"), held("band").alias("bands"), said("platform", share).alias("per_platform"), said("network", share).alias("per_network"), said("posture", pair).alias("per_posture"), said("archetype", pair).alias("per_archetype"),
    ).withColumn("known", known)
    zero = lambda m, k: F.coalesce(F.try_element_at(m, k), F.lit(0))
    asked = ("declared_licence", "content_signal", "agent_card", "dateline", "authorship")
    return days.select(
        "stat_day", "total_domains", _half_up(F.try_divide(F.col("points"), F.col("observed")), 2).alias("mean_score"), *[c for c in flags if c not in asked],
        *[F.when(F.col("signals_observed") > 0, F.col(c)).alias(c) for c in asked],
        F.col("total_domains").alias("attempted"), F.col("total_domains").alias("crawled"), F.lit(0).alias("carried"), F.lit(False).alias("partial"),
        F.array_join(F.transform("known", lambda t: F.concat(t, F.lit("="), zero(F.col("bots"), F.lower(t)))), ",").alias("per_bot"), "per_platform", "per_network", "per_posture", "per_archetype",
        F.array_join(F.transform(F.sequence(F.lit(0), F.lit(9)), lambda b: zero(F.col("bands"), b.cast("string"))), ",").alias("histogram"),
    )


def _record_sql() -> str:
    seen = "total is not null"
    denied = f"coalesce(list_contains(t1, '{TOKEN.lower()}'), false)"
    status = "coalesce(cloaking.bot_status, 0)"
    n_if = lambda c: f"count(*) filter (where {c})"
    sig = lambda c: f"case when {n_if(f'{seen} and signals is not null')} > 0 then {n_if(f'{seen} and signals is not null and {c}')} end"
    stack = lambda k: f"p_{k} as (select stat_day, string_agg(k || '=' || n || '/' || hit, ',' order by k) as text from (select stat_day, stack.{k} as k, count(*) as n, count(*) filter (where n_blocked > 0) as hit from h where {seen} and stack.{k} is not null group by 1, 2) group by 1)"
    facet = lambda k: f"p_{k} as (select stat_day, string_agg(k || '=' || n, ',' order by k) as text from (select stat_day, {k} as k, count(*) as n from h where {seen} group by 1, 2) group by 1)"
    return f"""{duck_text(PAST)}, h0 as (select *, cast(observed_at as date) as stat_day, row_number() over () as rid from totalled),
  br as (select h0.rid, list_sort(list_distinct(list(coalesce(a.agent_role, 'unknown')))) as roles from (select rid, unnest(t1) as token from h0) h0 left join agent_registry a on lower(a.token) = h0.token group by h0.rid),
  h as (select h0.*, case when coalesce(control.kind, '') = 'payment-required' then 'metered' when not coalesce(robots.present, false) then 'undeclared' when n_blocked = 0 then 'open' when n_blocked >= 11 then 'walled' when br.roles = ['training'] then 'no-training'
    when not list_contains(br.roles, 'assistant') and (select count(*) from agent_registry where tier = 1 and agent_role = 'assistant') > 0 then 'assistant-only' else 'selective' end as archetype from h0 left join br on br.rid = h0.rid),
  {stack('platform')}, {stack('network')}, {facet('posture')}, {facet('archetype')},
  toks as (select distinct stat_day, rid, token from (select stat_day, rid, unnest(t1) as token from h union all select stat_day, rid, unnest(t2) from h)), cells as (select stat_day, token, count(*) as n from toks group by 1, 2), days as (select distinct stat_day from h),
  bots as (select d.stat_day, string_agg(a.token || '=' || coalesce(c.n, 0), ',' order by a.registry_order) as text from days d join agent_registry a on a.token is not null left join cells c on c.stat_day = d.stat_day and c.token = lower(a.token) group by 1),
  bands as (select d.stat_day, string_agg(cast(coalesce(c.n, 0) as varchar), ',' order by b.b) as text from days d join (select unnest(range(0, 10)) as b) b on true left join (select stat_day, least(9, total // 10) as b, count(*) as n from h where {COMPARABLE} group by 1, 2) c on c.stat_day = d.stat_day and c.b = b.b group by 1),
  one as (select stat_day, count(*) as total_domains, floor(sum(total) / count(total) * 100 + 0.5) / 100 as mean_score, count(total) as observed, {n_if(f'{seen} and n_blocked > 0')} as blocking_any, {n_if(f'{seen} and n_blocked >= 11')} as blocking_all,
    {n_if(f'{seen} and llms_txt.present')} as llms_txt, {n_if(f'{seen} and agents_md.present')} as agents_md, {n_if(f'{seen} and cloaking.detected')} as refused, {n_if("control.kind = 'payment-required'")} as payment_required, {n_if('reachable')} as succeeded, {n_if(f'{seen} and gap')} as policy_gaps,
    {n_if(f'{seen} and not {denied} and not gap')} as open_honest, {n_if(f'{seen} and {denied} and {status} >= 400')} as blocked_honest, {n_if(f'{seen} and {denied} and cloaking.tested and {status} > 0 and {status} < 400')} as declared_only, {n_if(f'{seen} and signals is not null')} as signals_observed,
    {sig('(signals.license_url is not null or coalesce(signals.license_link, false))')} as declared_licence, {sig("coalesce(signals.content_signal, '') <> ''")} as content_signal, {sig('coalesce(signals.agent_card, false)')} as agent_card, {sig('coalesce(signals.date_published, false)')} as dateline, {sig('coalesce(signals.has_author, false)')} as authorship,
    count(*) as attempted, count(*) as crawled, 0 as carried, false as partial from h group by 1)
  select one.*, bots.text as per_bot, coalesce(p_platform.text, '') as per_platform, coalesce(p_network.text, '') as per_network, coalesce(p_posture.text, '') as per_posture, coalesce(p_archetype.text, '') as per_archetype, bands.text as histogram
  from one left join bots using (stat_day) left join p_platform using (stat_day) left join p_network using (stat_day) left join p_posture using (stat_day) left join p_archetype using (stat_day) left join bands using (stat_day)"""


def _crawl(spark: SparkSession, sf_dir: str, day: str) -> DataFrame:
    """Every site's row before ``day`` and its row of that day (``prev``, ``fresh``; null if none), with failures in a row and whether the corpus knows it.

    One pass: a site's two rows come from one aggregation that map tasks combine.
    """
    start = F.lit(day).cast("timestamp")
    rows = runs_of(sites.scored_history(spark, sf_dir), "site", "observed_at", ~_flag("reachable"), "failures").where(F.col("observed_at") < start + F.expr("interval 1 day"))
    state = F.struct("observed_at", "vantage", "probe_version", _flag("reachable").alias("up"), _flag("opted_out").alias("out"), F.coalesce(F.array_sort("t1"), F.array().cast("array<string>")).alias("blocked"), _flag("llms_txt.present").alias("llms"), _flag("agents_md.present").alias("agents"), "total", "n_blocked", "failures")
    new = F.col("observed_at") >= start
    last = lambda cond: F.max_by(F.when(cond, state), F.when(cond, F.col("observed_at")))
    both = rows.groupBy("site").agg(last(~new).alias("prev"), last(new).alias("fresh"))
    corpus = query(f"select distinct {_NORMAL} as site from @domain_rows where domain is not null")(spark, sf_dir).withColumn("known", F.lit(True))
    gone = lambda r: F.col(f"{r}.out") | (F.col(f"{r}.failures") >= DEMOTE)
    outcome = (
        F.when(F.col("fresh").isNotNull(), F.when(F.col("fresh.out"), "opted-out").when(F.col("fresh.failures") >= DEMOTE, "demoted").otherwise("published"))
        .when(gone("prev"), "excluded").when(F.col("known"), "carried").otherwise("dropped")
    )
    return both.join(corpus, "site", "left").withColumn("outcome", outcome).withColumn("now", F.coalesce("fresh", "prev"))


def crawl_rows(spark: SparkSession, sf_dir: str, day: str = CRAWL_DAY) -> DataFrame:
    """What one crawl makes of every site: published, opted out, demoted after DEMOTE failures; those not crawled are carried if the corpus knows them, stay excluded, or are dropped."""
    return _crawl(spark, sf_dir, day).select("site", "outcome", F.col("now.observed_at").alias("observed_at"), F.col("now.failures").alias("failures"), F.col("now.total").alias("total"))


def _figures(c: DataFrame, row: str, cond: Column) -> list[Column]:
    seen = cond & F.col(f"{row}.total").isNotNull()
    return [F.count_if(cond).alias("total_domains"), F.count_if(seen).alias("observed"), F.avg(F.when(seen, F.col(f"{row}.total"))).alias("mean"), F.count_if(seen & (F.col(f"{row}.n_blocked") > 0)).alias("blocking_any"), F.count_if(cond & F.col(f"{row}.up")).alias("succeeded")]


def crawl_run(spark: SparkSession, sf_dir: str, day: str = CRAWL_DAY, force: bool = False) -> DataFrame:
    """The crawl's figures and its gate, one row: figures of what is published or carried against those of the sites as they stood before.

    ``suspect``: nothing observed, or too many score changes (``broken``), or figures that moved too far (``drifted``), unless forced; a suspect
    crawl's changes are held back (``crawl_changes``).
    """
    c = _crawl(spark, sf_dir, day)
    kept = F.col("outcome").isin("published", "carried")
    was = F.col("prev").isNotNull() & ~F.col("prev.out") & (F.col("prev.failures") < DEMOTE) & F.coalesce("known", F.lit(False))
    ok = F.col("prev").isNotNull() & (F.col("prev.vantage") == F.col("fresh.vantage")) & (F.col("prev.probe_version") == F.col("fresh.probe_version"))
    moved = (F.col("outcome") == "published") & ok & (F.abs(F.col("fresh.total") - F.col("prev.total")) >= 3)
    f = c.agg(F.struct(*_figures(c, "now", kept)).alias("n"), F.struct(*_figures(c, "prev", was)).alias("b"), F.count_if(F.col("outcome") == "published").alias("crawled"), F.count_if(F.col("outcome") == "carried").alias("carried"), F.count_if(moved).alias("score_changes"))
    over = lambda c: F.coalesce(c, F.lit(False))
    rate = lambda r: F.try_divide(F.col(f"{r}.succeeded"), F.col(f"{r}.total_domains"))
    broken = (F.col("n.observed") == 0) | over(F.try_divide(F.col("score_changes"), F.col("n.observed")) > 0.1)
    drifted = F.when(
        F.col("b.total_domains") > 0,
        over(((rate("b") - F.coalesce(rate("n"), F.lit(0.0))) * 100 > 15) & (F.col("b.observed") > 0)) | (F.abs(F.col("n.observed") - F.col("b.observed")) / F.greatest(F.lit(1), "b.observed") > 0.2)
        | (F.try_divide(F.col("b.total_domains") - F.col("n.total_domains"), F.col("b.total_domains")) > 0.1) | over(F.abs(F.col("n.mean") - F.col("b.mean")) > 5),
    ).otherwise(False)
    return f.select(
        F.lit(day).alias("day"), "n.total_domains", "n.observed", _half_up(F.col("n.mean"), 2).alias("mean_score"), "n.blocking_any", "crawled", "carried", (F.col("carried") > 0).alias("partial"), "score_changes",
        broken.alias("broken"), drifted.alias("drifted"), ((broken | drifted) & F.lit(not force)).alias("suspect"),
    )


def crawl_changes(spark: SparkSession, sf_dir: str, day: str = CRAWL_DAY, force: bool = False) -> DataFrame:
    """Changes of the published sites against their stored rows; none if the run is suspect."""
    c = _crawl(spark, sf_dir, day).where("outcome = 'published' and prev is not null and prev.vantage = fresh.vantage and prev.probe_version = fresh.probe_version")
    kinds = F.array_compact(
        F.array(
            F.when(F.col("fresh.up") != F.col("prev.up"), F.lit("reachability")), F.when(F.col("fresh.blocked") != F.col("prev.blocked"), F.lit("access")),
            F.when((F.col("fresh.llms") != F.col("prev.llms")) | (F.col("fresh.agents") != F.col("prev.agents")), F.lit("surface")), F.when(F.abs(F.col("fresh.total") - F.col("prev.total")) >= 3, F.lit("score")),
        )
    )
    held_back = checkpoint(crawl_run(spark, sf_dir, day, force).select("suspect")).scalar()
    return c.select("site", F.explode(kinds).alias("kind")).withColumn("held_back", held_back).where("not held_back").drop("held_back")


def _crawl_sql(day: str) -> str:
    state = "site, observed_at, vantage, probe_version, coalesce(reachable, false) as up, coalesce(opted_out, false) as out, coalesce(list_sort(t1), []) as blocked, coalesce(llms_txt.present, false) as llms, coalesce(agents_md.present, false) as agents, total, n_blocked, failures"
    gone = lambda r: f"({r}.out or {r}.failures >= {DEMOTE})"
    last = lambda name, cond: f"{name} as (select {state} from runs where {cond} qualify row_number() over (partition by site order by observed_at desc) = 1)"
    return f"""{duck_text(PAST)}, g as (select *, sum(case when coalesce(reachable, false) then 1 else 0 end) over (partition by site order by observed_at) as run from totalled),
  runs as (select *, case when coalesce(reachable, false) then 0 else sum(case when coalesce(reachable, false) then 0 else 1 end) over (partition by site, run order by observed_at) end as failures from g),
  {last('prev', f"observed_at < timestamptz '{day} 00:00:00+00'")}, {last('fresh', f"observed_at >= timestamptz '{day} 00:00:00+00' and observed_at < timestamptz '{day} 00:00:00+00' + interval 1 day")},
  corpus as (select distinct {_NORMAL} as site from domain_rows where domain is not null),
  c as (select coalesce(f.site, p.site) as site, k.site is not null as known, p as prev, f as fresh, f.site is not null as has_fresh, p.site is not null as has_prev, case when f.site is not null then f else p end as now,
    case when f.site is not null then case when f.out then 'opted-out' when f.failures >= {DEMOTE} then 'demoted' else 'published' end when {gone('p')} then 'excluded' when k.site is not null then 'carried' else 'dropped' end as outcome
    from fresh f full outer join prev p on f.site = p.site left join corpus k on k.site = coalesce(f.site, p.site))"""


def _run_sql(day: str) -> str:
    kept = "outcome in ('published', 'carried')"
    was = f"has_prev and not prev.out and prev.failures < {DEMOTE} and known"
    n_if = lambda c: f"count(*) filter (where {c})"
    ok = "outcome = 'published' and has_prev and prev.vantage = fresh.vantage and prev.probe_version = fresh.probe_version"
    return f"""{_crawl_sql(day)}, f as (select {n_if(kept)} as total_domains, {n_if(f'{kept} and now.total is not null')} as observed, avg(now.total) filter (where {kept}) as mean, {n_if(f'{kept} and now.total is not null and now.n_blocked > 0')} as blocking_any, {n_if(f'{kept} and now.up')} as succeeded,
    {n_if(was)} as b_total, {n_if(f'{was} and prev.total is not null')} as b_observed, avg(prev.total) filter (where {was}) as b_mean, {n_if(f'{was} and prev.up')} as b_succeeded, {n_if("outcome = 'published'")} as crawled, {n_if("outcome = 'carried'")} as carried, {n_if(f'{ok} and abs(fresh.total - prev.total) >= 3')} as score_changes from c),
  v as (select *, observed = 0 or coalesce(score_changes / nullif(observed, 0) > 0.1, false) as broken, b_total > 0 and (coalesce(b_observed > 0 and (b_succeeded / b_total - coalesce(succeeded / nullif(total_domains, 0), 0)) * 100 > 15, false) or abs(observed - b_observed) / greatest(1, b_observed) > 0.2
    or (b_total - total_domains) / b_total > 0.1 or coalesce(abs(mean - b_mean) > 5, false)) as drifted from f)
  select '{day}' as day, total_domains, observed, floor(mean * 100 + 0.5) / 100 as mean_score, blocking_any, crawled, carried, carried > 0 as partial, score_changes, broken, drifted, broken or drifted as suspect from v"""


def _changes_sql(day: str) -> str:
    return f"""with run as ({_run_sql(day)}), c as ({_crawl_sql(day)} select * from c), k as (select site, unnest(list_filter([case when fresh.up <> prev.up then 'reachability' end, case when fresh.blocked <> prev.blocked then 'access' end,
    case when fresh.llms <> prev.llms or fresh.agents <> prev.agents then 'surface' end, case when abs(fresh.total - prev.total) >= 3 then 'score' end], lambda x: x is not null)) as kind from c where outcome = 'published' and has_prev and prev.vantage = fresh.vantage and prev.probe_version = fresh.probe_version)
  select site, kind from k where not (select suspect from run)"""


#: Seeds by precedence: fixed pins, then entries pinned before, then the ranked list; infrastructure names enter only pinned.
_PINS = f"select distinct {_NORMAL} as site from @documents where lower(trim(source)) = 'llms_txt' and domain is not null"
SEED = f"""with ranked as (select {_NORMAL} as site, min(site_rank) as site_rank, min(first_seen) as first_seen from @domain_rows where site_rank is not null and domain is not null group by 1),
  prior as (select {_NORMAL} as site, min(site_rank) as site_rank, min(observed_at) as first_seen, count(case when array_size(coalesce(tier1_blocked, empty_list())) >= 11 then 1 end) > 0 as pinned from @domain_snapshots where domain is not null group by 1), pins as ({_PINS}),
  every as (select site, site_rank, first_seen, 'pin' as origin, 1 as precedence, true as pinned from (select p.site, r.site_rank, coalesce(o.first_seen, r.first_seen) as first_seen from pins p left join ranked r on r.site = p.site left join prior o on o.site = p.site) x
    union all select o.site, coalesce(r.site_rank, o.site_rank), o.first_seen, 'prior', 2, true from prior o left join ranked r on r.site = o.site where o.pinned
    union all select r.site, r.site_rank, coalesce(o.first_seen, r.first_seen), 'ranked', 3, false from ranked r left join prior o on o.site = r.site where length(r.site) - length(replace(r.site, '.', '')) <= 2 and not regexp_like(r.site, '(^|[.])(cdn|api|static|assets|cache|img|images|media|fonts|ads|track|telemetry|edge|dl|update)[.]'))
  select site, site_rank, first_seen, origin, pinned from (select *, row_number() over (partition by site order by precedence) as nth from every) x where nth = 1"""

TARGETS = f"""with wanted as ({_PINS}), c as (select site, site_rank, row_number() over (order by site_rank asc nulls last, site) as nth from (select {_NORMAL} as site, min(site_rank) as site_rank from @domain_rows where domain is not null group by 1) x)
  select site, nth, asked from (select c.site, c.nth, w.site is not null as asked from c left join wanted w on w.site = c.site) y where asked or nth <= 500"""

_SEAL_LOAD = 4
MONTHS = f"""with {SERIES}, sealed as (select feed, month_of(stat_day) as month, count(*) as days, min_by(observed, stat_day) filter (where observed is not null) as first_observed, max_by(observed, stat_day) filter (where observed is not null) as last_observed
    from {{first_series}} where not coalesce(suspect, false) and stat_day is not null group by 1, 2),
  live as (select feed, month_of(stat_day) as month, count(*) as days, min_by(observed, stat_day) filter (where observed is not null) as first_observed, max_by(observed, stat_day) filter (where observed is not null) as last_observed from series where stat_day is not null group by 1, 2)
  select coalesce(s.feed, l.feed) as feed, coalesce(s.month, l.month) as month, s.feed is not null as sealed, case when s.feed is not null then s.days else l.days end as days, case when s.feed is not null then s.last_observed - s.first_observed else l.last_observed - l.first_observed end as observed_delta,
    row_number() over (partition by coalesce(s.feed, l.feed) order by coalesce(s.month, l.month) desc) as newest from live l full outer join sealed s on s.feed = l.feed and s.month = l.month"""
MONTHS = MONTHS.replace("{first_series}", "(select * from (select d.*, row_number() over (partition by feed, stat_day order by load_no desc, loaded_at desc, observed desc, total_domains desc, mean_score desc, blocking_any_tier1 desc, suspect desc) as nth from @daily_stats d where load_no <= 4) x where nth = 1)")


def bot_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Blocked counts of every token on the first and last day of each month, with the move between them."""
    d = query("select stat_day, token, blocked from @daily_per_bot", views={"daily_per_bot": _per_bot})(spark, sf_dir)
    m = d.groupBy(F.date_format("stat_day", "yyyy-MM").alias("month"), "token").agg(F.min_by("blocked", "stat_day").alias("first"), F.max_by("blocked", "stat_day").alias("last"))
    return m.select("month", "token", "first", "last", (F.col("last") - F.col("first")).alias("delta"))


def _per_bot(spark: SparkSession, sf_dir: str) -> DataFrame:
    from tidemark.plans.reference import QUERIES as site_queries

    return site_queries["daily_per_bot"](spark, sf_dir)


def site_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public document of every site: one JSON object each."""
    c = sites.scored_sites(spark, sf_dir)
    score = F.struct(F.col("total"), "grade", "partial", F.struct("earned_access", "max_access").alias("access"), F.struct("earned_surface", "max_surface").alias("surface"), F.struct("earned_structure", "max_structure").alias("structure"))
    policy = F.struct("posture", F.coalesce(F.array_sort("t1"), F.array().cast("array<string>")).alias("tier1_blocked"), F.coalesce(F.array_sort("t2"), F.array().cast("array<string>")).alias("tier2_blocked"), "gap")
    doc = F.struct(F.col("site").alias("domain"), "site_rank", "suffix", F.struct("platform", "network").alias("stack"), score.alias("score"), policy.alias("policy"))
    return c.select("site", F.to_json(doc, {"ignoreNullFields": "false"}).alias("document"))


_SITE_DOC = duck_text(f"""{FULL} select site, cast(to_json(struct_pack(domain := site, site_rank := site_rank, suffix := suffix, stack := struct_pack(platform := platform, network := network), score := struct_pack(total := total, grade := grade, partial := partial,
  access := struct_pack(earned_access := earned_access, max_access := max_access), surface := struct_pack(earned_surface := earned_surface, max_surface := max_surface), structure := struct_pack(earned_structure := earned_structure, max_structure := max_structure)),
  policy := struct_pack(posture := posture, tier1_blocked := coalesce(array_sort(t1), []), tier2_blocked := coalesce(array_sort(t2), []), gap := gap))) as varchar) as document from scored""")


def stats_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The public figures as one JSON object: the snapshot, cohorts by platform and network, the 40 largest suffixes, and the days' history."""
    c = sites.scored_sites(spark, sf_dir)
    now = c.agg(F.count(F.lit(1)).alias("sites"), F.count("total").alias("observed"), F.count_if(F.expr(COMPARABLE)).alias("comparable"), _half_up(F.avg("total"), 1).alias("mean_score"), F.count_if(F.col("gap") & F.col("total").isNotNull()).alias("policy_gaps"))

    def cohort(key: str, least: int) -> DataFrame:
        return c.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("id")).agg(F.count("total").alias("observed"), F.count_if(F.col("total").isNotNull() & (F.col("n_blocked") > 0)).alias("blocking"), F.count(F.lit(1)).alias("__n")).where(F.col("__n") >= least).where("observed > 0")

    def rows(df: DataFrame, limit: int | None = None):
        x = df.withColumn("__nth", F.row_number().over(Window.orderBy(F.desc("observed"), "id"))).where(F.col("__nth") <= (limit or 10**9))
        return x.agg(F.transform(F.array_sort(F.collect_list(F.struct("__nth", "id", "observed", "blocking"))), lambda r: F.struct(r["id"].alias("id"), r["observed"].alias("observed"), r["blocking"].alias("blocking")))).scalar()

    days = daily_record(spark, sf_dir).agg(F.array_sort(F.collect_list(F.struct("stat_day", "total_domains", "observed", "mean_score")))).scalar()
    full = now.select(F.struct("*").alias("snapshot"), rows(cohort("platform", MIN_COHORT)).alias("platforms"), rows(cohort("network", MIN_COHORT)).alias("networks"), rows(cohort("suffix", 1), 40).alias("suffixes"), days.alias("history"))
    return full.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("document"))


def run_meta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The run's singleton: what the last crawl day saw, and by which probe."""
    o = table(spark, sf_dir, "observations")
    return o.agg(F.max("observed_at").alias("last_seen"), F.max_by("probe_version", F.struct("observed_at", "obs_id")).alias("probe_version"), F.max_by("vantage", F.struct("observed_at", "obs_id")).alias("vantage"), F.max_by("registry_version", F.struct("observed_at", "obs_id")).alias("registry_version"), F.count_distinct("obs_id").alias("observations"))


META_SQL = "select max(observed_at) as last_seen, arg_max(probe_version, row(observed_at, obs_id)) as probe_version, arg_max(vantage, row(observed_at, obs_id)) as vantage, arg_max(registry_version, row(observed_at, obs_id)) as registry_version, count(distinct obs_id) as observations from observations"

#: Ten bands of scores with their slugs and the grades that begin in them.
BANDS = """select b as band, b * 10 as least, case when b = 9 then 100 else b * 10 + 9 end as greatest, concat(cast(b * 10 as string), '-', cast(case when b = 9 then 100 else b * 10 + 9 end as string)) as slug,
  case b when 9 then 'A' when 7 then 'B' when 6 then 'C' when 4 then 'D' else '' end as grade_begins from (select explode({range10}) as b) r"""
BADGES = "select site, theme, concat(site, case when theme = 'light' then '' else concat('--', theme) end, '.svg') as slug, regexp_extract(concat(site, case when theme = 'light' then '' else concat('--', theme) end, '.svg'), '^(.*?)(--(dark|card))?[.]svg$', 1) as parsed from (select site, explode({themes}) as theme from (select distinct " + _NORMAL + " as site from @domain_rows where domain is not null) d) x"
TOP_LABEL = f"""{FULL}, c as (select total, count(*) as n from scored where {COMPARABLE} group by total), m as (select total, floor((sum(n) over (order by total) - n + n / 2.0) * 100 / sum(n) over () + 0.5) as pct from c)
  select s.site, coalesce(concat('top ', cast(cast(greatest(1, 100 - m.pct) as int) as string), '%'), s.grade, 'unscored') as label from scored s left join m on s.total = m.total and s.total is not null and not s.partial"""
QUADRANT = f"""{FULL}, q as (select {s.flag(f"array_contains(t1, '{TOKEN.lower()}')")} as denied, {s.flag('cloaking.tested')} as tested, coalesce(cloaking.bot_status, 0) as status, gap from scored where total is not null),
  n as (select count_if(gap) as g, count_if(not denied and not gap) as o, count_if(denied and status >= 400) as b, count_if(denied and tested and status > 0 and status < 400) as d, count(*) as n from q)
  select cell, n, coalesce(floor(n * cast(1000 as double) / nullif(total, 0) + 0.5) / 10, 0) as share from (select 'gap' as cell, g as n, n as total from n union all select 'open-honest', o, n from n union all select 'blocked-honest', b, n from n union all select 'declared-only', d, n from n) x"""
COHORT_LABELS = f"{FULL}, k as (select 'platform' as kind, platform as id, count(*) as n from scored where platform is not null group by platform union all select 'network', network, count(*) from scored where network is not null group by network union all select 'tld', suffix, count(*) from scored where suffix <> '' group by suffix) select kind, id, case when kind = 'tld' then concat('.', id) else concat(upper(left(id, 1)), substr(id, 2)) end as label, n from k"
FACETS = f"{FULL} select posture, n, row_number() over (order by n desc, posture) as nth from (select posture, count(*) as n from scored where total is not null group by posture) x"
BOT_ENTRIES = "select token, blocked, row_number() over (order by blocked desc, token) as nth from (select token, blocked from ({daily}) d where stat_day = (select max(stat_day) from ({daily}) e)) x"
FORWARDED = "select event_id, coalesce(nullif(trim(split_part(case when event_id % 3 = 0 then concat(' 10.0.0.', cast(user_id as string), ' , 10.9.9.9') when event_id % 3 = 1 then '' end, ',', 1)), ''), case when event_id % 2 = 0 then concat('r', cast(user_id as string)) end, 'unknown') as caller from @events"
LOCATIONS = f"select site, concat('https://index.example/site/', site) as url, concat('Index of sites, ', site, ', https://index.example/site/', site) as citation from (select distinct {_NORMAL} as site from @domain_rows where domain is not null) d"

_TEXTS = {"seed_corpus": SEED, "crawl_targets": TARGETS, "month_reports": MONTHS, "band_table": BANDS, "badge_slugs": BADGES, "top_labels": TOP_LABEL, "quadrant_shares": QUADRANT, "cohort_labels": COHORT_LABELS, "facets_sorted": FACETS, "caller_keys": FORWARDED, "site_locations": LOCATIONS}
_FORMS = {"{range10}": ("sequence(0, 9)", "range(0, 10)"), "{themes}": ("array('light', 'dark', 'card')", "['light', 'dark', 'card']")}
QUERIES = {
    "daily_record": daily_record, "crawl_rows": crawl_rows, "crawl_run": crawl_run, "crawl_changes": crawl_changes, "crawl_changes_forced": lambda spark, sf_dir: crawl_changes(spark, sf_dir, force=True), "bot_months": bot_months, "site_documents": site_documents,
    "stats_document": stats_document, "run_meta": run_meta,
}
ORACLE = {
    "daily_record": _record_sql(), "crawl_rows": f"{_crawl_sql(CRAWL_DAY)} select site, outcome, now.observed_at as observed_at, now.failures as failures, now.total as total from c", "crawl_run": _run_sql(CRAWL_DAY), "crawl_changes": _changes_sql(CRAWL_DAY),
    "crawl_changes_forced": _changes_sql(CRAWL_DAY).replace("where not (select suspect from run)", "where (select true from run)"),
    "bot_months": f"with d as ({SITE_SQL['daily_per_bot']}) select strftime(stat_day, '%Y-%m') as month, token, arg_min(blocked, stat_day) as first, arg_max(blocked, stat_day) as last, arg_max(blocked, stat_day) - arg_min(blocked, stat_day) as delta from d group by 1, 2", "site_documents": _SITE_DOC, "run_meta": META_SQL,
}
for _name, _text in _TEXTS.items():
    _a, _b = _text.replace(FULL, "with scored as (select * from @scored_sites)"), _text
    for _k, (_x, _y) in _FORMS.items():
        _a, _b = _a.replace(_k, _x), _b.replace(_k, _y)
    QUERIES[_name], ORACLE[_name] = query(_a, views=sites.VIEWS), duck_text(_b)
QUERIES["bot_ranking"] = query(BOT_ENTRIES.replace("{daily}", "select * from @daily_per_bot"), views={"daily_per_bot": _per_bot})
ORACLE["bot_ranking"] = BOT_ENTRIES.replace("{daily}", SITE_SQL["daily_per_bot"])
