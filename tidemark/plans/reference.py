"""Queries over sites: scores, facets, cohorts, rankings, changes and daily figures.

Each is one SQL text (see sqlkit, texts), read by Spark from the sites scored once (see sites).
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import scoring as s
from tidemark.plans import sites
from tidemark.plans.sqlkit import duck_text, literal, query
from tidemark.plans.texts import COMPARABLE, FULL, HISTORY, LINES_NOW, MIN_COHORT, PAST, SERIES, SITES, TOKEN, _NORMAL

TEXTS: dict[str, str] = {}


def _score_lines() -> str:
    parts = " union all ".join(f"select site, '{n}' as line, '{s.BAND_NAMES[b]}' as band, {m} as points, e{i} as earned, a{i} as observable from lined" for i, (n, b, m, _, _) in enumerate(s.LINES))
    return f"with {SITES}, {LINES_NOW} {parts}"


TEXTS["score_lines"] = _score_lines()
TEXTS["score_totals"] = f"{FULL} select site, earned_access, max_access, earned_surface, max_surface, earned_structure, max_structure, total, partial, grade from scored"
TEXTS["score_fix_list"] = (
    f"with {SITES}, {LINES_NOW}, l as (select site, line, points, earned, floor((points - earned) * 10 + 0.5) / 10 as gap from ({_score_lines().split(LINES_NOW)[1]}) x where observable and earned < points)"
    " select site, line, gap, nth from (select *, row_number() over (partition by site order by gap desc, line) as nth from l) y where nth <= 8"
)
_FIX_FROM = _score_lines().split(LINES_NOW)[1]
TEXTS["score_rescore_check"] = f"{FULL} select count(*) as n, count_if(s.total = d.score.total) as same, count_if(s.total is distinct from d.score.total) as different from scored s join (select distinct obs_id, row_id, score from @domain_rows) d on s.obs_id = d.obs_id"
TEXTS["score_rescore_gaps"] = f"{FULL} select site, obs_id, now, stored, gap, nth from (select *, row_number() over (order by gap desc, site, obs_id, stored) as nth from (select s.site, s.obs_id, s.total as now, d.score.total as stored, abs(s.total - d.score.total) as gap from scored s join (select distinct obs_id, score from @domain_rows) d on s.obs_id = d.obs_id where s.total is not null and d.score.total is not null) x where gap > 0) y where nth <= 8"
TEXTS["stub_and_trust"] = f"with {SITES} select site, {s.STUB} as stub, {s.IS_TRUSTED} as trusted from sites"
TEXTS["facets"] = f"""{FULL}, roles as (select t.site, array_join(array_sort(array_distinct(collect_list(coalesce(a.agent_role, 'unknown')))), '|') as roles, count(distinct case when a.agent_role = 'assistant' then a.token end) as assistants
    from (select site, explode(t1) as token from scored) t left join @agent_registry a on lower(a.token) = t.token group by t.site),
  known as (select count(*) as n from @agent_registry where tier = 1 and agent_role = 'assistant')
  select f.site, posture, {s.archetype("r.roles", "coalesce(r.assistants, 0)", "(select n from known)")} as archetype, gap, contradicts, {s.CLOAKING} as cloaking_kind, {s.BADGE} as badge
  from scored f left join roles r on f.site = r.site"""
TEXTS["brand_fingerprint"] = f"""{FULL} select site, concat(coalesce(regexp_extract(left(site, greatest(length(site) - length(suffix) - 1, 0)), '([^.]*)$', 1), ''), '|', coalesce(array_join(array_sort(t1), ','), ''), '|', coalesce(network, '-')) as fingerprint from scored"""
TEXTS["percentile_midpoint"] = f"""{FULL}, c as (select total, count(*) as n from scored where {COMPARABLE} group by total),
  m as (select total, floor((sum(n) over (order by total) - n + n / 2.0) * 100 / sum(n) over () + 0.5) as pct from c)
  select s.site, s.total, cast(m.pct as int) as percentile, greatest(1, 100 - cast(m.pct as int)) as top_percent from scored s left join m on s.total = m.total and {COMPARABLE.replace('total', 's.total').replace('partial', 's.partial')}"""
TEXTS["band_counts"] = f"""{FULL}, b as (select least(9, cast(floor(total / 10) as int)) as band from scored where {COMPARABLE}),
  all_bands as (select explode({{range10}}) as band)
  select a.band, count(b.band) as n, count(b.band) / nullif(sum(count(b.band)) over (), 0) as share from all_bands a left join b on a.band = b.band group by a.band"""
TEXTS["histogram_median"] = f"""{FULL}, b as (select least(9, cast(floor(total / 10) as int)) as band, count(*) as n from scored where {COMPARABLE} group by 1),
  c as (select band, n, sum(n) over (order by band) as cum, sum(n) over () as total from b)
  select cast(floor(band * 10 + (total / 2.0 - (cum - n)) / n * 10 + 0.5) as int) as median_of_bands from (select *, row_number() over (order by band) as nth from c where cum >= total / 2.0) x where nth = 1"""
TEXTS["mid_band_share"] = f"{FULL} select count_if(total >= 50 and total < 80) / nullif(count(*), 0) as share, count(*) as n from scored where {COMPARABLE}"
TEXTS["modal_band"] = f"{FULL} select band, n from (select band, n, row_number() over (order by n desc, band) as nth from (select least(9, cast(floor(total / 10) as int)) as band, count(*) as n from scored where {COMPARABLE} group by 1) b) x where nth = 1"
TEXTS["policy_gaps"] = f"{FULL} select site, site_rank, nth from (select site, site_rank, row_number() over (order by site_rank asc nulls last, site) as nth from scored where gap) x where nth <= 200"
TEXTS["gap_count"] = f"{FULL} select count_if(gap) as gaps, count_if(contradicts) as contradictions, count_if(total is not null) as observed from scored"
TEXTS["blockers_of"] = f"""{FULL} select site, site_rank, nth from (select site, site_rank, row_number() over (order by site_rank asc nulls last, site) as nth from scored
  where {s.flag(f"array_contains(t1, '{TOKEN.lower()}')")} or {s.flag(f"array_contains(t2, '{TOKEN.lower()}')")}) x where nth <= 100"""


def site_lookup(domain: str) -> str:
    """Text of the lookup of one site by its normalised domain."""
    return f"{FULL} select site, total, grade, posture from scored where site = {literal(domain)}"


def cohort_detail(key: str, value: str) -> str:
    """Text of one cohort's figures: ``key`` is platform, network or suffix."""
    return f"select * from ({_cohorts(key, 1, f'{key} = {literal(value)}')}) c"


def rows_in_cohort(key: str, value: str, limit: int = 200) -> str:
    """Text of the best ranked observed sites of one cohort."""
    return f"{FULL} select site, total, nth from (select site, total, row_number() over (order by site_rank asc nulls last, site) as nth from scored where {key} = {literal(value)} and total is not null) x where nth <= {int(limit)}"


def count_with(predicate: str) -> str:
    """Text of how many observed sites fulfil a predicate on their columns, and of how many."""
    return f"{FULL} select count_if({s.flag(predicate)}) as n, count(*) as observed from scored where total is not null"


def search_sites(words: str, limit: int = 100) -> str:
    """Text of a search by part of a domain: exact, then beginning with it, then holding it; at least two characters of the normalised needle."""
    needle = words.strip().lower().removeprefix("https://").removeprefix("http://").split("/")[0].split(":")[0].removeprefix("www.").rstrip(".")
    n = literal(needle)
    found = f"case when site = {n} then 0 when left(site, {len(needle)}) = {n} then 1 else 2 end" if len(needle) >= 2 else "9"
    return f"{FULL} select site, tier, nth from (select site, tier, row_number() over (order by tier, site_rank asc nulls last, site) as nth from (select site, site_rank, {found} as tier from scored where {len(needle)} >= 2 and replace(site, {n}, '') <> site) t) x where nth <= {int(limit)}"


def month_changes(month: str, limit: int = 40) -> str:
    """Text of the notable changes (access, surface) of one month, newest first."""
    return f"select site, observed_at, kind, nth from (select site, observed_at, kind, row_number() over (order by observed_at desc, site, kind) as nth from ({TEXTS['change_events']}) c where month_of(observed_at) = {literal(month)} and kind in ('access', 'surface')) x where nth <= {int(limit)}"


def changes_of(domain: str) -> str:
    """Text of all changes of one site."""
    return f"select site, observed_at, kind, delta, newly_blocked, newly_allowed from ({TEXTS['change_events']}) c where site = {literal(domain)}"


TEXTS["site_lookup"] = site_lookup("pulse-canary.example")
TEXTS["count_with_signal"] = count_with("signals.license_link")
TEXTS["signal_adoption"] = f"""with {SITES} select count(*) as n, count(signals) as looked, case when count(signals) > 0 then count_if({s.flag('signals.has_author')}) end as authors,
  case when count(signals) > 0 then count_if({s.flag('signals.date_published')}) end as dated, case when count(signals) > 0 then count_if({s.flag('signals.agent_card')}) end as cards,
  case when count(signals) > 0 then count_if(signals.license_url is not null or {s.flag('signals.license_link')}) end as licences from sites where {s.flag('reachable')}"""

def _cohorts(key: str, least: int, where: str) -> str:
    return f"""{FULL} select {key} as cohort, count(*) as n, count(total) as observed, count_if(total is not null and n_blocked > 0) as blocking_any, count_if(total is not null and n_blocked >= {s.TIER1_TOKENS}) as blocking_all,
      count_if(total is not null and {s.flag('llms_txt.present')}) as llms_txt, floor(avg(total) * 10 + 0.5) / 10 as mean_score, count_if(total is not null and n_blocked > 0) / count(total) as rate
      from scored where {where} group by {key} having count(*) >= {least} and count(total) > 0"""


for _key in ("platform", "network", "suffix"):
    TEXTS[f"cohorts_by_{_key}"] = _cohorts(_key, MIN_COHORT, f"{_key} is not null")
TEXTS["cohort_detail"] = cohort_detail("network", "nimbusedge")
TEXTS["cohort_grouping_sets"] = f"""{FULL} select platform, network, suffix, count(*) as n, count(total) as observed, sum(total) as points from scored group by grouping sets ((platform), (network), (suffix), ())"""
TEXTS["cohort_medians"] = f"{FULL} select platform, count(*) as n, floor(median(total) * 10 + 0.5) / 10 as median_score from scored where {COMPARABLE} and platform is not null group by platform"
TEXTS["index_median"] = f"{FULL} select floor(median(total) * 10 + 0.5) / 10 as median_score, count(*) as n from scored where {COMPARABLE}"
TEXTS["peer_delta"] = f"""{FULL}, p as (select platform, floor(median(total) * 10 + 0.5) / 10 as platform_median from scored where {COMPARABLE} and platform is not null group by platform having count(*) >= {MIN_COHORT}),
  w as (select network, floor(median(total) * 10 + 0.5) / 10 as network_median from scored where {COMPARABLE} and network is not null group by network having count(*) >= {MIN_COHORT})
  select site, total, platform_median, network_median, (select floor(median(total) * 10 + 0.5) / 10 from scored where {COMPARABLE}) as index_median, floor((total - platform_median) * 10 + 0.5) / 10 as platform_delta, floor((total - network_median) * 10 + 0.5) / 10 as network_delta,
  coalesce(total < platform_median, false) or coalesce(total < network_median, false) as behind_any from scored s left join p on s.platform = p.platform left join w on s.network = w.network where {COMPARABLE}"""
TEXTS["facet_counts"] = f"{FULL} select posture, count(*) as n from scored where total is not null group by posture"
TEXTS["stack_counts"] = f"{FULL} select 'platform' as kind, platform as id, count(*) as n, count_if(n_blocked > 0) as blocking from scored where total is not null and platform is not null group by platform union all select 'network', network, count(*), count_if(n_blocked > 0) from scored where total is not null and network is not null group by network"
TEXTS["cohort_extremes"] = f"""{FULL}, c as (select network as cohort, count_if(total is not null and n_blocked > 0) / nullif(count(total), 0) as rate from scored where network is not null group by network having count(*) >= {MIN_COHORT} and count(total) > 0)
  select max_by(cohort, struct_of(rate, cohort)) as highest, max(rate) as highest_rate, min_by(cohort, struct_of(rate, cohort)) as lowest, min(rate) as lowest_rate from c"""
TEXTS["failure_reasons"] = f"""with {SITES} select reason, n from (select reason, n, row_number() over (order by n desc, reason) as nth from (select coalesce(left(trim(split_part(error, ':', 1)), 48), 'no response') as reason, count(*) as n from sites where not {s.flag('reachable')} group by 1) r) x where nth <= 12"""
TEXTS["partial_reasons"] = f"{FULL} select coalesce(control.kind, 'none') as kind, count(*) as n from scored where total is not null and partial group by 1"
TEXTS["coverage_funnel"] = f"{FULL} select count(*) as attempted, count_if({s.flag('reachable')}) as published, count(total) as observed, count_if({COMPARABLE}) as comparable from scored"
TEXTS["coverage_funnel_long"] = f"""{FULL}, f as (select count(*) as attempted, count_if({s.flag('reachable')}) as published, count(total) as observed, count_if({COMPARABLE}) as comparable from scored)
  select 'attempted' as stage, attempted as n from f union all select 'published', published from f union all select 'observed', observed from f union all select 'comparable', comparable from f"""
TEXTS["bot_shares"] = f"""with {SITES}, e as (select explode({s.distinct_lower('tier1_blocked')}) as token from sites union all select explode({s.distinct_lower('tier2_blocked')}) from sites), c as (select token, count(*) as n from e group by token)
  select a.token, a.agent_role, a.tier, coalesce(c.n, 0) as blocked, coalesce(c.n, 0) / nullif((select count_if({s.flag('reachable')}) from sites), 0) as share from @agent_registry a left join c on lower(a.token) = c.token"""
TEXTS["award_count"] = f"{FULL} select count_if(grade = 'A') as ready, count_if(grade in ('A', 'B')) as embeddable, count(total) as observed from scored"
TEXTS["quadrant"] = f"""with {SITES}, q as (select {s.flag(f"array_contains({s.distinct_lower('tier1_blocked')}, '{TOKEN.lower()}')")} as denied, {s.flag('cloaking.tested')} as tested, coalesce(cloaking.bot_status, 0) as status from sites where {s.flag('reachable')})
  select count_if(not denied and tested and status in {s.listed(s.GAP_REFUSED)}) as gap, count_if(not denied and not (tested and status in {s.listed(s.GAP_REFUSED)})) as open_honest, count_if(denied and status >= 400) as blocked_honest, count_if(denied and tested and status > 0 and status < 400) as declared_only, count(*) as n from q"""
TEXTS["snapshot_day"] = "select max(observed_at) as last_seen, cast(max(observed_at) as date) as snapshot_day from @observations"
TEXTS["daily_rollup"] = f"""{PAST} select day_of(observed_at) as stat_day, count(*) as total_domains, count(total) as observed, floor(avg(total) * 100 + 0.5) / 100 as mean_score, count_if(total is not null and n_blocked > 0) as blocking_any,
  count_if(total is not null and n_blocked >= {s.TIER1_TOKENS}) as blocking_all, count_if(total is not null and {s.flag('llms_txt.present')}) as llms_txt, count_if(total is not null and {s.flag('agents_md.present')}) as agents_md,
  count_if({s.METERED}) as payment_required, count_if(total is not null and {s.flag('cloaking.detected')}) as refused, case when count(signals) > 0 then count_if({s.flag('signals.has_author')}) end as authors from totalled group by 1"""
TEXTS["daily_per_bot"] = f"""{PAST}, d as (select day_of(observed_at) as stat_day, explode(t1) as token from totalled union all select day_of(observed_at), explode(t2) from totalled),
  days as (select stat_day, explode((select collect_list(token) from @agent_registry)) as token from (select distinct day_of(observed_at) as stat_day from totalled) u), c as (select stat_day, token, count(*) as n from d group by stat_day, token)
  select days.stat_day, days.token, coalesce(c.n, 0) as blocked from days left join c on c.stat_day = days.stat_day and c.token = lower(days.token)"""
TEXTS["daily_histogram"] = f"{PAST} select day_of(observed_at) as stat_day, least(9, cast(floor(total / 10) as int)) as band, count(*) as n from totalled where {COMPARABLE} group by 1, 2"
TEXTS["daily_stack"] = f"{PAST} select day_of(observed_at) as stat_day, stack.platform as platform, count(total) as n, count_if(total is not null and n_blocked > 0) as blocking from totalled where stack.platform is not null group by 1, 2"

for _dir, _o in (("top", "desc"), ("bottom", "asc")):
    TEXTS[f"leaderboard_{_dir}"] = f"{FULL} select site, total, site_rank, nth from (select site, total, site_rank, row_number() over (order by total {_o}, site_rank asc nulls last, site) as nth from scored where {COMPARABLE}) x where nth <= 50"
TEXTS["rows_in_cohort"] = rows_in_cohort("network", "nimbusedge")
TEXTS["band_examples"] = f"{FULL} select band, site, nth from (select site, band, row_number() over (partition by band order by site_rank asc nulls last, site) as nth from (select *, least(9, cast(floor(total / 10) as int)) as band from scored where {COMPARABLE}) b) x where nth <= 3"
TEXTS["band_members"] = f"{FULL} select site, total from scored where {COMPARABLE} and total >= 70 and total < 80"
TEXTS["entity_groups"] = f"""{FULL}, pool as (select *, row_number() over (order by total desc, site_rank asc nulls last, site) as pos from scored where {COMPARABLE}),
  branded as (select site, pos, regexp_extract(left(site, greatest(length(site) - length(suffix) - 1, 0)), '([^.]*)$', 1) as brand, coalesce(array_join(array_sort(t1), ','), '') as policy, coalesce(network, '-') as net from pool where pos <= 400),
  g as (select *, case when length(brand) < 4 then concat('@', site) else concat(brand, '|', policy, '|', net) end as k from branded)
  select * from (select *, row_number() over (order by pos) as nth from (select min_by(site, pos) as lead, count(*) as size, min(pos) as pos, array_join(array_sort(collect_list(site)), ',') as members from g group by k) e) f where nth <= 100"""
TEXTS["search_sites"] = search_sites(" https://WWW.garden/ ")
TEXTS["search_index"] = f"{FULL} select site, coalesce(site_rank, 0) as site_rank, coalesce(total, -1) as total, coalesce(grade, '') as grade, (case when n_blocked > 0 then 1 else 0 end) + (case when {s.flag('llms_txt.present')} then 2 else 0 end) + (case when gap then 4 else 0 end) + (case when partial then 8 else 0 end) as flags from scored"
TEXTS["report_extracts"] = f"""{FULL} select * from (select 'best' as kind, site, total, row_number() over (order by total desc, site_rank asc nulls last, site) as nth from scored where {COMPARABLE}) b where nth <= 10
  union all select * from (select 'worst' as kind, site, total, row_number() over (order by total asc, site_rank asc nulls last, site) as nth from scored where {COMPARABLE}) w where nth <= 10
  union all select * from (select 'platform' as kind, platform as site, n as total, row_number() over (order by n desc, platform) as nth from (select platform, cast(count(total) as int) as n from scored where platform is not null group by platform) p) p where nth <= 12
  union all select * from (select 'network' as kind, network as site, n as total, row_number() over (order by n desc, network) as nth from (select network, cast(count(total) as int) as n from scored where network is not null group by network) p) p where nth <= 10"""
TEXTS["rebuilt_access"] = f"""with {SITES}, each as (select site, {s.distinct_lower('tier1_blocked')} as t1, {s.distinct_lower('tier2_blocked')} as t2, explode((select collect_list(token) from @agent_registry)) as token from sites)
  select site, token, not {s.flag("array_contains(t1, lower(token))")} and not {s.flag("array_contains(t2, lower(token))")} as allowed from each"""

# changes and run health
TEXTS["change_events"] = f"""{PAST}, p as (select site, observed_at, vantage, probe_version, {s.flag('reachable')} as up, coalesce(array_sort(t1), empty_list()) as blocked, {s.flag('llms_txt.present')} as llms, {s.flag('agents_md.present')} as agents, total from totalled),
  w as (select *, lag(observed_at) over h as b_at, lag(vantage) over h as b_vantage, lag(probe_version) over h as b_version, lag(up) over h as b_up, lag(blocked) over h as b_blocked, lag(llms) over h as b_llms, lag(agents) over h as b_agents, lag(total) over h as b_total from p window h as (partition by site order by observed_at)),
  ok as (select * from w where b_at is not null and vantage = b_vantage and probe_version = b_version)
  select site, observed_at, 'reachability' as kind, cast(null as int) as delta, '' as newly_blocked, '' as newly_allowed from ok where up <> b_up
  union all select site, observed_at, 'access', null, array_join(filter(blocked, x -> not array_contains(b_blocked, x)), ','), array_join(filter(b_blocked, x -> not array_contains(blocked, x)), ',') from ok where blocked <> b_blocked
  union all select site, observed_at, 'surface', null, '', '' from ok where llms <> b_llms or agents <> b_agents
  union all select site, observed_at, 'score', cast(total - b_total as int), '', '' from ok where abs(total - b_total) >= 3"""
TEXTS["change_counts"] = f"select day_of(observed_at) as stat_day, kind, count(*) as n from ({TEXTS['change_events']}) c group by 1, 2"
TEXTS["change_feed"] = f"select site, observed_at, kind, nth from (select *, row_number() over (order by observed_at desc, site, kind) as nth from ({TEXTS['change_events']}) c) x where nth <= 300"
TEXTS["month_changes"] = month_changes("2026-02")
TEXTS["changes_of"] = changes_of("pulse-canary.example")
TEXTS["access_delta"] = f"""with {HISTORY}, p as (select site, observed_at, coalesce(array_sort({s.distinct_lower('tier1_blocked')}), empty_list()) as now, coalesce(lag(array_sort({s.distinct_lower('tier1_blocked')})) over (partition by site order by observed_at), empty_list()) as was from sites where {s.flag('reachable')})
  select site, observed_at, array_join(filter(now, x -> not array_contains(was, x)), ',') as newly_blocked, array_join(filter(was, x -> not array_contains(now, x)), ',') as newly_allowed from p where now <> was"""
TEXTS["failure_runs"] = f"""with {HISTORY}, f as (select site, observed_at, {s.flag('reachable')} as up, sum(case when {s.flag('reachable')} then 1 else 0 end) over (partition by site order by observed_at) as run from sites),
  c as (select site, observed_at, up, case when up then 0 else sum(case when up then 0 else 1 end) over (partition by site, run order by observed_at) end as failures from f)
  select site, observed_at, failures, failures >= 3 as demoted from c where not up"""
TEXTS["latest_trusted_day"] = f"with {SERIES} select feed, max(stat_day) as stat_day, max_by(observed, stat_day) filter (where observed is not null) as observed from series where not coalesce(suspect, false) group by feed"
TEXTS["day_to_day"] = f"with {SERIES} select feed, stat_day, observed - lag(observed) over h as observed_delta, total_domains - lag(total_domains) over h as total_delta, mean_score - lag(mean_score) over h as mean_delta from series window h as (partition by feed order by stat_day)"
TEXTS["run_verdicts"] = f"""with {SERIES}, t as (select *, max(case when not coalesce(suspect, false) then stat_day end) over (partition by feed order by stat_day rows between unbounded preceding and 1 preceding) as trusted from series where stat_day is not null),
  p as (select t.*, b.observed as b_observed, b.total_domains as b_total, b.mean_score as b_mean, b.attempted as b_attempted, b.succeeded as b_succeeded from t left join series b on b.feed = t.feed and b.stat_day = t.trusted)
  select feed, stat_day, trusted as baseline_day, coalesce(observed, 0) = 0 as broken, coalesce(b_attempted > 0 and b_total > 0 and b_observed > 0 and (coalesce(b_succeeded, 0) / b_attempted - case when attempted > 0 then coalesce(succeeded, 0) / attempted else 0 end) * 100 > 15, false) as reachability_fell,
  coalesce(abs(observed - b_observed) / greatest(1, b_observed) > 0.2, false) as population_moved, coalesce(b_total > 0 and (b_total - total_domains) / nullif(b_total, 0) > 0.1, false) as shrank, coalesce(abs(mean_score - b_mean) > 5, false) as mean_moved from p"""
TEXTS["month_report"] = f"""with {SERIES}, m as (select feed, month_of(stat_day) as month, count(*) as days, count_if(coalesce(suspect, false)) as suspect_days, min_by(observed, stat_day) filter (where observed is not null) as first_observed, max_by(observed, stat_day) filter (where observed is not null) as last_observed, min_by(blocking_any_tier1, stat_day) filter (where blocking_any_tier1 is not null) as first_blocking, max_by(blocking_any_tier1, stat_day) filter (where blocking_any_tier1 is not null) as last_blocking
  from series group by 1, 2) select *, last_observed - first_observed as observed_delta, case when last_observed > first_observed then 'rose' when last_observed < first_observed then 'fell' else 'unchanged' end as movement from m"""
TEXTS["sealed_month"] = f"with {SERIES} select feed, month_of(stat_day) as month, count(*) as days, sum(observed) as observed, max(stat_day) as last_day from series where not coalesce(suspect, false) group by 1, 2"
TEXTS["unsealed_months"] = f"""with {SERIES}, m as (select distinct feed, month_of(stat_day) as month from series where stat_day is not null), today as (select feed, max(month_of(stat_day)) as now from series group by feed),
  done as (select distinct feed, month_of(stat_day) as month from @daily_stats where load_no = 1 and stat_day is not null)
  select m.feed, m.month from m join today on m.feed = today.feed where m.month < today.now and not exists (select 1 from done d where d.feed = m.feed and d.month = m.month)"""


def _loads(name: str, cond: str) -> str:
    """The series that the loads of ``cond`` give by themselves: one row of a feed a day."""
    return SERIES.replace("series as", f"{name} as").replace("from @daily_stats d)", f"from @daily_stats d where {cond})")


TEXTS["guarded_upsert"] = f"""with {_loads('stored', 'load_no <= 4')}, {_loads('fresh', 'load_no > 4')}
  select coalesce(f.feed, o.feed) as feed, coalesce(f.stat_day, o.stat_day) as stat_day, case when f.feed is null then o.observed when o.feed is not null and not coalesce(o.suspect, false) and o.observed > f.observed then o.observed else f.observed end as observed,
    f.feed is not null and o.feed is not null and not coalesce(o.suspect, false) and coalesce(o.observed > f.observed, false) as refused
  from stored o full outer join fresh f on o.feed = f.feed and o.stat_day = f.stat_day"""
TEXTS["stats_findings"] = f"""with {SERIES}, l as (select * from (select *, row_number() over (partition by feed order by stat_day desc) as last_no from series where not coalesce(suspect, false)) x where last_no = 1)
  select feed, 'blocking' as finding, blocking_any_tier1 / nullif(observed, 0) as value from l where observed > 0 and blocking_any_tier1 is not null union all select feed, 'walled', blocking_all_tier1 / nullif(observed, 0) from l where observed > 0 and blocking_all_tier1 is not null
  union all select feed, 'policy-gap', policy_gaps / nullif(observed, 0) from l where observed > 0 and policy_gaps is not null union all select feed, 'llms-txt', llms_txt / nullif(observed, 0) from l where observed > 0 and llms_txt is not null
  union all select feed, 'agents-md', agents_md / nullif(observed, 0) from l where observed > 0 and agents_md is not null union all select feed, 'mean-score', mean_score from l where mean_score is not null"""

# corpus upkeep: joins and set operations over keys
CORPUS = f"""numbers as (select distinct snapshot_no as k from @domain_snapshots),
  old as (select distinct snapshot_no + 1 as snapshot_no, {_NORMAL} as site, probe_version from @domain_snapshots where snapshot_no + 1 in (select k from numbers) and domain is not null),
  new as (select distinct snapshot_no, {_NORMAL} as site, probe_version from @domain_snapshots where snapshot_no - 1 in (select k from numbers) and domain is not null)"""
TEXTS["carried_forward"] = f"with {CORPUS} select o.snapshot_no, o.site, o.probe_version from old o where not exists (select 1 from new n where n.site = o.site and n.snapshot_no = o.snapshot_no) and exists (select 1 from @domain_rows d where d.domain = o.site)"
TEXTS["published_union"] = f"with {CORPUS} select snapshot_no, site, 'new' as origin from new union all select o.snapshot_no, o.site, 'carried' from old o where not exists (select 1 from new n where n.site = o.site and n.snapshot_no = o.snapshot_no)"
TEXTS["keys_union"] = f"with {CORPUS} select snapshot_no, site from old union select snapshot_no, site from new"
TEXTS["keys_except"] = f"with {CORPUS} select snapshot_no, site from old except select snapshot_no, site from new"
TEXTS["keys_intersect"] = f"with {CORPUS} select snapshot_no, site from old intersect select snapshot_no, site from new"
TEXTS["ranked_into_corpus"] = f"""with {CORPUS}, ranked as (select {_NORMAL} as domain, min(site_rank) as site_rank, min(first_seen) as first_seen from @domain_rows where site_rank is not null group by 1)
  select coalesce(r.domain, o.site) as site, r.site_rank, r.first_seen, o.site is not null as known from ranked r full outer join (select distinct site from old) o on r.domain = o.site"""
TEXTS["token_roles"] = f"with {SITES} select t.site, a.agent_role, count(*) as n from (select site, explode({s.distinct_lower('tier1_blocked')}) as token from sites) t join @agent_registry a on lower(a.token) = t.token group by t.site, a.agent_role"
TEXTS["ranked_ingest"] = f"select domain, site_rank, nth from (select domain, site_rank, row_number() over (order by site_rank, domain) as nth from (select domain, min(site_rank) as site_rank from @domain_rows where site_rank is not null and length(domain) - length(replace(domain, '.', '')) <= 2 and not regexp_like(domain, '(^|[.])(cdn|api|static|assets|cache)[.]') group by domain) d) x where nth <= 100"


def _at_least(c: str, floor: str) -> str:
    """Whether a dotted version is at least ``floor``: parts are numbers, missing or unreadable ones 0, a missing version 0.0.0."""
    parts = [f"coalesce(try_cast(split_part(coalesce({c}, ''), '.', {i + 1}) as bigint), 0)" for i in range(4)]
    wanted = [int(x) for x in floor.split(".")] + [0] * 4
    cond = "true"
    for p, w in reversed(list(zip(parts, wanted))):
        cond = f"({p} > {w} or ({p} = {w} and {cond}))"
    return cond


_ODD_VERSIONS = "select probe_version from @observations union all select left(probe_version, 3) from @observations union all select concat(probe_version, '-x.1') from @observations union all select ''"
TEXTS["version_at_least"] = f"select probe_version, {_at_least('probe_version', '2.3')} as at_least, count(*) as n from ({_ODD_VERSIONS}) v group by probe_version"
TEXTS["domain_parts"] = f"with d as (select distinct {_NORMAL} as site from @observations) select site, {s.last_labels('site')} as suffix, regexp_extract(left(site, greatest(length(site) - length({s.last_labels('site')}) - 1, 0)), '([^.]*)$', 1) as brand, length(site) <= 253 and regexp_like(site, '^[a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?([.][a-z0-9]([a-z0-9-]{{0,61}}[a-z0-9])?)+$') as valid from d where site is not null"
#: Loopback, private, link-local, shared and reserved ranges, IPv4 and IPv6 (RFC 1918, 3927, 4193, 4291, 5735, 6598), and names that stay inside a network.
_PRIVATE = "regexp_like(lower(final_url), '^https?://(0[.]|10[.]|127[.]|169[.]254[.]|172[.](1[6-9]|2[0-9]|3[01])[.]|192[.]168[.]|192[.]0[.]0[.]|100[.](6[4-9]|[7-9][0-9]|1[01][0-9]|12[0-7])[.]|198[.]1[89][.]|(22[4-9]|2[34][0-9]|25[0-5])[.]|localhost([:/]|$)|[^/:]*[.](local|internal|localhost)([:/]|$)|[^a-z0-9./](::1?[^a-z0-9.:/]|f[cd]|fe[89ab]))')"
TEXTS["final_host"] = f"select obs_id, lower(regexp_extract(final_url, '^https?://([^/:]+)', 1)) as host, final_url like 'https://%' as secure, {_PRIVATE} as private_target from @observations where final_url is not null"
TEXTS["security_flags"] = f"with {SITES} select count(*) as n, count_if({s.flag('security.hsts')}) as hsts, count_if({s.flag('security.csp')}) as csp, count_if({s.flag('security.x_content_type_options')}) as nosniff, count_if({s.flag('https')}) as https from sites"

#: Where Spark has a better form than the text that both engines share.
SPARK_TEXTS = {
    "score_lines": f"with {SITES}, {LINES_NOW} select site, stack({len(s.LINES)}, "
    + ", ".join(f"'{n}', '{s.BAND_NAMES[b]}', {m}, e{i}, a{i}" for i, (n, b, m, _, _) in enumerate(s.LINES))
    + ") as (line, band, points, earned, observable) from lined",
}
SPARK_TEXTS["score_fix_list"] = TEXTS["score_fix_list"].replace(_FIX_FROM, SPARK_TEXTS["score_lines"].split(LINES_NOW)[1])

_RANGE10 = ("sequence(0, 9)", "range(0, 10)")
QUERIES, ORACLE = {}, {}


def peer_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each comparable site against the medians of its platform and its network, where those have enough sites, and of all."""
    rows = sites.scored_sites(spark, sf_dir).where(COMPARABLE).select("site", "total", "platform", "network")

    def median_of(key: str) -> DataFrame:
        mid = F.floor(F.median("total") * 10 + 0.5) / 10
        return rows.where(F.col(key).isNotNull()).groupBy(key).agg(F.count(F.lit(1)).alias("n"), mid.alias(f"{key}_median")).where(F.col("n") >= MIN_COHORT).drop("n")

    index = rows.agg(F.floor(F.median("total") * 10 + 0.5) / 10).scalar()
    both = rows.withColumn("index_median", index).join(median_of("platform"), "platform", "left").join(median_of("network"), "network", "left")
    delta = lambda k: (F.floor((F.col("total") - F.col(f"{k}_median")) * 10 + 0.5) / 10).alias(f"{k}_delta")
    behind = F.coalesce(F.col("total") < F.col("platform_median"), F.lit(False)) | F.coalesce(F.col("total") < F.col("network_median"), F.lit(False))
    return both.select("site", "total", "platform_median", "network_median", "index_median", delta("platform"), delta("network"), behind.alias("behind_any"))

#: Texts over parts that Spark has better forms of.
_SHARED = ((FULL, "with scored as (select * from @scored_sites)"), (TEXTS["change_events"], "select * from @change_events"))
_VIEWS = {**sites.VIEWS, "change_events": sites.change_events}

for _name, _text in TEXTS.items():
    _spark = SPARK_TEXTS.get(_name, _text)
    for _a, _b in _SHARED:
        _spark = _spark.replace(_a, _b)
    QUERIES[_name] = query(_spark.replace("{range10}", _RANGE10[0]), costly=("observations",) if " lined as " in _spark else (), views=_VIEWS)
    ORACLE[_name] = duck_text(_text.replace("{range10}", _RANGE10[1]))
QUERIES |= {"peer_delta": peer_delta, "change_events": sites.change_events, "access_delta": sites.access_delta, "failure_runs": sites.failure_runs}
