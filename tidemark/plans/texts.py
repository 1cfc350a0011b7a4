"""Parts of SQL text that the queries over sites share, in both dialects.

``sites`` is the latest observation of every normalised domain, opted-out sites left out; ``ranks`` the latest scored row of
every domain, for its rank.
"""

from __future__ import annotations

from tidemark.functions import scoring as s

MIN_COHORT = 25
TOKEN = "OrvexBot"

_NORMAL = "regexp_replace(regexp_replace(lower(trim(domain)), '[.]$', ''), '^www[.]', '')"
SITES = f"""sites as (
  select * from (select o.*, {_NORMAL} as site, row_number() over (partition by {_NORMAL} order by observed_at desc, ingested_at desc, obs_id desc) as nth
    from @observations o where domain is not null) x where nth = 1 and not {s.flag('opted_out')})"""
RANKS = f"""ranks as (
  select site as rsite, site_rank, first_seen, tld from (select {_NORMAL} as site, site_rank, first_seen, tld,
    row_number() over (partition by {_NORMAL} order by scored_at desc, row_id desc) as nth from @domain_rows where domain is not null) x where nth = 1)"""
KEYED = f"keyed as (select o.*, {_NORMAL} as site from @observations o where domain is not null)"
LINES = f"primed as (select *, {s.PRELUDE} from keyed), lined as (select *, {s.line_columns()} from primed)"
LINES_NOW = f"primed as (select *, {s.PRELUDE} from sites), lined as (select *, {s.line_columns()} from primed)"
BANDS = f"banded as (select *, {s.band_columns()} from lined)"
TOTALS = f"totalled as (select *, {s.TOTAL} as total, {s.PARTIAL} as partial, {s.POSTURE} as posture, {s.policy_gap(TOKEN)} as gap, {s.contradicts(TOKEN)} as contradicts, coalesce(array_size(t1), 0) as n_blocked from banded)"
LATEST = f"""latest as (select * from (select *, row_number() over (partition by site order by observed_at desc, ingested_at desc, obs_id desc) as nth from totalled) x where nth = 1 and not {s.flag('opted_out')})"""
SCORED = f"scored as (select l.*, {s.grade('total')} as grade, stack.platform as platform, stack.network as network, r.site_rank, r.first_seen, {s.last_labels('site')} as suffix from latest l left join ranks r on l.site = r.rsite)"
#: As the check reads it; Spark's queries read the sites scored once (see sites.py).
FULL = f"with {RANKS}, {KEYED}, {LINES}, {BANDS}, {TOTALS}, {LATEST}, {SCORED}"
SCORED_SITES = f"with {RANKS}, {SITES}, {LINES_NOW}, {BANDS}, {TOTALS}, latest as (select * from totalled), {SCORED} select * from scored"
COMPARABLE = "total is not null and not partial"

#: Versions of a site over time, for change detection.
HISTORY = f"""sites as (select * from (select o.*, {_NORMAL} as site, row_number() over (partition by {_NORMAL}, observed_at order by ingested_at desc, obs_id desc) as nth
  from @observations o where domain is not null and observed_at is not null) x where nth = 1)"""
PAST = f"""with {KEYED}, {LINES}, {BANDS}, {TOTALS.replace('totalled', 'each_total')},
  totalled as (select * from (select *, row_number() over (partition by site, observed_at order by ingested_at desc, obs_id desc) as nth from each_total where observed_at is not null) x where nth = 1)"""

#: One row of a feed's series a day: the last load stands.
SERIES = """series as (select * from (select d.*, row_number() over (partition by feed, stat_day order by load_no desc, loaded_at desc, observed desc, total_domains desc, mean_score desc, blocking_any_tier1 desc, suspect desc) as nth
  from @daily_stats d) x where nth = 1)"""

EACH_TOTAL = f"with {KEYED}, {LINES}, {BANDS}, {TOTALS.replace('totalled', 'each_total')}"
HISTORY_COLUMNS = (
    "site", "observed_at", "ingested_at", "obs_id", "vantage", "probe_version", "reachable", "opted_out", "http_status", "control", "robots", "t1", "t2", "llms_txt", "agents_md", "cloaking", "signals", "stack", "total", "partial", "posture", "gap", "n_blocked",
)
