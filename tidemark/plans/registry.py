"""The modules that register queries, the subpackage ``llm`` excepted."""

from __future__ import annotations

#: Output columns whose sums DuckDB widens to 128 bits; the SQL gives them in Spark's 64 bits.
WIDE = {
    "score_rescore_check": "same different",
    "gap_count": "gaps contradictions observed",
    "signal_adoption": "authors dated cards licences",
    "cohorts_by_platform": "blocking_any blocking_all llms_txt",
    "cohorts_by_network": "blocking_any blocking_all llms_txt",
    "cohorts_by_suffix": "blocking_any blocking_all llms_txt",
    "cohort_grouping_sets": "points",
    "stack_counts": "blocking",
    "coverage_funnel": "published comparable",
    "coverage_funnel_long": "n",
    "award_count": "ready embeddable",
    "quadrant": "gap open_honest blocked_honest declared_only",
    "daily_rollup": "blocking_any blocking_all llms_txt agents_md payment_required refused authors",
    "daily_stack": "blocking",
    "failure_runs": "failures",
    "month_report": "suspect_days",
    "sealed_month": "observed",
    "security_flags": "hsts csp nosniff https",
    "events_json": "total",
    "sessions": "session_no",
    "stream_failures": "failures",
    "cohort_detail": "blocking_any blocking_all llms_txt",
    "count_with_signal": "n",
    "crawl_rows": "failures",
    "quadrant_shares": "n",
}


def modules() -> list:
    from tidemark.plans import batch, derive, extended, found_core, pipelines, reference, storage, surface

    return [found_core, reference, extended, pipelines, derive, batch, surface, storage]


def narrow(name: str, sql: str) -> str:
    """``sql`` with its columns of WIDE cast to bigint."""
    if name not in WIDE:
        return sql
    casts = ", ".join(f'cast("{c}" as bigint) as "{c}"' for c in WIDE[name].split())
    return f"select * replace ({casts}) from ({sql}) q"
