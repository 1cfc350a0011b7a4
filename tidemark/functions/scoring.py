"""Scores and facets of an observation, as SQL expressions over the observation's columns.

The rubric is three bands of 18 lines worth 100 points. A line counts only if it could be observed;
the total is the share of the observable points that was earned, so what a probe could not see is
never charged to a site. Null flags read as false, null lists as empty, null or negative text
lengths as 0.
"""

from __future__ import annotations

# The rubric's thresholds and lists.
TIER1_TOKENS = 11
TIER2_TOKENS = 12
STUB_BYTES, STUB_TEXT, STUB_REFUSED_TEXT = 5000, 100, 400
SCORE_REFUSED = (401, 403, 406, 429, 503)
GAP_REFUSED = (401, 403, 405, 406, 429, 503)
PROBE_REFUSED = (403, 429, 503)
PLAIN_TYPES = ("organization", "corporation", "localbusiness", "onlinebusiness", "newsmediaorganization", "website")
GRADES = ((90, "A"), (75, "B"), (60, "C"), (40, "D"))
BAND_NAMES = ("access", "surface", "structure")


def flag(c: str) -> str:
    return f"coalesce({c}, false)"


def listed(values) -> str:
    return "(" + ", ".join(f"'{v}'" if isinstance(v, str) else str(v) for v in values) + ")"


def distinct_lower(c: str) -> str:
    return f"array_distinct(transform(filter({c}, x -> x is not null), x -> lower(x)))"


def size_of(c: str) -> str:
    return f"coalesce(array_size({distinct_lower(c)}), 0)"


def tenth(x: str) -> str:
    """Rounded half up to one decimal."""
    return f"floor(({x}) * 10 + 0.5) / 10"


#: Access is sold: the control request was answered as a demand for payment, whatever the status of the final answer.
METERED = "coalesce(control.kind = 'payment-required', false)"
TEXT = "greatest(coalesce(content.ssr_text_length, 0), 0)"
STUB = (
    f"(coalesce(cloaking.browser_bytes, 0) > 0 and cloaking.browser_bytes < {STUB_BYTES} and ({TEXT} < {STUB_TEXT}"
    f" or ({TEXT} < {STUB_REFUSED_TEXT} and coalesce(cloaking.bot_status, 0) in {listed(SCORE_REFUSED)})))"
)
IS_TRUSTED = f"(not {flag('control.challenged')} and not {STUB})"
#: Columns that many lines share, computed once: canonical token lists, and whether the body can be trusted.
PRELUDE = f"{distinct_lower('tier1_blocked')} as t1, {distinct_lower('tier2_blocked')} as t2, {IS_TRUSTED} as trusted"
TRUSTED = "trusted"
SIGNALS = "(signals is not null)"
OTHER_TYPES = f"array_size(filter({distinct_lower('structured.json_ld_types')}, x -> x not in {listed(PLAIN_TYPES)}))"

# The rubric's lines, their bands and points.
def lines(full: bool = False) -> tuple:
    """(line, band, points, points earned, when it can be observed) of every line.

    ``full``: the observations also say which checks were skipped (a skipped check can't be observed) and whether a page tells when it was modified.
    """
    skip = lambda path: f" and not {flag(f'array_contains(signals.skipped_checks, {path!r})')}" if full else ""
    dated = f"{flag('signals.date_published')} or {flag('signals.date_modified')}" if full else flag("signals.date_published")
    return (
        ("tier1-access", 0, 30, tenth(f"greatest({TIER1_TOKENS} - coalesce(array_size(t1), 0), 0) * 30.0 / {TIER1_TOKENS}"), "true"),
        ("tier2-access", 0, 8, tenth(f"greatest({TIER2_TOKENS} - coalesce(array_size(t2), 0), 0) * 8.0 / {TIER2_TOKENS}"), "true"),
        ("no-cloaking", 0, 7, f"case when {flag('cloaking.detected')} then 0 else 7 end", f"({TRUSTED} and {flag('cloaking.tested')})"),
        ("robots", 1, 3, f"case when {flag('robots.present')} then 3 else 0 end", "true"),
        ("sitemap", 1, 4, f"case when {flag('robots.sitemap_declared')} then 4 else 0 end", "true"),
        ("llms-txt", 1, 9, f"case when not {flag('llms_txt.present')} then 0 when {flag('llms_txt.spec_valid')} then 9 else 6 end", f"({TRUSTED}{skip('/llms.txt')})"),
        ("agents-md", 1, 4, f"case when {flag('agents_md.present')} then 4 else 0 end", f"({TRUSTED}{skip('/agents.md')})"),
        ("declared-licence", 1, 2, f"case when signals.license_url is not null or ({TRUSTED} and {flag('signals.license_link')}) then 2 else 0 end", SIGNALS),
        ("content-signal", 1, 2, "case when coalesce(signals.content_signal, '') <> '' then 2 else 0 end", SIGNALS),
        ("agent-card", 1, 1, f"case when {flag('signals.agent_card')} then 1 else 0 end", f"({SIGNALS} and {TRUSTED}{skip('/.well-known/agent-card.json')})"),
        ("schema-org", 2, 7, f"case when {flag('structured.has_organization')} then 7 else 0 end", TRUSTED),
        ("schema-website", 2, 3, f"case when {flag('structured.has_website')} then 3 else 0 end", TRUSTED),
        ("schema-other", 2, 3, f"case when coalesce({OTHER_TYPES}, 0) > 0 then 3 else 0 end", TRUSTED),
        ("ssr-text", 2, 7, f"case when {TEXT} >= 500 then 7 when {TEXT} >= 150 then 4 else 0 end", TRUSTED),
        ("single-h1", 2, 3, "case when content.h1_count = 1 then 3 else 0 end", TRUSTED),
        ("landmarks", 2, 2, "case when coalesce(array_size(array_distinct(content.landmarks)), 0) >= 3 then 2 else 0 end", TRUSTED),
        ("dateline", 2, 3, f"case when {dated} then 3 else 0 end", f"({SIGNALS} and {TRUSTED})"),
        ("authorship", 2, 2, f"case when {flag('signals.has_author')} then 2 else 0 end", f"({SIGNALS} and {TRUSTED})"),
    )


LINES = lines()


def line_columns(full: bool = False) -> str:
    """Columns e0, a0, e1, a1, ... over the columns of PRELUDE: points earned, and whether the line could be observed."""
    return ", ".join(f"cast({e} as double) as e{i}, {a} as a{i}" for i, (_, _, _, e, a) in enumerate(lines(full)))


def band_columns() -> str:
    """Columns earned_<band>, max_<band> from line_columns()."""
    out = []
    for b, name in enumerate(BAND_NAMES):
        own = [i for i, x in enumerate(LINES) if x[1] == b]
        out.append(tenth(" + ".join(f"case when a{i} then e{i} else 0 end" for i in own)) + f" as earned_{name}")
        out.append(" + ".join(f"case when a{i} then {LINES[i][2]} else 0 end" for i in own) + f" as max_{name}")
    return ", ".join(out)


_EARNED = " + ".join(f"earned_{b}" for b in BAND_NAMES)
_MAX = " + ".join(f"max_{b}" for b in BAND_NAMES)
TOTAL = f"case when {flag('reachable')} and ({_MAX}) > 0 then cast(floor(({_EARNED}) / ({_MAX}) * 100 + 0.5) as int) end"
PARTIAL = f"(({_MAX}) <> case when {SIGNALS} then 100 else 90 end)"


def grade(c: str) -> str:
    return f"case when {c} is null then null " + " ".join(f"when {c} >= {n} then '{g}'" for n, g in GRADES) + " else 'F' end"


POSTURE = f"case when not {flag('robots.present')} then 'absent' when {flag('robots.blocks_all_crawlers')} then 'blanket' when coalesce(array_size(robots.named_tokens), 0) > 0 then 'deliberate' else 'inherited' end"


def archetype(blocked_roles: str, blocked_assistants: str, assistants: str) -> str:
    """Facet of access; the arguments are the distinct roles of blocked tier-1 tokens and counts of assistants."""
    n = "n_blocked"
    return (
        f"case when {METERED} then 'metered' when not {flag('robots.present')} then 'undeclared' when {n} = 0 then 'open' when {n} >= {TIER1_TOKENS} then 'walled'"
        f" when {blocked_roles} = 'training' then 'no-training' when {blocked_assistants} = 0 and {assistants} > 0 then 'assistant-only' else 'selective' end"
    )


def policy_gap(token: str) -> str:
    """Robots allow ``token`` but the server refuses its agent."""
    return f"({flag('cloaking.tested')} and coalesce(cloaking.bot_status, 0) in {listed(GAP_REFUSED)} and not {flag(f'''array_contains(t1, '{token.lower()}')''')})"


def contradicts(token: str) -> str:
    return f"({flag('cloaking.detected')} and not {flag(f'''array_contains(t1, '{token.lower()}')''')})"


CLOAKING = f"case when not {flag('cloaking.detected')} then 'none' when cloaking.bot_status in {listed(PROBE_REFUSED)} then 'refused' else 'served less' end"
BADGE = "case when total is null then 'unscored' when grade = 'A' then 'ready' when grade = 'B' then 'friendly' else 'measured' end"


def last_labels(c: str) -> str:
    """Public suffix of a host: the last label, or two if the second is a common registry label under a country code."""
    return f"case when {c} not like '%.%' then '' when regexp_like({c}, '[^.]+[.](co|com|org|net|ac|gov|edu)[.][^.][^.]$') then regexp_extract({c}, '([^.]+[.][^.]+)$', 1) else regexp_extract({c}, '([^.]*)$', 1) end"
