"""Observations derived from captured responses.

The test tables hold no responses, so CAPTURED makes them from the documents: a document's text is the robots or link file of
its site, or part of its home page, and the rest (statuses, headers, marks) goes by its id. Both engines read that text; what
follows from it is derived by functions/derive.py here and by SQL of its own in the check.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.functions import derive, detect
from tidemark.functions import html as h
from tidemark.functions import scoring as s
from tidemark.plans.extended import _LINES, _OK, _ROBOTS, PROBE, UNLISTED
from tidemark.plans.sqlkit import duck_text, query
from tidemark.tables import table

HEADERS = {
    "content-type": "case when id % 29 = 5 then 'text/html' else '' end",
    "server": "case id % 8 when 0 then 'nginx' when 1 then 'AkamaiGHost' when 2 then 'Squarespace' when 3 then 'BunnyCDN-DE1' else '' end",
    "cf-ray": "case when id % 6 = 0 then 'x' else '' end",
    "x-vercel-id": "case when id % 6 = 1 then 'x' else '' end",
    "via": "case when id % 6 = 2 then '1.1 vegur' else '' end",
    "x-shopid": "case when id % 19 = 3 then '7' else '' end",
    "cf-mitigated": "case when id % 37 = 4 then 'challenge' else '' end",
    "strict-transport-security": "case when id % 2 = 0 then 'max-age=1' else '' end",
    "content-security-policy": "case when id % 3 = 0 then 'x' else '' end",
    "x-content-type-options": "case id % 4 when 0 then 'NoSniff' when 1 then 'other' else '' end",
    "x-robots-tag": "case when id % 11 = 5 then 'NOINDEX' else '' end",
    "crawler-price": "case when id % 13 = 6 then 'USD 0.01' else '' end",
}
_H = {k: "h_" + k.replace("-", "_") for k in HEADERS}
_ROBOTS_BODY = """case when src = 'robots_txt' then body when id % 9 = 2 then concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'License: https://x.example/l ', chr(10), 'Content-Signal: search=yes, ai-train=no # c')
  when id % 9 = 3 then concat('User-agent: TansyBot', chr(10), 'User-agent: OrvexBot', chr(10), 'Disallow: /') when id % 9 = 4 then concat('User-agent: *', chr(10), 'Disallow: /', chr(10), 'Allow: /', chr(10), 'Crawl-delay: 2.5', chr(10), 'Sitemap: /s.xml')
  when id % 9 = 5 then '<html>User-agent: *' when id % 9 = 6 then '' else concat('User-agent: orvexbot', chr(10), 'Disallow: /', chr(10), 'License: l', chr(10), 'User-agent: *', chr(10), 'Disallow: /p') end"""
# ~ stands for the sign that begins a table's name in these texts
_LD = """replace(case id % 7 when 0 then '{"~graph": [{"~type": "Organization"}, {"~type": ["WebSite", "Thing"], "author": {"name": "x"}}]}' when 1 then '[{"~type": "Article", "author": "", "datePublished": "2026"}, {"part": {"~type": "Hidden"}}]'
  when 2 then '{"~type": "Broken",' when 3 then ' {"~type": "EducationalOrganization", "creator": ["x"], "dateModified": "2026"} ' else '' end, '~', chr(64))"""
_MARKS = """case id % 16 when 0 then '<link href="/wp-content/a.css">' when 1 then '<script src="https://cdn.shopify.com/s.js"></script>' when 2 then '<script src="/_next/static/b.js"></script>' when 3 then '<a href="/sites/default/files/c">' when 4 then '<p ng-version="1">'
  when 5 then '<html data-wf-site="x">' when 6 then '<meta content="Ghost 5">' when 7 then '<input name="csrf-param">' else '' end"""
_HEAD = """case id % 10 when 0 then '<meta name="robots" content="noindex,follow">' when 1 then '<link rel="canonical" href="/x"><link type="application/rss+xml" href="/f">' when 2 then '<meta name="author" content="A"><meta property="article:modified_time" content="x">'
  when 3 then '<link rel="x license" href="/l"><meta property="article:published_time" content="x">' when 4 then '<time datetime="2026">' when 5 then '<a rel="nofollow author">' else '' end"""
_WALL = """case id % 41 when 0 then '<title>Just a moment...</title>' when 1 then '<script src="/cdn-cgi/challenge-platform/x"></script>' when 2 then '<div id="px-captcha"></div>' when 3 then '<title>Server busy</title>' when 4 then 'The requested URL was rejected. Please consult' else '' end"""
_MAIN = """case when id % 23 = 0 then '' when id % 23 = 1 then '<form action="x"></form><script>document.forms[0].submit( )</script>' else concat('<header></header><main><h1>', domain, '</h1><!-- c --><p>', replace(body, '<', '&lt;'),
  '</p><h2>a</h2><h3>b</h3><ul><li>x</li></ul><ol></ol><table></table><img src="a" alt="b"><img src="c" alt=""></main>', case when id % 3 = 0 then '<footer></footer>' else '' end) end"""
CAPTURED = f"""d as (select doc_id as id, coalesce(domain, '') as domain, coalesce(text, '') as body, coalesce(lower(trim(source)), '') as src, coalesce(lower(trim(lang)), '') as lang from @documents),
  c as (select id, domain, id % 7 <> 0 as https, case when src = 'robots_txt' then 200 when id % 9 = 0 then 404 when id % 9 = 1 then 0 else 200 end as robots_status, {_ROBOTS_BODY} as robots_body,
    case id % 31 when 0 then 402 when 1 then 403 when 2 then 429 when 3 then 451 when 4 then 404 when 5 then 500 when 6 then 0 when 7 then 503 else 200 end as home_status,
    concat('<!doctype html><html lang="', lang, '-XX"><head>', {_WALL}, '<title> ', domain, ' </title>', {_HEAD}, '<script type="application/ld+json">', {_LD}, '</script></head><body>', {_MARKS}, {_MAIN}, '</body></html>') as home_body,
    concat('https://', domain, '/') as home_url, case when id % 2 = 0 then 'timeout: no answer' end as home_error,
    case id % 8 when 0 then 403 when 1 then 503 when 2 then 0 when 3 then 404 else 200 end as bot_status, id % 5 = 0 as thin, case when id % 17 = 0 then 'EUR 1' else '' end as b_price,
    case when src = 'llms_txt' then 200 when id % 5 = 0 then cast(null as int) when id % 5 = 1 then 404 else 200 end as llms_status, case when src = 'llms_txt' then body when id % 5 = 2 then '<!DOCTYPE html>' when id % 5 = 3 then concat('# t', chr(10), '> s', chr(10), '## x', chr(10), '- [a](b)', chr(10), ' - [c](d)') else ' ' end as llms_body,
    case when src = 'agents_md' then 200 when id % 4 = 0 then cast(null as int) when id % 4 = 1 then 500 else 200 end as agents_status, case when src = 'agents_md' then body when id % 4 = 2 then 'hello' else '{{"a": 1}}' end as agents_body,
    case when id % 6 = 0 then cast(null as int) when id % 6 = 1 then 404 else 200 end as card_status, case id % 6 when 2 then ' {{"name": "x"}} ' when 3 then '{{"name": ' when 4 then '[]' else 'x' end as card_body,
    {', '.join(f'{v} as {_H[k]}' for k, v in HEADERS.items())} from d)"""


def responses(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The captured responses of every document's site."""
    c = query(f"with {CAPTURED} select * from c")(spark, sf_dir)
    none = F.lit(None).cast("string")
    headers = F.map_from_arrays(F.array(*[F.lit(k) for k in HEADERS]), F.array(*[F.col(v) for v in _H.values()]))

    def res(name: str, heads, body, url=none, error=none):
        s = F.struct(F.col(f"{name}_status").alias("status"), heads.alias("headers"), body.alias("body"), url.alias("url"), error.alias("error"))
        return F.when(F.col(f"{name}_status").isNotNull(), s).alias(name)

    bare = F.create_map(F.lit("content-type"), F.lit("text/plain"))
    page = F.when(F.col("home_status") == 0, F.lit("")).otherwise(F.col("home_body"))
    thin = F.when(F.col("bot_status") == 0, F.lit("")).when(F.col("thin"), F.left("home_body", F.floor(F.length("home_body") / 5).cast("int"))).otherwise(F.col("home_body"))
    return c.select(
        "id", "domain", "https", res("robots", bare, F.col("robots_body")), res("home", headers, page, F.col("home_url"), F.col("home_error")),
        res("bot", F.create_map(F.lit("crawler-price"), F.col("b_price")), thin), res("llms", F.create_map(F.lit("content-type"), F.col("h_content_type")), F.col("llms_body")), res("agents", bare, F.col("agents_body")), res("card", bare, F.col("card_body")),
    )


#: The columns of the flat result: name and where it is in the observation.
FLAT = {
    "reachable": "reachable", "opted_out": "opted_out", "https": "https", "http_status": "http_status", "final_url": "final_url", "error": "error", "kind": "control.kind", "challenged": "control.challenged", "reason": "control.reason",
    "robots_present": "robots.present", "blanket": "robots.blocks_all_crawlers", "sitemap": "robots.sitemap_declared", "named": "robots.named_tokens", "groups": "robots.group_count", "uses_allow": "robots.uses_allow_rules", "crawl_delay": "robots.crawl_delay", "robots_bytes": "robots.bytes",
    "tier1": "tier1_blocked", "tier2": "tier2_blocked", "tested": "cloaking.tested", "browser_bytes": "cloaking.browser_bytes", "bot_status": "cloaking.bot_status", "bot_bytes": "cloaking.bot_bytes", "detected": "cloaking.detected",
    "llms": "llms_txt.present", "llms_valid": "llms_txt.spec_valid", "llms_issues": "llms_txt.issues", "llms_links": "llms_txt.link_count", "agents": "agents_md.present", "agents_bytes": "agents_md.bytes",
    "types": "structured.json_ld_types", "organization": "structured.has_organization", "website": "structured.has_website", "title": "content.title", "lang": "content.lang", "text_length": "content.ssr_text_length", "h1": "content.h1_count", "landmarks": "content.landmarks",
    "images": "content.images_total", "images_alt": "content.images_with_alt", "feed": "content.feed", "canonical": "content.canonical", "noindex": "content.meta_noindex",
    "license_url": "signals.license_url", "license_link": "signals.license_link", "content_signal": "signals.content_signal", "price": "signals.crawler_price", "card": "signals.agent_card", "card_bytes": "signals.agent_card_bytes", "published": "signals.date_published", "modified": "signals.date_modified",
    "author": "signals.has_author", "h2": "signals.h2_count", "h3": "signals.h3_count", "lists": "signals.list_count", "tables": "signals.table_count", "text_ratio": "signals.text_ratio", "skipped": "signals.skipped_checks",
    "platform": "stack.platform", "network": "stack.network", "server": "stack.server", "hsts": "security.hsts", "csp": "security.csp", "nosniff": "security.x_content_type_options",
}


def derived_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The observation of every document's site, flat: lists as texts."""
    o = derive.observe(responses(spark, sf_dir), table(spark, sf_dir, "agent_registry"), PROBE)
    listed = {"named", "tier1", "tier2", "llms_issues", "types", "landmarks", "skipped"}
    return o.select("id", *[(F.array_join(F.array_sort(c) if n == "types" else F.col(c), ",") if n in listed else F.col(c)).alias(n) for n, c in FLAT.items()])


def _case(rules, body: str | None) -> str:
    """The rules as SQL of the check."""
    arms = []
    for r in rules:
        conds = []
        if r.header in _H:
            conds.append(f"regexp_matches({_H[r.header]}, '{r.value}')" if r.value else f"{_H[r.header]} <> ''")
        if r.body and body:
            conds.append(f"regexp_matches({body}, '{r.body}')")
        if conds:
            arms.append(f"when {' or '.join(conds)} then '{r.id}'")
    return f"case {' '.join(arms)} end"


def _as_text(status: str, body: str, kind: str) -> str:
    return f"coalesce({status} = 200 and trim({body}) <> '' and not regexp_matches(substr({body}, 1, 400), '(?i)^\\s*(<!doctype html|<html|<\\?xml|\\{{|\\[)') and not contains({kind}, 'text/html'), false)"


def _sql() -> str:
    lines = _LINES.replace(f"documents where {_ROBOTS}", "rdocs")
    seen = lambda c, other="false": f"case when seen then {c} else {other} end"
    has = lambda p: seen(f"regexp_matches(html, '{p}')")
    tags = lambda t: seen(f"len(regexp_extract_all(html, '(?i)<({t})[\\s>]'))", "0")
    q = "[\"'']"
    marks = f"case {' '.join(f'''when regexp_matches(substr(html, 1, {detect.CHALLENGE_WINDOW}), '{r.body}') then '{r.id}' ''' for r in detect.CHALLENGE_RULES)} end"
    self_sent = "length(html) <= 25000 and text_length <= 200 and regexp_matches(html, '(?i)<form[\\s>]') and regexp_matches(html, '(?i)requestsubmit\\(\\)|\\.submit\\(\\s*\\)')"
    stub = "home_status < 400 and length(html) < 5000 and text_length < 100"
    reason = f"case when home_status = 402 then 'status 402' when home_status in (403, 429, 451) then 'status ' || home_status when h_cf_mitigated <> '' then 'mitigated' when mark is not null then mark when {self_sent} then 'self-submitting form' when {stub} then 'stub' end"
    kind = f"case when home_status = 402 then 'payment-required' when home_status in (403, 429, 451) or h_cf_mitigated <> '' or mark is not null or ({self_sent}) then 'bot-challenge' when {stub} then 'unreadable' else 'none' end"
    landmarks = " || ".join(f"case when regexp_matches(html, '(?i)<{t}[\\s>]') then ['{t}'] else [] end" for t in derive.LANDMARKS)
    skipped = " || ".join(f"case when {c}_status is null then ['{p}'] else [] end" for c, p in derive.CHECKS)
    issues = " || ".join(f"case when regexp_matches(llms_body, '{p}') then [] else ['{n}'] end" for p, n in (("(?m)^#[ \\t]+[^ \\t\\r\\n]", "title"), ("(?m)^>[ \\t]*[^ \\t\\r\\n]", "summary"), ("(?m)^##[ \\t]+[^ \\t\\r\\n]", "section"))) + " || case when links = 0 then ['links'] else [] end"
    truthy = lambda k: f"coalesce(json_extract_string(node, '$.{k}'), '') not in ('', '[]', 'null', 'false')"
    said = "(seen or gate = 'robots-restricted')"
    take = lambda p, n: f"nullif(left(trim(regexp_extract(rtext, '{p}', 1)), {n}), '')"
    return f"""with {duck_text(CAPTURED)}, r0 as (select id, {_as_text('robots_status', 'robots_body', "'text/plain'")} as rpresent, robots_body from c), rdocs as (select id as doc_id, robots_body as text from r0 where rpresent), {lines},
  j as (select doc_id, group_no, {_OK} as ok, list_contains(disallow, '/') as root, unnest(list_transform(agents, lambda x: lower(x))) as agent from g),
  f as (select doc_id, agent, arg_min(ok, group_no) as ok, arg_min(root, group_no) as root from j group by doc_id, agent), gs as (select doc_id, count(*) as groups, bool_or(len(list_filter(allow, lambda x: x <> '')) > 0) as uses_allow from g group by doc_id),
  t as (select c.id, a.token, a.tier, a.registry_order, f.agent is not null as named, coalesce(f.ok, star.ok, true) as ok from c join agent_registry a on true left join f on f.doc_id = c.id and f.agent = lower(a.token) left join f star on star.doc_id = c.id and star.agent = '*'),
  y as (select id, coalesce(string_agg(token, ',' order by registry_order) filter (where named), '') as named, coalesce(string_agg(token, ',' order by registry_order) filter (where tier = 1 and not ok), '') as t1, coalesce(string_agg(token, ',' order by registry_order) filter (where tier = 2 and not ok), '') as t2 from t group by id),
  rob as (select c.*, r0.rpresent, case when r0.rpresent then c.robots_body else '' end as rtext, y.named, y.t1, y.t2, coalesce(gs.groups, 0) as groups, coalesce(gs.uses_allow, false) as uses_allow, coalesce(star.root and not star.ok, false) as blanket,
    case when x.ok = false then 'opted-out' when x.ok is null and star.ok = false then 'robots-restricted' else 'open' end as gate
    from c join r0 on r0.id = c.id join y on y.id = c.id left join gs on gs.doc_id = c.id left join f star on star.doc_id = c.id and star.agent = '*' left join f x on x.doc_id = c.id and x.agent = '{PROBE.lower()}'),
  p0 as (select *, case when gate = 'open' and home_status <> 0 then home_body else '' end as html from rob),
  p1 as (select *, length({h.strip_to_text('html', ", 'g'")}) as text_length, {marks} as mark, case when bot_status = 0 then 0 when thin then cast(floor(length(home_body) / 5) as int) else length(home_body) end as bbytes, case when home_status = 0 then 0 else length(home_body) end as hbytes,
    {_as_text('llms_status', 'llms_body', 'h_content_type')} as has_llms, {_as_text('agents_status', 'agents_body', "'text/plain'")} as has_agents,
    coalesce(card_status = 200 and regexp_matches(trim(card_body), '^[\\[{{]') and json_valid(trim(card_body)), false) as has_card, len(regexp_extract_all(llms_body, '(?m)^[ \\t]*-[ \\t]*\\[.+\\]\\(.+\\)')) as links from p0),
  p2 as (select *, {kind} as ckind, {reason} as creason from p1),
  p as (select *, gate = 'open' and home_status <> 0 and not (home_status >= 400 and ckind = 'none') as seen from p2),
  b as (select id, i, trim(x) as v from (select id, unnest(range(0, len(xs))) as i, unnest(xs) as x from (select id, regexp_extract_all(html, '(?is)<script[^>]+type=.application/ld.json.[^>]*>(.*?)</script>', 1) as xs from p) q) q2),
  ok as (select id, i, cast(v as json) as v from b where json_valid(v)),
  root as (select id, i, unnest(case when json_type(v) = 'ARRAY' then json_extract(v, '$[*]') else [v] end) as v from ok),
  nodes as (select id, unnest([v] || coalesce(json_extract(v, '$."@graph"[*]'), [])) as node from root),
  ld as (select id, list_distinct(flatten(list(case when json_type(node, '$."@type"') = 'ARRAY' then json_extract_string(node, '$."@type"[*]') when json_type(node, '$."@type"') = 'VARCHAR' then [json_extract_string(node, '$."@type"')] else [] end))) as types,
    bool_or({truthy('author')} or {truthy('creator')}) as author, bool_or({truthy('datePublished')}) as published, bool_or({truthy('dateModified')}) as modified from nodes group by id),
  s as (select p.*, coalesce(ld.types, []) as types, coalesce(ld.author, false) as ld_author, coalesce(ld.published, false) as ld_published, coalesce(ld.modified, false) as ld_modified from p left join ld on ld.id = p.id)
  select id, seen or gate <> 'open' as reachable, gate = 'opted-out' as opted_out, https, case when gate = 'open' then home_status else 0 end as http_status, case when gate = 'open' and home_status <> 0 then home_url end as final_url,
    case when gate = 'open' and home_status = 0 then coalesce(home_error, 'no response') when gate = 'open' and not seen then 'homepage returned HTTP ' || home_status end as error,
    case when gate = 'robots-restricted' then 'robots-restricted' when seen then ckind else 'none' end as kind, gate = 'robots-restricted' or (seen and ckind <> 'none') as challenged, case when gate = 'robots-restricted' then 'robots' when seen then creason end as reason,
    rpresent as robots_present, blanket, regexp_matches(rtext, '(?im)^[ \\t]*sitemap[ \\t]*:[ \\t]*[^ \\t\\r\\n#]') as sitemap, named, groups, uses_allow, try_cast(nullif(regexp_extract(rtext, '(?im)^[ \\t]*crawl-delay[ \\t]*:[ \\t]*([0-9]+([.][0-9]+)?)', 1), '') as double) as crawl_delay, length(rtext) as robots_bytes,
    case when {said} then t1 else '' end as tier1, case when {said} then t2 else '' end as tier2, {seen('bot_status <> 0')} as tested, {seen('hbytes', '0')} as browser_bytes, {seen('bot_status', '0')} as bot_status, {seen('bbytes', '0')} as bot_bytes,
    {seen('bot_status in (403, 429, 503) or (home_status = 200 and bot_status = 200 and bbytes < hbytes * 0.25)')} as detected,
    seen and has_llms as llms, seen and has_llms and len({issues}) = 0 as llms_valid, case when seen and has_llms then array_to_string({issues}, ',') else '' end as llms_issues, case when seen and has_llms then links else 0 end as llms_links,
    seen and has_agents as agents, case when seen and has_agents then length(agents_body) else 0 end as agents_bytes, {seen("array_to_string(list_sort(types), ',')", "''")} as types,
    {seen(f"len(list_filter(types, lambda x: lower(x) in ({', '.join(repr(x) for x in derive.ORGANIZATIONS)}))) > 0")} as organization, {seen("len(list_filter(types, lambda x: lower(x) = 'website')) > 0")} as website,
    {seen("nullif(trim(regexp_extract(html, '(?is)<title[^>]*>(.{0,300}?)</title>', 1)), '')", 'null')} as title, {seen(f"nullif(split_part(lower(regexp_extract(html, '(?i)<html[^>]+lang={q}([a-zA-Z-]{{2,12}}){q}', 1)), '-', 1), '')", 'null')} as lang, {seen('text_length', '0')} as text_length, {tags('h1')} as h1,
    {seen(f"array_to_string({landmarks}, ',')", "''")} as landmarks, {seen("len(regexp_extract_all(html, '(?i)<img[^>]*>'))", '0')} as images, {seen("len(list_filter(regexp_extract_all(html, '(?i)<img[^>]*>'), lambda x: regexp_matches(x, '(?i)alt=.[^\"]+\"')))", '0')} as images_alt,
    {has(f'(?i)<link[^>]+type={q}application/(rss|atom)[+]xml{q}')} as feed, {has(f'(?i)<link[^>]+rel={q}canonical{q}')} as canonical, {seen("contains(lower(regexp_extract(html, '(?i)<meta[^>]+name=.robots.[^>]+content=.([^\"]+)\"', 1)), 'noindex') or contains(lower(h_x_robots_tag), 'noindex')")} as noindex,
    case when {said} then {take('(?im)^[ \\t]*license[ \\t]*:[ \\t]*([^ \\t\\r\\n]+)', 300)} end as license_url, {has(f'(?i)<link[^>]+rel={q}[^\"]*license')} as license_link, case when {said} then {take('(?im)^[ \\t]*content-signal[ \\t]*:[ \\t]*([^\\r\\n#]+)', 200)} end as content_signal,
    {seen("nullif(case when h_crawler_price <> '' then h_crawler_price else b_price end, '')", 'null')} as price, seen and has_card as card, case when seen and has_card then length(card_body) else 0 end as card_bytes,
    {seen(f"ld_published or regexp_matches(html, '(?i)property={q}article:published_time|<time[^>]+datetime=')")} as published, {seen(f"ld_modified or regexp_matches(html, '(?i)property={q}article:modified_time')")} as modified, {seen(f"ld_author or regexp_matches(html, '(?i)<meta[^>]+name={q}author{q}|rel={q}[^\"]*author')")} as author,
    {tags('h2')} as h2, {tags('h3')} as h3, {tags('ul|ol')} as lists, {tags('table')} as tables, {seen('floor(text_length * cast(10000 as double) / length(html) + 0.5) / 10000', '0')} as text_ratio, {seen(f"array_to_string({skipped}, ',')", "''")} as skipped,
    {seen(_case(detect.PLATFORM_RULES, 'html'), 'null')} as platform, {seen(_case(detect.NETWORK_RULES, None), 'null')} as network, {seen("nullif(left(h_server, 40), '')", 'null')} as server, {seen("h_strict_transport_security <> ''")} as hsts, {seen("h_content_security_policy <> ''")} as csp, {seen("lower(h_x_content_type_options) = 'nosniff'")} as nosniff from s"""


def stack_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sites by derived platform and network, with the label and kind that the rules give them (the id where they give none)."""
    o = derived_observations(spark, sf_dir).select(F.explode(F.array("platform", "network")).alias("id")).where("id is not null")
    n = o.groupBy("id").agg(F.count(F.lit(1)).alias("n"))
    return n.join(detect.labels(spark), "id", "left").select("id", F.coalesce("label", "id").alias("label"), F.coalesce("kind", F.lit("other")).alias("kind"), "n")


def derived_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of the derived observations, with checks that were skipped left out and modification dates counted."""
    o = derive.observe(responses(spark, sf_dir), table(spark, sf_dir, "agent_registry"), PROBE)
    text = f"with primed as (select *, {s.PRELUDE} from {{o}}), lined as (select *, {s.line_columns(full=True)} from primed), banded as (select *, {s.band_columns()} from lined)"
    return spark.sql(f"{text} select id, earned_access, max_access, earned_surface, max_surface, earned_structure, max_structure, {s.TOTAL} as total, {s.PARTIAL} as partial, {s.grade(s.TOTAL)} as grade from banded where not opted_out", o=o)


def _scores_sql() -> str:
    """The rubric over the flat columns, line by line."""
    pts = lambda cond, n: f"case when {cond} then {n} else 0 end"
    tenth = lambda x: f"floor(({x}) * 10 + 0.5) / 10"
    rest = "len(list_filter(string_split(types, ','), lambda x: x <> '' and lower(x) not in ('organization', 'corporation', 'localbusiness', 'onlinebusiness', 'newsmediaorganization', 'website'))) > 0"
    return f"""with o as ({_sql()}), x as (select *, len(list_filter(string_split(tier1, ','), lambda x: x <> '')) as n1, len(list_filter(string_split(tier2, ','), lambda x: x <> '')) as n2, string_split(skipped, ',') as sk,
    not challenged and not (browser_bytes > 0 and browser_bytes < 5000 and (text_length < 100 or (text_length < 400 and bot_status in (401, 403, 406, 429, 503)))) as ok from o where not opted_out),
  y as (select *, ok and not list_contains(sk, '/llms.txt') as ok_llms, ok and not list_contains(sk, '/agents.md') as ok_agents, ok and not list_contains(sk, '/.well-known/agent-card.json') as ok_card from x),
  b as (select *, {tenth(f"{tenth('(11 - n1) * 30.0 / 11')} + {tenth('(12 - n2) * 8.0 / 12')} + {pts('ok and tested and not detected', 7)}")} as earned_access, 38 + {pts('ok and tested', 7)} as max_access,
    {tenth(f"{pts('robots_present', 3)} + {pts('sitemap', 4)} + case when not ok_llms or not llms then 0 when llms_valid then 9 else 6 end + {pts('ok_agents and agents', 4)} + {pts('license_url is not null or (ok and license_link)', 2)} + {pts('content_signal is not null', 2)} + {pts('ok_card and card', 1)}")} as earned_surface,
    11 + {pts('ok_llms', 9)} + {pts('ok_agents', 4)} + {pts('ok_card', 1)} as max_surface,
    {tenth(f"case when ok then {pts('organization', 7)} + {pts('website', 3)} + {pts(rest, 3)} + case when text_length >= 500 then 7 when text_length >= 150 then 4 else 0 end + {pts('h1 = 1', 3)} + {pts("len(string_split(landmarks, ',')) >= 3", 2)} + {pts('published or modified', 3)} + {pts('author', 2)} else 0 end")} as earned_structure, {pts('ok', 30)} as max_structure from y),
  t as (select *, case when reachable then cast(floor((earned_access + earned_surface + earned_structure) / (max_access + max_surface + max_structure) * 100 + 0.5) as int) end as total from b)
  select id, earned_access, max_access, earned_surface, max_surface, earned_structure, max_structure, total, max_access + max_surface + max_structure <> 100 as partial, case when total >= 90 then 'A' when total >= 75 then 'B' when total >= 60 then 'C' when total >= 40 then 'D' when total is not null then 'F' end as grade from t"""


QUERIES = {"derived_scores": derived_scores, "derived_observations": derived_observations, "stack_labels": stack_labels}
_NAMES = ", ".join(f"('{r.id}', '{r.label}', '{r.kind}')" for r in (*detect.PLATFORM_RULES, *detect.NETWORK_RULES))
ORACLE = {
    "derived_observations": _sql(),
    "derived_scores": _scores_sql(),
    "stack_labels": f"with o as ({_sql()}), e as (select unnest([platform, network]) as id from o), n as (select id, count(*) as n from e where id is not null group by id) select n.id, coalesce(l.label, n.id) as label, coalesce(l.kind, 'other') as kind, n.n from n left join (values {_NAMES}) l(id, label, kind) on l.id = n.id",
}
