"""From captured responses to observations, as column expressions.

A response is a struct ``status`` (0: none came), ``headers`` (map, lower-case names), ``body``, ``url``, ``error``; a null
response was never asked for. Sizes are characters of the body.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tidemark.functions import detect, robots

# Limits and lists of the derivation.
STUB_SIZE, STUB_TEXT = 5000, 100
FORM_SIZE, FORM_TEXT = 25_000, 200
STARVED = 0.25
LANDMARKS = ("main", "nav", "header", "footer", "article", "aside")
ORGANIZATIONS = ("organization", "corporation", "localbusiness", "onlinebusiness", "newsmediaorganization", "educationalorganization", "governmentorganization")
MAX_NODES = 500
CHECKS = (("llms", "/llms.txt"), ("agents", "/agents.md"), ("card", "/.well-known/agent-card.json"))


def header(res: str, name: str) -> Column:
    return F.coalesce(F.try_element_at(F.col(f"{res}.headers"), F.lit(name)), F.lit(""))


def _body(res: str) -> Column:
    return F.coalesce(F.col(f"{res}.body"), F.lit(""))


def served_as_text(res: str) -> Column:
    """Status 200 with a body that isn't blank, begins like no page or data, and isn't called a page."""
    return F.coalesce(
        (F.col(f"{res}.status") == 200) & (F.trim(_body(res)) != "") & ~F.substring(_body(res), 1, 400).rlike(r"(?i)^\s*(<!doctype html|<html|<\?xml|\{|\[)") & ~F.contains(header(res, "content-type"), F.lit("text/html")), F.lit(False)
    )


def served_as_json(res: str) -> Column:
    """Status 200 with a body that is a JSON object or array."""
    t = F.trim(_body(res))
    return F.coalesce((F.col(f"{res}.status") == 200) & t.rlike(r"^[\[{]") & F.try_parse_json(t).isNotNull(), F.lit(False))


def strip_to_text(c: Column) -> Column:
    """Visible text: scripts, styles, comments, tags and entities removed in that order, white space collapsed."""
    for tag in ("script", "style", "noscript"):
        c = F.regexp_replace(c, rf"(?is)<{tag}[^>]*>.*?</{tag}>", " ")
    for pattern in (r"(?s)<!--.*?-->", r"<[^>]+>", r"(?i)&[a-z]+;|&#[0-9]+;"):
        c = F.regexp_replace(c, pattern, " ")
    return F.trim(F.regexp_replace(c, r"[ \t\n\r]+", " "))


def interstitial(html: Column, text_length: Column) -> Column:
    """A small page with next to no text whose form a script submits at once."""
    return (F.length(html) <= FORM_SIZE) & (text_length <= FORM_TEXT) & html.rlike(r"(?i)<form[\s>]") & html.rlike(r"(?i)requestsubmit\(\)|\.submit\(\s*\)")


def control(res: str, text_length: Column) -> Column:
    """Struct ``challenged``, ``reason``, ``kind`` of the control answer: payment wanted, refusals by status, a mitigation header, known
    marks at the head of the body, a form that submits itself, a stub; in this order."""
    status, body = F.col(f"{res}.status"), _body(res)
    mark = detect.first_match(detect.CHALLENGE_RULES, body, window=detect.CHALLENGE_WINDOW)
    of = lambda reason, kind: F.struct(F.lit(True).alias("challenged"), reason.alias("reason"), F.lit(kind).alias("kind"))
    return (
        F.when(status == 402, of(F.lit("status 402"), "payment-required"))
        .when(status.isin(403, 429, 451), of(F.concat(F.lit("status "), status), "bot-challenge"))
        .when(header(res, "cf-mitigated") != "", of(F.lit("mitigated"), "bot-challenge"))
        .when(mark.isNotNull(), of(mark, "bot-challenge"))
        .when(interstitial(body, text_length), of(F.lit("self-submitting form"), "bot-challenge"))
        .when((status < 400) & (F.length(body) < STUB_SIZE) & (text_length < STUB_TEXT), of(F.lit("stub"), "unreadable"))
        .otherwise(F.struct(F.lit(False).alias("challenged"), F.lit(None).cast("string").alias("reason"), F.lit("none").alias("kind")))
    )


def cloaking(home: str, bot: str) -> Column:
    """Struct ``tested``, ``browser_bytes``, ``bot_status``, ``bot_bytes``, ``detected``: the bot is refused, or served under a quarter of what the browser is."""
    hs, bs = F.coalesce(F.col(f"{home}.status"), F.lit(0)), F.coalesce(F.col(f"{bot}.status"), F.lit(0))
    hb, bb = F.length(_body(home)).cast("bigint"), F.length(_body(bot)).cast("bigint")
    starved = (hs == 200) & (bs == 200) & (bb < hb * STARVED)
    return F.struct((bs != 0).alias("tested"), hb.alias("browser_bytes"), bs.alias("bot_status"), bb.alias("bot_bytes"), (bs.isin(403, 429, 503) | starved).alias("detected"))


def linked_data(html: Column) -> Column:
    """Struct ``types`` (in order, repeated), ``author``, ``published``, ``modified`` of a page's linked-data blocks.

    A block's root, the items of a root array and of ``@graph`` are nodes, MAX_NODES at most; nothing deeper is. Blocks that are no JSON are skipped.
    """
    raw = F.regexp_extract_all(html, F.lit(r"(?is)<script[^>]+type=.application/ld.json.[^>]*>(.*?)</script>"), 1)
    blocks = F.filter(F.transform(raw, lambda x: F.try_parse_json(F.trim(x))), lambda v: v.isNotNull())
    none = F.array().cast("array<variant>")
    roots = F.flatten(F.transform(blocks, lambda v: F.coalesce(F.try_variant_get(v, "$", "array<variant>"), F.array(v))))
    nodes = F.slice(F.flatten(F.transform(roots, lambda n: F.concat(F.array(n), F.coalesce(F.try_variant_get(n, '$["@graph"]', "array<variant>"), none)))), 1, MAX_NODES)
    one = lambda n: F.coalesce(F.try_variant_get(n, '$["@type"]', "array<string>"), F.array_compact(F.array(F.try_variant_get(n, '$["@type"]', "string"))))
    some = lambda n, *names: F.exists(F.array(*[F.coalesce(F.try_variant_get(n, f"$.{k}", "string"), F.lit("")) for k in names]), lambda x: ~x.isin("", "[]", "null", "false"))
    anywhere = lambda *names: F.exists(nodes, lambda n: some(n, *names))
    return F.struct(F.flatten(F.transform(nodes, one)).alias("types"), anywhere("author", "creator").alias("author"), anywhere("datePublished").alias("published"), anywhere("dateModified").alias("modified"))


def link_file(text: Column) -> Column:
    """Struct ``valid``, ``issues``, ``links`` of a link file: it wants a title, a summary, a section and a list of links."""
    n = F.array_size(F.regexp_extract_all(text, F.lit(r"(?m)^[ \t]*-[ \t]*\[.+\]\(.+\)"), 0))
    wants = ((r"(?m)^#[ \t]+[^ \t\r\n]", "title"), (r"(?m)^>[ \t]*[^ \t\r\n]", "summary"), (r"(?m)^##[ \t]+[^ \t\r\n]", "section"))
    issues = F.array_compact(F.array(*[F.when(~text.rlike(p), F.lit(name)) for p, name in wants], F.when(n == 0, F.lit("links"))))
    return F.struct((F.size(issues) == 0).alias("valid"), issues.alias("issues"), n.alias("links"))


def _tags(html: Column, tag: str) -> Column:
    return F.regexp_count(html, F.lit(rf"(?i)<({tag})[\s>]"))


def robots_of(responses: DataFrame, registry: DataFrame, probe: str) -> DataFrame:
    """``id`` with what each site's robots document says: ``rob`` (summary), ``gate``, ``tier1_blocked``, ``tier2_blocked``, ``directives``.

    A document that isn't served as text says nothing, so everything is allowed.
    """
    docs = responses.select("id", F.when(served_as_text("robots"), F.col("robots.body")).alias("text"))
    groups = robots.rule_groups(robots.rule_lines(docs.where("text is not null"), "id", "text"))
    agents = F.transform("agents", F.lower)
    first_star = F.min_by(F.when(F.array_contains(agents, "*"), F.array_contains("disallow", "/")), F.when(F.array_contains(agents, "*"), F.col("group_no")))
    per = groups.groupBy("doc_id").agg(
        F.count(F.lit(1)).cast("int").alias("groups"), F.max(F.exists("allow", lambda x: x != "")).alias("allows"), first_star.alias("star"), F.array_distinct(F.flatten(F.collect_list(agents))).alias("names")
    )
    known = registry.where("token is not null").dropDuplicates(["token"]).agg(F.array_sort(F.collect_list(F.struct("registry_order", "token", "tier")))).scalar()
    d = docs.join(per.withColumnRenamed("doc_id", "id"), "id", "left").join(robots.verdicts(groups).withColumnRenamed("doc_id", "id"), "id", "left").withColumn("known", known)
    v = F.col("verdicts")
    pick = lambda cond: F.transform(F.filter("known", cond), lambda t: t["token"])
    denied = lambda tier: pick(lambda t: (t["tier"] == tier) & ~robots.allowed(v, t["token"]))
    text = F.coalesce("text", F.lit(""))
    take = lambda pattern: F.nullif(F.trim(F.regexp_extract(text, pattern, 1)), F.lit(""))
    gate = F.when(robots.allowed(v, F.lit(probe)), "open").when(F.try_element_at(v, F.lit(probe.lower())).isNotNull(), "opted-out").otherwise("robots-restricted")
    return d.select(
        "id",
        gate.alias("gate"),
        F.struct(
            F.col("text").isNotNull().alias("present"),
            (F.coalesce("star", F.lit(False)) & ~robots.allowed(v, F.lit("an-agent-that-no-list-names"))).alias("blocks_all_crawlers"),
            text.rlike(r"(?im)^[ \t]*sitemap[ \t]*:[ \t]*[^ \t\r\n#]").alias("sitemap_declared"),
            F.coalesce(pick(lambda t: F.array_contains("names", F.lower(t["token"]))), F.array().cast("array<string>")).alias("named_tokens"),
            F.coalesce("groups", F.lit(0)).alias("group_count"),
            F.coalesce("allows", F.lit(False)).alias("uses_allow_rules"),
            F.try_to_number(F.nullif(F.regexp_extract(text, r"(?im)^[ \t]*crawl-delay[ \t]*:[ \t]*([0-9]+([.][0-9]+)?)", 1), F.lit("")), F.lit("999999999.999")).cast("double").alias("crawl_delay"),
            F.length(text).alias("bytes"),
        ).alias("rob"),
        denied(1).alias("tier1"),
        denied(2).alias("tier2"),
        F.struct(F.left(take(r"(?im)^[ \t]*license[ \t]*:[ \t]*([^ \t\r\n]+)"), F.lit(300)).alias("license_url"), F.left(take(r"(?im)^[ \t]*content-signal[ \t]*:[ \t]*([^\r\n#]+)"), F.lit(200)).alias("content_signal")).alias("directives"),
    )


def observe(responses: DataFrame, registry: DataFrame, probe: str) -> DataFrame:
    """Observations of captured responses: ``id``, ``domain`` and the observation's fields.

    ``responses``: ``id`` (unique), ``domain``, ``https`` and the responses ``robots``, ``home``, ``bot``, ``llms``, ``agents``, ``card``. A site that names
    the probe and denies it is opted out and nothing else is recorded; one that denies all is recorded by its rules alone; one
    that doesn't answer, or answers with an error that is no challenge, is unreachable. What was not asked for (a null
    response) is listed in ``skipped_checks``, so it can be told from what is absent.
    """
    r = robots_of(responses, registry, probe)
    base = responses.join(r, "id").withColumn("html", F.when(F.col("gate") == "open", _body("home")).otherwise(F.lit("")))
    base = base.withColumn("text_length", F.length(strip_to_text(F.col("html"))))
    base = base.withColumn("ctl", control("home", F.col("text_length"))).withColumn("ld", linked_data(F.col("html")))
    status = F.coalesce("home.status", F.lit(0))
    opened = F.col("gate") == "open"
    seen = opened & (status != 0) & ~((status >= 400) & ~F.col("ctl.challenged"))
    base = base.withColumn("seen", seen)
    h, none = F.col("html"), F.lit(None)
    no_text = F.array().cast("array<string>")
    if_seen = lambda c, other: F.when(F.col("seen"), c).otherwise(other)
    told = F.col("gate").isin("open", "robots-restricted")
    lower_types = F.transform("ld.types", F.lower)
    has = lambda pattern: if_seen(h.rlike(pattern), F.lit(False))
    first = lambda pattern: F.regexp_extract(h, pattern, 1)
    llms, agents_there, card = (if_seen(f(c), F.lit(False)) for f, c in ((served_as_text, "llms"), (served_as_text, "agents"), (served_as_json, "card")))
    price = F.left(F.coalesce(F.nullif(header("home", "crawler-price"), F.lit("")), header("bot", "crawler-price")), F.lit(80))
    file = link_file(_body("llms"))
    images = F.regexp_extract_all(h, F.lit(r"(?i)<img\b[^>]*>"), 0)
    blocked = lambda c: F.when(F.col("seen") | (F.col("gate") == "robots-restricted"), F.col(c)).otherwise(no_text)
    return base.select(
        "id", "domain", "https",
        (F.col("seen") | (F.col("gate") != "open")).alias("reachable"),
        (F.col("gate") == "opted-out").alias("opted_out"),
        F.when(opened, status).otherwise(0).alias("http_status"),
        F.when(opened & (status != 0), F.col("home.url")).alias("final_url"),
        F.when(opened & (status == 0), F.coalesce("home.error", F.lit("no response"))).when(opened & ~F.col("seen"), F.concat(F.lit("homepage returned HTTP "), status)).alias("error"),
        F.when(F.col("gate") == "robots-restricted", F.struct(F.lit(True).alias("challenged"), F.lit("robots").alias("reason"), F.lit("robots-restricted").alias("kind")))
        .when(F.col("seen"), F.col("ctl")).otherwise(F.struct(F.lit(False).alias("challenged"), none.cast("string").alias("reason"), F.lit("none").alias("kind"))).alias("control"),
        F.col("rob").alias("robots"),
        blocked("tier1").alias("tier1_blocked"),
        blocked("tier2").alias("tier2_blocked"),
        if_seen(cloaking("home", "bot"), F.struct(F.lit(False).alias("tested"), F.lit(0).cast("bigint").alias("browser_bytes"), F.lit(0).alias("bot_status"), F.lit(0).cast("bigint").alias("bot_bytes"), F.lit(False).alias("detected"))).alias("cloaking"),
        F.when(llms, F.struct(F.lit(True).alias("present"), file["valid"].alias("spec_valid"), file["issues"].alias("issues"), F.length(_body("llms")).alias("bytes"), file["links"].alias("link_count")))
        .otherwise(F.struct(F.lit(False).alias("present"), F.lit(False).alias("spec_valid"), no_text.alias("issues"), F.lit(0).alias("bytes"), F.lit(0).alias("link_count"))).alias("llms_txt"),
        F.struct(agents_there.alias("present"), F.when(agents_there, F.length(_body("agents"))).otherwise(0).alias("bytes")).alias("agents_md"),
        F.struct(if_seen(F.array_distinct("ld.types"), no_text).alias("json_ld_types"), if_seen(F.exists(lower_types, lambda x: x.isin(*ORGANIZATIONS)), F.lit(False)).alias("has_organization"), if_seen(F.array_contains(lower_types, "website"), F.lit(False)).alias("has_website")).alias("structured"),
        F.struct(
            if_seen(F.nullif(F.trim(first(r"(?is)<title[^>]*>(.{0,300}?)</title>")), F.lit("")), none).alias("title"),
            if_seen(F.nullif(F.split(F.lower(first(r"(?i)<html[^>]+lang=[\"']([a-zA-Z-]{2,12})[\"']")), "-")[0], F.lit("")), none).alias("lang"),
            if_seen(F.col("text_length"), F.lit(0)).cast("bigint").alias("ssr_text_length"),
            if_seen(_tags(h, "h1"), F.lit(0)).alias("h1_count"),
            if_seen(F.array_compact(F.array(*[F.when(h.rlike(rf"(?i)<{t}[\s>]"), F.lit(t)) for t in LANDMARKS])), no_text).alias("landmarks"),
            if_seen(F.size(images), F.lit(0)).alias("images_total"),
            if_seen(F.size(F.filter(images, lambda x: x.rlike(r"(?i)\balt\s*=\s*[\"'][^\"']+[\"']"))), F.lit(0)).alias("images_with_alt"),
            has(r"(?i)<link[^>]+type=[\"']application/(rss|atom)\+xml[\"']").alias("feed"),
            has(r"(?i)<link[^>]+rel=[\"']canonical[\"']").alias("canonical"),
            if_seen(first(r"(?i)<meta[^>]+name=[\"']robots[\"'][^>]+content=[\"']([^\"']+)[\"']").rlike("(?i)noindex") | header("home", "x-robots-tag").rlike("(?i)noindex"), F.lit(False)).alias("meta_noindex"),
        ).alias("content"),
        F.struct(
            F.when(told, F.when(F.col("seen") | ~opened, F.col("directives.license_url"))).alias("license_url"),
            has(r"(?i)<link[^>]+rel=[\"'][^\"']*\blicense\b[^\"']*[\"']").alias("license_link"),
            F.when(told, F.when(F.col("seen") | ~opened, F.col("directives.content_signal"))).alias("content_signal"),
            if_seen(F.nullif(price, F.lit("")), none).alias("crawler_price"),
            card.alias("agent_card"),
            F.when(card, F.length(_body("card"))).otherwise(0).alias("agent_card_bytes"),
            if_seen(F.col("ld.published") | h.rlike(r"(?i)<meta[^>]+property=[\"']article:published_time[\"']|<time[^>]+datetime="), F.lit(False)).alias("date_published"),
            if_seen(F.col("ld.modified") | h.rlike(r"(?i)<meta[^>]+property=[\"']article:modified_time[\"']"), F.lit(False)).alias("date_modified"),
            if_seen(F.col("ld.author") | h.rlike(r"(?i)<meta[^>]+name=[\"']author[\"'][^>]+content=[\"'][^\"']+[\"']|rel=[\"'][^\"']*\bauthor\b[^\"']*[\"']"), F.lit(False)).alias("has_author"),
            *[if_seen(_tags(h, t), F.lit(0)).alias(n) for t, n in (("h2", "h2_count"), ("h3", "h3_count"), ("ul|ol", "list_count"), ("table", "table_count"))],
            if_seen(F.floor(F.coalesce(F.try_divide(F.col("text_length").cast("double") * 10_000, F.length(h)), F.lit(0.0)) + 0.5) / 10_000, F.lit(0.0)).alias("text_ratio"),
            if_seen(F.array_compact(F.array(*[F.when(F.col(c).isNull(), F.lit(path)) for c, path in CHECKS])), no_text).alias("skipped_checks"),
        ).alias("signals"),
        F.struct(
            if_seen(detect.first_match(detect.PLATFORM_RULES, h, F.col("home.headers"), window=None), none).alias("platform"),
            if_seen(detect.first_match(detect.NETWORK_RULES, headers=F.col("home.headers")), none).alias("network"),
            if_seen(F.nullif(F.left(header("home", "server"), F.lit(40)), F.lit("")), none).alias("server"),
        ).alias("stack"),
        F.struct(
            if_seen(header("home", "strict-transport-security") != "", F.lit(False)).alias("hsts"),
            if_seen(header("home", "content-security-policy") != "", F.lit(False)).alias("csp"),
            if_seen(F.lower(header("home", "x-content-type-options")) == "nosniff", F.lit(False)).alias("x_content_type_options"),
        ).alias("security"),
    )
