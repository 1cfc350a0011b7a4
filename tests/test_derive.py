"""The derive stage, clause by clause, on responses of our own."""

import pytest
from pyspark.sql import functions as F

from tidemark.functions import derive, detect

RES = "struct<status: int, headers: map<string, string>, body: string, url: string, error: string>"
SCHEMA = f"id int, domain string, https boolean, robots {RES}, home {RES}, bot {RES}, llms {RES}, agents {RES}, card {RES}"
REGISTRY = [("A-Bot", 1, 1), ("B-Bot", 1, 2), ("C-Bot", 2, 3), (None, 1, 4)]
PAGE = "<html lang='EN-gb'><title> T </title><h1>x</h1><main>" + "word " * 2000 + "</main></html>"


def res(status=200, body="", headers=None, error=None):
    return (status, headers or {}, body, "https://x/", error)


def observe(spark, *sites):
    base = {"robots": res(404), "home": res(200, PAGE), "bot": res(200, PAGE), "llms": res(404), "agents": res(404), "card": res(404)}
    rows = [(i, "x.example", True, *(base | s).values()) for i, s in enumerate(sites)]
    reg = spark.createDataFrame(REGISTRY, "token string, tier int, registry_order int")
    return derive.observe(spark.createDataFrame(rows, SCHEMA), reg, "Probe").orderBy("id").collect()


@pytest.mark.parametrize(
    "home, kind, reason, reachable",
    [
        (res(402, PAGE), "payment-required", "status 402", True),
        (res(403, "<title>Just a moment"), "bot-challenge", "status 403", True),
        (res(429, ""), "bot-challenge", "status 429", True),
        (res(451, ""), "bot-challenge", "status 451", True),
        (res(200, PAGE, {"cf-mitigated": "challenge"}), "bot-challenge", "mitigated", True),
        (res(200, "<title>Just a moment...</title>"), "bot-challenge", "waiting-title", True),
        (res(200, " " * 20_000 + "px-captcha" + PAGE), "none", None, True),
        (res(200, "<form x><script>f.submit()</script>" + "<b>" * 3000), "bot-challenge", "self-submitting form", True),
        (res(200, "<p>hi</p>"), "unreadable", "stub", True),
        (res(200, "<p>hi</p>" + " " * 5000), "none", None, True),
        (res(404, PAGE), "none", None, False),
        (res(404, "px-captcha"), "bot-challenge", "px-captcha", True),
        (res(503, "<p>hi</p>"), "none", None, False),
        (res(0, "", error="dns"), "none", None, False),
    ],
)
def test_challenges_in_order_and_reachability(spark, home, kind, reason, reachable):
    o = observe(spark, {"home": home})[0]
    assert (o.control.kind, o.control.reason, o.reachable) == (kind, reason, reachable)
    if not reachable:
        assert o.error == ("dns" if home[0] == 0 else f"homepage returned HTTP {home[0]}") and o.stack.platform is None and o.content.ssr_text_length == 0


def test_robots_gates(spark):
    deny = "User-agent: {}\nDisallow: /\nLicense: l\nContent-Signal: a=b # c"
    out, all_, none, named, page = observe(
        spark, {"robots": res(200, deny.format("probe"))}, {"robots": res(200, deny.format("*"))}, {"robots": res(200, "")},
        {"robots": res(200, deny.format("b-bot") + "\nUser-agent: *\nDisallow: /\nAllow: /\nSitemap: s\nCrawl-delay: 2.5")}, {"robots": res(200, "<html>" + deny.format("*"))},
    )
    assert out.opted_out and out.reachable and out.tier1_blocked == [] and out.signals.license_url is None and out.http_status == 0
    assert not all_.opted_out and all_.control.kind == "robots-restricted" and all_.tier1_blocked == ["A-Bot", "B-Bot"] and all_.tier2_blocked == ["C-Bot"]
    assert all_.robots.blocks_all_crawlers and (all_.signals.license_url, all_.signals.content_signal) == ("l", "a=b") and all_.content.title is None
    assert not none.robots.present and none.control.kind == "none" and none.tier1_blocked == []
    assert named.tier1_blocked == ["B-Bot"] and named.robots.named_tokens == ["B-Bot"] and not named.robots.blocks_all_crawlers and named.robots.crawl_delay == 2.5 and named.robots.sitemap_declared
    assert not page.robots.present and page.tier1_blocked == []


def test_cloaking_and_files(spark):
    thin, refused, untested, files = observe(
        spark, {"bot": res(200, PAGE[: len(PAGE) // 5])}, {"bot": res(503, PAGE)}, {"bot": res(0)},
        {"llms": res(200, "# t\n> s\n## x\n - [a](b)"), "agents": res(200, "{}"), "card": res(200, " [1] "), "home": res(200, PAGE, {"crawler-price": "", "x-robots-tag": "NoIndex"}), "bot": res(200, PAGE, {"crawler-price": "1"})},
    )
    assert thin.cloaking.detected and refused.cloaking.detected and not untested.cloaking.detected and not untested.cloaking.tested
    assert files.llms_txt.spec_valid and files.llms_txt.link_count == 1 and not files.agents_md.present and files.signals.agent_card and files.signals.crawler_price == "1" and files.content.meta_noindex
    skipped = observe(spark, {"llms": None, "agents": None, "card": None})[0]
    assert skipped.signals.skipped_checks == ["/llms.txt", "/agents.md", "/.well-known/agent-card.json"] and not skipped.llms_txt.present
    assert files.signals.skipped_checks == [] and (files.content.lang, files.content.title) == ("en", "T")


def test_linked_data(spark):
    def types(*blocks):
        html = "".join(f"<script type='application/ld+json'>{b}</script>" for b in blocks)
        return spark.range(1).select(derive.linked_data(F.lit(html)).alias("d")).first().d

    d = types('{"@graph": [{"@type": ["A", "B"]}, {"creator": []}]}', "{bad", '[{"@type": "C", "sub": {"@type": "D"}}, 5]', "null")
    assert sorted(d.types) == ["A", "B", "C"] and not d.author
    assert types('{"author": {"name": "x"}, "dateModified": "y"}').author and types('{"datePublished": "y"}').published and not types("").published


def test_every_rule_names_its_system_and_no_two_share_an_id(spark):
    rules = (*detect.PLATFORM_RULES, *detect.NETWORK_RULES)
    assert len({r.id for r in rules}) == len(rules) == 46 and len(detect.CHALLENGE_RULES) == 17
    heads = [(r.id, {r.header: "vegur" if r.header == "via" else r.label if r.value is None else r.value.removeprefix("(?i)").lstrip("^(").split("|")[0]}) for r in detect.NETWORK_RULES]
    df = spark.createDataFrame(heads, "id string, h map<string,string>")
    assert [r[0] for r in df.select(detect.first_match(detect.NETWORK_RULES, headers=F.col("h"))).collect()] == [i for i, _ in heads]
    prose = "We moved from WordPress to Next.js and like Shopify, Wix, Drupal and Cloudflare."
    assert spark.range(1).select(detect.first_match(rules, F.lit(prose), F.create_map(F.lit("server"), F.lit("nginx")))).first()[0] is None
    assert {r.id: r.label for r in detect.labels(spark).collect()}["next"] == "Next.js"


def test_nulls_and_empty(spark):
    assert observe(spark)[:] == []
    o = observe(spark, {"robots": None, "home": None, "bot": None, "llms": None, "agents": None, "card": None}, {"home": (200, None, None, None, None)})
    assert not o[0].reachable and o[0].error == "no response" and o[1].control.kind == "unreadable"


def test_skipped_checks_are_left_out_of_the_score(spark):
    from tidemark.functions import scoring

    def totals(*sites):
        reg = spark.createDataFrame(REGISTRY, "token string, tier int, registry_order int")
        base = {"robots": res(404), "home": res(200, PAGE), "bot": res(200, PAGE), "llms": res(404), "agents": res(404), "card": res(404)}
        o = derive.observe(spark.createDataFrame([(i, "x", True, *(base | x).values()) for i, x in enumerate(sites)], SCHEMA), reg, "Probe")
        rows = spark.sql(f"with primed as (select *, {scoring.PRELUDE} from {{o}}), lined as (select *, {scoring.line_columns(True)} from primed), banded as (select *, {scoring.band_columns()} from lined) select max_surface, {scoring.TOTAL} as total, {scoring.PARTIAL} as partial from banded order by id", o=o).collect()
        return [tuple(r) for r in rows]

    none, llms, all_three, dated = totals({}, {"llms": None}, {"llms": None, "agents": None, "card": None}, {"home": res(200, PAGE + '<meta property="article:modified_time" content="x">')})
    assert none[0] == 25 and not none[2] and llms[0] == 16 and llms[2] and llms[1] > none[1] and all_three[0] == 11 and dated[1] > none[1]
