"""Rules pinned by small fixtures: scores, robots rules, run health, domains, detection."""

from datetime import date

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import detect, robots, scoring
from tidemark.functions.normal import normal_domain, token_set
from tidemark.operators import run_health
from tidemark.plans import pipelines

TIER1 = [f"t{i}" for i in range(11)]
OBS = """reachable boolean, http_status int, control struct<challenged: boolean>, robots struct<present: boolean, blocks_all_crawlers: boolean, sitemap_declared: boolean, named_tokens: array<string>>,
  tier1_blocked array<string>, tier2_blocked array<string>, cloaking struct<tested: boolean, browser_bytes: bigint, bot_status: int, detected: boolean>, llms_txt struct<present: boolean, spec_valid: boolean>, agents_md struct<present: boolean>,
  structured struct<json_ld_types: array<string>, has_organization: boolean, has_website: boolean>, content struct<ssr_text_length: bigint, h1_count: int, landmarks: array<string>>,
  signals struct<license_url: string, license_link: boolean, content_signal: string, agent_card: boolean, date_published: boolean, has_author: boolean>"""


def site(**kw):
    base = dict(
        reachable=True, http_status=200, control=Row(challenged=False), robots=Row(present=True, blocks_all_crawlers=False, sitemap_declared=True, named_tokens=[]), tier1_blocked=[], tier2_blocked=[],
        cloaking=Row(tested=True, browser_bytes=50_000, bot_status=200, detected=False), llms_txt=Row(present=True, spec_valid=True), agents_md=Row(present=True), structured=Row(json_ld_types=["Organization", "WebSite", "FAQPage"], has_organization=True, has_website=True),
        content=Row(ssr_text_length=4000, h1_count=1, landmarks=["main", "nav", "footer"]), signals=Row(license_url="x", license_link=True, content_signal="search=yes", agent_card=True, date_published=True, has_author=True),
    )
    return tuple((base | kw).values())


def score(spark, *sites):
    df = spark.createDataFrame(list(sites), OBS).selectExpr("*", "1 as one")
    df.createOrReplaceTempView("obs_under_test")
    rows = spark.sql(f"with primed as (select *, {scoring.PRELUDE} from obs_under_test), lined as (select *, {scoring.line_columns()} from primed), banded as (select *, {scoring.band_columns()} from lined) select {scoring.TOTAL} as total, {scoring.PARTIAL} as partial, {scoring.STUB} as stub, earned_access from banded").collect()
    return rows


def test_rubric_sums_to_100():
    assert sum(x[2] for x in scoring.LINES) == 100 and len(scoring.LINES) == 18
    assert [sum(x[2] for x in scoring.LINES if x[1] == b) for b in range(3)] == [45, 25, 30]


@pytest.mark.parametrize(
    "change, total, partial",
    [
        ({}, 100, False),
        ({"tier1_blocked": TIER1}, 70, False),
        ({"tier2_blocked": [f"u{i}" for i in range(12)]}, 92, False),
        ({"cloaking": Row(tested=True, browser_bytes=50_000, bot_status=200, detected=True)}, 93, False),
        ({"cloaking": Row(tested=False, browser_bytes=50_000, bot_status=0, detected=False)}, 100, True),
        ({"llms_txt": Row(present=True, spec_valid=False)}, 97, False),
        ({"llms_txt": Row(present=False, spec_valid=False)}, 91, False),
        ({"control": Row(challenged=True)}, 100, True),
        ({"reachable": False}, None, False),
        ({"content": Row(ssr_text_length=200, h1_count=1, landmarks=["main", "nav", "footer"])}, 97, False),
        ({"content": Row(ssr_text_length=20, h1_count=1, landmarks=["main", "nav", "footer"])}, 93, False),
        ({"signals": None}, 100, False),
    ],
)
def test_score_anchors(spark, change, total, partial):
    r = score(spark, site(**change))[0]
    assert (r.total, r.partial) == (total, partial)


def test_challenged_and_all_blocked(spark):
    r = score(spark, site(control=Row(challenged=True), tier1_blocked=TIER1, tier2_blocked=[f"u{i}" for i in range(12)], robots=Row(present=True, blocks_all_crawlers=False, sitemap_declared=False, named_tokens=[])))[0]
    assert r.total == 14


def test_stubs(spark):
    cases = [((2167, 0, 503), True), ((3781, 151, 503), True), ((2036, 129, 200), False), ((362692, 22, 200), False), ((900000, 300, 503), False), ((0, 0, 0), False)]
    rows = score(spark, *[site(cloaking=Row(tested=True, browser_bytes=b, bot_status=s, detected=False), content=Row(ssr_text_length=t, h1_count=1, landmarks=[])) for (b, t, s), _ in cases])
    assert [r.stub for r in rows] == [w for _, w in cases]


def verdict(spark, text, token="OrvexBot", path="/"):
    d = spark.createDataFrame([(1, text)], "id int, text string")
    t = spark.createDataFrame([(token,), (None,)], "token string")
    return {r.token: r.allowed for r in robots.access(robots.rule_groups(robots.rule_lines(d, "id", "text")), t, d.withColumnRenamed("id", "doc_id"), path).collect()}.get(token)


@pytest.mark.parametrize(
    "text, path, allowed",
    [
        ("User-agent: *\nDisallow: /", "/", False),
        ("User-agent: *\nDisallow:", "/", True),
        ("User-agent: *\nDisallow: /\nUser-agent: orvexbot\nDisallow: /x", "/", True),
        ("User-agent: a\nUser-agent: OrvexBot # c\nDisallow: /p\nAllow: /p/q", "/p/q/r", True),
        ("User-agent: OrvexBot\nDisallow: /p\nAllow: /p", "/p", True),
        ("User-agent: OrvexBot\nDisallow: /p*", "/pq", False),
        ("User-agent: OrvexBot\nAllow: /\n\nUser-agent: OrvexBot\nDisallow: /", "/", True),
        ("User-agent: a\nSitemap: x\nUser-agent: OrvexBot\nDisallow: /", "/", False),
        ("User-agent: a\n# note\n\nUser-agent: OrvexBot\nDisallow: /", "/", False),
        ("Disallow: /\nUser-agent: OrvexBot\r\nDisallow: /x\r\n", "/", True),
        ("", "/", True),
        ("Disallow: /\n# no group", "/", True),
    ],
)
def test_robots_rules(spark, text, path, allowed):
    assert verdict(spark, text, path=path) is allowed


def days(*xs):
    return [("f", date(2026, 1, i + 1), 3700, o, m, 5000, 3650, c) for i, (o, m, c) in enumerate(xs)]


def judge(spark, *xs):
    df = spark.createDataFrame(days(*xs), "feed string, day date, total_domains bigint, observed bigint, mean_score double, attempted bigint, succeeded bigint, score_changes bigint")
    return [(r.suspect, r.baseline_moved) for r in run_health.reassess(df).orderBy("day").collect()]


def test_run_health(spark):
    assert judge(spark, (3600, 64.5, 682)) == [(True, False)] and judge(spark, (3600, 64.5, 120)) == [(False, False)]
    assert judge(spark, (3600, 68.88, 0), (3600, 63.25, 0), (3600, 63.13, 0), (3600, 63.0, 0)) == [(False, False), (True, False), (False, True), (False, False)]
    assert judge(spark, (3600, 64.5, 0), (0, None, 0), (0, None, 0)) == [(False, False), (True, False), (True, False)]
    assert judge(spark, (3600, 64.0, 0), (3600, 69.0, 0)) == [(False, False)] * 2
    assert judge(spark, (3600, 64.0, 0), (4320, 64.0, 0)) == [(False, False)] * 2 and judge(spark, (3600, 64.0, 0), (4321, 64.0, 0))[1] == (True, False)


def test_normal_forms(spark):
    df = spark.createDataFrame([(" WWW.A.Example. ", ["B", "a", None, "b"]), (None, None), ("", [])], "d string, t array<string>")
    rows = df.select(normal_domain(F.col("d")).alias("d"), token_set(F.col("t")).alias("t")).collect()
    assert [r.d for r in rows] == ["a.example", None, ""] and [r.t for r in rows] == [["a", "b"], None, []]


def test_first_match_reads_the_whole_body(spark):
    df = spark.range(1).select(F.concat(F.repeat(F.lit("x"), 300_000), F.lit("/wp-content/")).alias("body"))
    assert df.select(detect.first_match(detect.PLATFORM_RULES, F.col("body"), window=None)).first()[0] == "wordpress"


def test_platform_detection_reads_long_documents(spark, small, tmp_path):
    docs = spark.read.parquet(f"{small}/documents.parquet").where("text is not null")
    docs.withColumn("text", F.concat(F.repeat(F.lit("x"), 300_000), F.lit("/wp-content/"))).limit(2).write.parquet(f"{tmp_path}/documents.parquet")
    assert [r.platform for r in pipelines.platform_detection(spark, str(tmp_path)).collect()] == ["wordpress"] * 2


def test_first_match(spark):
    df = spark.createDataFrame([("<a href='/WP-content/x'>/_next/static/", {}), ("x" * 250_001 + "/_nuxt/", {}), ("", {"x-drupal-cache": "HIT"}), (None, None)], "body string, h map<string,string>")
    assert [r[0] for r in df.select(detect.first_match(detect.PLATFORM_RULES, F.col("body"), F.col("h"))).collect()] == ["wordpress", None, "drupal", None]
