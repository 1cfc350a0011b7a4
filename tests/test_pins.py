"""Pinned answers: facets, percentiles, bands, changes, the crawl's outcome, worked out by hand."""

from datetime import datetime

import pytest
from pyspark.sql import Row
from pyspark.sql import functions as F

from tidemark.functions import scoring
from tidemark.functions.normal import is_indexable, normal_host, valid_host
from tidemark.plans import batch, reference, sites

FACET = "http_status int, control struct<kind: string>, robots struct<present: boolean, blocks_all_crawlers: boolean, named_tokens: array<string>>, n_blocked int, roles string, blocked_assistants int"


@pytest.mark.parametrize(
    "row, want",
    [
        ((200, Row("payment-required"), Row(True, False, []), 0, None, 0), "metered"),
        ((402, Row("none"), Row(True, False, []), 0, None, 0), "open"),  # the status alone sells nothing
        ((402, None, Row(False, False, []), 3, "training", 0), "undeclared"),
        ((200, Row("none"), Row(True, False, []), 11, "assistant|search|training", 3), "walled"),
        ((200, Row("none"), Row(True, False, []), 5, "training", 0), "no-training"),
        ((200, Row("none"), Row(True, False, []), 5, "search|training", 0), "assistant-only"),
        ((200, Row("none"), Row(True, False, []), 5, "assistant", 1), "selective"),
        ((200, Row("none"), Row(True, False, []), 1, "unknown", 0), "assistant-only"),
    ],
)
def test_archetypes(spark, row, want):
    e = scoring.archetype("roles", "blocked_assistants", "3")
    assert spark.createDataFrame([row], FACET).selectExpr(f"{e} as a").first().a == want


def test_bands_and_grades_cover_every_score(spark):
    rows = spark.range(101).selectExpr("cast(id as int) as total").selectExpr("total", "least(9, cast(floor(total / 10) as int)) as band", f"{scoring.grade('total')} as grade").collect()
    assert [r.band for r in rows] == [min(9, i // 10) for i in range(101)]
    assert [r.grade for r in rows] == ["F"] * 40 + ["D"] * 20 + ["C"] * 15 + ["B"] * 15 + ["A"] * 11
    table = {r.band: (r.least, r.greatest, r.slug) for r in batch.QUERIES["band_table"](spark, "").collect()}
    assert table[9] == (90, 100, "90-100") and table[0] == (0, 9, "0-9") and len(table) == 10


def observations(spark, tmp_path, rows, ranked=()):
    """Tables of a few observations in the test tables' schema: (obs_id, domain, at, change of the base row)."""
    base = spark.read.parquet("/root/testdata/sf0.001/observations.parquet").where("reachable and not coalesce(opted_out, false) and signals is not null").limit(1)
    out = None
    for obs_id, domain, at, change in rows:
        sets = {"obs_id": F.lit(obs_id).cast("bigint"), "domain": F.lit(domain), "observed_at": F.lit(at).cast("timestamp"), "ingested_at": F.lit(at).cast("timestamp"), "opted_out": F.lit(False)}
        one = base.withColumns(sets | {k: F.expr(v).cast(base.schema[k].dataType) for k, v in change.items()})
        out = one if out is None else out.unionByName(one)
    out.coalesce(1).write.parquet(f"{tmp_path}/observations.parquet")
    d = spark.read.parquet("/root/testdata/sf0.001/domain_rows.parquet")
    d.limit(1).withColumn("domain", F.explode(F.array(*[F.lit(x) for x in ranked or ["none.example"]]))).write.parquet(f"{tmp_path}/domain_rows.parquet")
    spark.read.parquet("/root/testdata/sf0.001/agent_registry.parquet").write.parquet(f"{tmp_path}/agent_registry.parquet")
    return str(tmp_path)


BLOCK, OPEN = {"tier1_blocked": "array('LumioBot')"}, {"tier1_blocked": "array()"}


def test_changes_only_between_equal_probes_and_vantages(spark, tmp_path):
    v = lambda p, w: {"probe_version": f"'{p}'", "vantage": f"'{w}'"}
    d = observations(spark, tmp_path, [
        (1, "a.example", "2026-01-01", OPEN | v("2", "x")), (2, " WWW.a.example. ", "2026-01-05", BLOCK | v("2", "x")), (3, "a.example", "2026-01-09", OPEN | v("3", "x")), (4, "a.example", "2026-01-10", BLOCK | v("3", "y")),
        (5, "a.example", "2026-01-11", BLOCK | v("3", "y")), (6, "b.example", "2026-01-01", OPEN | v("2", "x")), (7, "b.example", "2026-01-02", OPEN | v("2", "x") | {"reachable": "false"}), (8, "c.example", "2026-01-02", BLOCK | v("2", "x")),
    ])
    got = sorted((r.site, r.observed_at.day, r.kind, r.newly_blocked, r.newly_allowed) for r in sites.change_events(spark, d).where("kind <> 'score'").collect())
    assert got == [("a.example", 5, "access", "lumiobot", ""), ("b.example", 2, "reachability", "", "")]
    moved = [r.delta for r in sites.change_events(spark, d).where("kind = 'score' and site = 'a.example'").collect()]
    assert all(abs(x) >= 3 for x in moved)


def test_one_crawl(spark, tmp_path):
    down = {"reachable": "false"}
    d = observations(spark, tmp_path, [
        (1, "kept.example", "2026-02-27", {}), (2, "new.example", "2026-03-01", {}), (3, "gone.example", "2026-02-27", {}), (4, "fails.example", "2026-02-26", down), (5, "fails.example", "2026-02-27", down), (6, "fails.example", "2026-03-01", down),
        (7, "out.example", "2026-03-01", {"opted_out": "true"}), (8, "wasout.example", "2026-02-01", {"opted_out": "true"}), (9, "later.example", "2026-03-02", {}), (10, "once.example", "2026-03-01", down),
    ], ranked=["kept.example", "fails.example", "wasout.example"])
    got = {r.site: (r.outcome, r.failures) for r in batch.crawl_rows(spark, d).collect()}
    assert got == {"kept.example": ("carried", 0), "new.example": ("published", 0), "gone.example": ("dropped", 0), "fails.example": ("demoted", 3), "out.example": ("opted-out", 0), "wasout.example": ("excluded", 0), "once.example": ("published", 1)}
    run = batch.crawl_run(spark, d).first()
    assert (run.total_domains, run.crawled, run.carried, run.partial, run.observed) == (3, 2, 1, True, 2)
    assert batch.crawl_run(spark, d, force=True).first().suspect is False


def test_latest_row_stands_and_scores_agree(spark, tmp_path):
    d = observations(spark, tmp_path, [(1, "a.example", "2026-01-01", BLOCK), (2, "A.example", "2026-01-02", OPEN), (3, "www.a.example", "2026-01-02", OPEN)])
    rows = sites.scored_sites(spark, d).collect()
    assert len(rows) == 1 and rows[0].obs_id == 3 and rows[0].n_blocked == 0
    assert reference.QUERIES["score_totals"](spark, d).first().total == rows[0].total


def test_percentiles(spark, tmp_path):
    d = observations(spark, tmp_path, [(i, f"s{i}.example", "2026-01-01", OPEN) for i in range(4)])
    got = reference.QUERIES["percentile_midpoint"](spark, d).collect()
    assert len(got) == 4 and len({r.total for r in got}) == 1
    assert {r.percentile for r in got} <= {50, None}


def test_hosts(spark):
    df = spark.createDataFrame([(" HTTPS://WWW.A.example.:8080/x?y#z",), ("a.example.",), ("ftp+x://b.c.d.example/",), ("cdn.x.example",), ("a_b.example",), ("one",), (None,), ("ns1.x.example",)], "h string")
    rows = df.select(normal_host(F.col("h")).alias("h")).select("h", valid_host(F.col("h")).alias("ok"), is_indexable(F.col("h")).alias("in_"), is_indexable(F.col("h"), F.lit(True)).alias("pinned")).collect()
    assert [r.h for r in rows] == ["a.example", "a.example", "b.c.d.example", "cdn.x.example", "a_b.example", "one", None, "ns1.x.example"]
    assert [r.in_ for r in rows] == [True, True, False, False, False, False, False, False] and [r.pinned for r in rows] == [True, True, True, True, False, False, False, True]


def test_parameters_make_queries(spark, small):
    from tidemark.plans.sqlkit import literal, query

    one = query(reference.site_lookup("no.such.site").replace(reference.FULL, "with scored as (select * from @scored_sites)"), views=sites.VIEWS)
    assert one(spark, small).count() == 0
    assert "9 >= 2" not in reference.search_sites("a") and "1 >= 2" in reference.search_sites(" A ")
    with pytest.raises(ValueError):
        literal("a\\b")
    assert literal("o'x") == "'o''x'" and datetime(2026, 1, 1).year == 2026
