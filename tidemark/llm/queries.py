"""Queries of the problems tagged llm (1, 2, 8, 9, 10), with their SQL where SQL can express them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from tidemark.functions.normal import plain_label
from tidemark.llm import bpe, mixing, req_sketch, spans
from tidemark.llm.top_groups import top_n
from tidemark.tables import checkpoint, spread, table

TOP = 5
MIN_VALUES = 25
COHORT = ["vantage", "network", "platform"]


def _standing_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per domain and vantage the row of latest scored_at, then highest row_id, if it is rankable."""
    d = table(spark, sf_dir, "domain_rows")
    last = d.groupBy("domain", "vantage").agg(
        F.max(F.struct("scored_at", "row_id", F.col("score.total").alias("total"), F.col("score.partial").alias("partial"), "site_rank", "network", "platform", "tld")).alias("r")
    )
    return last.select("vantage", "domain", "r.*").where("total is not null and not coalesce(partial, false)")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The five best sites of every cohort within its vantage."""
    keys = {"network": F.col("network"), "platform": F.col("platform"), "tld": F.col("tld"), "combined": F.concat(F.col("network"), F.lit("|"), F.col("platform"), F.lit("|"), F.col("tld"))}
    kinds = F.explode(F.array(*[F.struct(F.lit(k).alias("cohort_kind"), c.alias("cohort_key")) for k, c in keys.items()]))
    rows = _standing_scores(spark, sf_dir).select("vantage", kinds.alias("k"), "total", "site_rank", "domain").select("vantage", "k.*", "total", "site_rank", "domain").where("cohort_key is not null")
    best = top_n(rows, ["vantage", "cohort_kind", "cohort_key"], [("total", True), ("site_rank", False), ("domain", False)], TOP)
    return best.select("vantage", "cohort_kind", "cohort_key", "pos", "domain")


P1_SQL = f"""
with one as (select *, score.total as total, coalesce(score.partial, false) as partial from domain_rows
  qualify row_number() over (partition by domain, vantage order by scored_at desc nulls last, row_id desc) = 1),
ok as (select * from one where total is not null and not partial),
k as (
  select vantage, 'network' as cohort_kind, network as cohort_key, total, site_rank, domain from ok
  union all select vantage, 'platform', platform, total, site_rank, domain from ok
  union all select vantage, 'tld', tld, total, site_rank, domain from ok
  union all select vantage, 'combined', network || '|' || platform || '|' || tld, total, site_rank, domain from ok)
select vantage, cohort_kind, cohort_key, cast(pos as integer) as pos, domain from (
  select *, row_number() over (partition by vantage, cohort_kind, cohort_key order by total desc, site_rank asc nulls last, domain asc) as pos
  from k where cohort_key is not null) where pos <= {TOP}
"""


def _text_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "observations").select(
        "obs_id", "vantage", F.col("stack.network").alias("network"), F.col("stack.platform").alias("platform"), F.to_date("observed_at").alias("day"), F.col("content.ssr_text_length").alias("value")
    )
    return o.where("value >= 0 and vantage is not null and network is not null and platform is not null").dropDuplicates(["obs_id"])


def _percentile_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "domain_rows").select("row_id", *COHORT, F.to_date("scored_at").alias("day"), F.col("percentile").alias("value"))
    return d.where("value is not null and not isnan(value) and vantage is not null and network is not null and platform is not null").dropDuplicates(["row_id"])


def _measured(spark: SparkSession, sf_dir: str, *more: str) -> DataFrame:
    cols = [*COHORT, *more, "value"]
    text = _text_values(spark, sf_dir).select(F.lit("text").alias("kind"), *[F.col(c).cast("double") if c == "value" else F.col(c) for c in cols])
    return text.unionAll(_percentile_values(spark, sf_dir).select(F.lit("percentile").alias("kind"), *cols))


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cohorts whose median or 90th percentile is out of line, read from merged sketches."""
    parts = req_sketch.build_sketches(_measured(spark, sf_dir), ["kind", *COHORT], "value")
    whole = req_sketch.merge_sketches(parts, ["kind", *COHORT]).where(F.col("n") >= MIN_VALUES)
    q = whole.select("kind", *COHORT, req_sketch.quantiles(whole, [0.5, 0.9]).alias("q"))
    found = F.array_compact(
        F.array(
            F.when((F.col("kind") == "text") & (F.col("q")[0] < 500), F.lit("text_p50")),
            F.when((F.col("kind") == "text") & (F.col("q")[1] > 12000), F.lit("text_p90")),
            F.when((F.col("kind") == "percentile") & (F.col("q")[0] < 40), F.lit("percentile_p50")),
        )
    )
    return q.select(*COHORT, F.explode(found).alias("measure"))


P2_SQL = f"""
with o as (select distinct on (obs_id) vantage, stack.network as network, stack.platform as platform, content.ssr_text_length as v from observations
  where content.ssr_text_length >= 0 and vantage is not null and stack.network is not null and stack.platform is not null),
d as (select distinct on (row_id) vantage, network, platform, percentile as v from domain_rows
  where percentile is not null and vantage is not null and network is not null and platform is not null),
t as (select vantage, network, platform, quantile_disc(v, 0.5) as p50, quantile_disc(v, 0.9) as p90 from o group by all having count(*) >= {MIN_VALUES}),
p as (select vantage, network, platform, quantile_disc(v, 0.5) as p50 from d group by all having count(*) >= {MIN_VALUES})
select vantage, network, platform, 'text_p50' as measure from t where p50 < 500
union all select vantage, network, platform, 'text_p90' from t where p90 > 12000
union all select vantage, network, platform, 'percentile_p50' from p where p50 < 40
"""


def p2_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Percentiles from sketches kept by day, combined over all days, each with the error bound of its rank (a share of n)."""
    parts = req_sketch.build_sketches(_measured(spark, sf_dir, "day"), ["kind", *COHORT, "day"], "value")
    days = req_sketch.merge_sketches(parts, ["kind", *COHORT, "day"]).withColumn("part", F.datediff("day", F.lit("1970-01-01")))
    whole = req_sketch.merge_sketches(days, ["kind", *COHORT])
    q = whole.select("kind", *COHORT, "n", req_sketch.quantiles(whole, [0.5, 0.9, 0.99]).alias("q"), req_sketch.quantile_errors(whole, [0.5, 0.9, 0.99]).alias("e"))
    return q.select("kind", *COHORT, "n", *[F.col(c)[i].alias(f"p{x}{name}") for i, x in enumerate((50, 90, 99)) for c, name in (("q", ""), ("e", "_error"))])


def p8_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids of every document."""
    return spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", bpe.encode(F.col("text")).alias("ids"))


def p8_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Per document the number of ids and pieces, and whether the ids give the text back."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "text", bpe.encode_with_offsets(F.col("text")).alias("e"))
    return d.select("doc_id", F.size("e.ids").alias("n_ids"), F.size("e.piece_at").alias("n_pieces"), (bpe.decode(F.col("e.ids")) == F.coalesce("text", F.lit(""))).alias("same"))


def p10_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pairs of documents with an identical run of at least 200 code points."""
    return spans.shared_pairs(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")


def p10_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same, linear in the texts: which document is in which class of documents that hold one run; two with a run in common share a class."""
    c = spans.shared_classes(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text")
    return c.select(F.col("doc").alias("doc_id"), F.concat(*[F.lpad(F.hex(k), 16, "0") for k in ("k1", "k2")]).alias("class_id"))


def p10_amount(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How much of each document is held elsewhere."""
    return spans.shared_amount(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def p10_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shared spans themselves: which document holds which span, where, and how long it is."""
    return spans.shared_spans(spread(table(spark, sf_dir, "documents").select("doc_id", "text")), "doc_id", "text").withColumnRenamed("doc", "doc_id")


def _sized_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id``, ``source`` (normalised), ``tokens`` of every document that has a source; repeated rows once."""
    d = spread(table(spark, sf_dir, "documents").select("doc_id", plain_label(F.col("source")).alias("source"), "text").where("source is not null"))
    return d.select("doc_id", "source", bpe.count_tokens(F.col("text")).alias("tokens")).distinct()


def _sizes(docs: DataFrame) -> DataFrame:
    return docs.groupBy("source").agg(F.sum("tokens").alias("available"))


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Targets that cannot be met without repeating a source beyond its cap."""
    plan = mixing.plan_mix(_sizes(_sized_documents(spark, sf_dir)), table(spark, sf_dir, "mix_targets"))
    return plan.where("over_cap").select("mix_id", "source")


def p9_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The mixes: which documents each takes, and how often."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = checkpoint(_sized_documents(spark, sf_dir))
    return mixing.realise(docs, checkpoint(mixing.plan_mix(_sizes(docs), targets)))


def p9_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target, planned and actual share of every source in every mix, with the repetitions made."""
    targets = table(spark, sf_dir, "mix_targets")
    docs = checkpoint(_sized_documents(spark, sf_dir))
    plan = checkpoint(mixing.plan_mix(_sizes(docs), targets))
    got = mixing.realise(docs, plan).groupBy("mix_id", "source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("actual"), F.max("repeats").alias("repeats"))
    rows = plan.join(got.withColumnRenamed("source", "label"), ["mix_id", "label"], "left")
    total = Window.partitionBy("mix_id")
    share = lambda c: F.coalesce(F.try_divide(F.col(c), F.sum(c).over(total)), F.lit(0.0))
    return rows.withColumn("actual", F.coalesce("actual", F.lit(0))).select(
        "mix_id", "source", share("wanted").alias("target_share"), share("planned").alias("planned_share"), share("actual").alias("actual_share"), "wanted", "planned", "actual", F.coalesce("repeats", F.lit(0)).alias("repeats"), "max_repeats", "exponent"
    )


def p9_entropy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mixes whose shares are the sources' sizes to the power at which they are as even as the mix's weights."""
    plan = mixing.plan_mix(_sizes(_sized_documents(spark, sf_dir)), table(spark, sf_dir, "mix_targets"), by_entropy=True)
    return plan.select("mix_id", "source", "wanted", "over_cap", "exponent", "planned")


QUERIES = {
    "p1_found": p1_found, "p2_found": p2_found, "p2_days": p2_days, "p8_ids": p8_ids, "p8_round_trip": p8_round_trip, "p9_found": p9_found, "p9_mix": p9_mix, "p9_shares": p9_shares, "p9_entropy": p9_entropy,
    "p10_found": p10_found, "p10_classes": p10_classes, "p10_amount": p10_amount, "p10_spans": p10_spans,
}
ORACLE = {"p1_found": P1_SQL, "p2_found": P2_SQL}
