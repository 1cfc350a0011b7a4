import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from tidemark.operators.joins import size_bytes, sized_join


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("name, operator", [("join_merge", "SortMergeJoin"), ("join_hash", "ShuffledHashJoin"), ("join_sized", "BroadcastHashJoin")])
def test_strategies(spark, small, name, operator):
    assert operator in plan(entry.queries()[name](spark, small))


def test_a_side_of_unknown_or_large_size_is_not_broadcast(spark, small):
    o, c = (spark.read.parquet(f"{small}/{t}.parquet") for t in ("orders", "customer"))
    c = c.withColumnRenamed("c_custkey", "o_custkey")
    assert 0 < size_bytes(c) < 1 << 20
    assert "SortMergeJoin" in plan(sized_join(o, c, ["o_custkey"], limit=100))
    unknown = c.groupBy("o_custkey").applyInPandas(lambda p: p, c.schema)
    assert sized_join(o, unknown, ["o_custkey"], limit=100).count() == o.count()


@pytest.mark.parametrize("name", ["published_union", "carried_forward", "join_theta_bands", "robots_access", "change_events", "failure_runs", "daily_record", "crawl_rows"])
def test_no_nested_loops_over_rows(spark, small, name):
    text = plan(entry.queries()[name](spark, small))
    assert "NestedLoop" not in text and "Cartesian" not in text and "null aware" not in text.lower()


def test_change_events_read_the_rows_once_and_shuffle_them_once(spark, small):
    df = entry.queries()["change_events"](spark, small)
    df.collect()
    final = plan(df).split("== Initial Plan ==")[0]
    assert final.count("FileScan") == 1 and final.count("ReusedExchange") == 1


def test_scored_sites_are_kept_until_the_tables_change(spark, small, tmp_path):
    from tidemark.plans import sites

    for t in ("observations", "domain_rows"):
        spark.read.parquet(f"{small}/{t}.parquet").write.parquet(f"{tmp_path}/{t}.parquet")
    a = sites.scored_sites(spark, str(tmp_path))
    assert sites.scored_sites(spark, str(tmp_path)) is a and a.count() > 100
    spark.read.parquet(f"{small}/observations.parquet").where(F.col("obs_id") % 2 == 0).write.mode("overwrite").parquet(f"{tmp_path}/observations.parquet")
    assert sites.scored_sites(spark, str(tmp_path)) is not a
    b = sites.scored_sites(spark, str(tmp_path))
    sites.reset_sites()
    assert sites.scored_sites(spark, str(tmp_path)) is not b


def joined_rows(df):
    """Rows that come out of the sort merge joins of the plan that ran."""
    found, todo = [], [df._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name = node.getClass().getSimpleName()
        if name == "SortMergeJoinExec":
            found.append(node.metrics().apply("numOutputRows").value())
        if name == "AdaptiveSparkPlanExec":
            todo.append(node.executedPlan())
        elif name.endswith("QueryStageExec"):
            todo.append(node.plan())
        todo += [node.children().apply(i) for i in range(node.children().size())]
    return found


def test_copies_of_a_salted_join_are_not_broadcast(spark, small):
    df = entry.queries()["salted_skew_join"](spark, small)
    df.collect()
    assert "SortMergeJoin" in plan(df) and "Broadcast" not in plan(df)


def test_salted_skew_join_makes_no_pairs_of_a_hot_domain(spark, tmp_path):
    o = spark.range(300).selectExpr("if(id < 200, 'hot', if(id < 290, concat('d', id % 9), null)) as domain", "id as obs_id")
    d = spark.range(120).selectExpr("if(id < 100, 'hot', if(id < 110, 'd1', if(id < 115, 'alone', null))) as domain", "if(id % 10 = 3, null, id) as row_id")
    o.unionByName(o.where("obs_id in (5, 201)")).write.parquet(f"{tmp_path}/observations.parquet")
    d.unionByName(d.where("row_id < 50")).write.parquet(f"{tmp_path}/domain_rows.parquet")
    df = entry.queries()["salted_skew_join"](spark, str(tmp_path))
    # repeated observations count, repeated domain rows don't; the rows without a row_id are one
    ones = spark.read.parquet(f"{tmp_path}/observations.parquet").where("domain = 'd1'").count()
    assert {r.domain: r.n for r in df.collect()} == {"hot": 201 * 91, "d1": ones * 10}
    assert joined_rows(df) == [201 + ones]
