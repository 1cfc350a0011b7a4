import pytest
from pyspark.sql import functions as F
from pyspark.sql import types as T

from tidemark.sources import files, sinks

SCHEMA = T.StructType([T.StructField("domain", T.StringType()), T.StructField("rank", T.LongType())])


def test_lines_tolerate_corruption_and_absence(spark, tmp_path):
    p = tmp_path / "d.jsonl"
    p.write_text('{"domain":"b","rank":2}\n\n{"domain":\n{"domain":"a","rank":null,"more":1}\n')
    assert sorted(map(tuple, files.read_lines(spark, str(p), SCHEMA).collect()), key=str) == [("a", None), ("b", 2)]
    assert files.read_lines(spark, str(tmp_path / "none"), SCHEMA).count() == 0


def test_document_and_ranked_list(spark, tmp_path):
    p = tmp_path / "c.json"
    p.write_text('[{"domain":"a",\n"rank":1},{"domain":"b","rank":2}]')
    assert files.read_document(spark, str(p), SCHEMA).count() == 2
    assert files.read_document(spark, str(tmp_path / "x.json"), SCHEMA, [("z", 9)]).collect()[0].domain == "z"
    q = tmp_path / "r.csv"
    q.write_text("3,c.example\n1, A.Example\n2,cdn.b.example\nx,d\n")
    got = files.read_ranked(spark, str(q), lambda d: ~d.startswith("cdn."), 2).collect()
    assert [(r["rank"], r.domain) for r in got] == [(1, "a.example"), (3, "c.example")]


def test_replace_sorted_log_and_seal(spark, tmp_path):
    df = spark.createDataFrame([("b", 2), ("a", 1)], SCHEMA)
    path = str(tmp_path / "t")
    sinks.replace(df, path)
    sinks.replace(spark.read.parquet(path).where("rank > 1"), path)
    assert spark.read.parquet(path).count() == 1
    sinks.write_sorted_lines(df, str(tmp_path / "s"), "domain", ["rank", "domain"])
    assert [r.value for r in spark.read.text(str(tmp_path / "s")).collect()] == ['{"rank":1,"domain":"a"}', '{"rank":2,"domain":"b"}']
    log = str(tmp_path / "log")
    for i in range(4):
        sinks.append_log(spark.createDataFrame([(f"d{i}", i)], SCHEMA), log, "rank", keep=3)
    assert sorted(r["rank"] for r in spark.read.parquet(log).collect()) == [1, 2, 3]
    month = str(tmp_path / "2026-01.json")
    assert sinks.seal(df, month) and not sinks.seal(df.limit(1), month) and spark.read.json(month).count() == 2
    (tmp_path / "notes.json").write_text("{")
    assert {r.month for r in files.read_sealed(spark, str(tmp_path), SCHEMA).select("month").distinct().collect()} <= {"2026-01", ""}


def test_a_broken_off_replace_loses_no_table(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "t")
    old, new = spark.createDataFrame([("a", 1)], SCHEMA), spark.createDataFrame([("b", 2), ("c", 3)], SCHEMA)
    sinks.replace(old, path)
    real, calls = sinks._rename, []

    def dies(fs, a, b):
        calls.append(1)
        if len(calls) == 2:
            raise KeyboardInterrupt  # the process ends between the two renames
        real(fs, a, b)

    monkeypatch.setattr(sinks, "_rename", dies)
    with pytest.raises(KeyboardInterrupt):
        sinks.replace(new, path)
    monkeypatch.setattr(sinks, "_rename", real)
    sinks.recover(spark, path)
    assert [r.domain for r in spark.read.parquet(path).collect()] == ["a"]
    sinks.replace(new, path)
    assert spark.read.parquet(path).count() == 2 and not (tmp_path / "t.old").exists()


def test_log_is_stored_oldest_first_and_singletons_have_one_row(spark, tmp_path):
    log = str(tmp_path / "log")
    sinks.append_log(spark.createDataFrame([("b", 2), ("a", 1), ("d", 4), ("c", 3)], SCHEMA), log, "rank", keep=3)
    assert [r["rank"] for r in spark.read.parquet(log).collect()] == [2, 3, 4]
    sinks.write_one(spark.createDataFrame([("m", 1)], SCHEMA), str(tmp_path / "meta"))
    assert spark.read.json(str(tmp_path / "meta")).count() == 1
    with pytest.raises(ValueError):
        sinks.write_one(spark.createDataFrame([], SCHEMA), str(tmp_path / "meta"))


def test_a_cluster_without_a_shared_folder_is_an_error():
    from types import SimpleNamespace

    from tidemark.tables import shared_folder

    def session(master, folder):
        conf = SimpleNamespace(get=lambda *a: folder)
        return SimpleNamespace(conf=conf, sparkContext=SimpleNamespace(master=master, getConf=lambda: SimpleNamespace(get=lambda *a: None)))

    assert shared_folder(session("spark://x", "/shared")) == "/shared" and shared_folder(session("local[2]", None)).endswith("tidemark-checkpoints")
    with pytest.raises(RuntimeError):
        shared_folder(session("spark://x", None))


def test_guarded_upsert(spark):
    s = "day int, observed bigint, suspect boolean"
    stored = spark.createDataFrame([(1, 10, False), (2, 10, True), (3, 10, None), (4, 10, False)], s)
    fresh = spark.createDataFrame([(1, 9, False), (2, 9, False), (3, 10, True), (5, 1, False)], s)
    got = {r.day: (r.observed, r.suspect) for r in sinks.guarded_upsert(stored, fresh, ["day"], "observed", "suspect").collect()}
    assert got == {1: (10, False), 2: (9, False), 3: (10, True), 4: (10, False), 5: (1, False)}
    assert {r.day: r.observed for r in sinks.guarded_upsert(stored, fresh, ["day"], "observed", "suspect", force=True).collect()}[1] == 9
    assert sinks.guarded_upsert(stored.limit(0), stored.limit(0), ["day"], "observed", "suspect").count() == 0


def test_as_of_and_range(spark):
    from tidemark.operators.asof import asof_join, count_before

    a = spark.createDataFrame([(i, "k" if i else None, i * 10) for i in range(4)], "id int, k string, at int")
    b = spark.createDataFrame([("k", 5, 1, "x"), ("k", 10, 2, "y"), ("k", 10, 3, "z"), ("k", None, 9, "n")], "k string, at2 int, t int, v string")
    assert {r.id: r.v for r in asof_join(a, b, ["k"], "at", "at2", tie="t", carry=["v"]).collect()} == {0: None, 1: "z", 2: "z", 3: "z"}
    e = spark.range(200).select(F.lit(1).alias("u"), F.col("id").alias("event_id"), (F.col("id") * 7).cast("timestamp").alias("ts"))
    n = {r.event_id: r.n for r in count_before(e, e.select("u", F.col("ts").alias("at")), "event_id", ["u"], "ts", "at", 60).collect()}
    assert n[0] == 0 and n[5] == 5 and n[100] == 8 and len(n) == 200
