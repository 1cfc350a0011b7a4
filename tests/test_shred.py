import json

import pytest

from pyspark.sql import functions as F

from tidemark.operators.shred import _read_deep, parent_label, read_json, shred, table_of, write_json

ARRAYS = ["obs", "obs.g", "obs.g.a", "obs.t"]


def nodes(spark, raws, **kw):
    df = spark.createDataFrame([(i, r, "x") for i, r in enumerate(raws)], "id bigint, raw string, record_id string")
    return shred(df, "id", "raw", arrays=ARRAYS, texts=["obs"], **kw)


def leaves(spark, raws):
    return sorted((r.record_id, tuple(r.label), r.value) for r in nodes(spark, raws, paths=["obs.g.a"]).where("element and kind <> 'null'").collect())


def test_every_shape_has_labels_of_one_depth(spark):
    inner = {"t": [], "g": [None, {"a": ["x", None, 1.50]}]}
    shapes = [{"obs": inner}, {"obs": [inner]}, {"obs": json.dumps(inner)}, {"obs": json.dumps([inner])}]
    got = leaves(spark, [json.dumps(x) for x in shapes])
    for i in range(4):
        assert [(label, v) for r, label, v in got if r == i] == [((0, 0, 1, 1, 0, 0), "x"), ((0, 0, 1, 1, 0, 2), "1.5")]
    assert leaves(spark, ['{"obs": {"g": {"a": "s"}}}']) == [(0, (0, 0, 0, 0, 0, 0), "s")]
    assert leaves(spark, ['{"obs": {"g": {"a": [1.50, true, {"z": [1]}, ["q"]]}}}']) == [
        (0, (0, 0, 0, 0, 0, 0), "1.50"), (0, (0, 0, 0, 0, 0, 1), "true"), (0, (0, 0, 0, 0, 0, 2), '{"z":[1]}'), (0, (0, 0, 0, 0, 0, 3), '["q"]')
    ]


def test_unreadable_null_empty_and_deep_texts(spark):
    bad = [None, "", "  ", "{", "5", '"x"', "null", '{"obs": NaN}', "[" * 100_000, '{"obs": null}', '{"obs": "not json"}', '{"obs": {"g": null}}', '{"obs": [null, 3]}']
    assert leaves(spark, bad) == []
    assert leaves(spark, []) == []
    big = json.dumps({"obs": {"g": [{"a": [str(i) for i in range(20_000)]}]}})
    assert len(leaves(spark, [big])) == 20_000


def test_repeated_rows_count_once(spark):
    df = spark.createDataFrame([(1, '{"obs": {"g": {"a": "s"}}}')] * 3, "id bigint, raw string")
    assert shred(df, "id", "raw", arrays=ARRAYS, paths=["obs.g.a"]).where("element").count() == 1


def test_parents_by_truncation(spark):
    n = nodes(spark, ['{"obs": [{"g": [{"a": ["x"]}, {"a": ["y", "z"]}]}]}'])
    a, g = table_of(n, "obs.g.a").where("kind = 'string'"), table_of(n, "obs.g").where("kind = 'object'")
    up = a.withColumn("owner", parent_label(F.col("parent")))
    joined = up.join(g.select(F.col("label").alias("owner"), "record_id"), ["record_id", "owner"])
    assert joined.count() == 3
    assert sorted(tuple(r.owner) for r in joined.collect()) == [(0, 0, 0, 0), (0, 0, 0, 1), (0, 0, 0, 1)]


@pytest.mark.parametrize("depth", [1_200, 20_000, 100_000])
def test_no_depth_is_dropped(spark, depth):
    inner = "[" * depth + "1.50" + "]" * depth
    objects = '{"x":' * depth + "7" + "}" * depth
    raws = [f'{{"obs": {{"g": {{"a": ["s", {inner}, {objects}]}}}}}}', f'{{"deep": {inner}, "obs": {{"g": {{"a": "t"}}}}}}', json.dumps({"obs": f'{{"g": {{"a": [{inner}]}}}}'})]
    got = leaves(spark, raws)
    assert [(r, label[-1], len(v)) for r, label, v in got] == [(0, 0, 1), (0, 1, 2 * depth + 3), (0, 2, 6 * depth + 1), (1, 0, 1), (2, 0, 2 * depth + 3)]


def test_all_paths_of_a_deep_record(spark):
    n = nodes(spark, ["[" * 1_500 + "]" * 1_500 + " "])
    assert n.count() == 1_500 and n.where("size(label) = 1499").count() == 1


def test_deep_reader_reads_what_the_plain_one_does():
    good = ['{"a": [1, -2.50e+3, true, false, null, "\\u00e9\\n"], "b": {}, "c": [], "a": 2}', " [ ] ", '"x"', "0", "[[],[{}]]", '{"":{"":[]}}']
    for raw in good:
        assert _read_deep(raw) == read_json(raw) and json.loads(write_json(read_json(raw))) == json.loads(raw)
    for raw in ["", " ", "[1,]", "{,}", '{"a":1,}', "[1 2]", "[1", '{"a"}', "{1:2}", "01", "1.", "nul", "[1]]", '"a', "NaN", "-Infinity", "[}", '{"a":1]', '"\n"', "+1", "tru"]:
        for read in (_read_deep, read_json):
            with pytest.raises(ValueError):
                read(raw)


def test_a_wide_record_is_put_out_in_parts(spark):
    raw = json.dumps({"obs": {"g": [{"a": ["v" * 30] * 50}]}})
    assert shred(spark.createDataFrame([(1, raw), (2, raw)], "id bigint, raw string").coalesce(1), "id", "raw", arrays=ARRAYS, paths=["obs.g.a"], flush=100).where("element").groupBy("record_id").count().where("count = 50").count() == 2
