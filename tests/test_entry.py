"""Registered queries against their SQL on the smallest tables."""

import datetime
import json
import math
import os

import pytest

import __spark_entry__ as entry
from tidemark.plans import registry

SKIP = set(os.environ.get("SKIP_QUERIES", "").split(","))


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else f"{v:.6g}"
    if isinstance(v, (list, tuple)):
        return [plain(x) for x in v]
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    return v


@pytest.fixture(scope="session")
def duck(small):
    import duckdb

    con = duckdb.connect()
    con.execute("set TimeZone='UTC'")
    for f in os.listdir(small):
        con.execute(f"create view {f.split('.')[0]} as select * from '{small}/{f}'")
    return con


@pytest.mark.parametrize("name", sorted(set(entry.oracle_sql()) - SKIP))
def test_equals_sql(spark, small, duck, name):
    df = entry.queries()[name](spark, small)
    cols = sorted(df.columns)
    got = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    cur = duck.execute(entry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(names) == cols
    assert got == sorted(repr([plain(r[names.index(c)]) for c in cols]) for r in cur.fetchall())


def _stats(rows):
    doc = json.loads(rows[0].document)
    assert len(rows) == 1 and doc["snapshot"]["observed"] <= doc["snapshot"]["sites"] and len(doc["suffixes"]) <= 40
    assert [x["observed"] for x in doc["platforms"]] == sorted((x["observed"] for x in doc["platforms"]), reverse=True)
    assert [x["stat_day"] for x in doc["history"]] == sorted({x["stat_day"] for x in doc["history"]})


def _tables(rows):
    paths = {r.path: r for r in rows}
    assert all(r.records <= r.parents <= r.nodes and r.nulls <= r.nodes for r in rows if r.path) and {"obs", "obs.robots", "obs.content", "obs.structured", "domain"} <= set(paths)


def _united(rows):
    for r in rows:
        record, kinds = json.loads(r.record), json.loads(r.kinds)
        assert set(record) == set(kinds)
        of = {"string": str, "number": (int, float), "boolean": bool, "array": list}
        assert all(isinstance(v, of[kinds[k]]) for k, v in record.items())
    assert len({(r.feed, r.file_no, r.line_no) for r in rows}) == len(rows) > 100


def _approximate(rows):
    assert {r.l_returnflag for r in rows} == {"A", "N", "R"} and all(0 < r.parts < 250 and 900 < r.median < 100_000 for r in rows)


#: What must hold of the results of queries that SQL can't say; the subpackage's own are in its tests.
FACTS = {
    "stats_document": _stats,
    "p6_tables": _tables,
    "p5_table": _united,
    "p5_candidates": lambda rows: [r.score > 0 for r in rows if not (0 < r.score <= 1)] == [] and any(r.selected for r in rows) or pytest.fail("scores"),
    "p4_discrimination": lambda rows: all(r.auc is None or 0 <= r.auc <= 1 and -1 <= r.ablation <= 1 for r in rows) and len({r.column_name for r in rows}) == 4 or pytest.fail("parts"),
    "approximate_aggregates": _approximate,
}


def test_every_query_is_checked():
    own = {n for m in registry.modules() for n in m.QUERIES}
    assert own - set(entry.oracle_sql()) == set(FACTS)


@pytest.mark.parametrize("name", sorted(FACTS))
def test_facts(spark, small, name):
    FACTS[name](entry.queries()[name](spark, small).collect())


def test_the_subpackage_is_left_out_only_where_it_is_not_there(monkeypatch):
    if any(m.__name__.startswith("tidemark.llm") for m in entry._modules()):
        import importlib

        real = importlib.import_module
        monkeypatch.setattr(entry.importlib, "import_module", lambda n: (_ for _ in ()).throw(ImportError("broken")) if n.startswith("tidemark.llm") else real(n))
        with pytest.raises(ImportError):
            entry.queries()

    def missing(name):
        raise ModuleNotFoundError(name="tidemark.llm")

    monkeypatch.setattr(entry.importlib.util, "find_spec", missing)
    assert set(entry.queries()) == {n for m in registry.modules() for n in m.QUERIES}


def test_entry(spark):
    assert entry.entry(spark).limit(1).count() == 1


@pytest.mark.parametrize("name", sorted(n for m in registry.modules() for n in m.QUERIES if n[0] == "p" and n[1].isdigit()))
def test_empty_tables_give_nothing(spark, empty, name):
    assert entry.queries()[name](spark, empty).collect() == []
