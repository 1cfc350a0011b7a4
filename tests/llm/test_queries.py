"""What must hold of the results of queries that SQL can't say."""

import pytest

import __spark_entry__ as entry
from tidemark.llm import queries


def _days(rows):
    assert len({(r.kind, r.vantage, r.network, r.platform) for r in rows}) == len(rows) > 20
    for r in rows:
        assert r.p50 <= r.p90 <= r.p99 and 0 <= r.p99_error <= r.p90_error <= r.p50_error < 0.05


def _trips(rows):
    assert all(r.same for r in rows) and len(rows) >= 100 and all(r.n_pieces <= r.n_ids for r in rows) and any(r.n_ids == 0 for r in rows)


def _shares(rows):
    for mix in {r.mix_id for r in rows}:
        own = [r for r in rows if r.mix_id == mix]
        assert abs(sum(r.target_share for r in own) - 1) < 1e-6 and all(r.repeats <= r.max_repeats and r.actual <= r.planned for r in own)
        total = sum(r.planned for r in own)
        assert total == 0 or all(abs(r.planned_share - r.planned / total) < 1e-9 for r in own)


def _mix(rows):
    assert all(r.repeats >= 1 and r.tokens > 0 for r in rows) and len({(r.mix_id, r.source, r.doc_id) for r in rows}) == len(rows)


def _entropy(rows):
    for mix in {r.mix_id for r in rows}:
        own = [r for r in rows if r.mix_id == mix]
        assert all(r.wanted >= 0 and r.planned >= 0 for r in own)


def _pairs(rows):
    assert all(r.doc_id_a < r.doc_id_b for r in rows) and len(set(rows)) == len(rows) > 0


def _amount(rows):
    assert all(0 <= r.shared_chars <= r.chars and 0 <= r.share <= 1 for r in rows) and any(r.shared_chars >= 200 for r in rows)


def _spans(rows):
    ids = {}
    for r in rows:
        assert r.length >= 200 and r.stretch_start <= r.start and r.start + r.length <= r.stretch_start + r.stretch_length
        ids.setdefault(r.span_id, set()).add(r.doc_id)
    assert all(len(d) >= 2 for d in ids.values())


def _ids(rows):
    assert len({r.doc_id for r in rows}) == len(rows) and all(isinstance(r.ids, list) for r in rows) and max(max(r.ids, default=0) for r in rows) < 50_500


FACTS = {
    "p2_days": _days, "p8_ids": _ids, "p8_round_trip": _trips, "p9_shares": _shares, "p9_mix": _mix, "p9_entropy": _entropy, "p9_found": lambda rows: len(set(rows)) == len(rows) > 0 or pytest.fail("flags"),
    "p10_found": _pairs, "p10_amount": _amount, "p10_spans": _spans, "p10_classes": lambda rows: len(set(rows)) == len(rows) > 0 or pytest.fail("classes"),
}


def test_every_query_is_checked():
    assert set(queries.QUERIES) - set(queries.ORACLE) == set(FACTS)


@pytest.mark.parametrize("name", sorted(FACTS))
def test_facts(spark, small, name):
    FACTS[name](entry.queries()[name](spark, small).collect())


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_empty_tables_give_nothing(spark, empty, name):
    assert entry.queries()[name](spark, empty).collect() == []
