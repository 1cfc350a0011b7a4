import numpy as np

from tidemark.llm.mixing import beyond_limit, entropy, exponent_for_entropy, plan_mix, plan_shares, realise, tempered

TARGETS = "mix_id string, source string, weight double, max_repeats int, budget_tokens bigint, label string, planned int"


def setup(spark, targets, docs):
    d = spark.createDataFrame([(i, s, t) for i, (s, t) in enumerate(docs)], "doc_id bigint, source string, tokens bigint")
    sizes = d.groupBy("source").sum("tokens").withColumnRenamed("sum(tokens)", "available")
    t = spark.createDataFrame([(*x, "l", 1) for x in targets], TARGETS)
    plan = plan_mix(sizes, t)
    return d, t, plan


DOCS = [("a", 1 + i % 50) for i in range(400)] + [("b", 10)] * 100 + [("c", 0)] * 5


def test_feasible_mix_keeps_its_targets_and_budget(spark):
    d, t, plan = setup(spark, [("m", " A ", 3.0, 4, 3000), ("m", "b", 1.0, 1, 3000)], DOCS)
    p = {r.label: r for r in plan.collect()}
    assert p["a"].exponent == 0 and (p["a"].planned, p["b"].planned) == (2250, 750) and not p["a"].over_cap
    got = realise(d, plan).collect()
    used = {s: sum(r.tokens * r.repeats for r in got if r.source == s) for s in "ab"}
    assert 2250 - 50 < used["a"] <= 2250 and 750 - 10 < used["b"] <= 750
    assert max(r.repeats for r in got) == 1 and len({r.doc_id for r in got}) == len(got)


def test_passes_and_caps(spark):
    d, t, plan = setup(spark, [("m", "b", 1.0, 3, 2500)], DOCS)
    got = realise(d, plan).collect()
    assert sum(r.tokens * r.repeats for r in got) == 2500 and {r.repeats for r in got} == {2, 3} and len(got) == 100


def test_over_cap_is_flagged_and_tempered(spark):
    d, t, plan = setup(spark, [("m", "a", 1.0, 4, 6000), ("m", "b", 1.0, 2, 6000), ("z", "none", 1.0, 9, 10), ("z", "a", 0.0, 1, 10)], DOCS)
    p = {(r.mix_id, r.label): r for r in plan.collect()}
    assert p["m", "b"].over_cap and not p["m", "a"].over_cap and 0 < p["m", "b"].exponent < 1
    assert p["m", "b"].planned <= 2000 and p["m", "b"].planned >= 1998 and p["m", "a"].planned + p["m", "b"].planned >= 5998
    assert p["z", "none"].over_cap and not p["z", "a"].over_cap and p["z", "none"].planned == 0
    got = realise(d, plan).collect()
    assert all(r.repeats <= 4 for r in got) and all(r.tokens > 0 for r in got)


def test_nulls_repeats_and_empty(spark):
    rows = [("m", "a", 1.0, 1, 100), ("m", "a", 1.0, 1, 100), ("m", None, 1.0, 1, 100), ("m", "b", None, None, None)]
    d, t, plan = setup(spark, rows, DOCS)
    p = sorted(plan.collect(), key=str)
    assert len(p) == 3 and {r.source: r.wanted for r in p}["a"] == 50
    d, t, plan = setup(spark, [], DOCS)
    assert plan.count() == 0 and realise(d, plan).count() == 0
    d, t, plan = setup(spark, rows[:1], [])
    assert [r.over_cap for r in plan.collect()] == [True] and realise(d, plan).count() == 0


def test_shares_and_entropy():
    t, planned = plan_shares([1, 1], [100, 1000], [1, 1], 10_000)
    assert t == 1.0 and planned.tolist() == [100, 1000]
    sizes = [1, 10, 100]
    a = exponent_for_entropy(sizes, 0.9)
    w = np.array(sizes, float) ** a
    w /= w.sum()
    assert abs(-(w * np.log(w)).sum() - 0.9) < 1e-6


def test_caps_that_differ_leave_their_rest_to_sources_with_room():
    # natural shares exceed the third limit, targets the first
    t, planned = plan_shares([8, 1, 1], [100, 1000, 1000], [1, 1, 0.1], 1000)
    assert np.allclose(planned, [100, 800, 100])
    # sources that are not full keep the ratio of their targets
    t, planned = plan_shares([6, 3, 1], [10, 10_000, 10_000], [5, 1, 0.024], 1000)
    assert t == 0 and np.allclose(planned, [50, 712.5, 237.5])
    # a weight of 0 or a source without tokens gets nothing, however much is left over
    t, planned = plan_shares([1, 1, 0, 1], [100, 500, 9000, 0], [1, 2, 9, 9], 10_000)
    assert planned.tolist() == [100, 1000, 0, 0]


def test_budget_is_filled_within_the_caps_whenever_they_allow_it():
    r = np.random.default_rng(5)
    for _ in range(500):
        n = r.integers(1, 8)
        w, a, c = r.exponential(1, n) ** 2, r.integers(0, 1000, n), r.integers(0, 7, n)
        w[r.random(n) < 0.2] = 0
        budget = float(r.integers(1, 4000))
        _, planned = plan_shares(w, a, c, budget)
        limit = np.where(w > 0, c * a, 0)
        assert (planned <= limit + 1e-6).all()
        assert abs(planned.sum() - min(budget, limit.sum())) < 1e-6 * budget
        assert (planned >= 0).all()


def test_an_exponent_within_fits_though_natural_shares_do_not():
    w, a, c, budget = [0.7, 0.2, 0.1], [100, 100, 9800], [4, 9, 0.05], 1000
    t, planned = plan_shares(w, a, c, budget)
    limit = np.multiply(a, c)
    fits = [x for x in np.linspace(0, 1, 2001) if (tempered(np.array(w), np.array(a) / 10_000, x) * budget <= limit).all()]
    assert fits and 0 < fits[0] < 1 and abs(t - fits[0]) < 1e-3 and abs(planned.sum() - budget) < 1e-6


def test_shares_at_exponent_0_are_the_targets_and_flag_what_exceeds_its_cap():
    target, natural = np.array([0.5, 0.3, 0.2]), np.array([0.9, 0.1, 0.0])
    assert tempered(target, natural, 0).tolist() == target.tolist()
    assert beyond_limit(target, natural, np.array([50.0, 30.0, 0.0]), 100, 0.0).tolist() == [False, False, True]
    assert beyond_limit(target, natural, np.array([50.0, 29.9, 0.0]), 100, 0.0).tolist() == [False, True, True]


def test_mix_by_entropy(spark):
    d, t, _ = setup(spark, [("m", "a", 3.0, 9, 1000), ("m", "b", 1.0, 9, 1000), ("m", "none", 2.0, 9, 1000), ("z", "a", 0.0, 1, 10)], DOCS)
    sizes = d.groupBy("source").sum("tokens").withColumnRenamed("sum(tokens)", "available")
    p = {(r.mix_id, r.label): r for r in plan_mix(sizes, t, by_entropy=True).collect()}
    share = np.array([p["m", "a"].wanted, p["m", "b"].wanted]) / 1000
    assert abs(share.sum() - 1) < 1e-9 and share[0] > share[1] and p["m", "none"].wanted == 0 == p["z", "a"].wanted
    assert abs(entropy(share) - entropy(np.array([0.75, 0.25]))) < 1e-6
