import random

import pytest

from tidemark.llm.spans import MIN_RUN, shared_amount, shared_pairs, shared_spans

SCHEMA = "id bigint, body string, doc bigint, edge string"


def frame(spark, docs):
    return spark.createDataFrame([(i, t, 1, "e") for i, t in docs], SCHEMA).repartition(3)


def brute(docs):
    held = {}
    for i, t in docs:
        for j in range(len(t or "") - MIN_RUN + 1):
            if i is not None:
                held.setdefault(t[j : j + MIN_RUN], set()).add(i)
    pairs = {(a, b) for s in held.values() for a in s for b in s if a < b}
    return pairs, {k for k, s in held.items() if len(s) > 1}


def check(spark, docs):
    df = frame(spark, docs)
    pairs, rep = brute(docs)
    assert {tuple(r) for r in shared_pairs(df, "id", "body").collect()} == pairs
    got = {r.doc: r.shared_chars for r in shared_amount(df, "id", "body").collect()}
    for i, t in docs:
        covered, last = 0, 0
        for j in range(len(t or "") - MIN_RUN + 1):
            if t[j : j + MIN_RUN] in rep:
                covered += j + MIN_RUN - max(last, j)
                last = j + MIN_RUN
        if i is not None:
            assert got[i] == covered, i
    return pairs


def text(r, n, alphabet="abcdefghij klmno"):
    return "".join(r.choice(alphabet) for _ in range(n))


@pytest.mark.parametrize("seed", range(3))
def test_planted_runs_at_and_below_the_limit(spark, seed):
    r = random.Random(seed)
    docs, want = [], set()
    for k in range(12):
        n = r.choice([199, 200, 201, 250, 600])
        run = text(r, n, r.choice(["ab", "日本語の文書😀", "abcdefghij klmno"]))
        docs += [(10 * k, text(r, r.randint(0, 300)) + "<" + run + ">" + text(r, 20)), (10 * k + 1, text(r, r.randint(0, 300)) + "[" + run + "]" + text(r, r.randint(0, 90)))]
        if n >= 200:
            want.add((10 * k, 10 * k + 1))
    assert check(spark, docs) >= want


def test_branching_overlaps_and_copies(spark):
    r = random.Random(9)
    a, b, c = text(r, 260), text(r, 150), text(r, 260)
    docs = [(1, a + b + c), (2, a + b), (3, b + c), (4, a), (5, b), (6, a + b + c), (7, c + a), (8, text(r, 50) + b + text(r, 60)), (9, text(r, 40) + b + text(r, 90))]
    assert len(check(spark, docs)) > 10


def test_periodic_and_constant_texts(spark):
    docs = [(1, "a" * 1000), (2, "b" + "a" * 200 + "c"), (3, "d" + "a" * 199 + "e"), (4, "ab" * 400), (5, "x" + "ba" * 100), (6, "lorem ipsum dolor " * 60), (7, "ipsum dolor lorem " * 30), (8, " " * 500)]
    check(spark, docs)


def test_nulls_empty_short_repeated_rows(spark):
    t = "".join(chr(97 + (i * i) % 23) for i in range(300))
    docs = [(1, t), (1, t), (2, None), (3, ""), (4, t[:199]), (5, t[50:250]), (None, t)]
    assert check(spark, docs) == {(1, 5)}
    assert shared_pairs(frame(spark, []), "id", "body").count() == 0


def test_one_very_long_text(spark):
    r = random.Random(3)
    long = text(r, 1_200_000)
    df = frame(spark, [(1, long), (2, long[700_000:700_200]), (3, long[5:204])])
    assert {tuple(x) for x in shared_pairs(df, "id", "body").collect()} == {(1, 2)}


def test_short_limit_is_refused(spark):
    with pytest.raises(ValueError):
        shared_pairs(frame(spark, []), "id", "body", 100)


def spans_of(spark, docs):
    """Spans against brute force: each shared window in one span of its document, each span at every place of its text."""
    texts = dict(docs)
    _, rep = brute(docs)
    held = {(i, j) for i, t in docs for j in range(len(t) - MIN_RUN + 1) if t[j : j + MIN_RUN] in rep}
    rows = shared_spans(frame(spark, docs), "id", "body").collect()
    windows = [(r.doc, j) for r in rows for j in range(r.start, r.start + r.length - MIN_RUN + 1)]
    assert len(windows) == len(set(windows)) and set(windows) == held
    by_id = {}
    for r in rows:
        by_id.setdefault(r.span_id, set()).add((r.doc, r.start, texts[r.doc][r.start : r.start + r.length]))
        lo, hi = r.stretch_start, r.stretch_start + r.stretch_length
        assert lo <= r.start and r.start + r.length <= hi and all((r.doc, j) in held for j in range(lo, hi - MIN_RUN + 1))
        assert (r.doc, lo - 1) not in held and (r.doc, hi - MIN_RUN + 1) not in held
    for places in by_id.values():
        (t,) = {x for _, _, x in places}
        assert {(i, j) for i, j, _ in places} == {(i, j) for i, body in docs for j in range(len(body)) if body.startswith(t, j)}
        assert len({i for i, _, _ in places}) > 1
    return rows


def test_spans_give_their_places(spark):
    r = random.Random(11)
    x, y = text(r, 420), text(r, 230)
    docs = [(1, "<" + x + ">" + text(r, 50)), (2, text(r, 90) + "[" + x + "]"), (3, "(" + y + ")" + text(r, 300) + "{" + x + "}"), (4, y)]
    rows = spans_of(spark, docs)
    assert sorted((q.doc, q.start, q.length) for q in rows) == [(1, 1, 420), (2, 91, 420), (3, 1, 230), (3, 533, 420), (4, 0, 230)]
    assert len({q.span_id for q in rows}) == 2


def test_spans_of_branching_and_periodic_texts(spark):
    r = random.Random(9)
    a, b, c = text(r, 260), text(r, 150), text(r, 260)
    spans_of(spark, [(1, a + b + c), (2, a + b), (3, b + c), (4, a), (5, b), (6, a + b + c), (7, c + a), (8, text(r, 50) + b), (9, a + "|" + a + c)])
    spans_of(spark, [(1, "a" * 1000), (2, "b" + "a" * 200 + "c"), (4, "ab" * 400), (5, "x" + "ba" * 110), (6, "lorem ipsum dolor " * 60), (7, "ipsum dolor lorem " * 30)])
    x = text(r, 700)
    rows = spans_of(spark, [(1, x), (2, x), (3, "<" + x[200:500] + ">")])
    assert {(q.doc, q.stretch_start, q.stretch_length) for q in rows} == {(1, 0, 700), (2, 0, 700), (3, 1, 300)}
    assert shared_spans(frame(spark, []), "id", "body").count() == 0


@pytest.mark.parametrize("length, found", [(200, True), (199, False)])
def test_runs_at_the_ends_of_texts(spark, length, found):
    """A run of just the limit at the start, at the end or as all of a text, so that an edge in it has text on one side only."""
    import random

    r = random.Random(11)
    noise = lambda n: "".join(r.choice("abcdefghij klmnop") for _ in range(n))
    docs, want = [], set()
    for i in range(40):
        run = noise(length)
        forms = [run + "#" + noise(300), noise(300) + "#" + run, noise(250) + "#" + run + "#" + noise(9)]
        forms = forms[:2] if length == 199 else [*forms, run]
        ids = [10 * i + k for k in range(len(forms))]
        docs += zip(ids, forms)
        want |= {(a, b) for a in ids for b in ids if a < b}
    got = {(x.doc_id_a, x.doc_id_b) for x in shared_pairs(spark.createDataFrame(docs, "doc_id bigint, text string"), "doc_id", "text").collect()}
    assert got == (want if found else set())
