"""Cases of the third round's findings."""

import random
import tracemalloc

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from docquarry.operators import layout, records, retrieval
from docquarry.plans import records as record_plans


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_states_move_no_answers(spark, small):
    plan = _plan(record_plans.query_log_states(spark, small))
    join = plan[plan.index("Join") :]
    # The answer is made below the join, and only what is asked of it goes up.
    assert "chars" in join and plan.index("length(") > plan.index("Join")
    started = spark.createDataFrame([(1,), (2,), (3,)], "query_id int")
    ended = spark.createDataFrame([(1, "a" * 6000, None), (2, None, "late")], "query_id int, answer string, error string")
    whole = {r.query_id: r for r in records.query_states(started, ended).collect()}
    views = {r.query_id: r for r in records.query_states(started, ended, {"chars": F.length("answer")}).collect()}
    assert {k: (r.status, r.answer and len(r.answer)) for k, r in whole.items()} == {k: (r.status, r.chars) for k, r in views.items()} == {1: ("completed", 5000), 2: ("failed", 11), 3: ("running", None)}


@pytest.mark.parametrize("n", [1, 2, 4])
def test_nearest_against_all_pairs(spark, n):
    r = random.Random(n)
    place = lambda: r.choice([None, *(x / 2 for x in range(-60, 60))])
    left = [(r.choice(["p", "q", None]), k, place()) for k in range(80)] + [("p", 5, 1.0), ("p", 5, 1.0), ("q", None, 0.0)]
    right = [(r.choice(["p", "q", "z", None]), r.randrange(40), place()) for k in range(120)] + [("p", k, 1.0) for k in (7, 3, 7)]
    a, b = spark.createDataFrame(left, "page string, a bigint, y double"), spark.createDataFrame(right, "page string, b bigint, y double")
    made = layout.nearest(a, b, ["page"], "y", 4.0, n, "a", "b")
    want = []
    for page, one in {(p, k) for p, k, y in left if p is not None}:
        pairs = sorted((abs(y - z), other) for p, k, y in left for q, other, z in right if (p, k) == (page, one) and q == p and None not in (y, z) and abs(y - z) <= 4.0)
        want += [(page, one, other, away, nth) for nth, (away, other) in enumerate(pairs[:n], 1)]
    assert sorted(map(repr, map(tuple, made.collect()))) == sorted(map(repr, want)) and made.columns == ["page", "a", "b", "distance", "nth"]
    # Right rows never meet left rows in a join, whose rows would grow with the square of a page's.
    assert "Join" not in _plan(made)


def _embedded(r, n, name):
    return pa.table({name: pa.array(range(n)), "embedding": pa.array(list(r.integers(-2, 3, (n, 8)).astype(float)), pa.list_(pa.float64())), "client": [f"c{k % 3}" for k in range(n)]})


def test_a_batch_of_vectors_makes_no_large_matrix(monkeypatch):
    r = np.random.default_rng(3)
    asked, held = _embedded(r, 2000, "qid"), _embedded(r, 8000, "node_id")
    tracemalloc.start()
    best = retrieval._Best(asked, 5, ["client"], None)
    best.add(held)
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    # All scores at once are 128 MB, and sorting them takes several times that.
    assert peak < 100e6
    monkeypatch.setattr(retrieval, "SCORE_CELLS", 10_000)
    again = retrieval._Best(asked, 5, ["client"], None)
    again.add(held)
    assert again.found().equals(best.found())
    a, b = (retrieval._unit(t.column("embedding")) for t in (asked, held))
    score = np.round(a[:40] @ b.T, 6) + 0.0
    score[np.arange(40)[:, None] % 3 != np.arange(8000) % 3] = -np.inf
    want = [n for row in score for n in np.lexsort((np.arange(8000), -row))[:5]]
    assert best.found().column("node_id").to_pylist()[:200] == want


def test_slices_of_scores_change_nothing(monkeypatch):
    r = random.Random(11)
    words = [f"w{k}" for k in range(12)]
    lists = lambda n, most: pa.array([r.choices(words, k=r.randint(0, most)) for _ in range(n)], pa.list_(pa.string()))
    asked, held = lists(9, 3), lists(70, 30)
    postings = retrieval._Postings(pa.table({"qid": pa.array(range(9)), "terms": asked}))
    row, term, times, _ = postings.counts(held)
    want = {(d, q): float(sum(held[d].as_py().count(w) for w in asked[q].as_py())) for d in range(70) for q in range(9) if set(held[d].as_py()) & set(asked[q].as_py())}
    for cells in (1, 50, 1 << 20):
        monkeypatch.setattr(retrieval, "SCORE_CELLS", cells)
        best, got = retrieval._Firsts(3, 9, False), {}
        for at, question, score in postings.scores(row, term, times.astype(float), 70):
            got |= dict(zip(zip(at.tolist(), question.tolist()), score.tolist()))
            best.add(question, np.zeros(len(at), np.int64), score, at)
        assert got == want
        best.prune()
        firsts = [(q, d) for q in range(9) for d in sorted((d for d, p in want if p == q), key=lambda d: (-want[d, q], d))[:3]]
        assert list(zip(best.rows[0].tolist(), best.rows[3].tolist())) == firsts


@pytest.mark.parametrize("overlap, group", [(False, None), (False, "client_id"), (True, None), (True, "client_id")])
def test_sparse_lists_against_joins(spark, overlap, group):
    r = random.Random(7)
    text = lambda n: r.choice([None, "", "?!"]) if r.random() < 0.05 else " ".join(r.choices(["Rent", "lease", "cap-rate", "noi", "2024", "q3", "the", "İ", "of"] + [f"w{k}" for k in range(60)], k=n))
    chunks = spark.createDataFrame([(k, text(r.randint(1, 40)), r.choice(["a", "b", None])) for k in range(300)], "node_id bigint, text string, client_id string").repartition(5)
    asked = spark.createDataFrame([(k, text(r.randint(1, 6))) for k in range(25)] + [(3, "lease of w1 w1"), (None, "noi"), (90, "zzz")], "qid bigint, question string")
    made = retrieval.sparse_topk(asked, chunks, 4, group, overlap)
    joined = retrieval.sparse_topk(asked, chunks, 4, group, overlap, query_block=1)
    # Pairs of questions and chunks aren't rows any more; they are where questions are more than a block.
    assert "Join" not in _plan(made) and "Join" in _plan(joined)
    got, want = (sorted(map(repr, map(tuple, rows.collect()))) for rows in (made, joined))
    assert len(want) > 50 and got == want and made.columns == joined.columns
    for a, b in ((asked.where("false"), chunks), (asked, chunks.where("false")), (asked.where("qid = 90"), chunks)):
        assert retrieval.sparse_topk(a, b, 4, group, overlap).count() == 0
