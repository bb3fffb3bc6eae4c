"""Literal cases of conflicts, states, searches in blocks, regions, keys and deletions."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from docquarry.functions import intents
from docquarry.operators import answers, evaluation, facts, metadata, records, regions, retrieval
from docquarry.streaming import jobs


def _conflicts(spark, question, *nodes):
    rows = [(1, place, question, text, document, name, label, group, page) for place, (text, document, name, label, group, page) in enumerate(nodes, 1)]
    schema = "qid int, place bigint, question string, text string, document_id string, document_name string, version_label string, version_group string, page_num int"
    return facts.detect_conflicts(spark.createDataFrame(rows, schema)).orderBy("conflict_no").collect()


def test_conflicts_within_a_family(spark):
    newer = ("Portfolio occupancy rate was 95% in the latest quarter.", "doc-v2", "Operations v2", "v2", "ops_policy", None)
    older = ("Portfolio occupancy rate was 91% in the previous quarter.", "doc-v1", "Operations v1", "v1", "ops_policy", None)
    (found,) = _conflicts(spark, "What changed across versions?", newer, older)
    assert (found.left_value, found.right_value, found.unit) == ("95%", "91%", "percent")


def test_conflicts_across_documents_only_when_asked(spark):
    a = ("Demand growth in suburban markets was 12% this year.", "doc-a", "Market Outlook A", "current", "market_outlook_a", None)
    b = ("Demand growth in suburban markets was 7% this year.", "doc-b", "Market Outlook B", "current", "market_outlook_b", None)
    (found,) = _conflicts(spark, "Are there conflicting data points across documents?", a, b)
    assert {found.left_value, found.right_value} == {"12%", "7%"}
    assert _conflicts(spark, "What is the demand growth?", a, b) == []


def test_no_conflict_within_one_document_and_version(spark):
    one = ("Revenue reached $100 million in Q1.", "doc-single", "Single Source", "v2", "single_group", None)
    two = ("Revenue reached $120 million in Q2.", "doc-single", "Single Source", "v2", "single_group", None)
    assert _conflicts(spark, "Find conflicts", one, two) == []


def test_conflicts_are_three_at_most_and_told_once(spark):
    nodes = [(f"Portfolio occupancy rate was {80 + k}% in the latest quarter.", f"doc-{k}", f"Report {k}", f"v{k}", "g", k) for k in range(5)]
    assert len(_conflicts(spark, "any?", *nodes)) == 3
    twice = [nodes[0], nodes[1], nodes[1]]
    assert len(_conflicts(spark, "any?", *twice)) == 1


def test_facts_of_texts_without_figures(spark):
    rows = spark.createDataFrame([(1, None), (2, ""), (3, "no figure here"), (4, "1 2 3 4 5 6 7 8 9 10 11 12 13 14 15 axis"), (5, "rent and yield grew to 65 percent")], "node_id int, text string")
    assert [(r.node_id, r.raw, r.value) for r in facts.facts(rows).collect()] == [(5, "65 percent", 65.0)]


@pytest.mark.parametrize("query_block, vector_block", [(1000, 1000), (7, 20), (1, 5)])
def test_dense_search_in_blocks(spark, query_block, vector_block):
    r = np.random.default_rng(5)
    made = [(i, [float(x) for x in r.normal(size=6)], i % 3, i % 2) for i in range(90)] + [(90, None, 0, 0), (91, [0.0] * 6, 1, 1)]
    vectors = spark.createDataFrame(made, "node_id bigint, embedding array<double>, client int, session int").repartition(3)
    queries = vectors.where("node_id % 9 = 0").withColumnRenamed("node_id", "qid")
    got = {}
    for x in retrieval.dense_topk(queries, vectors, 4, ("client",), "session", query_block, vector_block).collect():
        got.setdefault(x.qid, []).append((x.rank, x.node_id, x.score))
    for q, e, client, session in made:
        if q % 9 or e is None:
            continue
        unit = lambda v: np.array(v) / max(np.linalg.norm(v), 1e-300)
        scored = sorted((-round(float(unit(e) @ unit(v)), 6) + 0.0, n) for n, v, c, s in made if v is not None and c == client and s != session)[:4]
        assert [(n, s) for _, n, s in sorted(got[q])] == [(n, -s + 0.0) for s, n in scored]
    assert retrieval.dense_topk(queries.where("false"), vectors, 4).count() == 0


def test_states_never_go_back(spark):
    rows = [(1, "2024-01-01 00:00:00", 7, "purchase"), (2, "2024-01-01 01:00:00", 7, "click"), (3, "2024-01-01 00:00:00", 8, "click"), (4, "2024-01-01 00:00:01", 8, "view")]
    made = spark.createDataFrame(rows, "event_id bigint, ts string, user_id bigint, event_type string").withColumn("ts", F.to_timestamp_ntz("ts"))
    assert {r.document_id: (r.status, r.events) for r in jobs.latest_states(made).collect()} == {7: ("completed", 2), 8: ("running", 2)}


def test_queue_is_bounded(spark):
    waiting = spark.createDataFrame([(1, "queued"), (2, "running"), (3, "queued")], "document_id int, status string")
    new = spark.createDataFrame([(4,)], "document_id int")
    assert [tuple(r) for r in jobs.enqueue(new, waiting, 3).collect()] == [(4, "queued")]
    with pytest.raises(jobs.QueueFull):
        jobs.enqueue(new, waiting, 2)
    assert [r.document_id for r in jobs.retryable(waiting.withColumn("status", F.lit("failed")), new.withColumn("document_id", F.lit(3))).collect()] == [3]


def test_suppression_by_overlap(spark):
    r = random.Random(2)
    boxes = [(p, i, x := r.randrange(30) * 1.0, y := r.randrange(30) * 1.0, x + r.choice([1, 10, 11]), y + r.choice([0.5, 10, 10.5])) for p in range(6) for i in range(25)]
    got = {(b.page, b.box_id) for b in regions.suppressed(spark.createDataFrame(boxes, "page int, box_id int, x0 double, y0 double, x1 double, y1 double")).collect()}
    want = set()
    for p in range(6):
        kept = []
        for _, i, a, b, c, d in (x for x in boxes if x[0] == p):
            area = (c - a) * (d - b)
            over = lambda k: max(min(c, k[2]) - max(a, k[0]), 0) * max(min(d, k[3]) - max(b, k[1]), 0)  # noqa: B023, E731
            if area > 1 and all(over(k) / (area + (k[2] - k[0]) * (k[3] - k[1]) - over(k)) <= 0.8 for k in kept):
                kept.append((a, b, c, d))
                want.add((p, i))
    assert got == want


def test_keys_round_trip_and_refuse(spark):
    rows = [("a", "1", "n é /+", None, ""), ("b", None, "x" * 300, "p", "v")]
    made = spark.createDataFrame(rows, "client_id string, document_id string, document_name string, parser_name string, parser_version string")
    key = metadata.encode_key(**{c: F.col(c) for c in made.columns})
    back = made.select(key.alias("k"), *made.columns).select("k", metadata.decode_key(F.col("k")).alias("m"), *made.columns)
    for r in back.collect():
        assert tuple(r.m) == tuple(r)[2:] and not set(r.k) & set("+/=\r\n ")
    bad = spark.createDataFrame([("!!",), ("",), ("abc",), (None,)], "k string")
    assert all(r.m is None for r in bad.select(metadata.decode_key(F.col("k")).alias("m")).collect())


def test_writing_a_row_again_gives_its_id(spark):
    import uuid

    names = spark.createDataFrame([("a",), ("é 1",)], "n string")
    space = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
    assert {r.u for r in names.select(records.uuid5(space, F.col("n")).alias("u")).collect()} == {str(uuid.uuid5(uuid.UUID(space), n)) for n in ("a", "é 1")}


def test_answers_are_taken_apart(spark):
    said = ["<thinking> a </thinking><answer> b </answer>", "<thinking>a</thinking> b </answer>", "x <thinking foo> never closed", "<thinking> open <answer x> b", None, " plain "]
    rows = spark.createDataFrame([(i, s) for i, s in enumerate(said)], "i int, said string")
    answer, thought = answers.split_reasoning(F.col("said"))
    got = {r.i: (r.a, r.t) for r in rows.select("i", answer.alias("a"), thought.alias("t")).collect()}
    assert got == {0: ("b", "a"), 1: ("b", "a"), 2: ("x", None), 3: ("b", None), 4: ("", None), 5: ("plain", None)}
    topic = spark.createDataFrame([("What changed in NOI margin guidance between the 2023 and the 2024 reports?",), ("What's changed between rents of malls and offices",)], "q string")
    assert [r.t for r in topic.select(intents.topic_phrase(F.col("q")).alias("t")).collect()][1] == "rents of malls and offices"


def test_companions_of_changes_carry_the_topic_first(spark):
    asked = [
        "What's changed in BXP's strategy between the 2025 Investor Day and the Q4 2025 update?",
        "What changed   in the 2024 outlook between the Q1 deck and the Q4 update, as of the footnote caveat?",
        "plain question",
        None,
    ]
    rows = spark.createDataFrame(list(enumerate(asked)), "qid int, q string").select("qid", intents.companions(F.col("q")).alias("made"), intents.labels(F.col("q")).alias("labels")).collect()
    got = {r.qid: r for r in rows}
    topic = "the 2025 Investor Day and the Q4 2025 update?"
    assert "temporal_delta" in got[0].labels and got[0].made[:2] == [f"{topic} investor day baseline presentation", f"{topic} quarterly update current guidance"]
    assert len(got[1].made) == 6 and got[1].made[0].endswith("investor day baseline presentation") and "  " not in "".join(got[1].made)
    assert got[2].made == [] and not got[3].made


def test_image_evidence_drops_repeats_of_path_and_content(spark):
    a = lambda path, digest: {"path": path, "digest": digest}
    rows = [
        (1, 2, [a("b.png", "2"), a("c.png", "1"), a("d.svg", "9"), a("e.png", None)]),
        (1, 1, [a("a.PNG", "1"), a("a.PNG", "7"), a(None, "8")]),
        (1, 3, [a("c.png", "3")] + [a(f"x{i}.jpg", f"x{i}") for i in range(20)]),
        (2, 1, []), (3, 1, None),
    ]
    got = answers.image_evidence(spark.createDataFrame(rows, "qid int, rank int, assets array<struct<path:string,digest:string>>")).collect()
    assert [r.path for r in sorted(got, key=lambda r: r.nth)] == ["a.PNG", "b.png", "c.png", "x0.jpg", "x1.jpg", "x2.jpg", "x3.jpg", "x4.jpg"] and {r.qid for r in got} == {1}


def test_judged_answers_refuse_missing_gold_and_unknown_verdicts(spark):
    questions = spark.createDataFrame([(1, "a"), (2, None), (None, "b")], "id int, category string")
    said = spark.createDataFrame([(1, "yes")], "id int, answer string")
    gold = lambda *rows: spark.createDataFrame(rows, "id int, verdict string, score double")
    got = {r.id: (r.verdict, r.score, r.answer) for r in evaluation.judged(questions, gold((1, " Partial", None), (2, "failed", 3.0), (5, "odd", None)), said).collect()}
    assert got == {1: ("partially_correct", 0.5, "yes"), 2: ("incorrect", 1.0, None)}
    for bad, word in ((gold((1, "pass", None)), "missing gold label for question 2"), (gold((1, "pass", None), (2, "maybe", None)), "unsupported verdict value: maybe")):
        with pytest.raises(Exception, match=word):
            evaluation.judged(questions, bad, said).collect()
