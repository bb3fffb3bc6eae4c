"""Literal cases of functions and operators."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from docquarry.functions import intents, text as T, versions
from docquarry.operators import evaluation as E, facts as X, ingest as I, relational as R, retrieval as V


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first()["x"]


FILES = [
    ("policy_v2.1_final.pdf", "v2.1", 2, None, None, None, True, "policy_final"),
    ("roadmap_Q2 2024.pptx", "Q2 2024", 20242, dt.date(2024, 4, 1), dt.date(2024, 6, 28), None, False, "roadmap_"),
    ("budget_FY2023.pdf", "2023", 2023, dt.date(2023, 1, 1), dt.date(2023, 12, 31), None, False, "budget_fy2023"),
    ("Digital Realty_Investor Presentation March 2026.pdf", "March 2026", 202603, dt.date(2026, 3, 1), dt.date(2026, 3, 28), None, False, None),
    ("PSA Company-Update-Mar-26-vF.pdf", "March 2026", 202603, dt.date(2026, 3, 1), dt.date(2026, 3, 28), None, False, None),
    ("BXP Q4 2025 Investor Presentation with Appendix 3.20.2026.pdf", "Q4 2025", 20254, dt.date(2025, 10, 1), dt.date(2025, 12, 28), dt.date(2026, 3, 20), False, None),
    ("plan_draft_v1.docx", "v1", 1, None, None, None, False, "plan_draft_"),
    ("policy_2024-02-30.pdf", "2024", 2024, dt.date(2024, 1, 1), dt.date(2024, 12, 31), None, False, "policy_"),
]


@pytest.mark.parametrize("case", FILES, ids=[c[0] for c in FILES])
def test_versions(spark, case):
    name, label, rank, begin, end, published, current, group = case
    r = versions.resolve(spark.createDataFrame([(name,)], "file_name string")).first()
    assert (r.version_label, r.version_rank, r.effective_from, r.effective_to, r.published_at, r.is_current) == (label, rank, begin, end, published, current)
    assert group is None or r.version_group == group


def test_signals(spark):
    assert one(spark, T.has_table_signals(F.lit("a | b | c\nd | e | f")))
    assert one(spark, T.has_table_signals(F.lit("total\tx")))
    assert not one(spark, T.has_table_signals(F.lit("plain words")))
    assert one(spark, T.numeric_density(F.lit("12 of 48 items"))) == 0.5
    assert one(spark, T.numeric_density(F.lit(None).cast("string"))) == 0.0
    assert one(spark, T.safe_int(F.lit("3.7"), 7)) == 7
    assert one(spark, T.singular(F.lit("-Properties-"))) == "property"
    assert one(spark, T.natural_key(F.lit("c10"))) > one(spark, T.natural_key(F.lit("c9")))
    assert one(spark, T.citation_label(F.lit("a.pdf"), F.lit(0), F.lit(2), F.lit(3))) == "a.pdf - slide 2 - chunk 3"


def test_labels(spark):
    q = lambda s: one(spark, intents.labels(F.lit(s)))
    assert "temporal_delta" in q("What changed between Q3 2024 and the latest update?")
    assert "temporal_delta" not in q("annualized yield compare")
    assert q("What is the dividend yield?") == ["multi_version_lookup"]


def test_values(spark):
    value, unit = X.parse_value(F.lit("$12 million"))
    assert (one(spark, value), one(spark, unit)) == (12.0, "currency")
    value, unit = X.parse_value(F.lit("1,200 mm"))
    assert (one(spark, value), one(spark, unit)) == (1.2e9, "count")


def test_conflict_example(spark):
    rows = [("g", 1, "Portfolio occupancy rate was 95% in the latest quarter."), ("g", 2, "Portfolio occupancy rate was 91% in the previous quarter.")]
    nodes = spark.createDataFrame(rows, "version_group string, node int, text string").selectExpr("*", "concat('doc', node) AS document_id", "concat('file', node) AS document_name", "concat('v', node) AS version_label", "1 AS page_num")
    found = X.conflicts(X.node_facts(nodes, ["node"]), X.node_topics(nodes), [], "node", 2).collect()
    assert [(r.l_raw, r.r_raw) for r in found] == [("95%", "91%")]


def test_measures(spark):
    ids, gold = F.array(*map(F.lit, ["b", "a", "c"])), F.array(F.lit("a"), F.lit("z"))
    assert one(spark, E.recall_at(ids, gold, 5)) == 0.5
    assert one(spark, E.recall_at(ids, gold, 1)) == 0.0
    assert one(spark, E.reciprocal_rank(ids, gold)) == 0.5
    rows = spark.createDataFrame([("tables", "correct", 1.0), ("tables", "partially_correct", 0.5), (None, "incorrect", 0.0)], "category string, verdict string, score double")
    made = {r.category: r.score for r in E.factuality(rows).collect()}
    assert made == {None: 0.5, "tables": 0.75, "uncategorized": 0.0}


def test_budget_stops_at_first_overflow(spark):
    rows = spark.createDataFrame([(1, 1, 5), (1, 2, 9), (1, 3, 1)], "s int, n int, c int")
    assert [r.n for r in R.within_budget(rows, "s", [F.col("n")], F.col("c"), 10).collect()] == [1]


def test_pages(spark):
    text = "[[START OF PAGE 1]]\nx\n[[END OF PAGE 1]]\n[[START OF PAGE 2]]\n \n[[END OF PAGE 2]]\n[[START OF PAGE 3]] lost"
    rows = spark.createDataFrame([(1, text), (2, "plain")], "k int, t string")
    assert sorted((r.k, r.page, r.page_text) for r in I.pages(rows, "k", "t").collect()) == [(1, 1, "x"), (2, 1, "plain")]


def test_quota_holds_and_keeps_cap(spark):
    rows = spark.createDataFrame([(1, n, "a" if n <= 6 else "b", n) for n in range(1, 11)], "qid int, node_id int, g string, rank int")
    got = [r.node_id for r in V.with_quota(rows, ["qid"], "g", 2, 2, 5).orderBy("place").collect()]
    assert got == [1, 2, 3, 7, 8]


def test_dense_empty(spark):
    schema = "node_id bigint, embedding array<float>"
    empty = spark.createDataFrame([], schema)
    assert V.dense_topk(empty.withColumnRenamed("node_id", "qid"), empty, 3).count() == 0


def test_stream(spark, small, tmp_path):
    from docquarry.streaming import jobs

    events = spark.read.parquet(f"{small}/events.parquet")
    events.repartition(3).write.parquet(str(tmp_path / "in"))
    seen = []
    jobs.run_batches(jobs.job_events(spark, str(tmp_path / "in"), 1), lambda df, n: seen.append(df.count()), str(tmp_path / "check"))
    assert sum(seen) == events.count() and len(seen) == 3
    query = jobs.latest_states(jobs.job_events(spark, str(tmp_path / "in"))).writeStream.format("memory").queryName("states").outputMode("complete").trigger(availableNow=True).start()
    query.awaitTermination()
    assert spark.table("states").count() == events.select("user_id").distinct().count()
