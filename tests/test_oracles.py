"""Every query of the library against its SQL, on the smallest tables."""

import oracle
import pytest

import __spark_entry__
from docquarry.plans import documents, search

QUERIES = {name: (query, module.ORACLES[name]) for module in __spark_entry__.PLANS for name, query in module.QUERIES.items() if name in module.ORACLES}


@pytest.fixture(scope="module")
def duck(small):
    return oracle.connect(small)


@pytest.mark.parametrize("name", QUERIES)
def test_equals_sql(spark, small, duck, name):
    query, sql = QUERIES[name]
    assert oracle.differences(query(spark, small), sql, duck) == []


@pytest.mark.parametrize("name", ["prompt_budgets", "companion_queries", "sentence_chunks", "truncated_texts", "semantic_chunks", "routed_search", "judged_answers", "table_artifacts", "merged_tables", "figure_artifacts", "chart_analysis", "prompt_context", "staged_units"])
def test_equals_sql_on_more_rows(spark, name):
    query, sql = QUERIES[name]
    assert oracle.differences(query(spark, "/root/testdata/sf0.01"), sql, oracle.connect("/root/testdata/sf0.01")) == []


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())


def test_evidence_pipeline_keeps_caps_and_ranked_rows(spark, small):
    rows = search.evidence_pipeline(spark, small).toPandas()
    ranked = {(r.qid, r.node_id) for r in search.rerank_topk(spark, small).collect()}
    assert set(zip(rows.qid, rows.node_id)) <= ranked and rows.groupby("qid").size().max() <= 8
    assert not rows.duplicated(["qid", "node_id"]).any()


def test_retrieval_eval_keeps_gold_as_rows(spark, small, tmp_path):
    plan = search.retrieval_eval(spark, small)._jdf.queryExecution().optimizedPlan().toString()
    assert "collect_set" not in plan and "collect_list" not in plan
    made = [(i, [1.0, i / 1000], None if i == 50 else "a" if i < 90 else "b") for i in range(120)]
    spark.createDataFrame(made, "vec_id bigint, embedding array<float>, label string").write.parquet(f"{tmp_path}/embeddings.parquet")
    got = {r.qid: r for r in search.retrieval_eval(spark, str(tmp_path)).collect()}
    assert set(got) == {0, 50, 100, None}
    near = {r.qid: set() for r in got.values()}
    for r in search.dense_topk(spark, str(tmp_path)).collect():
        near[r.qid].add(r.node_id)
    for q, same in ((0, set(range(90)) - {50}), (50, set()), (100, set(range(90, 120)))):
        assert got[q].recall_10 == round(len(near[q] & same) / len(same), 6) if same else got[q].recall_10 == 0
        assert got[q].precision == len(near[q] & same) / 10 and got[q].mrr == (1.0 if same else 0.0)


def test_document_compare_holds_no_document_whole(spark, small, duck):
    made = documents.document_compare(spark, small)
    assert "collect_list" not in made._jdf.queryExecution().optimizedPlan().toString()
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "2")
    try:
        assert oracle.differences(documents.document_compare(spark, small), documents.ORACLES["document_compare"], duck) == []
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
