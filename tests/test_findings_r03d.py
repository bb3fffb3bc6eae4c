"""Cases of the third round's findings on what is built on ranked rows."""

import pytest

import __spark_entry__


@pytest.mark.parametrize("name", ["metric_sources", "image_evidence", "evidence_diverse"])
def test_ranked_rows_take_no_texts(spark, small, name):
    """Lists are held by then; what is left of the query reads ids and sources of documents only, and sends ranked rows to them."""
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        execution = __spark_entry__.queries()[name](spark, small)._jdf.queryExecution()
        plan = execution.executedPlan().toString().splitlines()
        texts = [k for k, line in enumerate(plan) if "FileScan" in line and "documents.parquet" in line]
        assert len(texts) == 1 and "ReadSchema: struct<doc_id:bigint>" in plan[texts[0]]
        depth = lambda line: len(line) - len(line.lstrip(" :+-*"))
        above, at = [], depth(plan[texts[0]])
        for up in reversed(plan[: texts[0]]):
            if depth(up) < at:
                above, at = [*above, up], depth(up)
        assert "BroadcastHashJoin" in next(up for up in above if "Join" in up or "Exchange" in up)
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
