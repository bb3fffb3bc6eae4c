"""Tables, figures and charts are gone through as sorted rows, not as a group for each page or run."""

import random

import pytest

from docquarry.operators import artifacts, regions
from docquarry.plans import artifacts as plans


@pytest.fixture
def short_batches(spark):
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "3")
    yield
    spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def _plan(rows):
    return rows._jdf.queryExecution().optimizedPlan().toString()


def test_tables_go_on_over_batches(spark, small, short_batches):
    kinds = "document_id bigint, page_num bigint, table_id string, x0 double, x1 double, rows array<array<string>>, notes array<string>, caption string, section string, units string, confidence double"
    rows = [(d, p, f"t{p}", 0.0, 9.0 if p < 6 else 99.0, [["Head"], [f"{d}-{p}"]], [], "", "s", "", 0.5) for d in range(5) for p in range(1, 9)]
    made = artifacts.merged_tables(spark.createDataFrame(rows, kinds).repartition(3))
    want = {(d, tuple(span)): [["Head"], *([f"{d}-{p}"] for p in span)] for d in range(5) for span in (range(1, 6), range(6, 9))}
    assert {(r.document_id, tuple(r.pages)): r.rows for r in made.collect()} == want
    assert "FlatMapGroups" not in _plan(plans.merged_tables(spark, small))


def test_boxes_are_suppressed_over_batches(spark, small, short_batches):
    r = random.Random(2)
    boxes = [(p, k, x, y, x + 10.0, y + 10.0) for p in range(7) for k, (x, y) in enumerate([(r.choice([0.0, 0.4, 30.0]), r.choice([0.0, 0.4, 30.0])) for _ in range(9)])]
    iou = lambda a, b: (s := max(min(a[4], b[4]) - max(a[2], b[2]), 0) * max(min(a[5], b[5]) - max(a[3], b[3]), 0)) / (200 - s)
    want = []
    for b in boxes:
        if not any(k[0] == b[0] and iou(k, b) > 0.8 for k in want):
            want.append(b)
    made = regions.suppressed(spark.createDataFrame(boxes, "page int, box_id int, x0 double, y0 double, x1 double, y1 double").repartition(4))
    assert sorted(map(tuple, made.collect())) == want
    assert "FlatMapGroups" not in _plan(plans.figure_artifacts(spark, small))


def test_figures_are_made_once_for_charts(spark, small):
    once = _plan(plans.figure_artifacts(spark, small)).count("MapInArrow")
    # One more is the reading of the charts.
    assert _plan(plans.chart_analysis(spark, small)).count("MapInArrow") == once + 1
