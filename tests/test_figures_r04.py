"""figures are made from regions that are written once, in one pass over sorted pages."""

import random

from docquarry.operators import artifacts
from docquarry.plans import artifacts as plans


def test_regions_are_made_once(spark, small):
    plan = plans.figure_artifacts(spark, small)._jdf.queryExecution()
    assert "lineitem" not in plan.optimizedPlan().toString() and "lineitem" not in plan.executedPlan().toString()
    # Pages with figures (three), vectors, pages, the sorted pages, equal contents.
    assert plan.executedPlan().toString().count("Exchange hashpartitioning") <= 8


def test_around_as_surroundings_have_it(spark, monkeypatch):
    r = random.Random(5)
    kinds = ["caption", "footnote", "title", "section_heading", "subsection_heading", "body_text"]
    regions = [(p, k, r.choice(kinds), r.choice([None, *map(float, range(0, 600, 50))]), r.choice([None, "", f"t{p}-{k}"])) for p in range(60) for k in range(9)]
    boxes = [(p, b, float(y), y + 90.0) for p in range(60) for b, y in enumerate(r.sample(range(0, 600, 25), 4))]
    made = artifacts.surroundings(spark.createDataFrame(boxes, "page int, anchor_id int, y0 double, y1 double"), spark.createDataFrame(regions, "page int, reading_order int, kind string, y0 double, text string"))
    want = {(x.page, x.anchor_id): (x.caption or "", "Document" if x.section is None else x.section, x.notes, x.nearby) for x in made.collect()}
    for p, b, y0, y1 in boxes:
        near = [(at, kind, y, text or "") for page, at, kind, y, text in regions if page == p]
        assert artifacts._around(y0, y1, near) == want.get((p, b), ("", "Document", [], ""))
