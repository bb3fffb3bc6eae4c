"""Tables and figures as records: literal cases for what the queries' tables can't show."""

import os
import time

import pytest
from pyspark.sql import functions as F

from docquarry.operators import artifacts as K, layout as L
from docquarry.operators.bounded import bounded_map
from docquarry.operators.charts import analysed_charts

REGION = "page bigint, reading_order bigint, kind string, x0 double, y0 double, x1 double, y1 double, text string"
TABLE = "page bigint, table_id string, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"
IMAGE = "page bigint, box_id bigint, content string, wasteful boolean, x0 double, y0 double, x1 double, y1 double"
VECTOR = "page bigint, box_id bigint, vectors bigint, x0 double, y0 double, x1 double, y1 double"
FRAGMENT = "document_id bigint, page_num bigint, table_id string, x0 double, x1 double, rows array<array<string>>, caption string, section string, notes array<string>, units string, confidence double"


@pytest.fixture(scope="module")
def regions(spark):
    rows = [
        (1, 1, "title", 0, 10, 90, 20, "Rents"), (1, 2, "section_heading", 0, 50, 90, 60, "By region"), (1, 3, "section_heading", 0, 50, 90, 60, "A tie"), (1, 4, "caption", 0, 80, 90, 90, "Table 1 in USD"),
        (1, 5, "caption", 0, 120, 90, 130, "as near"), (1, 6, "footnote", 0, 130, 90, 140, "too high"), (1, 7, "footnote", 0, 180, 90, 190, "1) a"), (1, 8, "footnote", 0, 300, 90, 310, None), (1, 9, "footnote", 0, 310, 90, 320, "3) c"),
        (1, 10, "footnote", 0, 320, 90, 330, "4) d"), (1, 11, "section_heading", 0, 400, 90, 410, "Below"), (1, 12, "body_text", 0, 361, 90, 370, "too far"),
        (2, 1, "table_region", 5, 50, 60, 70, "a | b"), (2, 2, "table_region", 0, 80, 50, 90, "1 | 2\n\nno cells"), (2, 3, "figure_region", 0, 300, 90, 400, "a chart"), (3, 1, "table_region", 0, 0, 9, 9, "one | row"),
    ]
    return spark.createDataFrame([tuple(float(v) if 3 <= k <= 6 else v for k, v in enumerate(r)) for r in rows], REGION)


def test_surroundings_of_a_box(spark, regions):
    anchors = spark.createDataFrame([(1, "t", 100.0, 200.0), (9, "alone", 0.0, 1.0)], "page bigint, anchor_id string, y0 double, y1 double")
    (got,) = K.surroundings(anchors, regions).collect()
    # Ties go to the first in reading order; a note may begin 20 above the end; of texts within 260 the two nearest.
    assert (got.caption, got.section, got.notes, got.nearby) == ("Table 1 in USD", "By region", ["1) a", "", "3) c"], "By region\nA tie")


def test_tables_of_regions_only_where_none_is_detected(spark, regions):
    found = [(1, "x", 0.0, 100.0, 90.0, 200.0, [["Head", " in  % "], ["", None], None, ["1", "2"]]), (2, "y", 0.0, 0.0, 9.0, 9.0, [["head alone"]])]
    with_both = {r.table_id: r for r in K.table_artifacts(K.table_candidates(spark.createDataFrame(found, TABLE), regions), regions).collect()}
    assert set(with_both) == {"x"}  # page 2 has a candidate, if a useless one, so its regions aren't read
    x = with_both["x"]
    assert (x.rows, x.text, x.units, x.confidence, x.caption) == ([["Head", "in %"], ["1", "2"]], "row_1: Head=1; in %=2", "%,USD", 0.86, "Table 1 in USD")
    (text,) = K.table_artifacts(K.table_candidates(spark.createDataFrame([], TABLE), regions), regions).collect()
    assert (text.table_id, text.rows, (text.x0, text.y0, text.x1, text.y1), text.section, text.notes, text.confidence) == ("text_regions_page_2", [["a", "b"], ["1", "2"]], (0.0, 50.0, 60.0, 90.0), "Document", [], 0.74)


def _fragment(page, table, x0=0.0, header=("A", "B"), caption="", notes=(), units="", confidence=0.74, document=1):
    return document, page, table, x0, x0 + 100.0, [list(header), [table, "v"]], caption, f"section {table}", list(notes), units, confidence


def test_fragments_go_on_by_page_sides_and_the_first_ones_header_or_caption(spark):
    made = [
        _fragment(1, "a", notes=["n  1"], units="%"), _fragment(2, "b", x0=28.0, header=(" a", "b"), notes=["n 1", " "], units="$,%", confidence=0.86), _fragment(3, "c", x0=50.0, header=("C", "D")),
        _fragment(4, "d", x0=50.0, header=("C", "D")), _fragment(6, "e", x0=50.0, header=("C", "D"), caption="Rents "), _fragment(7, "f", x0=50.0, header=("E", "F"), caption="rents"),
        # The header of the fragment before isn't enough: the first one's counts.
        _fragment(8, "g", x0=50.0, header=("E", "F")), _fragment(9, "h", x0=90.0, header=("E", "F")), _fragment(1, "z", document=2, notes=["x", "x"]),
    ]
    got = {r.table_id: r for r in K.merged_tables(spark.createDataFrame(made, FRAGMENT)).collect()}
    assert {k: r.pages for k, r in got.items()} == {"a": [1, 2], "c": [3, 4], "e": [6, 7], "g": [8], "h": [9], "z": [1]}
    assert got["a"].rows == [["A", "B"], ["a", "v"], ["b", "v"]] and (got["a"].notes, got["a"].units, got["a"].confidence, got["a"].continued) == (["n 1"], "$,%", 0.86, True)
    assert got["e"].rows == [["E", "F"] if k == 2 else r for k, r in enumerate([["C", "D"], ["e", "v"], None, ["f", "v"]])] and got["e"].section == "section e"
    assert got["z"].notes == ["x", "x"] and not got["z"].continued
    assert K.merged_tables(spark.createDataFrame([], FRAGMENT)).count() == 0


def test_figures_once_by_place_and_once_by_content(spark, regions):
    images = spark.createDataFrame([
        (1, 1, "p", False, 0.0, 100.0, 90.0, 200.0), (1, 2, "q", False, 0.0, 105.0, 90.0, 205.0), (1, 3, "w", True, 0.0, 300.0, 90.0, 380.0), (2, 1, "p", False, 0.0, 500.0, 90.0, 600.0),
        (3, 1, "w", True, 0.0, 0.0, 50.0, 50.0), (3, 2, "flat", None, 5.0, 5.0, 5.5, 5.5), (4, 1, "p", False, 0.0, 0.0, 50.0, 50.0),
    ], IMAGE)
    vectors = spark.createDataFrame([(5, 9, 20, 0.0, 0.0, 80.0, 80.0), (2, 9, 19, 0.0, 0.0, 80.0, 80.0)], VECTOR)
    pages = spark.createDataFrame([(1, 1, 1), (2, 1, 2), (3, 1, 3), (4, 2, 1), (5, 2, 2)], "page bigint, document_id bigint, page_num bigint")
    got = {(r.page, r.box_id): r for r in K.figure_artifacts(K.figure_candidates(images, vectors, regions), regions, pages).collect()}
    # Box 2 lies on box 1; page 2 shows box 1's picture again; page 3 has a cut that shows nothing without texts, and a box without area.
    assert set(got) == {(1, 1), (1, 3), (4, 1), (5, 9)}
    assert (got[1, 3].content, got[1, 3].figure_no, got[1, 1].figure_type, got[5, 9].figure_type, got[5, 9].section) == (None, 2, "photo", "diagram", "Document")
    assert got[1, 1].proxy == "Page: 1\nSection: By region\nFigure type: photo\nCaption: Table 1 in USD\nNearby text: By region\nA tie" and (got[1, 1].confidence, got[5, 9].confidence) == (0.83, 0.72)
    hints = K.figure_candidates(spark.createDataFrame([], IMAGE), vectors, regions).collect()
    assert {(r.page, r.candidate) for r in hints} == {(2, "text_figure_hint"), (5, "vector_dense")}


def test_lines_of_a_table_keep_figures_at_their_ends(spark):
    text = "0 | head | 0\n 1 | 2 \nno cells\n\t3\t3\n4  wide  4"
    assert spark.range(1).select(L.parse_rows(F.lit(text))).first()[0] == [["0", "head", "0"], ["1", "2"], ["3", "3"], ["4", "wide", "4"]]


def test_items_that_hang_crash_or_raise_leave_the_others_alone(spark):
    def work(item: str):
        if item == "hang":
            time.sleep(600)
        if item == "crash":
            os._exit(9)
        if item == "raise":
            raise KeyError("no such thing")
        return {"n": len(item)} if item != "odd" else {1, 2}

    items = ["a", "hang", "bb", None, "crash", "raise", "odd", "hang", "ccc"] + ["x" * k for k in range(60)]
    rows = spark.createDataFrame(list(enumerate(items)), "id int, item string").coalesce(1)
    began = time.time()
    got = [(r.id, r.result, r.error) for r in bounded_map(rows, "item", work, 1.0, lanes=3).collect()]
    assert time.time() - began < 60 and [g[0] for g in got] == list(range(len(items)))
    assert got[:6] == [(0, '{"n": 1}', None), (1, None, "timeout"), (2, '{"n": 2}', None), (3, None, None), (4, None, "crash"), (5, None, "KeyError: 'no such thing'")]
    assert got[6][2].startswith("TypeError") and got[7][2] == "timeout" and [g[1] for g in got[8:]] == ['{"n": 3}', *(f'{{"n": {k}}}' for k in range(60))]
    assert bounded_map(rows.limit(0), "item", work, 1.0).count() == 0
    with pytest.raises(ValueError):
        bounded_map(rows, "item", work, 1.0, result="id")


def test_charts_fall_back_to_their_words(spark):
    def reader(shown: str):
        if "slow" in shown:
            time.sleep(600)
        return {"chart_type": "bar", "facts": ["up 4"], "trend": "up"} if "good" in shown else ["no object"]

    figure = "document_id bigint, page bigint, page_num bigint, figure_no bigint, candidate string, caption string, nearby string"
    figures = [(1, 1, 1, 1, "image", "good chart", ""), (1, 1, 1, 2, "image", "slow line chart", "from 5 to 9"), (1, 1, 1, 3, "image", "chart", "2 then 1"), (1, 1, 1, 4, "image", "good chart", ""), (1, 2, 2, 1, "image", "good chart", ""), (1, 3, 3, 1, "image", "a lobby", "")]
    pages = spark.createDataFrame([(1, "hard_page", False, 0.5), (2, "simple_text_page", True, 1.0)], "page bigint, page_class string, degraded boolean, complexity double")
    made = analysed_charts(spark.createDataFrame(figures, figure), pages, reader, 1.0, most_pages=1)
    got = {(r.page, r.figure_no): (r.state, r.parsed, r.chart_type, r.trend, r.facts, r.confidence) for r in made.collect()}
    assert got == {
        (1, 1): ("success", "success", "bar", "up", ["up 4"], 0.75), (1, 2): ("timeout_fallback", "partial", "line", "Increasing trend", ["Approximate range: 5.00 to 9.00"], 0.42),
        (1, 3): ("failed", "partial", "unknown", "Decreasing trend", ["Approximate range: 2.00 to 1.00"], 0.42), (1, 4): ("skipped", "partial", "unknown", None, [], None), (2, 1): ("skipped", "partial", "unknown", None, [], None),
    }
