"""Regions of pages: their kind and zone, layout hints, notes and captions near boxes, and chunks of tables and figures."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .ingest import iou
from .layout import markdown

#: What the texts of page numbers, footnotes and captions look like; how many words and capitals a heading has.
PAGE_NUMBER = r"(?i)^(page\s+)?\d+(\s*/\s*\d+)?$"
FOOTNOTE = r"^(\*|†|‡|\[\d+\]|\d+[.)])\s+"
CAPTION = r"^(figure|fig\.|table|chart|graph|exhibit)\s*\d*"
HEADING_CHARS, HEADING_WORDS, HEADING_SHARE = 120, 14, 0.55
#: Parts of layout labels with the kind and zone that they stand for, the first that fits counts.
LAYOUT = (
    ("table", "table_region", "table_zone"), ("caption", "caption", "figure_zone"), ("figure|chart|graph|plot|image|diagram", "figure_region", "figure_zone"), ("footnote|^note", "footnote", "footnote_zone"),
    ("footer", "footer", "footer_zone"), ("header", "header", "header_zone"), ("title", "title", "header_zone"), ("heading|section|subtitle", "section_heading", "main_body"),
    ("left_column|left column|column_1|col1", "body_text", "left_column"), ("right_column|right column|column_2|col2", "body_text", "right_column"), ("sidebar", "body_text", "sidebar"), ("body|text|paragraph", "body_text", "main_body"),
)
FIRM_HINTS = ("table_region", "figure_region", "caption", "footnote", "header", "footer", "title")
TEXT_KINDS = ("body_text", "section_heading", "subsection_heading")
#: Least share of a region that a layout box must cover, rows of a table's piece, numbers and characters of a fallback summary.
LEAST_HINT, TABLE_ROWS, SUMMARY_NUMBERS, SUMMARY_CHARS = 0.12, 6, 12, 600


def looks_like_heading(text: Column) -> Column:
    """Short, not ended like a sentence, no table, and mostly words with a capital."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    words = F.split(t, r"\s+")
    titled = F.size(F.filter(words, lambda w: w.rlike(r"^\p{Lu}")))
    short = (t != "") & (F.length(t) <= HEADING_CHARS) & ~t.rlike("[.;:]$") & (F.size(words) <= HEADING_WORDS)
    return short & ~T.has_table_signals(t) & (titled / F.size(words) >= HEADING_SHARE)


def layout_kind(label: Column) -> tuple[Column, Column]:
    """(kind, zone) that a layout label stands for, null for labels that are none."""
    low, kind, zone = F.lower(F.trim(F.coalesce(label, F.lit("")))), F.lit(None).cast("string"), F.lit(None).cast("string")
    for pattern, k, z in reversed(LAYOUT):
        kind, zone = F.when(low.rlike(pattern), k).otherwise(kind), F.when(low.rlike(pattern), z).otherwise(zone)
    return kind, zone


def region_kind(text: Column, y0: Column, y1: Column, height: Column, hinted: Column) -> Column:
    """What a region is by its text and place; a layout hint wins where it is firm, and between body text and headings."""
    t = F.trim(F.regexp_replace(text, r"^\s+|\s+$", ""))
    own = (
        F.when(t.rlike(PAGE_NUMBER) & (y0 >= height * 0.88), "footer")
        .when((y1 <= height * 0.12) & (F.length(text) <= 80) & text.rlike("[A-Za-z]"), "header")
        .when(F.lower(t).rlike(CAPTION), "caption")
        .when(t.rlike(FOOTNOTE) | (y0 >= height * 0.9), "footnote")
        .when(T.has_table_signals(text), "table_region")
        .when(looks_like_heading(text), "section_heading")
        .when(T.has_chart_signals(text), "figure_region")
        .otherwise("body_text")
    )
    return F.when(hinted.isin(*FIRM_HINTS) | (hinted.isin(*TEXT_KINDS) & own.isin(*TEXT_KINDS)), hinted).otherwise(own)


def region_zone(kind: Column, x0: Column, y0: Column, x1: Column, width: Column, height: Column, hinted: Column) -> Column:
    """Where on the page a region lies: as hinted, by its kind, or by its place."""
    middle = (x0 + x1) / 2
    return (
        F.when(hinted.isNotNull(), hinted)
        .when(kind.isin("header", "footer", "footnote"), F.concat(kind, F.lit("_zone")))
        .when(kind == "table_region", "table_zone")
        .when(kind.isin("figure_region", "caption"), "figure_zone")
        .when(y0 >= height * 0.86, "footnote_zone")
        .when((middle < width * 0.45) & (x1 < width * 0.7), "left_column")
        .when((middle > width * 0.55) & (x0 > width * 0.3), "right_column")
        .when((x1 - x0 <= width * 0.3) & (x0 > width * 0.65), "sidebar")
        .otherwise("main_body")
    )


def region_confidence(kind: Column, hinted: Column) -> Column:
    base = F.when(kind.isin(*TEXT_KINDS), 0.9).when(kind.isin("caption", "table_region", "figure_region"), 0.82).when(kind.isin("footnote", "header", "footer"), 0.72).otherwise(0.75)
    return F.round(F.when(hinted, F.least(F.lit(0.98), base + 0.08)).otherwise(base), 6)


def box(prefix: str = "") -> tuple[Column, ...]:
    return tuple(F.col(f"{prefix}{c}") for c in ("x0", "y0", "x1", "y1"))


def overlap(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Area that two boxes share."""
    return F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0)) * F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))


def layout_hints(regions: DataFrame, boxes: DataFrame) -> DataFrame:
    """``regions`` (page, region_id, x0..y1) with hint_id, hint_score and the label of the layout box (page, box_id, label, x0..y1) that fits
    best: by the larger of intersection over union and the share of the region covered, LEAST_HINT at least. Pages are the join's
    key; a page's boxes are few. Ties go to the smaller box_id."""
    other = boxes.select("page", "box_id", "label", *(F.col(c).alias(f"b_{c}") for c in ("x0", "y0", "x1", "y1"))).where("(b_x1 - b_x0) * (b_y1 - b_y0) > 1")
    a, b = box(), box("b_")
    area = (a[2] - a[0]) * (a[3] - a[1])
    score = F.greatest(iou(a, b), F.when(area > 0, overlap(a, b) / area).otherwise(F.lit(0.0)))
    pairs = regions.select("page", "region_id", "x0", "y0", "x1", "y1").join(other, "page").withColumn("score", F.round(score, 9)).where((F.col("score") >= LEAST_HINT) & (area > 0))
    best = pairs.groupBy("page", "region_id").agg(F.max_by(F.struct("box_id", "label", "score"), F.struct("score", (-F.col("box_id")).alias("first"))).alias("b"))
    return regions.join(best, ["page", "region_id"], "left").select(regions["*"], F.col("b.box_id").alias("hint_id"), F.round("b.score", 6).alias("hint_score"), F.col("b.label").alias("label"))


def notes_below(anchors: DataFrame, regions: DataFrame, most: int = 3, slack: float = 20.0) -> DataFrame:
    """(page, anchor_id, notes): texts of the first footnotes in reading order that begin no more than ``slack`` above a box's end."""
    notes = regions.where("kind = 'footnote'").select("page", F.col("reading_order").alias("note_order"), F.col("y0").alias("note_y"), F.col("text").alias("note"))
    near = anchors.select("page", "anchor_id", "y1").join(notes, "page").where(F.col("note_y") >= F.col("y1") - slack)
    near = near.withColumn("nth", F.row_number().over(Window.partitionBy("page", "anchor_id").orderBy("note_order"))).where(F.col("nth") <= most)
    return near.groupBy("page", "anchor_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("nth", "note"))), lambda x: x["note"]), "; ").alias("notes"))


def nearest_caption(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, anchor_id, caption): the caption of the page that begins nearest to a box; ties go to the first in reading order."""
    captions = regions.where("kind = 'caption'").select("page", F.col("reading_order").alias("at"), F.col("y0").alias("caption_y"), F.col("text").alias("caption"))
    pairs = anchors.select("page", "anchor_id", "y0").join(captions, "page")
    return pairs.groupBy("page", "anchor_id").agg(F.min_by("caption", F.struct(F.abs(F.col("caption_y") - F.col("y0")), "at")).alias("caption"))


def accepted(kept: list[tuple], x0: float, y0: float, x1: float, y1: float, most: float = 0.8) -> bool:
    """Whether a box has an area and overlaps none of ``kept`` by more than ``most``; it is put among them then."""
    area = (x1 - x0) * (y1 - y0)
    if not area > 1:
        return False
    for a0, b0, a1, b1, other in kept:
        both = max(min(x1, a1) - max(x0, a0), 0.0) * max(min(y1, b1) - max(y0, b0), 0.0)
        if both > 0 and both / (area + other - both) > most:
            return False
    kept.append((x0, y0, x1, y1, area))
    return True


def suppressed(boxes: DataFrame, most: float = 0.8) -> DataFrame:
    """Boxes (page, box_id, x0..y1) less those of hardly any area and those that overlap one accepted before them by more than ``most``.

    What is accepted depends on what was before, so a page's boxes, a few dozen, are gone through in order of box_id. Tasks read sorted pages
    one after the other and hold the accepted boxes of one.
    """

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at, kept = object(), []
        for batch in batches:
            chosen = []
            for i, (page, *box) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("page", "x0", "y0", "x1", "y1")))):
                if page != at:
                    at, kept = page, []
                if accepted(kept, *box, most):
                    chosen.append(i)
            yield batch.take(pa.array(chosen, pa.int64()))

    # Boxes without a number come last.
    return boxes.repartition("page").sortWithinPartitions("page", F.asc_nulls_last("box_id")).mapInArrow(keep, boxes.schema)


def table_html(rows: Column) -> Column:
    """Rows of cells as HTML, the first as its head, with the five signs escaped."""
    escape = lambda c: F.replace(F.replace(F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit(">"), F.lit("&gt;")), F.lit('"'), F.lit("&quot;")), F.lit("'"), F.lit("&#x27;"))
    line = lambda cells, tag: F.concat(F.lit("<tr>"), F.array_join(F.transform(cells, lambda c: F.concat(F.lit(f"<{tag}>"), escape(c), F.lit(f"</{tag}>"))), ""), F.lit("</tr>"))
    body = F.array_join(F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(r, "td")), "")
    return F.when(F.size(rows) > 0, F.concat(F.lit("<table><thead>"), line(F.get(rows, F.lit(0)), "th"), F.lit("</thead><tbody>"), body, F.lit("</tbody></table>"))).otherwise(F.lit(""))


def table_chunks(tables: DataFrame) -> DataFrame:
    """Chunks of tables (table_id, caption, pages, units, rows with a head): the whole as Markdown, or pieces of TABLE_ROWS rows each under
    the head, and a summary of caption, pages, columns and units."""
    head, body = F.get("rows", F.lit(0)), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))
    n_pieces = F.greatest(F.ceil(F.size(body) / TABLE_ROWS), F.lit(1)).cast("int")
    piece = lambda k: markdown(F.concat(F.array(head), F.slice(body, k * TABLE_ROWS + 1, F.lit(TABLE_ROWS))))
    kind = F.when(n_pieces > 1, "table_segment").otherwise("full_table")
    pieces = tables.select("table_id", F.posexplode(F.transform(F.sequence(F.lit(0), n_pieces - 1), piece)).alias("chunk_no", "text"), kind.alias("chunk_type"))
    title = F.when(F.col("caption") != "", F.concat(F.lit("Table summary: "), F.col("caption"))).otherwise(F.lit("Table summary"))
    columns = F.concat(F.lit("Columns: "), F.array_join(F.slice(head, 1, 8), ", "))
    units = F.when(F.col("units") != "", F.concat(F.lit("Units: "), F.col("units")))
    summary = F.concat_ws("\n", title, F.concat(F.lit("Pages: "), F.col("pages")), columns, units)
    rest = tables.select("table_id", n_pieces.alias("chunk_no"), summary.alias("text"), F.lit("table_summary_text").alias("chunk_type"))
    return pieces.unionByName(rest)


def figure_fields(caption: Column, nearby: Column, candidate: Column) -> dict[str, Column]:
    """A figure's type, and of its text the kind of chart, the first and last number and the trend between them."""
    words = F.lower(F.concat_ws(" ", caption, nearby))
    text = F.trim(F.regexp_replace(F.concat_ws(" ", caption, nearby), r"\s+", " "))
    numbers = F.transform(F.regexp_extract_all(text, F.lit(r"\b\d+(?:\.\d+)?\b"), F.lit(0)), lambda x: x.cast("double"))
    first, last, enough = F.get(numbers, F.lit(0)), F.try_element_at(numbers, F.lit(-1)), F.size(numbers) >= 2
    kind = (
        F.when(words.contains("infographic"), "infographic")
        .when(words.contains("diagram"), "diagram")
        .when(words.rlike("chart|graph|plot|trend"), "chart")
        .when(candidate == "vector_dense", "diagram")
        .when(candidate == "image", "photo")
        .otherwise("unknown")
    )
    return {
        "figure_type": kind,
        "is_chart": kind.isin("chart", "diagram", "infographic") | F.lower(caption).rlike("chart|graph|bar|line|trend|histogram"),
        "chart_type": F.when(words.contains("bar"), "bar").when(words.rlike("line|trend"), "line").otherwise("unknown"),
        "first_value": F.when(enough, first),
        "last_value": F.when(enough, last),
        "trend": F.when(enough, F.when(last > first, "Increasing trend").when(last < first, "Decreasing trend").otherwise("Flat trend")),
        "confidence": F.when(enough, 0.42),
    }


def fallback_summary(text: Column) -> Column:
    """A page's first numbers and the beginning of its text, for pages that no model described."""
    numbers = F.array_join(F.slice(F.regexp_extract_all(text, F.lit(T.NUMBER), F.lit(0)), 1, SUMMARY_NUMBERS), ", ")
    return F.concat_ws("\n", F.when(numbers != "", F.concat(F.lit("Numbers: "), numbers)), F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, SUMMARY_CHARS))
