"""Tables and figures of pages as records: candidates of two sources, what stands around them, and what goes on or comes again on later pages.

A page is one page of one document and its regions, boxes and candidates are few; a document's pages may be many, so nothing here gathers
a document. Null texts and captions count as empty; a page without regions gives records without caption, notes or texts nearby, in the
section ``Document``; empty tables give empty results.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types

from ..functions import text as T
from .layout import labelled_rows, parse_rows
from .regions import accepted, figure_fields

#: Kinds of region that name a section or explain a figure; how far notes, texts and columns may be; how sure records are.
HEADINGS = ("title", "section_heading", "subsection_heading")
EXPLAINING = ("body_text", "section_heading")
NOTE_SLACK, TEXT_REACH, ALIGNED = 20.0, 260.0, 28.0
MOST_NOTES, MOST_TEXTS, DENSE_VECTORS = 3, 2, 20
TABLE_CONFIDENCE, FIGURE_CONFIDENCE = (0.86, 0.74), (0.83, 0.72)
BOX = ("x0", "y0", "x1", "y1")


def surroundings(anchors: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, anchor_id, caption, section, notes, nearby) of boxes (page, anchor_id, y0, y1) among regions (page, reading_order, kind, y0, text).

    The caption that begins nearest; the last heading that begins no lower; the first notes in reading order that begin at most
    NOTE_SLACK above the box's end; the nearest texts within TEXT_REACH. Ties go to the first in reading order. All four are ranks in one join
    by page, and only ranked rows are put together, so boxes without any region have no row.
    """
    c, away = F.col, F.abs(F.col("_y") - F.col("y0"))
    # A region may serve as heading and as text; each use has the number that its rows are ranked by.
    use = lambda test, name, key: F.when(test, F.struct(F.lit(name).alias("use"), key.cast("double").alias("key")))
    uses = F.array_compact(
        F.array(
            use(c("_kind") == "caption", "caption", away),
            use(c("_kind").isin(*HEADINGS) & (c("_y") <= c("y0")), "section", -c("_y")),
            use((c("_kind") == "footnote") & (c("_y") >= c("y1") - NOTE_SLACK), "note", F.lit(0.0)),
            use(c("_kind").isin(*EXPLAINING) & (away <= TEXT_REACH), "nearby", away),
        )
    )
    near = regions.where(c("kind").isin("caption", "footnote", *HEADINGS, *EXPLAINING)).select("page", c("reading_order").alias("_at"), c("kind").alias("_kind"), c("y0").alias("_y"), F.coalesce("text", F.lit("")).alias("_text"))
    pairs = anchors.select("page", "anchor_id", "y0", "y1").join(near, "page").select("page", "anchor_id", "_at", "_text", F.inline(uses))
    nth = F.row_number().over(Window.partitionBy("page", "anchor_id", "use").orderBy("key", "_at"))
    first = pairs.withColumn("nth", nth).where((c("nth") <= MOST_NOTES) & ((c("use") == "note") | (c("nth") == 1) | ((c("use") == "nearby") & (c("nth") <= MOST_TEXTS))))
    one = lambda name: F.max(F.when(c("use") == name, c("_text")))
    many = lambda name: F.transform(F.array_sort(F.collect_list(F.when(c("use") == name, F.struct("nth", "_text")))), lambda x: x["_text"])
    return first.groupBy("page", "anchor_id").agg(one("caption").alias("caption"), one("section").alias("section"), many("note").alias("notes"), F.array_join(many("nearby"), "\n").alias("nearby"))


def _placed(boxes: DataFrame, regions: DataFrame) -> DataFrame:
    """``boxes`` (page, anchor_id, ...) with what stands around them, empty where nothing does."""
    around = surroundings(boxes, regions)
    text = lambda name, none="": F.coalesce(name, F.lit(none)).alias(name)
    return boxes.join(around, ["page", "anchor_id"], "left").select(boxes["*"], text("caption"), text("section", "Document"), F.coalesce("notes", F.array().cast("array<string>")).alias("notes"), text("nearby"))


def table_candidates(detected: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, table_id, origin, x0..y1, rows): tables that a detector found (page, table_id, x0..y1, rows); on pages without any, the lines of
    all table regions together, where at least two of them look like rows of a table."""
    bare = regions.where("kind = 'table_region'").join(detected.select("page").distinct(), "page", "left_anti")
    lines = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("reading_order", F.coalesce("text", F.lit("")).alias("text")))), lambda x: x["text"]), "\n")
    made = bare.groupBy("page").agg(lines.alias("lines"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    texts = made.select("page", F.concat(F.lit("text_regions_page_"), F.col("page").cast("string")).alias("table_id"), F.lit("regions").alias("origin"), *BOX, parse_rows(F.col("lines")).alias("rows")).where(F.size("rows") >= 2)
    return detected.select("page", "table_id", F.lit("detected").alias("origin"), *BOX, "rows").unionByName(texts)


def table_artifacts(candidates: DataFrame, regions: DataFrame) -> DataFrame:
    """Records of tables: candidates less empty rows, of at least two rows, with caption, section, notes, units, the rows as text, confidence."""
    squeeze = lambda cell: F.trim(F.regexp_replace(F.coalesce(cell, F.lit("")), r"\s+", " "))
    rows = F.filter(F.transform("rows", lambda r: F.transform(F.coalesce(r, F.array().cast("array<string>")), squeeze)), lambda r: F.exists(r, lambda cell: cell != ""))
    boxes = candidates.withColumn("rows", rows).where(F.size("rows") >= 2).withColumn("anchor_id", F.col("table_id"))
    made = _placed(boxes, regions).withColumn("text", labelled_rows(F.col("rows")))
    with_caption, without = TABLE_CONFIDENCE
    return made.select("page", "table_id", "origin", *BOX, "rows", "caption", "section", "notes", T.units(F.concat_ws(" ", "caption", "text")).alias("units"), "text", F.when(F.col("caption") != "", with_caption).otherwise(without).alias("confidence"))


def header_signature(rows: Column) -> Column:
    return F.array_join(F.transform(F.get(rows, F.lit(0)), lambda cell: F.lower(F.trim(F.regexp_replace(cell, r"\s+", " ")))), "|")


def _folded(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Fragments in order with the number of their table in the document, and whether they repeat the header of its first fragment.

    One goes on while it is on the page after the fragment before it, at its sides, with the header or caption of the table's first.
    """
    document, last, head, part = object(), None, None, 0
    for batch in batches:
        parts, skips = [], []
        for of, page, x0, x1, header, caption in zip(*(batch.column(c).to_pylist() for c in ("document_id", "page_num", "x0", "x1", "header", "low_caption"))):
            known = of == document and None not in (page, x0, x1, *last)
            near = known and page == last[0] + 1 and abs(x0 - last[1]) <= ALIGNED and abs(x1 - last[2]) <= ALIGNED
            same_header = near and header == head[0]
            goes_on = same_header or near and bool(caption) and caption == head[1]
            if not goes_on:
                head, part = (header, caption), part + 1 if of == document else 1
            document, last = of, (page, x0, x1)
            parts.append(part)
            skips.append(same_header)
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(parts, pa.int64()), pa.array(skips, pa.bool_())], [*batch.schema.names, "part", "skips_header"])


def merged_tables(fragments: DataFrame) -> DataFrame:
    """Tables put together from fragments (document_id, page_num and what ``table_artifacts`` gives), ordered by page, then table_id.

    A fragment goes on if it is on the page after the fragment before it, its sides are at most ALIGNED from that one's, and it has the header
    or the caption of the table's first fragment. Documents are sorted and gone through in order, with the last fragment and the table's first
    at hand, so none is gathered. A repeated header is left out, notes and units are united, the first fragment gives caption and section.
    """
    low_caption = F.lower(F.trim(F.regexp_replace("caption", r"\s+", " ")))
    marked = fragments.select("document_id", "page_num", "table_id", "x0", "x1", "rows", "notes", "caption", "section", "units", "confidence", header_signature(F.col("rows")).alias("header"), low_caption.alias("low_caption"))
    schema = types.StructType([*marked.schema.fields, types.StructField("part", types.LongType()), types.StructField("skips_header", types.BooleanType())])
    rows = marked.repartition("document_id").sortWithinPartitions("document_id", "page_num", "table_id").mapInArrow(_folded, schema)
    piece = F.struct("page_num", "table_id", F.when(F.col("skips_header"), F.slice("rows", 2, F.greatest(F.size("rows") - 1, F.lit(0)))).otherwise(F.col("rows")).alias("rows"), "notes", "caption", "section", "units")
    grouped = rows.groupBy("document_id", "part").agg(F.array_sort(F.collect_list(piece)).alias("p"), F.max("confidence").alias("confidence"))
    first, squeeze = (lambda name: F.get("p", F.lit(0))[name]), (lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    notes = F.flatten(F.transform("p", lambda x: x["notes"]))
    units = F.array_sort(F.array_distinct(F.filter(F.flatten(F.transform("p", lambda x: F.split(x["units"], ","))), lambda u: u != "")))
    made = grouped.select(
        "document_id", first("table_id").alias("table_id"), F.transform("p", lambda x: x["page_num"]).alias("pages"), (F.size("p") > 1).alias("continued"), first("caption").alias("caption"), first("section").alias("section"),
        F.flatten(F.transform("p", lambda x: x["rows"])).alias("rows"), F.when(F.size("p") > 1, F.array_distinct(F.filter(F.transform(notes, squeeze), lambda x: x != ""))).otherwise(notes).alias("notes"), F.array_join(units, ",").alias("units"), "confidence",
    )
    return made.withColumn("text", labelled_rows(F.col("rows")))


def figure_candidates(images: DataFrame, vectors: DataFrame, regions: DataFrame) -> DataFrame:
    """(page, box_id, candidate, content, wasteful, x0..y1): boxes of images (page, box_id, content, wasteful, x0..y1), the box around a page's vectors
    (page, box_id, vectors, x0..y1) where they are DENSE_VECTORS at least, and on pages with neither the regions that speak of a figure.

    content is the digest of what the box shows, null where nothing could be cut out; wasteful marks cuts that show nothing."""
    nothing = (F.lit(None).cast("string").alias("content"), F.lit(False).alias("wasteful"))
    seen = images.select("page", "box_id", F.lit("image").alias("candidate"), "content", F.coalesce("wasteful", F.lit(False)).alias("wasteful"), *BOX)
    dense = vectors.where(F.col("vectors") >= DENSE_VECTORS).select("page", "box_id", F.lit("vector_dense").alias("candidate"), *nothing, *BOX)
    found = seen.unionByName(dense)
    hints = regions.where("kind = 'figure_region'").join(found.select("page").distinct(), "page", "left_anti")
    return found.unionByName(hints.select("page", F.col("reading_order").alias("box_id"), F.lit("text_figure_hint").alias("candidate"), *nothing, *BOX))


def _around(y0: float | None, y1: float | None, near: list[tuple]) -> tuple[str, str, list[str], str]:
    """(caption, section, notes, nearby) of a box among a page's regions (reading_order, kind, y0, text), as ``surroundings`` has them."""
    first = lambda x: (x is not None, x or 0)
    captions, headings, notes, texts = [], [], [], []
    for at, kind, y, text in near:
        away = None if y is None or y0 is None else abs(y - y0)
        if kind == "caption":
            captions.append((first(away), first(at), text))
        elif kind == "footnote" and None not in (y, y1) and y >= y1 - NOTE_SLACK:
            notes.append((first(at), text))
        if kind in HEADINGS and away is not None and y <= y0:
            headings.append((-y, first(at), text))
        if kind in EXPLAINING and away is not None and away <= TEXT_REACH:
            texts.append((away, first(at), text))
    text = lambda found, none: min(found)[-1] if found else none
    return text(captions, ""), text(headings, "Document"), [t for *_, t in sorted(notes)[:MOST_NOTES]], "\n".join(t for *_, t in sorted(texts)[:MOST_TEXTS])


def _figures_of_pages(candidates: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Figures less those suppressed and those that show nothing, with their number, what stands around them and their page's document.

    Pages, boxes and regions are dealt out by page once and sorted; tasks go from page to page and hold one page's boxes and regions.
    """
    kinds = {f.name: f.dataType for f in (*candidates.schema.fields, *pages.schema.fields)}
    names = ["page", "_row", "box_id", "_at", "document_id", "page_num", "candidate", "content", "wasteful", *BOX, "_kind", "_text"]
    kinds |= {"_row": types.IntegerType(), "_at": types.LongType(), "_kind": types.StringType(), "_text": types.StringType(), "page": candidates.schema["page"].dataType}

    def rows(of: DataFrame, number: int, **more: Column) -> DataFrame:
        given = {"_row": F.lit(number)} | {c: F.col(c) for c in names if c in of.columns} | more
        return of.select(*((given[c] if c in given else F.lit(None)).cast(kinds[c]).alias(c) for c in names))

    near = regions.where(F.col("kind").isin("caption", "footnote", *HEADINGS, *EXPLAINING)).select("page", "reading_order", "kind", "y0", "text")
    every = rows(pages.select("page", "document_id", "page_num"), 0).unionByName(rows(candidates, 1)).unionByName(rows(near, 2, _at=F.col("reading_order"), _kind=F.col("kind"), _text=F.coalesce("text", F.lit("")))).where("page IS NOT NULL")
    out = ["page", "box_id", "document_id", "page_num", "candidate", "content", *BOX]
    made = "figure_no bigint, caption string, section string, notes array<string>, nearby string"
    schema = types.StructType([*(types.StructField(c, kinds[c]) for c in out), *types._parse_datatype_string(made).fields])

    def of_page(page, of: list[tuple], boxes: list[dict], near: list[tuple]) -> Iterator[tuple]:
        kept: list[tuple] = []
        boxes = [b for b in boxes if accepted(kept, *(b[c] for c in BOX))]
        for number, b in enumerate(sorted(boxes, key=lambda b: b["box_id"] is not None), 1):
            caption, section, notes, nearby = _around(b["y0"], b["y1"], near)
            if b["wasteful"] is False or caption or nearby:
                content = b["content"] if b["wasteful"] is False else None
                for document, page_num in of:
                    yield page, b["box_id"], document, page_num, b["candidate"], content, *(b[c] for c in BOX), number, caption, section, notes, nearby

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        arrow = pa.schema([])
        at, of, boxes, near = None, [], [], []
        for batch in batches:
            done: list[tuple] = []
            if not len(arrow):
                own = batch.schema
                arrow = pa.schema([*(own.field(c) for c in out), ("figure_no", pa.int64()), ("caption", pa.string()), ("section", pa.string()), ("notes", pa.list_(pa.string())), ("nearby", own.field("_text").type)])
            columns = {c: batch.column(batch.schema.get_field_index(c)).to_pylist() for c in names}
            for i, (page, row) in enumerate(zip(columns["page"], columns["_row"])):
                if page != at:
                    done.extend(of_page(at, of, boxes, near))
                    at, of, boxes, near = page, [], [], []
                if row == 0:
                    of.append((columns["document_id"][i], columns["page_num"][i]))
                elif row == 1:
                    boxes.append({c: columns[c][i] for c in ("box_id", "candidate", "content", "wasteful", *BOX)})
                else:
                    near.append((columns["_at"][i], columns["_kind"][i], columns["y0"][i], columns["_text"][i]))
            if done:
                yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)
        done = list(of_page(at, of, boxes, near))
        if done:
            yield pa.RecordBatch.from_arrays([pa.array(x, f.type) for x, f in zip(zip(*done), arrow)], schema=arrow)

    # Boxes without a number come last.
    return every.repartition("page").sortWithinPartitions("page", "_row", F.asc_nulls_last("box_id"), "_at").mapInArrow(per_task, schema)


def figure_artifacts(candidates: DataFrame, regions: DataFrame, pages: DataFrame) -> DataFrame:
    """Records of figures: candidates in order of box_id less those that overlap one accepted before, less cuts that show nothing and have neither
    caption nor text nearby, less content that an earlier figure of the document (pages: page, document_id, page_num) showed already.

    Numbers of a page's figures are given before the last two steps. The first of equal contents is told by rank, of which each task gives
    on only its own first, so a picture on every page isn't gathered anywhere.
    """
    bare = F.col("content").isNull()
    # A figure without content is one of its own.
    alike = Window.partitionBy("document_id", "content", F.when(bare, F.col("page")), F.when(bare, F.col("figure_no"))).orderBy("page_num", "figure_no")
    rows = _figures_of_pages(candidates, regions, pages).withColumn("_nth", F.rank().over(alike)).where("_nth = 1")
    kind = figure_fields(F.col("caption"), F.col("nearby"), F.col("candidate"))["figure_type"]
    said = lambda head, name: F.concat(F.lit(head), F.col(name).cast("string"))
    proxy = F.concat_ws("\n", said("Page: ", "page_num"), said("Section: ", "section"), said("Figure type: ", "figure_type"), F.when(F.col("caption") != "", said("Caption: ", "caption")), F.when(F.col("nearby") != "", said("Nearby text: ", "nearby")))
    with_caption, without = FIGURE_CONFIDENCE
    made = rows.withColumn("figure_type", kind).withColumn("proxy", proxy)
    return made.select("document_id", "page", "page_num", "figure_no", "box_id", "candidate", *BOX, "figure_type", "caption", "nearby", "section", "notes", "content", "proxy", F.when(F.col("caption") != "", with_caption).otherwise(without).alias("confidence"))
