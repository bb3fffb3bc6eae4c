"""Queries of tables and figures as records, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import artifacts as K, charts as H, stages as I
from ..sources import collections as C
from ..sources.tables import table
from .regions import _KINDS, _LINES, _kinds

_BOX = ", ".join(K.BOX)


def _regions(spark: SparkSession, d: str) -> DataFrame:
    """Regions of pages (orders) in order of region_id; eight orders in a row are a document."""
    return _kinds(spark, d).withColumn("reading_order", F.col("region_id"))


def _place(page: str = "page"):
    return F.floor(F.col(page) / 8).cast("bigint").alias("document_id"), (F.col(page) % 8 + 1).alias("page_num")


def _detected(regions: DataFrame) -> DataFrame:
    """Tables that a detector found on every third page, some continued on the next, with empty rows, odd white space or a head alone."""
    n, text = F.col("region_id"), lambda c: F.col(c).cast("string")
    head = F.when(n % 2 == 0, F.array(F.lit("Part"), F.lit(" Share  in %"))).otherwise(F.array(F.lit("part"), F.lit("share in %")))
    body = F.array(F.array(text("region_id"), F.concat(text("label"), F.lit("  x"))), F.array(F.lit(" "), F.lit("")), F.array(F.lit("total"), F.lit("5 million")))
    rows = F.when(n % 11 == 0, F.array(head)).when(n % 3 == 0, F.concat(F.array(F.array(F.lit("Year"), F.lit("USD"))), body)).otherwise(F.concat(F.array(head), body))
    left = F.floor(F.col("x0") / 100) * 100.0
    return regions.where((F.col("page") % 8 < 4) & (n % 4 == 0)).select("page", text("region_id").alias("table_id"), left.alias("x0"), "y0", (left + 200.0).alias("x1"), "y1", rows.alias("rows"))


def _tables(spark: SparkSession, d: str) -> DataFrame:
    regions = _regions(spark, d)
    return K.table_artifacts(K.table_candidates(_detected(regions), regions), regions)


def table_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The record of every table, detected or read from regions."""
    notes = F.array_join("notes", "; ").alias("notes")
    return _tables(spark, d).select("page", "table_id", "origin", *K.BOX, F.size("rows").cast("bigint").alias("n_rows"), "caption", "section", notes, "units", F.sha2("text", 256).alias("digest"), "confidence")


_SQUEEZE = r"trim(regexp_replace(coalesce(c, ''), '\s+', ' ', 'g'))"
#: What stands around boxes ``{b}`` (page, anchor_id, y0, y1), as four joins.
_AROUND = """, {b}c AS (SELECT a.page, anchor_id, text AS caption FROM {b} a JOIN k3 k ON k.page = a.page AND k.kind = 'caption' QUALIFY row_number() OVER (PARTITION BY a.page, anchor_id ORDER BY abs(k.y0 - a.y0), region_id) = 1),
{b}s AS (SELECT a.page, anchor_id, text AS section FROM {b} a JOIN k3 k ON k.page = a.page AND k.kind IN ('title', 'section_heading', 'subsection_heading') AND k.y0 <= a.y0 QUALIFY row_number() OVER (PARTITION BY a.page, anchor_id ORDER BY k.y0 DESC, region_id) = 1),
{b}f AS (SELECT a.page, anchor_id, text, region_id FROM {b} a JOIN k3 k ON k.page = a.page AND k.kind = 'footnote' AND k.y0 >= a.y1 - 20 QUALIFY row_number() OVER (PARTITION BY a.page, anchor_id ORDER BY region_id) <= 3),
{b}n AS (SELECT page, anchor_id, list(text ORDER BY region_id) AS notes FROM {b}f GROUP BY 1, 2),
{b}t AS (SELECT a.page, anchor_id, text, abs(k.y0 - a.y0) AS away, region_id FROM {b} a JOIN k3 k ON k.page = a.page AND k.kind IN ('body_text', 'section_heading') AND abs(k.y0 - a.y0) <= 260 QUALIFY row_number() OVER (PARTITION BY a.page, anchor_id ORDER BY abs(k.y0 - a.y0), region_id) <= 2),
{b}e AS (SELECT page, anchor_id, string_agg(text, chr(10) ORDER BY away, region_id) AS nearby FROM {b}t GROUP BY 1, 2),
{b}p AS (SELECT {b}.*, coalesce(caption, '') AS caption, coalesce(section, 'Document') AS section, coalesce(notes, []) AS notes, coalesce(nearby, '') AS nearby FROM {b} LEFT JOIN {b}c USING (page, anchor_id) LEFT JOIN {b}s USING (page, anchor_id) LEFT JOIN {b}n USING (page, anchor_id) LEFT JOIN {b}e USING (page, anchor_id))"""
_UNITS = "concat_ws(',', CASE WHEN contains(w, '$') THEN '$' END, CASE WHEN contains(w, '%') THEN '%' END, CASE WHEN contains(lower(w), 'usd') THEN 'USD' END, CASE WHEN contains(lower(w), 'billion') THEN 'billion' END, CASE WHEN contains(lower(w), 'million') THEN 'million' END)"
#: Rows as labelled lines; every row of these tables is as wide as its head.
_TEXT = "array_to_string(list_transform(rows[2:], lambda z, i: 'row_' || i || ': ' || array_to_string(list_transform(z, lambda c, j: rows[1][j] || '=' || c), '; ')), chr(10))"
_TABLES = rf"""{_LINES}, {_KINDS},
td AS (SELECT page, region_id::VARCHAR AS table_id, floor(x0 / 100) * 100.0 AS x0, y0, floor(x0 / 100) * 100.0 + 200 AS x1, y1, CASE WHEN region_id % 11 = 0 THEN [head] WHEN region_id % 3 = 0 THEN list_concat([['Year', 'USD']], body) ELSE list_concat([head], body) END AS rows
  FROM (SELECT *, CASE WHEN region_id % 2 = 0 THEN ['Part', ' Share  in %'] ELSE ['part', 'share in %'] END AS head, [[region_id::VARCHAR, label || '  x'], [' ', ''], ['total', '5 million']] AS body FROM k3 WHERE page % 8 < 4 AND region_id % 4 = 0)),
tr AS (SELECT page, 'text_regions_page_' || page AS table_id, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY region_id) AS t FROM k3 WHERE kind = 'table_region' AND page NOT IN (SELECT page FROM td) GROUP BY page),
tl AS (SELECT * EXCLUDE (t), list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: list_filter(list_transform(CASE WHEN contains(x, '|') THEN string_split(x, '|') WHEN contains(x, chr(9)) THEN string_split(x, chr(9)) ELSE regexp_split_to_array(x, '\s{{2,}}') END,
  lambda c: {_SQUEEZE}), lambda c: c <> '')), lambda z: len(z) >= 2) AS rows FROM tr),
tc AS (SELECT page, table_id, 'detected' AS origin, {_BOX}, rows FROM td UNION ALL SELECT page, table_id, 'regions', {_BOX}, rows FROM tl WHERE len(rows) >= 2),
ta AS (SELECT page, table_id, table_id AS anchor_id, origin, {_BOX}, list_filter(list_transform(rows, lambda r: list_transform(r, lambda c: {_SQUEEZE})), lambda r: len(list_filter(r, lambda c: c <> '')) > 0) AS rows FROM tc),
tb AS (SELECT * FROM ta WHERE len(rows) >= 2){_AROUND.format(b='tb')},
tx AS (SELECT *, {_TEXT} AS text FROM tbp), tu AS (SELECT *, caption || ' ' || text AS w FROM tx),
tt AS (SELECT * EXCLUDE (w), {_UNITS} AS units, CASE WHEN caption <> '' THEN 0.86 ELSE 0.74 END::DOUBLE AS confidence FROM tu)"""
TABLE_ARTIFACTS = f"""WITH {_TABLES} SELECT page, table_id, origin, {_BOX}, len(rows) AS n_rows, caption, section, array_to_string(notes, '; ') AS notes, units, sha256(text) AS digest, confidence FROM tt"""


def merged_tables(spark: SparkSession, d: str) -> DataFrame:
    """Tables that go on over pages put together, with how many rows they have and where they stand."""
    rows = K.merged_tables(_tables(spark, d).select(*_place(), "*"))
    joined = lambda name, sep: F.array_join(name, sep).alias(name)
    return rows.select("document_id", "table_id", F.array_join(F.transform("pages", lambda p: p.cast("string")), ",").alias("pages"), "continued", F.size("rows").cast("bigint").alias("n_rows"), "caption", "section", joined("notes", "; "), "units", "confidence", F.sha2("text", 256).alias("digest"))


#: The fold goes from fragment to fragment of a document, the head's header and caption and the last page and sides at hand.
MERGED_TABLES = rf"""WITH RECURSIVE {_TABLES},
mo AS (SELECT *, page // 8 AS document_id, page % 8 + 1 AS page_num, lower(array_to_string(rows[1], '|')) AS sig, lower(caption) AS low, row_number() OVER (PARTITION BY page // 8 ORDER BY page % 8 + 1, table_id) AS nth FROM tt),
mf AS (SELECT document_id, nth, 1 AS part, sig AS head, low AS head_low, false AS skip FROM mo WHERE nth = 1
  UNION ALL SELECT document_id, nth, CASE WHEN goes THEN part ELSE part + 1 END, CASE WHEN goes THEN head ELSE sig END, CASE WHEN goes THEN head_low ELSE low END, goes AND sig = head FROM
  (SELECT b.document_id, b.nth, f.part, f.head, f.head_low, b.sig, b.low, b.page_num = a.page_num + 1 AND abs(a.x0 - b.x0) <= 28 AND abs(a.x1 - b.x1) <= 28 AND (b.sig = f.head OR (b.low <> '' AND b.low = f.head_low)) AS goes
   FROM mf f JOIN mo a USING (document_id, nth) JOIN mo b ON b.document_id = f.document_id AND b.nth = f.nth + 1)),
mg AS (SELECT mo.document_id, part, first(table_id ORDER BY nth) AS table_id, string_agg(page_num::VARCHAR, ',' ORDER BY nth) AS pages, count(*) AS n, first(caption ORDER BY nth) AS caption, first(section ORDER BY nth) AS section,
  flatten(list(CASE WHEN skip THEN rows[2:] ELSE rows END ORDER BY nth)) AS rows, flatten(list(notes ORDER BY nth)) AS every, list_sort(list_distinct(list_filter(flatten(list(string_split(units, ','))), lambda u: u <> ''))) AS us, max(confidence) AS confidence FROM mo JOIN mf USING (document_id, nth) GROUP BY 1, 2),
mq AS (SELECT *, list_transform(every, lambda x: trim(regexp_replace(x, '\s+', ' ', 'g'))) AS tidy FROM mg),
mn AS (SELECT *, list_filter(list_transform(tidy, lambda x, i: CASE WHEN x <> '' AND list_position(tidy, x) = i THEN x END), lambda x: x IS NOT NULL) AS once FROM mq)
SELECT document_id, table_id, pages, n > 1 AS continued, len(rows) AS n_rows, caption, section, array_to_string(CASE WHEN n > 1 THEN once ELSE every END, '; ') AS notes, array_to_string(us, ',') AS units, confidence, sha256({_TEXT.replace("rows[1][j]", "coalesce(rows[1][j], 'column_' || j)")}) AS digest FROM mn"""


def _figures(spark: SparkSession, d: str) -> DataFrame:
    """Figures of pages; images stand twice in their page's list, moved a little, and come again on other pages. Regions are read five
    times, so they are made once and written."""
    regions, n = I.kept_in(C.work_path(spark, "figures"))("regions", _regions(spark, d).drop("hint_kind", "hint_zone", "label")), F.col("region_id")
    moved = F.explode(F.array(F.struct(F.lit(0).alias("k"), F.lit(0.0).alias("by")), F.struct(F.lit(1).alias("k"), F.lit(1.0).alias("by")), F.struct(F.lit(2).alias("k"), F.lit(30.0).alias("by"))))
    images = regions.where((n % 5 == 1) & (F.col("page") % 4 != 3)).select("page", "region_id", *K.BOX, moved.alias("m"))
    content = F.when(n % 13 != 0, F.concat(F.lit("picture "), ((n + F.col("m.k")) % 40).cast("string")))
    images = images.select("page", (n * 4 + F.col("m.k")).alias("box_id"), content.alias("content"), (n % 9 == 0).alias("wasteful"), "x0", (F.col("y0") + F.col("m.by")).alias("y0"), "x1", (F.col("y1") + F.col("m.by")).alias("y1"))
    vectors = regions.where(F.col("page") % 5 == 2).groupBy("page").agg((F.max("region_id") * 4 + 3).alias("box_id"), (F.count("*") * 4).alias("vectors"), F.min("x0").alias("x0"), F.min("y0").alias("y0"), F.max("x1").alias("x1"), F.max("y1").alias("y1"))
    return K.figure_artifacts(K.figure_candidates(images, vectors, regions), regions, regions.select("page").distinct().select("page", *_place()))


def figure_artifacts(spark: SparkSession, d: str) -> DataFrame:
    """The record of every figure."""
    return _figures(spark, d).select("document_id", "page_num", "figure_no", "candidate", *K.BOX, "figure_type", "caption", "section", F.array_join("notes", "; ").alias("notes"), "content", F.sha2("proxy", 256).alias("digest"), "confidence")


#: Suppression goes from box to box of a page, those accepted at hand.
_IOU = "greatest(least(b.x1, c.x1) - greatest(b.x0, c.x0), 0) * greatest(least(b.y1, c.y1) - greatest(b.y0, c.y0), 0)"
_FIGURES = rf"""{_LINES}, {_KINDS},
im AS (SELECT page, region_id * 4 + k AS box_id, 'image' AS candidate, CASE WHEN region_id % 13 <> 0 THEN 'picture ' || ((region_id + k) % 40) END AS content, region_id % 9 = 0 AS wasteful, x0, y0 + [0, 1, 30][k + 1] AS y0, x1, y1 + [0, 1, 30][k + 1] AS y1
  FROM (SELECT *, unnest([0, 1, 2]) AS k FROM k3 WHERE region_id % 5 = 1 AND page % 4 <> 3)),
ve AS (SELECT page, max(region_id) * 4 + 3 AS box_id, 'vector_dense' AS candidate, NULL::VARCHAR AS content, false AS wasteful, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1 FROM k3 WHERE page % 5 = 2 GROUP BY page HAVING count(*) * 4 >= 20),
fo AS (SELECT * FROM im UNION ALL SELECT * FROM ve),
fc AS (SELECT * FROM fo UNION ALL SELECT page, region_id, 'text_figure_hint', NULL, false, {_BOX} FROM k3 WHERE kind = 'figure_region' AND page NOT IN (SELECT page FROM fo)),
fn AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY box_id) AS nth FROM fc),
fw AS (SELECT page, 0::BIGINT AS nth, []::STRUCT(box_id BIGINT, x0 DOUBLE, y0 DOUBLE, x1 DOUBLE, y1 DOUBLE)[] AS kept FROM (SELECT DISTINCT page FROM fn)
  UNION ALL SELECT c.page, c.nth, CASE WHEN (c.x1 - c.x0) * (c.y1 - c.y0) > 1 AND len(list_filter(kept, lambda b: {_IOU} / ((c.x1 - c.x0) * (c.y1 - c.y0) + (b.x1 - b.x0) * (b.y1 - b.y0) - {_IOU}) > 0.8)) = 0
    THEN list_append(kept, {{'box_id': c.box_id, 'x0': c.x0::DOUBLE, 'y0': c.y0::DOUBLE, 'x1': c.x1::DOUBLE, 'y1': c.y1::DOUBLE}}) ELSE kept END FROM fw w JOIN fn c ON c.page = w.page AND c.nth = w.nth + 1),
fl AS (SELECT page, unnest(kept).box_id AS box_id, generate_subscripts(kept, 1) AS figure_no FROM (SELECT * FROM fw QUALIFY row_number() OVER (PARTITION BY page ORDER BY nth DESC) = 1)),
fb AS (SELECT fn.*, box_id AS anchor_id, figure_no FROM fn JOIN fl USING (page, box_id)){_AROUND.format(b='fb')},
fx AS (SELECT * EXCLUDE (content), CASE WHEN NOT wasteful THEN content END AS content, page // 8 AS document_id, page % 8 + 1 AS page_num, lower(caption || ' ' || nearby) AS w FROM fbp WHERE NOT wasteful OR caption <> '' OR nearby <> ''),
fy AS (SELECT *, CASE WHEN contains(w, 'infographic') THEN 'infographic' WHEN contains(w, 'diagram') THEN 'diagram' WHEN regexp_matches(w, 'chart|graph|plot|trend') THEN 'chart' WHEN candidate = 'vector_dense' THEN 'diagram' WHEN candidate = 'image' THEN 'photo' ELSE 'unknown' END AS figure_type FROM fx QUALIFY content IS NULL OR row_number() OVER (PARTITION BY document_id, content ORDER BY page_num, figure_no) = 1)"""
FIGURE_ARTIFACTS = f"""WITH RECURSIVE {_FIGURES}
SELECT document_id, page_num, figure_no, candidate, {_BOX}, figure_type, caption, section, array_to_string(notes, '; ') AS notes, content, CASE WHEN caption <> '' THEN 0.83 ELSE 0.72 END::DOUBLE AS confidence,
sha256(concat_ws(chr(10), 'Page: ' || page_num, 'Section: ' || section, 'Figure type: ' || figure_type, 'Caption: ' || nullif(caption, ''), 'Nearby text: ' || nullif(nearby, ''))) AS digest FROM fy"""


def read_chart(shown: str) -> dict:
    """A stand-in for a model that reads charts: it names the words of the first line, can't read notes, and finds nothing in short texts."""
    first = shown.split("\n")[0]
    if "Note" in shown:
        raise ValueError("unreadable")
    if "†" in shown:
        return {"trend": "flat"}
    return {"chart_type": "line", "trend": first[:9], "facts": [first, " "], "confidence": 0.9} if len(shown) > 30 else {}


def chart_analysis(spark: SparkSession, d: str) -> DataFrame:
    """The charts among the figures, the most useful pages' read by a model, the others by their words."""
    figures, n = _figures(spark, d), F.col("page")
    # Pages are told of whether or not they have a figure, so figures aren't made for that.
    kinds = F.when(n % 3 == 0, "visual_heavy_page").otherwise("simple_text_page")
    pages = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("page")).distinct().select("page", kinds.alias("page_class"), (n % 7 == 0).alias("degraded"), (n % 10 / 10).alias("complexity"))
    made = H.analysed_charts(figures, pages, read_chart, 60.0)
    return made.select("document_id", "page_num", "figure_no", "figure_type", "state", "parsed", "chart_type", "trend", F.array_join("facts", "; ").alias("facts"), "confidence", "error")


CHART_ANALYSIS = rf"""WITH RECURSIVE {_FIGURES},
ch AS (SELECT *, list_transform(regexp_extract_all(regexp_replace(caption || ' ' || nearby, '\s+', ' ', 'g'), '\b\d+(?:\.\d+)?\b'), lambda x: x::DOUBLE) AS ns, row_number() OVER (PARTITION BY page ORDER BY figure_no) AS place FROM fy WHERE figure_type IN ('chart', 'diagram', 'infographic') OR regexp_matches(lower(caption), 'chart|graph|bar|line|trend|histogram')),
cp AS (SELECT document_id, page, round((count(*) * 4.5 + CASE WHEN page % 3 = 0 THEN 2 ELSE 1 END + CASE WHEN page % 7 = 0 THEN 1 ELSE 0 END + page % 10 / 10)::DOUBLE, 6) AS priority FROM ch GROUP BY 1, 2),
cq AS (SELECT page FROM cp QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY priority DESC, page DESC) <= 3),
cs AS (SELECT ch.*, cq.page IS NOT NULL AND place <= 3 AS asked, concat_ws(chr(10), nullif(caption, ''), nullif(nearby, '')) AS shown FROM ch LEFT JOIN cq USING (page)),
ct AS (SELECT *, string_split(shown, chr(10))[1] AS head, CASE WHEN NOT asked THEN 'skipped' WHEN contains(shown, 'Note') THEN 'failed' WHEN contains(shown, '†') THEN 'flat' WHEN length(shown) > 30 THEN 'read' ELSE 'failed' END AS how,
  CASE WHEN contains(w, 'bar') THEN 'bar' WHEN regexp_matches(w, 'line|trend') THEN 'line' ELSE 'unknown' END AS kind, CASE WHEN len(ns) < 2 THEN NULL WHEN ns[-1] > ns[1] THEN 'Increasing trend' WHEN ns[-1] < ns[1] THEN 'Decreasing trend' ELSE 'Flat trend' END AS own FROM cs)
SELECT document_id, page_num, figure_no, figure_type, CASE WHEN how IN ('read', 'flat') THEN 'success' ELSE how END AS state, CASE WHEN how IN ('read', 'flat') THEN 'success' ELSE 'partial' END AS parsed, CASE WHEN how = 'read' THEN 'line' ELSE kind END AS chart_type,
CASE how WHEN 'read' THEN head[:9] WHEN 'flat' THEN 'flat' ELSE own END AS trend, CASE WHEN how = 'read' THEN head WHEN len(ns) >= 2 THEN printf('Approximate range: %.2f to %.2f', ns[1], ns[-1]) ELSE '' END AS facts,
CASE WHEN how = 'read' THEN 0.9 WHEN how = 'flat' THEN 0.75 WHEN len(ns) >= 2 THEN 0.42 END::DOUBLE AS confidence, CASE WHEN asked AND contains(shown, 'Note') THEN 'ValueError: unreadable' END AS error FROM ct"""

QUERIES = {"table_artifacts": table_artifacts, "merged_tables": merged_tables, "figure_artifacts": figure_artifacts, "chart_analysis": chart_analysis}
ORACLES = {"table_artifacts": TABLE_ARTIFACTS, "merged_tables": MERGED_TABLES, "figure_artifacts": FIGURE_ARTIFACTS, "chart_analysis": CHART_ANALYSIS}
