"""Queries of page regions, tables, figures and what answers are made of, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A, layout as L, regions as G
from ..sources import tables as S
from .search import RERANKED, reranked

_TEXTS = ("Page 3 / 10", "Figure 2 growth", "1) a note on rents", "Revenue By Region And Tenant", "plain body text about leases", "a | b | c\nd | e | f", "† starred note", "the chart of quarterly trend lines", "[4] Another Note")
_LABELS = ("Table body", "picture caption", "bar chart", "Footnote", "page footer", "Page-Header", "Title", "section heading", "col1 text", "right column", "sidebar", "paragraph", "unknown", "")


def _lines(spark: SparkSession, d: str) -> DataFrame:
    """A region for each line of an order; the order is its page. Places are whole and half points."""
    pick = lambda values, n: F.element_at(F.array(*map(F.lit, values)), (n % len(values) + 1).cast("int"))
    line, (price, number, sort) = S.table(spark, d, "lineitem"), (F.col(c) for c in ("_price", "_number", "_sort"))
    # Lines are told apart by numbers; texts and places are made of those that are left.
    once = line.select(
        F.col("l_orderkey").alias("page"), (F.col("l_linenumber") * 10_000_000 + F.col("l_partkey") * 1000 + F.col("l_suppkey") % 1000).alias("region_id"), F.floor("l_extendedprice").cast("bigint").alias("_price"),
        (F.col("l_partkey") + F.col("l_suppkey")).alias("_number"), (F.col("l_suppkey") + F.col("l_linenumber")).alias("_sort"),
    ).dropDuplicates(["page", "region_id"])
    rows = once.select("page", "region_id", (number % 500 / 2.0).alias("x0"), (price % 780).cast("double").alias("y0"), (number % 7 * 45 + 20.0).alias("w"), (price % 5 * 9 + 8.0).alias("h"), pick(_TEXTS, price).alias("text"), pick(_LABELS, sort).alias("label"))
    return rows.withColumns({"x1": F.col("x0") + F.col("w"), "y1": F.col("y0") + F.col("h")}).drop("w", "h")


def _case(values, n: str) -> str:
    quoted = [v.replace("'", "''").replace("\n", "' || chr(10) || '") for v in values]
    return "[" + ", ".join(f"'{v}'" for v in quoted) + f"][({n} % {len(values)} + 1)::INT]"


_LINES = f"""ln AS (SELECT DISTINCT ON (page, region_id) * FROM (SELECT l_orderkey AS page, l_linenumber * 10000000 + l_partkey * 1000 + l_suppkey % 1000 AS region_id, (l_partkey + l_suppkey) % 500 / 2.0 AS x0, floor(l_extendedprice)::BIGINT % 780 AS y0,
  (l_partkey + l_suppkey) % 7 * 45 + 20.0 AS w, floor(l_extendedprice)::BIGINT % 5 * 9 + 8.0 AS h, {_case(_TEXTS, 'floor(l_extendedprice)::BIGINT')} AS text, {_case(_LABELS, '(l_suppkey + l_linenumber)')} AS label FROM lineitem) ORDER BY page, region_id, x0, y0),
rg AS (SELECT page, region_id, x0::DOUBLE AS x0, y0::DOUBLE AS y0, (x0 + w)::DOUBLE AS x1, (y0 + h)::DOUBLE AS y1, text, label FROM ln)"""
_KIND = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{k}'" for p, k, _ in G.LAYOUT)
_ZONE = " ".join(f"WHEN regexp_matches(low, '{p}') THEN '{z}'" for p, _, z in G.LAYOUT)
_FIRM = ", ".join(f"'{k}'" for k in G.FIRM_HINTS)
_TEXT_KINDS = ", ".join(f"'{k}'" for k in G.TEXT_KINDS)
_KINDS = rf"""k0 AS (SELECT *, lower(label) AS low, len(regexp_extract_all(text, '\b\d+[.,]?\d*%?\b')) AS n, len(list_filter(string_split(text, chr(10)), lambda x: contains(x, chr(9)) OR length(x) - length(replace(x, '|', '')) >= 2)) AS lines, regexp_split_to_array(text, '\s+') AS ws FROM rg),
k1 AS (SELECT *, CASE {_KIND} END AS hint_kind, CASE {_ZONE} END AS hint_zone, lines >= 2 OR (lines = 1 AND (n >= 3 OR regexp_matches(lower(text), '\b(q[1-4]|quarter|year|total|revenue|cost|amount|value)\b'))) AS tabled FROM k0),
k2 AS (SELECT *, CASE WHEN regexp_matches(text, '{G.PAGE_NUMBER}') AND y0 >= 704 THEN 'footer' WHEN y1 <= 96 AND length(text) <= 80 AND regexp_matches(text, '[A-Za-z]') THEN 'header' WHEN regexp_matches(lower(text), '{G.CAPTION}') THEN 'caption'
  WHEN regexp_matches(text, '{G.FOOTNOTE}') OR y0 >= 720 THEN 'footnote' WHEN tabled THEN 'table_region'
  WHEN length(text) <= 120 AND NOT regexp_matches(text, '[.;:]$') AND len(ws) <= 14 AND len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / len(ws) >= 0.55 THEN 'section_heading'
  WHEN regexp_matches(lower(text), 'figure|chart|graph|plot|diagram|trend') THEN 'figure_region' ELSE 'body_text' END AS own FROM k1),
k3 AS (SELECT *, CASE WHEN hint_kind IN ({_FIRM}) OR (hint_kind IN ({_TEXT_KINDS}) AND own IN ({_TEXT_KINDS})) THEN hint_kind ELSE own END AS kind FROM k2)"""


def _kinds(spark: SparkSession, d: str) -> DataFrame:
    kind, zone = G.layout_kind(F.col("label"))
    rows = _lines(spark, d).withColumns({"hint_kind": kind, "hint_zone": zone})
    return rows.withColumn("kind", G.region_kind(F.col("text"), F.col("y0"), F.col("y1"), F.lit(800.0), F.col("hint_kind")))


def region_kinds(spark: SparkSession, d: str) -> DataFrame:
    rows = _kinds(spark, d)
    zone = G.region_zone(F.col("kind"), F.col("x0"), F.col("y0"), F.col("x1"), F.lit(600.0), F.lit(800.0), F.col("hint_zone"))
    return rows.select("page", "region_id", "kind", zone.alias("zone"), G.region_confidence(F.col("kind"), F.col("hint_kind").isNotNull()).alias("confidence"), G.looks_like_heading(F.col("text")).alias("heading"))


REGION_KINDS = rf"""WITH {_LINES}, {_KINDS}
SELECT page, region_id, kind, CASE WHEN hint_zone IS NOT NULL THEN hint_zone WHEN kind IN ('header', 'footer', 'footnote') THEN kind || '_zone' WHEN kind = 'table_region' THEN 'table_zone' WHEN kind IN ('figure_region', 'caption') THEN 'figure_zone' WHEN y0 >= 688 THEN 'footnote_zone'
 WHEN (x0 + x1) / 2 < 270 AND x1 < 420 THEN 'left_column' WHEN (x0 + x1) / 2 > 330 AND x0 > 180 THEN 'right_column' WHEN x1 - x0 <= 180 AND x0 > 390 THEN 'sidebar' ELSE 'main_body' END AS zone,
round(CASE WHEN hint_kind IS NOT NULL THEN least(0.98, b + 0.08) ELSE b END, 6) AS confidence, length(text) <= 120 AND NOT regexp_matches(text, '[.;:]$') AND len(ws) <= 14 AND NOT tabled AND len(list_filter(ws, lambda x: regexp_matches(x, '^\p{{Lu}}'))) / len(ws) >= 0.55 AS heading
FROM (SELECT *, CASE WHEN kind IN ({_TEXT_KINDS}) THEN 0.9 WHEN kind IN ('caption', 'table_region', 'figure_region') THEN 0.82 WHEN kind IN ('footnote', 'header', 'footer') THEN 0.72 ELSE 0.75 END::DOUBLE AS b FROM k3)"""


def layout_hints(spark: SparkSession, d: str) -> DataFrame:
    """The box of a layout model that fits each region best; the boxes are the page's regions, moved and enlarged."""
    rows = _lines(spark, d)
    boxes = rows.select("page", F.col("region_id").alias("box_id"), "label", (F.col("x0") + 6.0).alias("x0"), (F.col("y0") - 10.0).alias("y0"), (F.col("x1") + 30.0).alias("x1"), (F.col("y1") + 4.0).alias("y1"))
    return G.layout_hints(rows.drop("label"), boxes).select("page", "region_id", "hint_id", "hint_score", "label")


LAYOUT_HINTS = f"""WITH {_LINES}, b AS (SELECT page, region_id AS box_id, label, x0 + 6 AS bx0, y0 - 10 AS by0, x1 + 30 AS bx1, y1 + 4 AS by1 FROM rg),
p AS (SELECT r.page, r.region_id, box_id, b.label, greatest(least(x1, bx1) - greatest(x0, bx0), 0) * greatest(least(y1, by1) - greatest(y0, by0), 0) AS inter, (x1 - x0) * (y1 - y0) AS area, (bx1 - bx0) * (by1 - by0) AS b_area FROM rg r JOIN b ON r.page = b.page),
s AS (SELECT *, round(greatest(inter / (area + b_area - inter), inter / area), 9) AS score FROM p),
w AS (SELECT * FROM s WHERE score >= 0.12 QUALIFY row_number() OVER (PARTITION BY page, region_id ORDER BY score DESC, box_id) = 1)
SELECT r.page, r.region_id, box_id AS hint_id, round(score, 6) AS hint_score, w.label FROM rg r LEFT JOIN w USING (page, region_id)"""


def region_joins(spark: SparkSession, d: str) -> DataFrame:
    """Captions nearest to tables and figures, and the notes below them."""
    rows = _kinds(spark, d).withColumn("reading_order", F.col("region_id"))
    anchors = rows.where("kind IN ('table_region', 'figure_region')").withColumn("anchor_id", F.col("region_id"))
    keys = ["page", "anchor_id"]
    made = anchors.select(*keys).join(G.nearest_caption(anchors, rows), keys, "left").join(G.notes_below(anchors, rows), keys, "left")
    return made.select("page", "anchor_id", F.coalesce("caption", F.lit("")).alias("caption"), F.coalesce("notes", F.lit("")).alias("notes"))


REGION_JOINS = f"""WITH {_LINES}, {_KINDS}, a AS (SELECT page, region_id AS anchor_id, y0, y1 FROM k3 WHERE kind IN ('table_region', 'figure_region')),
c AS (SELECT a.page, anchor_id, text FROM a JOIN k3 k ON k.page = a.page AND k.kind = 'caption' QUALIFY row_number() OVER (PARTITION BY a.page, anchor_id ORDER BY abs(k.y0 - a.y0), region_id) = 1),
n AS (SELECT a.page, anchor_id, text, region_id FROM a JOIN k3 k ON k.page = a.page AND k.kind = 'footnote' AND k.y0 >= a.y1 - 20 QUALIFY row_number() OVER (PARTITION BY a.page, anchor_id ORDER BY region_id) <= 3),
g AS (SELECT page, anchor_id, string_agg(text, '; ' ORDER BY region_id) AS notes FROM n GROUP BY 1, 2)
SELECT page, anchor_id, coalesce(c.text, '') AS caption, coalesce(notes, '') AS notes FROM a LEFT JOIN c USING (page, anchor_id) LEFT JOIN g USING (page, anchor_id)"""


def _tables(spark: SparkSession, d: str) -> DataFrame:
    """A table for each order, a row for each of its lines, some with signs that HTML escapes."""
    line, text = S.table(spark, d, "lineitem"), lambda c: F.col(c).cast("string")
    cells = F.array(text("l_linenumber"), text("l_partkey"), F.when(F.col("l_suppkey") % 3 == 0, F.lit("<a & 'b'>")).otherwise(text("l_suppkey")))
    rows = line.groupBy(F.col("l_orderkey").alias("table_id")).agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", cells.alias("cells")))).alias("r"), F.max("l_linenumber").cast("string").alias("pages"))
    body = F.transform("r", lambda x: x["cells"])
    return rows.select("table_id", F.when(F.col("table_id") % 2 == 0, F.concat(F.lit("Table "), text("table_id"))).otherwise("").alias("caption"), "pages", F.when(F.col("table_id") % 3 == 0, F.lit("%, USD")).otherwise("").alias("units"), F.concat(F.array(F.array(F.lit("Line"), F.lit("Part"), F.lit("Supplier"))), body).alias("rows"))


_TABLES = """tb AS (SELECT l_orderkey AS table_id, list([l_linenumber::VARCHAR, l_partkey::VARCHAR, CASE WHEN l_suppkey % 3 = 0 THEN '<a & ''b''>' ELSE l_suppkey::VARCHAR END] ORDER BY l_linenumber, l_partkey, l_suppkey) AS body, max(l_linenumber) AS pages FROM lineitem GROUP BY 1)"""


def table_chunks(spark: SparkSession, d: str) -> DataFrame:
    return G.table_chunks(_tables(spark, d)).select("table_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "chunk_type", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"))


TABLE_CHUNKS = f"""WITH {_TABLES}, p AS (SELECT table_id, body, pages, unnest(range(0, greatest(ceil(len(body) / 6), 1)::BIGINT)) AS k FROM tb),
c AS (SELECT table_id, k AS chunk_no, CASE WHEN len(body) > 6 THEN 'table_segment' ELSE 'full_table' END AS chunk_type, '|Line|Part|Supplier|' || chr(10) || '|---|---|---|' || array_to_string(list_transform(body[k * 6 + 1:k * 6 + 6], lambda z: chr(10) || '|' || array_to_string(z, '|') || '|'), '') AS text FROM p
UNION ALL SELECT table_id, greatest(ceil(len(body) / 6), 1)::BIGINT, 'table_summary_text', concat_ws(chr(10), CASE WHEN table_id % 2 = 0 THEN 'Table summary: Table ' || table_id ELSE 'Table summary' END, 'Pages: ' || pages, 'Columns: Line, Part, Supplier', CASE WHEN table_id % 3 = 0 THEN 'Units: %, USD' END) FROM tb)
SELECT table_id, chunk_no, chunk_type, length(text) AS chars, sha256(text) AS digest FROM c"""


def table_html(spark: SparkSession, d: str) -> DataFrame:
    rows = _tables(spark, d)
    return rows.select("table_id", F.sha2(G.table_html(F.col("rows")), 256).alias("html"), F.sha2(L.labelled_rows(F.col("rows")), 256).alias("labelled"))


TABLE_HTML = f"""WITH {_TABLES} SELECT table_id, sha256('<table><thead><tr><th>Line</th><th>Part</th><th>Supplier</th></tr></thead><tbody>' || array_to_string(list_transform(body, lambda z: '<tr>' || array_to_string(list_transform(z, lambda c: '<td>' || replace(replace(replace(replace(c, '&', '&amp;'), '<', '&lt;'), '>', '&gt;'), '''', '&#x27;') || '</td>'), '') || '</tr>'), '') || '</tbody></table>') AS html,
sha256(array_to_string(list_transform(body, lambda z, i: 'row_' || i || ': Line=' || z[1] || '; Part=' || z[2] || '; Supplier=' || z[3]), chr(10))) AS labelled FROM tb"""


def figure_fields(spark: SparkSession, d: str) -> DataFrame:
    """What captions of parts tell of their figures."""
    p, n = S.table(spark, d, "part"), F.col("p_partkey")
    caption = F.concat(F.element_at(F.array(*map(F.lit, ("Bar chart of rents", "Trend line", "Flow diagram", "An Infographic", "Photo of a lobby"))), (n % 5 + 1).cast("int")), F.lit(" from "), F.col("p_size").cast("string"))
    nearby = F.when(n % 3 != 0, F.concat(F.lit("to  "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" in all"))).otherwise(F.lit(""))
    kind = F.element_at(F.array(F.lit("image"), F.lit("vector_dense"), F.lit("hint")), (n % 3 + 1).cast("int"))
    return p.select(n.alias("figure_id"), *(c.alias(k) for k, c in G.figure_fields(caption, nearby, kind).items()))


FIGURE_FIELDS = r"""WITH f AS (SELECT p_partkey AS id, ['Bar chart of rents', 'Trend line', 'Flow diagram', 'An Infographic', 'Photo of a lobby'][(p_partkey % 5 + 1)::INT] || ' from ' || p_size AS cap, CASE WHEN p_partkey % 3 <> 0 THEN 'to  ' || p_retailprice::DECIMAL(12,2) || ' in all' ELSE '' END AS near FROM part),
g AS (SELECT *, lower(cap || ' ' || near) AS w, list_transform(regexp_extract_all(cap || ' ' || near, '\b\d+(?:\.\d+)?\b'), lambda x: x::DOUBLE) AS ns FROM f),
h AS (SELECT *, CASE WHEN contains(w, 'infographic') THEN 'infographic' WHEN contains(w, 'diagram') THEN 'diagram' WHEN regexp_matches(w, 'chart|graph|plot|trend') THEN 'chart' WHEN id % 3 = 1 THEN 'diagram' WHEN id % 3 = 0 THEN 'photo' ELSE 'unknown' END AS kind FROM g)
SELECT id AS figure_id, kind AS figure_type, kind IN ('chart', 'diagram', 'infographic') OR regexp_matches(lower(cap), 'chart|graph|bar|line|trend|histogram') AS is_chart, CASE WHEN contains(w, 'bar') THEN 'bar' WHEN regexp_matches(w, 'line|trend') THEN 'line' ELSE 'unknown' END AS chart_type,
CASE WHEN len(ns) >= 2 THEN ns[1] END AS first_value, CASE WHEN len(ns) >= 2 THEN ns[-1] END AS last_value, CASE WHEN len(ns) < 2 THEN NULL WHEN ns[-1] > ns[1] THEN 'Increasing trend' WHEN ns[-1] < ns[1] THEN 'Decreasing trend' ELSE 'Flat trend' END AS trend, CASE WHEN len(ns) >= 2 THEN 0.42 END::DOUBLE AS confidence FROM h"""


def page_summaries(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", F.sha2(G.fallback_summary(F.coalesce("text", F.lit(""))), 256).alias("summary"))


PAGE_SUMMARIES = r"""WITH n AS (SELECT doc_id, coalesce(text, '') AS t, array_to_string(regexp_extract_all(coalesce(text, ''), '\b\d+[.,]?\d*%?\b')[:12], ', ') AS ns FROM documents)
SELECT doc_id, sha256(concat_ws(chr(10), CASE WHEN ns <> '' THEN 'Numbers: ' || ns END, substr(trim(regexp_replace(t, '\s+', ' ', 'g')), 1, 600))) AS summary FROM n"""


# What answers are made of


def answer_tags(spark: SparkSession, d: str) -> DataFrame:
    """Messages with tags of thought and answer, some never closed, taken apart."""
    c, n, text = S.table(spark, d, "conversations"), F.col("conv_id") + F.col("turn"), F.substring("text", 1, 200)
    forms = [text, F.concat(F.lit("<thinking> on "), text, F.lit("</thinking> <Answer> it is "), F.col("turn").cast("string"), F.lit(" </Answer>")), F.concat(F.lit("<THINKING>x</THINKING>"), text), F.concat(F.lit("<thinking>never\nclosed <answer> so "), text), F.concat(text, F.lit(" <thinking open>lost"))]
    made = c.select("conv_id", "turn", "role", F.element_at(F.array(*forms), (n % 5 + 1).cast("int")).alias("said"))
    answer, reasoning = A.split_reasoning(F.col("said"))
    return made.select("conv_id", "turn", "role", F.sha2(answer, 256).alias("answer"), reasoning.isNotNull().alias("reasoned"), F.length(F.coalesce(reasoning, F.lit(""))).cast("bigint").alias("reasoning_chars"))


ANSWER_TAGS = r"""WITH c AS (SELECT conv_id, turn, role, substr(text, 1, 200) AS t, (conv_id + turn) % 5 AS k FROM conversations), s AS (SELECT *, regexp_replace(t, '^\s+|\s+$', '', 'g') AS u FROM c)
SELECT conv_id, turn, role, sha256(CASE k WHEN 0 THEN u WHEN 1 THEN 'it is ' || turn WHEN 2 THEN u WHEN 3 THEN regexp_replace(' so ' || t, '^\s+|\s+$', '', 'g') ELSE u END) AS answer, k IN (1, 2) AS reasoned,
CASE k WHEN 1 THEN length(regexp_replace(' on ' || t, '^\s+|\s+$', '', 'g')) WHEN 2 THEN 1 ELSE 0 END AS reasoning_chars FROM s"""


def session_summaries(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations").where("role <> 'system'")
    return A.session_summary(c, "conv_id").select("conv_id", "turns", F.sha2("summary", 256).alias("summary"))


SESSION_SUMMARIES = r"""WITH t AS (SELECT *, trim(regexp_replace(text, '\s+', ' ', 'g')) AS s FROM conversations WHERE role <> 'system' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 8)
SELECT conv_id, count(*) AS turns, sha256(string_agg(CASE role WHEN 'user' THEN 'User: ' ELSE 'Assistant: ' END || CASE WHEN length(s) > 180 THEN rtrim(s[:177]) || '...' ELSE s END, chr(10) ORDER BY turn, role)) AS summary FROM t GROUP BY 1"""


def prompt_budgets(spark: SparkSession, d: str) -> DataFrame:
    """Tokens for each part of a prompt, for a base of as many tokens as the conversation's messages have."""
    words = F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+"))
    c = S.table(spark, d, "conversations").groupBy("conv_id").agg((F.sum(words) + F.count("*") * 8).cast("bigint").alias("base"))
    return c.select("conv_id", "base", *(v.alias(k) for k, v in A.budgets(F.lit(2000), F.col("base")).items()))


PROMPT_BUDGETS = r"""WITH b AS (SELECT conv_id, (sum(len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+'))) + count(*) * 8)::BIGINT AS base FROM conversations GROUP BY 1), r AS (SELECT *, greatest(256, 2000 - base) AS r FROM b),
p AS (SELECT conv_id, base, floor(r * 0.35::DOUBLE)::BIGINT AS history, floor(r * 0.1::DOUBLE)::BIGINT AS summary, floor(r * 0.15::DOUBLE)::BIGINT AS cross_session, floor(r * 0.1::DOUBLE)::BIGINT AS conflict, floor(r * 0.1::DOUBLE)::BIGINT AS notes, r FROM r)
SELECT * EXCLUDE (r), greatest(128, r - history - summary - cross_session - conflict - notes)::BIGINT AS evidence FROM p"""


def entity_coverage(spark: SparkSession, d: str) -> DataFrame:
    """How often the ranked rows of a comparison name each of its sides, and what to ask for where one is named too rarely."""
    n = F.col("qid")
    names = F.array(F.lit("Alpha Realty"), F.lit("Bxp"), F.lit("Digital"), F.lit("Psa Storage"))
    pick = lambda k: F.element_at(names, ((n + k) % 4 + 1).cast("int"))
    rows = reranked(spark, d).select("qid", "node_id", F.lower(F.concat_ws(" ", F.coalesce("text", F.lit("")), F.when(F.col("node_id") % 3 == 0, pick(0)), F.when(F.col("node_id") % 5 == 0, pick(1)))).alias("text"))
    asked = rows.select("qid").distinct().select("qid", F.concat(F.lit("What growth outlook does "), pick(0), F.when(n % 3 == 0, F.lit(" have")).otherwise(F.concat(F.lit(" have compared with "), pick(1))), F.lit(" this quarter?")).alias("question"))
    return A.entity_coverage(asked, rows)


ENTITY_COVERAGE = rf"""WITH {RERANKED}, nm AS (SELECT ['Alpha Realty', 'Bxp', 'Digital', 'Psa Storage'] AS names),
eq AS (SELECT DISTINCT qid, names[(qid % 4 + 1)::INT] AS a, CASE WHEN qid % 3 <> 0 THEN names[((qid + 1) % 4 + 1)::INT] END AS b FROM ranked, nm),
et AS (SELECT r.qid, lower(concat_ws(' ', coalesce(text, ''), CASE WHEN node_id % 3 = 0 THEN names[(qid % 4 + 1)::INT] END, CASE WHEN node_id % 5 = 0 THEN names[((qid + 1) % 4 + 1)::INT] END)) AS text FROM ranked r, nm),
eh AS (SELECT eq.qid, a, b, count(*) FILTER (contains(text, lower(a))) AS ha, count(*) FILTER (contains(text, lower(b))) AS hb FROM eq JOIN et USING (qid) WHERE b IS NOT NULL GROUP BY 1, 2, 3)
SELECT qid, CASE WHEN ha <= hb THEN a ELSE b END AS weakest, least(ha, hb) AS hits, least(ha, hb) >= 3 AS sufficient, CASE WHEN least(ha, hb) < 3 THEN CASE WHEN ha <= hb THEN a ELSE b END || ' growth outlook compared quarter' END AS gap FROM eh"""


def attribution(spark: SparkSession, d: str) -> DataFrame:
    """Whether the right version and a conflict are among the first rows of each question, and how many there are of each document and version."""
    n = F.col("node_id")
    rows = reranked(spark, d).select(
        "qid", "rank", F.concat(F.lit(" V"), (n % 5).cast("string")).alias("version_label"), F.when(n % 17 == 0, F.lit("numeric_disagreement")).alias("conflict_type"), (F.col("version_group") % 7).cast("string").alias("version_group"), F.when(n % 2 == 0, F.col("document_name")).alias("document_label")
    )
    expected = rows.select("qid").distinct().select("qid", F.when(F.col("qid") % 4 != 0, F.concat(F.lit("v"), (F.col("qid") % 5).cast("string"))).alias("expected_version"), (F.col("qid") % 3 == 0).alias("expect_conflict"))
    return A.attribution(rows, expected)


ATTRIBUTION = f"""WITH {RERANKED}, ra AS (SELECT qid, 'v' || (node_id % 5) AS v, node_id % 17 = 0 AS c, node_id % 2 = 0 AS named, version_group % 7 AS g, document_name FROM ranked)
SELECT qid, CASE WHEN qid % 4 <> 0 AND bool_or(v = 'v' || (qid % 5)) THEN 1.0 ELSE 0.0 END::DOUBLE AS version_attribution, CASE WHEN qid % 3 <> 0 OR bool_or(c) THEN 1.0 ELSE 0.0 END::DOUBLE AS conflict_attribution,
count(DISTINCT v) AS versions, count(DISTINCT CASE WHEN named THEN document_name ELSE 'group ' || g END) AS documents FROM ra GROUP BY qid"""


def best_chunks(spark: SparkSession, d: str) -> DataFrame:
    """The best ranked row of each client's file in a question, and the sample that an evaluator reads: the two best and three spread over the rest."""
    rows = reranked(spark, d)
    sample = A.evaluator_sample(rows, "qid", "rank").select("qid", "node_id", F.lit(True).alias("sampled"))
    best = rows.groupBy("qid", "client_id").agg(F.max_by("node_id", F.struct("final", (-F.col("node_id")).alias("first"))).alias("node_id"), F.max("final").alias("final"))
    return best.join(sample, ["qid", "node_id"], "left").select("qid", "client_id", "node_id", "final", F.coalesce("sampled", F.lit(False)).alias("sampled"))


BEST_CHUNKS = f"""WITH {RERANKED}, b AS (SELECT qid, client_id, arg_max(node_id, (final, -node_id)) AS node_id, max(final) AS final FROM ranked GROUP BY 1, 2),
n AS (SELECT qid, node_id, rank, count(*) OVER (PARTITION BY qid) AS n FROM ranked), s AS (SELECT qid, node_id FROM n WHERE rank <= 2 OR (n - 2 <= 3) OR (rank - 3) % greatest(1, (n - 2) // 3) = 0 AND (rank - 3) // greatest(1, (n - 2) // 3) < 3)
SELECT b.*, s.node_id IS NOT NULL AS sampled FROM b LEFT JOIN s USING (qid, node_id)"""

QUERIES = {
    "region_kinds": region_kinds, "layout_hints": layout_hints, "region_joins": region_joins, "table_chunks": table_chunks, "table_html": table_html, "figure_fields": figure_fields, "page_summaries": page_summaries,
    "answer_tags": answer_tags, "session_summaries": session_summaries, "prompt_budgets": prompt_budgets, "entity_coverage": entity_coverage, "attribution": attribution, "best_chunks": best_chunks,
}
ORACLES = {
    "region_kinds": REGION_KINDS, "layout_hints": LAYOUT_HINTS, "region_joins": REGION_JOINS, "table_chunks": TABLE_CHUNKS, "table_html": TABLE_HTML, "figure_fields": FIGURE_FIELDS, "page_summaries": PAGE_SUMMARIES,
    "answer_tags": ANSWER_TAGS, "session_summaries": SESSION_SUMMARIES, "prompt_budgets": PROMPT_BUDGETS, "entity_coverage": ENTITY_COVERAGE, "attribution": ATTRIBUTION, "best_chunks": BEST_CHUNKS,
}
