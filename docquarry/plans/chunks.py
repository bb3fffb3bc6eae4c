"""Queries of figure chunks, page cards, page choice, pasted points and chat pairs, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import chunks as C, regions as G
from ..sources import tables as S
from .regions import FIGURE_FIELDS
from .search import FUSED, _lists


def _figures(spark: SparkSession, d: str) -> DataFrame:
    p, n = S.table(spark, d, "part"), F.col("p_partkey")
    caption = F.concat(F.element_at(F.array(*map(F.lit, ("Bar chart of rents", "Trend line", "Flow diagram", "An Infographic", "Photo of a lobby"))), (n % 5 + 1).cast("int")), F.lit(" from "), F.col("p_size").cast("string"))
    nearby = F.when(n % 3 != 0, F.concat(F.lit("to  "), F.col("p_retailprice").cast("decimal(12,2)").cast("string"), F.lit(" in all"))).otherwise(F.lit(""))
    kind = F.element_at(F.array(F.lit("image"), F.lit("vector_dense"), F.lit("hint")), (n % 3 + 1).cast("int"))
    fields = G.figure_fields(caption, nearby, kind)
    whole = lambda c: F.floor(c).cast("bigint")
    return p.select(n.alias("figure_id"), caption.alias("caption"), nearby.alias("nearby"), F.concat(F.lit("seen: "), F.col("p_brand")).alias("proxy"), *(fields[k].alias(k) for k in ("figure_type", "chart_type", "trend")), whole(fields["first_value"]).alias("first_value"), whole(fields["last_value"]).alias("last_value"))


def figure_chunks(spark: SparkSession, d: str) -> DataFrame:
    return C.figure_chunks(_figures(spark, d)).select("figure_id", "chunk_no", "chunk_type", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("digest"))


FIGURE_CHUNKS = f"""{FIGURE_FIELDS.split('SELECT id AS figure_id')[0].rstrip()},
v AS (SELECT h.*, 'seen: ' || p_brand AS proxy, CASE WHEN contains(w, 'bar') THEN 'bar' WHEN regexp_matches(w, 'line|trend') THEN 'line' ELSE kind END AS ctype, kind IN ('chart', 'diagram', 'infographic') AS charty, len(ns) >= 2 AS known, floor(ns[1])::BIGINT AS v1, floor(ns[-1])::BIGINT AS v2,
  CASE WHEN len(ns) < 2 THEN NULL WHEN ns[-1] > ns[1] THEN 'Increasing trend' WHEN ns[-1] < ns[1] THEN 'Decreasing trend' ELSE 'Flat trend' END AS trend FROM h JOIN part ON p_partkey = id),
c AS (SELECT id, 1 AS k, 'figure_artifact' AS chunk_type, trim(concat_ws(chr(10), cap, nullif(near, ''))) AS text FROM v UNION ALL SELECT id, 2, 'visual_proxy_text', proxy FROM v UNION ALL SELECT id, 3, 'chart_context', trim(concat_ws(chr(10), trend, near)) FROM v WHERE charty AND near <> ''
  UNION ALL SELECT id, 4, 'chart_data_points', concat_ws(chr(10), 'Chart type: ' || ctype, 'Title: ' || cap, 'Trend: ' || trend, CASE WHEN known THEN 'Approximate datapoints:' || chr(10) || '- derived_series | x=start | y=' || v1 || ' (approx)' || chr(10) || '- derived_series | x=end | y=' || v2 || ' (approx)' END, 'Note: numeric values may be approximate.') FROM v WHERE charty)
SELECT id AS figure_id, row_number() OVER (PARTITION BY id ORDER BY k) - 1 AS chunk_no, chunk_type, length(text) AS chars, sha256(text) AS digest FROM c"""


def _page_rows(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Pages (orders) and what is on them (their lines)."""
    o, n = S.table(spark, d, "orders"), F.col("o_orderkey")
    kind = F.when(n % 4 == 0, "table_heavy_page").when(n % 4 == 1, "hard_page").otherwise("simple_text_page")
    pages = o.select(n.alias("page"), F.col("o_custkey").alias("document_id"), kind.alias("page_class"), ((n % 30) / 100 + 0.7).alias("confidence"), ((n % 10) / 10).alias("complexity"), (n % 6 == 0).alias("degraded"))
    line = S.table(spark, d, "lineitem").where("l_linenumber <= 4 AND l_returnflag <> 'N'")
    made = line.groupBy(F.col("l_orderkey").alias("page"), F.col("l_linenumber").alias("artifact_id")).agg(F.max("l_partkey").alias("part"))
    made = made.select("page", "artifact_id", F.when(F.col("part") % 2 == 0, "table").otherwise("figure").alias("kind"), F.concat(F.lit("caption "), F.col("part").cast("string")).alias("caption"), (F.col("part") % 3 == 0).alias("bare"))
    return pages, made


_PAGES = """pg AS (SELECT o_orderkey AS page, o_custkey AS document_id, CASE o_orderkey % 4 WHEN 0 THEN 'table_heavy_page' WHEN 1 THEN 'hard_page' ELSE 'simple_text_page' END AS page_class, (o_orderkey % 30) / 100 + 0.7 AS confidence, (o_orderkey % 10) / 10 AS complexity, o_orderkey % 6 = 0 AS degraded FROM orders),
ar AS (SELECT page, artifact_id, CASE WHEN part % 2 = 0 THEN 'table' ELSE 'figure' END AS kind, 'caption ' || part AS caption, part % 3 = 0 AS bare FROM (SELECT l_orderkey AS page, l_linenumber AS artifact_id, max(l_partkey) AS part FROM lineitem WHERE l_linenumber <= 4 AND l_returnflag <> 'N' GROUP BY 1, 2))"""


def page_cards(spark: SparkSession, d: str) -> DataFrame:
    return C.page_cards(*_page_rows(spark, d)).select("page", "tables", "figures", F.sha2("text", 256).alias("digest"))


PAGE_CARDS = f"""WITH {_PAGES}, n AS (SELECT *, row_number() OVER (PARTITION BY page, kind ORDER BY artifact_id) AS nth FROM ar),
g AS (SELECT page, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'figure') AS figures, string_agg(caption, '; ' ORDER BY nth) FILTER (kind = 'table' AND nth <= 3) AS tc, string_agg(caption, '; ' ORDER BY nth) FILTER (kind = 'figure' AND nth <= 3) AS fc FROM n GROUP BY 1),
j AS (SELECT pg.*, coalesce(tables, 0) AS tables, coalesce(figures, 0) AS figures, tc, fc FROM pg LEFT JOIN g USING (page))
SELECT page, tables, figures, sha256(concat_ws(chr(10), 'Page ' || page || ' summary', 'Class: ' || page_class, 'Layout confidence: ' || confidence::DECIMAL(4,2), 'Tables: ' || tables, 'Figures: ' || figures, 'Table captions: ' || tc, 'Figure captions: ' || fc)) AS digest FROM j WHERE page_class <> 'simple_text_page' OR tables + figures > 0"""


def page_choice(spark: SparkSession, d: str) -> DataFrame:
    """The pages of each document whose charts a model should read, and those whose tables and figures it should describe: three of each."""
    pages, artifacts = _page_rows(spark, d)
    held = artifacts.groupBy("page").agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "figure").alias("figures"), F.count_if((F.col("kind") == "figure") & F.col("bare")).alias("bare"))
    rows = pages.join(held, "page")
    weight = C.page_weight(F.col("page_class"), F.col("degraded"), F.col("complexity"))
    charts = F.when(F.col("figures") > 0, F.col("figures") * C.CHART_WEIGHT + F.col("bare") * C.BARE_CHART_WEIGHT + weight)
    whole = F.when(F.col("page_class") != "simple_text_page", F.col("tables") * C.TABLE_WEIGHT + F.col("figures") * C.FIGURE_WEIGHT + weight)
    one = lambda name, priority: C.chosen_pages(rows, "document_id", priority, 3).select(F.lit(name).alias("choice"), "document_id", "page", "priority", "place")
    return one("charts", charts).unionByName(one("enrichment", whole))


PAGE_CHOICE = f"""WITH {_PAGES}, g AS (SELECT page, count(*) FILTER (kind = 'table') AS tables, count(*) FILTER (kind = 'figure') AS figures, count(*) FILTER (kind = 'figure' AND bare) AS bare FROM ar GROUP BY 1),
j AS (SELECT *, CASE WHEN page_class <> 'simple_text_page' THEN 2.0 ELSE 1.0 END + CASE WHEN degraded THEN 1.0 ELSE 0.0 END + complexity AS w FROM pg JOIN g USING (page)),
p AS (SELECT 'charts' AS choice, document_id, page, round((figures * 3.0 + bare * 1.5 + w)::DOUBLE, 6) AS priority FROM j WHERE figures > 0 UNION ALL SELECT 'enrichment', document_id, page, round((tables * 2.5 + figures * 2.0 + w)::DOUBLE, 6) FROM j WHERE page_class <> 'simple_text_page')
SELECT *, row_number() OVER (PARTITION BY choice, document_id ORDER BY priority DESC, page DESC) AS place FROM p QUALIFY place <= 3"""


def pasted_points(spark: SparkSession, d: str) -> DataFrame:
    e, n = S.table(spark, d, "events"), F.col("event_id").cast("string")
    one = F.concat(F.lit('{"id": '), n, F.lit(', "name": "a, ]{"}'))
    forms = [one, F.concat(F.lit(" ["), one, F.lit(', {"id": 0}]')), F.concat(F.lit('{"points": ['), one, F.lit("]}")), F.concat(F.lit("["), one, F.lit(", 5]")), F.lit("  "), F.lit("{broken"), F.lit("7")]
    made = e.select("event_id", F.element_at(F.array(*forms), (F.col("event_id") % len(forms) + 1).cast("int")).alias("raw"))
    out = C.pasted_points(made, "event_id", "raw")
    return out.select("event_id", F.col("point_no").cast("bigint").alias("point_no"), "state", F.get_json_object("point", "$.id").alias("id"), F.get_json_object("point", "$.name").alias("name"))


PASTED_POINTS = """WITH e AS (SELECT event_id, event_id % 7 AS k FROM events)
SELECT event_id, 0 AS point_no, CASE WHEN k < 3 THEN 'ok' ELSE 'error' END AS state, CASE WHEN k < 3 THEN event_id::VARCHAR END AS id, CASE WHEN k < 3 THEN 'a, ]{' END AS name FROM e WHERE k <> 4
UNION ALL SELECT event_id, 1, 'ok', '0', NULL FROM e WHERE k = 1"""


def chat_pairs(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations").selectExpr("conv_id", "conv_id % 10 AS client_id", "turn", "role", "text", "conv_id * 1000 + turn AS message_id")
    return C.chat_pairs(c).select("point_id", "client_id", "conv_id", "message_id", F.length("user_text").cast("bigint").alias("asked"), F.length("assistant_text").cast("bigint").alias("answered"))


CHAT_PAIRS = f"""WITH p AS (SELECT conv_id, conv_id % 10 AS client_id, conv_id * 1000 + turn AS message_id, role, text, lag(role) OVER w AS br, lag(text) OVER w AS bt FROM conversations WINDOW w AS (PARTITION BY conv_id ORDER BY turn)),
h AS (SELECT *, sha1(unhex('{C.NAMESPACE_URL.replace("-", "")}') || encode(client_id || ':' || conv_id || ':' || message_id)) AS x FROM p WHERE role = 'assistant' AND br = 'user' AND trim(coalesce(bt, '')) <> '' AND trim(coalesce(text, '')) <> '')
SELECT x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || translate(x[17], '0123456789abcdef', '89ab89ab89ab89ab') || x[18:20] || '-' || x[21:32] AS point_id, client_id, conv_id, message_id, length(bt) AS asked, length(text) AS answered FROM h"""


def variant_counts(spark: SparkSession, d: str) -> DataFrame:
    sparse, other = _lists(spark, d)
    # The exchange is that of ``search.fused``.
    return C.variant_counts(sparse.withColumn("variant", F.lit("terms")).unionByName(other.withColumn("variant", F.lit("overlap"))).repartition("qid", "node_id"))


VARIANT_COUNTS = f"""WITH {FUSED}, vl AS (SELECT qid, node_id, 'terms' AS variant FROM sparse UNION ALL SELECT qid, node_id, 'overlap' FROM overlap), vn AS (SELECT *, count(*) OVER (PARTITION BY qid, node_id) = 1 AS alone FROM vl)
SELECT qid, variant, count(*) AS found, count(*) FILTER (alone) AS own FROM vn GROUP BY 1, 2"""

QUERIES = {"figure_chunks": figure_chunks, "page_cards": page_cards, "page_choice": page_choice, "pasted_points": pasted_points, "chat_pairs": chat_pairs, "variant_counts": variant_counts}
ORACLES = {"figure_chunks": FIGURE_CHUNKS, "page_cards": PAGE_CARDS, "page_choice": PAGE_CHOICE, "pasted_points": PASTED_POINTS, "chat_pairs": CHAT_PAIRS, "variant_counts": VARIANT_COUNTS}
