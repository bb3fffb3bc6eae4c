"""The query of staged ingestion with two stages replaced, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..operators import regions as G, stages as I
from ..sources import collections as C, tables as S
from .artifacts import _AROUND, _SQUEEZE, _TEXT
from .regions import _KINDS

#: Tables and notes of a page that are reasoned about.
MOST_REASONED = 4


def barred_lines(documents: DataFrame) -> I.Tables:
    """Lines as ``extract_lines`` takes them; on every third one what commas part are cells, and a total follows."""
    made = dict(I.extract_lines(documents))
    made["regions"] = made["regions"].withColumn("text", F.when(F.col("region_id") % 3 == 1, F.concat(F.replace("text", F.lit(", "), F.lit(" | ")), F.lit(" | total | "), F.col("region_id").cast("string"))).otherwise(F.col("text")))
    return made


def counted_tables(pages: DataFrame, tables: DataFrame) -> I.Tables:
    """A stand-in for a model that says what it makes of a page's tables, the first of them at most."""
    nth = F.row_number().over(Window.partitionBy("page").orderBy("table_id"))
    rows = tables.withColumn("nth", nth).where(F.col("nth") <= MOST_REASONED)
    text = F.concat(F.lit("Table of "), F.length("text").cast("string"), F.lit(" characters in "), F.col("section"))
    return {"reasoning": rows.select("page", "document_id", "page_num", F.concat(F.col("page"), F.lit("/"), "table_id").alias("reasoning_id"), F.when(F.col("page_num") % 2 == 1, "table_reasoning").otherwise("other").alias("reasoning_type"), text.alias("text"))}


def staged_units(spark: SparkSession, d: str) -> DataFrame:
    """Units of all documents by the line with another extraction and enrichment; texts as length and digest. What several stages read is written once."""
    line = I.ingestion().with_stage("extract", barred_lines).with_stage("enrich", counted_tables)
    documents = S.table(spark, d, "documents").select(F.col("doc_id").alias("document_id"), "text", F.lit(1).alias("page"))
    units = line.run({"documents": documents}, I.kept_in(C.work_path(spark, "ingestion"), I.SHARED))["units"]
    text = F.col("raw_text")
    return units.select("unit_id", "document_id", "page_num", "chunk_no", "unit_type", "section_path", F.length(text).cast("bigint").alias("chars"), F.sha2(text, 256).alias("digest"), "table_detected", "chart_detected", "contains_numeric_data", "page_class", "complexity", "layout_confidence")


_BODY = ", ".join(f"'{k}'" for k in I.BODY_KINDS)
_NAMESPACE = "'" + I.NAMESPACE_URL.replace("-", "") + "'"
STAGED_UNITS = rf"""WITH li AS (SELECT doc_id AS document_id, unnest(string_split(coalesce(text, ''), chr(10))) AS line, generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) - 1 AS n FROM documents),
rg AS (SELECT document_id || ':' || (n // 40 + 1) AS page, document_id, n // 40 + 1 AS page_num, n AS region_id, 0.0::DOUBLE AS x0, 100.0 + n % 40 * 15.0 AS y0, length(line) * 5.0 AS x1, 112.0 + n % 40 * 15.0 AS y1, CASE WHEN n % 3 = 1 THEN replace(line, ', ', ' | ') || ' | total | ' || n ELSE line END AS text, '' AS label FROM li WHERE trim(line) <> ''),
{_KINDS},
ty AS (SELECT *, coalesce(last_value(CASE WHEN kind IN ('title', 'section_heading', 'subsection_heading') THEN trim(text) END IGNORE NULLS) OVER (PARTITION BY document_id ORDER BY region_id ROWS UNBOUNDED PRECEDING), 'Document') AS section,
  CASE WHEN kind IN ({", ".join(f"'{k}'" for k in G.TEXT_KINDS)}) THEN 0.9 WHEN kind IN ('caption', 'table_region', 'figure_region') THEN 0.82 WHEN kind IN ('footnote', 'header', 'footer') THEN 0.72 ELSE 0.75 END AS sure FROM k3),
pa AS (SELECT page, document_id, page_num, count(*) AS n, count(*) FILTER (kind = 'table_region') AS t, count(*) FILTER (kind = 'figure_region') AS f, round(avg(sure::DOUBLE), 4) AS layout_confidence FROM ty GROUP BY 1, 2, 3),
pb AS (SELECT *, round((CASE WHEN t > 0 THEN 0.3 ELSE 0 END + CASE WHEN f > 0 THEN 0.25 ELSE 0 END + CASE WHEN n >= 30 THEN 0.2 ELSE 0 END)::DOUBLE, 6) AS complexity FROM pa),
pc AS (SELECT *, CASE WHEN t > 0 AND complexity >= 0.4 THEN 'table_heavy_page' WHEN f > 0 THEN 'visual_heavy_page' WHEN complexity >= 0.65 OR n >= 45 THEN 'hard_page' ELSE 'simple_text_page' END AS page_class FROM pb),
tr AS (SELECT page, min(x0) AS x0, min(y0) AS y0, max(x1) AS x1, max(y1) AS y1, string_agg(text, chr(10) ORDER BY region_id) AS t FROM k3 WHERE kind = 'table_region' GROUP BY page),
tl AS (SELECT * EXCLUDE (t), list_filter(list_transform(list_filter(list_transform(string_split(t, chr(10)), lambda x: trim(x)), lambda x: x <> ''), lambda x: list_filter(list_transform(CASE WHEN contains(x, '|') THEN string_split(x, '|') WHEN contains(x, chr(9)) THEN string_split(x, chr(9)) ELSE regexp_split_to_array(x, '\s{{2,}}') END,
  lambda c: {_SQUEEZE}), lambda c: c <> '')), lambda z: len(z) >= 2) AS rows FROM tr),
tb AS (SELECT *, page AS anchor_id FROM tl WHERE len(rows) >= 2){_AROUND.format(b='tb')},
tt AS (SELECT p.page, document_id, page_num, 'text_regions_page_' || p.page AS table_id, caption, section, {_TEXT.replace("rows[1][j]", "coalesce(rows[1][j], 'column_' || j)")} AS text FROM tbp p JOIN pa ON pa.page = p.page),
ch AS (SELECT page, document_id, page_num, 0 AS k, min(region_id) AS nth, 'body_text' AS unit_type, section AS section_path, string_agg(text, chr(10) ORDER BY region_id) AS text FROM ty WHERE kind IN ({_BODY}) OR (kind = 'table_region' AND page NOT IN (SELECT page FROM tt)) GROUP BY page, document_id, page_num, section
  UNION ALL SELECT page, document_id, page_num, 1, 0, 'full_table', section, trim(concat_ws(chr(10), nullif(caption, ''), text)) FROM tt
  UNION ALL SELECT pc.page, pc.document_id, pc.page_num, 2, 0, 'page_card', 'Page', concat_ws(chr(10), 'Page ' || pc.page || ' summary', 'Class: ' || page_class, 'Layout confidence: ' || layout_confidence::DECIMAL(4,2), 'Tables: ' || (tt.page IS NOT NULL)::INT, 'Figures: 0', 'Table captions: ' || caption)
    FROM pc LEFT JOIN tt ON tt.page = pc.page WHERE page_class <> 'simple_text_page' OR tt.page IS NOT NULL
  UNION ALL SELECT page, document_id, page_num, 3, 0, CASE WHEN page_num % 2 = 1 THEN 'reasoning_table' ELSE 'reasoning_page' END, 'Reasoning Enrichment', 'Table of ' || length(text) || ' characters in ' || section FROM tt),
cn AS (SELECT *, row_number() OVER (PARTITION BY document_id ORDER BY page_num, k, nth) AS chunk_no, regexp_replace(text, '^\s+|\s+$', '', 'g') AS raw FROM ch),
cu AS (SELECT *, sha1(unhex({_NAMESPACE}) || encode(document_id || ':' || chunk_no)) AS h FROM cn)
SELECT h[:8] || '-' || h[9:12] || '-5' || h[14:16] || '-' || translate(h[17:17], '0123456789abcdef', '89ab89ab89ab89ab') || h[18:20] || '-' || h[21:32] AS unit_id, cu.document_id AS document_id, cu.page_num AS page_num, chunk_no, unit_type, section_path, length(raw) AS chars, sha256(raw) AS digest,
unit_type = 'full_table' AS table_detected, false AS chart_detected, len(regexp_extract_all(raw, '\b\d+[.,]?\d*%?\b')) >= 3 AS contains_numeric_data, page_class, complexity, layout_confidence FROM cu JOIN pc ON pc.page = cu.page"""

QUERIES = {"staged_units": staged_units}
ORACLES = {"staged_units": STAGED_UNITS}
