"""Queries of ingestion, chunk metadata and document views, and the same in SQL."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as T, versions
from ..operators import ingest as I, relational as R
from ..sources import tables as S


def text_signals(spark: SparkSession, d: str) -> DataFrame:
    t = F.col("text")
    return S.table(spark, d, "documents").select("doc_id", T.has_numeric_data(t).alias("numeric"), T.numeric_density(t).alias("density"), T.has_table_signals(t).alias("table_like"), T.has_chart_signals(t).alias("chart_like"), T.units(t).alias("units"))


TEXT_SIGNALS = r"""WITH a AS (SELECT doc_id, coalesce(text, '') AS t, len(regexp_extract_all(coalesce(text, ''), '\b\d+[.,]?\d*%?\b')) AS n, len(regexp_extract_all(coalesce(text, ''), '\S+')) AS w,
 len(list_filter(string_split(trim(coalesce(text, '')), chr(10)), lambda x: contains(x, chr(9)) OR length(x) - length(replace(x, '|', '')) >= 2)) AS lines FROM documents)
SELECT doc_id, n >= 3 AS numeric, CASE WHEN w > 0 THEN round(least(1.0, n / w), 4) ELSE 0.0 END::DOUBLE AS density,
 lines >= 2 OR (lines = 1 AND (n >= 3 OR regexp_matches(lower(t), '\b(q[1-4]|quarter|year|total|revenue|cost|amount|value)\b'))) AS table_like,
 regexp_matches(lower(t), 'figure|chart|graph|plot|diagram|trend') AS chart_like,
 concat_ws(',', CASE WHEN contains(t, '$') THEN '$' END, CASE WHEN contains(t, '%') THEN '%' END, CASE WHEN contains(lower(t), 'usd') THEN 'USD' END, CASE WHEN contains(lower(t), 'billion') THEN 'billion' END, CASE WHEN contains(lower(t), 'million') THEN 'million' END) AS units FROM a"""


def safe_values(spark: SparkSession, d: str) -> DataFrame:
    """Coercions of values that came as text: whole, fractional, blank and spaced numbers, and words for true."""
    n = F.col("event_id") % 5
    raw = F.when(n == 0, F.col("user_id").cast("string")).when(n == 1, F.lit("3.7")).when(n == 2, F.lit("")).when(n == 3, F.concat(F.lit(" "), F.col("user_id").cast("string"), F.lit(" "))).otherwise(F.lit("yes"))
    e = S.table(spark, d, "events").withColumn("raw", raw)
    k = F.get_json_object("props", "$.k")
    return e.select("event_id", T.safe_int(F.col("raw"), -1).alias("as_int"), T.safe_float(F.col("raw")).alias("as_float"), T.safe_bool(F.col("raw"), False).alias("as_bool"), T.safe_int(k, 0).alias("k"))


SAFE_VALUES = """WITH r AS (SELECT *, CASE event_id % 5 WHEN 0 THEN user_id::VARCHAR WHEN 1 THEN '3.7' WHEN 2 THEN '' WHEN 3 THEN ' ' || user_id || ' ' ELSE 'yes' END AS raw FROM events)
SELECT event_id, CASE WHEN regexp_full_match(trim(raw), '[+-]?[0-9]+') THEN trim(raw)::BIGINT ELSE -1 END AS as_int, try_cast(trim(raw) AS DOUBLE) AS as_float,
 lower(trim(raw)) IN ('true', '1', 'yes') AS as_bool, coalesce(json_extract_string(props, '$.k')::BIGINT, 0) AS k FROM r"""


def metric_names(spark: SparkSession, d: str) -> DataFrame:
    words = S.table(spark, d, "benchmark").select(F.explode(F.regexp_extract_all(F.lower("text"), F.lit("[a-z-]+"), F.lit(0))).alias("word")).distinct()
    return words.select("word", T.singular(F.col("word")).alias("name"))


METRIC_NAMES = r"""WITH w AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '[a-z-]+')) AS word FROM benchmark), t AS (SELECT word, regexp_replace(word, '^-+|-+$', '', 'g') AS x FROM w)
SELECT word, CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN x[:-4] || 'y' WHEN x LIKE '%s' AND length(x) > 3 THEN x[:-2] ELSE x END AS name FROM t"""


def version_resolve(spark: SparkSession, d: str) -> DataFrame:
    # Many files go by one name, which is resolved once.
    files = S.file_names(spark, d).select("file_id", "file_name")
    made = files.join(versions.resolve(files.select("file_name").distinct()), "file_name")
    return made.select("file_id", "file_name", "version_label", "version_group", "version_rank", "effective_from", "effective_to", "published_at", "is_current", "confidence", "document_type")


VERSION_RESOLVE = rf"""WITH {S.FILES_SQL}, p AS (SELECT f.*, o_orderkey % 6 AS k, year(o_orderdate) + 25 AS y, quarter(o_orderdate) AS q, month(o_orderdate) AS m, lower(substr(o_orderpriority, 3, 20)) AS g, o_orderdate FROM files f JOIN orders ON o_orderkey = file_id)
SELECT file_id, file_name, CASE k WHEN 0 THEN 'v3' WHEN 1 THEN 'v2.1' WHEN 2 THEN strftime(o_orderdate, '%B') || ' ' || y WHEN 3 THEN y::VARCHAR WHEN 4 THEN y::VARCHAR ELSE 'v1' END AS version_label,
 CASE k WHEN 0 THEN 'report_' || replace(g, ' ', '_') || '_' WHEN 1 THEN 'policy_final_' || replace(replace(g, ' ', '_'), '-', '_') WHEN 2 THEN 'company_update_vf' WHEN 3 THEN 'budget_fy' || y WHEN 4 THEN 'policy_' ELSE 'plan_draft_' || replace(g, ' ', '_') END AS version_group,
 CASE k WHEN 0 THEN y * 10 + q WHEN 1 THEN 2 WHEN 2 THEN y * 100 + m WHEN 3 THEN y WHEN 4 THEN y ELSE 1 END::BIGINT AS version_rank,
 CASE k WHEN 0 THEN make_date(y, q * 3 - 2, 1) WHEN 2 THEN make_date(y, m, 1) WHEN 3 THEN make_date(y, 1, 1) WHEN 4 THEN make_date(y, 1, 1) END AS effective_from,
 CASE k WHEN 0 THEN make_date(y, q * 3, 28) WHEN 2 THEN make_date(y, m, 28) WHEN 3 THEN make_date(y, 12, 31) WHEN 4 THEN make_date(y, 12, 31) END AS effective_to,
 CASE k WHEN 4 THEN try_cast(y || strftime(o_orderdate, '-%m-%d') AS DATE) END AS published_at, k = 1 AS is_current,
 CASE k WHEN 0 THEN 0.8 WHEN 1 THEN 0.8 WHEN 2 THEN 0.65 WHEN 3 THEN 0.5 WHEN 4 THEN CASE WHEN try_cast(y || strftime(o_orderdate, '-%m-%d') AS DATE) IS NULL THEN 0.5 ELSE 0.6 END ELSE 0.8 END::DOUBLE AS confidence, CASE k WHEN 0 THEN 'quarterly-update' END AS document_type FROM p"""


def supersede(spark: SparkSession, d: str) -> DataFrame:
    """Only the newest current version of a client's family stays current."""
    v = versions.resolve(S.file_names(spark, d)).withColumn("is_current", F.col("file_id") % 3 != 0)
    return R.supersede(v, ["client_id", "document_type"], "created_at", "file_id").select("file_id", "client_id", "is_current")


SUPERSEDE = f"""WITH {S.FILES_SQL}, v AS (SELECT file_id, client_id, created_at, CASE WHEN file_id % 6 = 0 THEN 'quarterly-update' END AS kind, file_id % 3 <> 0 AS cur FROM files)
SELECT file_id, client_id, cur AND row_number() OVER (PARTITION BY client_id, kind, cur ORDER BY created_at DESC, file_id DESC) = 1 AS is_current FROM v"""


def citation_labels(spark: SparkSession, d: str) -> DataFrame:
    c = S.chunks(spark, d)
    cut = F.when(F.col("chunk_type").isin("full_table", "chart_context"), 2600).otherwise(1400)
    return c.select("node_id", T.citation_label(F.col("document_name"), F.col("page_num"), F.lit(0), F.col("node_id") % 6).alias("label"), F.length(F.substring(F.col("text"), F.lit(1), cut)).cast("bigint").alias("shown"), T.document_key(F.col("client_id"), F.col("document_name"), F.col("version_group")).alias("document_key"))


CITATION_LABELS = f"""WITH {S.CHUNKS_SQL} SELECT node_id, concat_ws(' - ', document_name, CASE WHEN page_num > 0 THEN 'p.' || page_num END, CASE WHEN node_id % 6 > 0 THEN 'chunk ' || (node_id % 6) END) AS label,
least(length(text), CASE WHEN chunk_type IN ('full_table', 'chart_context') THEN 2600 ELSE 1400 END) AS shown,
rtrim(translate(to_base64(encode(client_id || chr(31) || document_name || chr(31) || version_group)), '+/', '-_'), '=') AS document_key FROM chunks"""


def previews(spark: SparkSession, d: str) -> DataFrame:
    return S.table(spark, d, "documents").select("doc_id", T.preview(F.col("text")).alias("preview"), T.natural_key(F.concat(F.col("source"), F.lit("_"), F.col("doc_id").cast("string"))).alias("sort_key"))


PREVIEWS = r"""SELECT doc_id, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500) AS preview,
'src' || lpad(source[4:], 12, '0') || '_' || lpad(doc_id::VARCHAR, 12, '0') AS sort_key FROM documents"""


def node_facets(spark: SparkSession, d: str) -> DataFrame:
    return R.facets(S.chunks(spark, d), ["client_id", "chunk_type", "version_group"])


NODE_FACETS = f"""WITH {S.CHUNKS_SQL} SELECT 'client_id' AS facet, client_id AS value, count(*) AS n FROM chunks GROUP BY 2
UNION ALL SELECT 'chunk_type', chunk_type, count(*) FROM chunks GROUP BY 2 UNION ALL SELECT 'version_group', version_group::VARCHAR, count(*) FROM chunks GROUP BY 2"""


def document_candidates(spark: SparkSession, d: str) -> DataFrame:
    """Nodes put together to documents: counts, distinct pages, text length and a fingerprint of the kinds."""
    c = S.chunks(spark, d)
    made = c.groupBy("client_id", "version_group").agg(F.count("*").alias("nodes"), F.count_distinct("page_num").alias("pages"), F.sum(F.length("text")).alias("chars"), F.array_join(F.array_sort(F.collect_set("chunk_type")), ",").alias("kinds"), F.min("node_id").alias("first_node"))
    return made


DOCUMENT_CANDIDATES = f"""WITH {S.CHUNKS_SQL} SELECT client_id, version_group, count(*) AS nodes, count(DISTINCT page_num) AS pages, sum(length(text))::BIGINT AS chars,
array_to_string(list_sort(list(DISTINCT chunk_type)), ',') AS kinds, min(node_id) AS first_node FROM chunks GROUP BY 1, 2"""


def _bodies(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A row for each run of one document's nodes; its text goes through the digest node by node."""
    key, digest, counts, done = None, None, [0, 0, 0], []
    close = lambda: done.append((*key, digest.hexdigest(), *counts)) if digest is not None else None
    names = ("client_id", "version_group", "digest", "chars", "body_text", "full_table")
    types = (pa.string(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.int64())
    made = lambda: pa.RecordBatch.from_arrays([pa.array([r[k] for r in done], t) for k, t in enumerate(types)], names)
    for batch in batches:
        done.clear()
        for client, group, text, kind in zip(*(batch.column(k) for k in range(4))):
            text, now = text.as_py() or "", (client.as_py(), group.as_py())
            if digest is None or now != key:
                close()
                key, digest, counts = now, hashlib.sha256(), [0, 0, 0]
            else:
                text = "\n\n" + text
            digest.update(text.encode())
            counts = [counts[0] + len(text), counts[1] + (kind.as_py() == "body_text"), counts[2] + (kind.as_py() == "full_table")]
        yield made()
    done.clear()
    close()
    yield made()


def document_compare(spark: SparkSession, d: str) -> DataFrame:
    """Each document as one text, its nodes in natural order, as a digest and a histogram of kinds. No document is held whole."""
    nodes = S.chunks(spark, d).repartition("client_id", "version_group").sortWithinPartitions("client_id", "version_group", "page_num", "node_id", "text", "chunk_type")
    return nodes.select("client_id", "version_group", "text", "chunk_type").mapInArrow(_bodies, "client_id string, version_group bigint, digest string, chars bigint, body_text bigint, full_table bigint")


DOCUMENT_COMPARE = f"""WITH {S.CHUNKS_SQL}, b AS (SELECT client_id, version_group, string_agg(coalesce(text, ''), chr(10) || chr(10) ORDER BY page_num, node_id) AS body,
count(*) FILTER (chunk_type = 'body_text') AS body_text, count(*) FILTER (chunk_type = 'full_table') AS full_table FROM chunks GROUP BY 1, 2)
SELECT client_id, version_group, sha256(body) AS digest, length(body) AS chars, body_text, full_table FROM b"""


def node_search(spark: SparkSession, d: str) -> DataFrame:
    """Payload filter and substring search; the needle's percent sign is an ordinary character."""
    c = S.chunks(spark, d)
    hay = F.lower(F.concat_ws(" ", "text", "document_name", "chunk_type"))
    return c.where((F.col("chunk_type") == "body_text") & hay.contains("_v3.pdf")).select("node_id", "client_id", "document_name", "page_num")


NODE_SEARCH = f"WITH {S.CHUNKS_SQL} SELECT node_id, client_id, document_name, page_num FROM chunks WHERE chunk_type = 'body_text' AND contains(lower(concat_ws(' ', text, document_name, chunk_type)), '_v3.pdf')"


def checksum_dedupe(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "documents").select("doc_id", F.sha2(F.coalesce("text", F.lit("")), 256).alias("checksum"))
    return docs.groupBy("checksum").agg(F.min("doc_id").alias("first_doc"), F.count("*").alias("copies"))


CHECKSUM_DEDUPE = "SELECT sha256(coalesce(text, '')) AS checksum, min(doc_id) AS first_doc, count(*) AS copies FROM documents GROUP BY 1"


def page_markers(spark: SparkSession, d: str) -> DataFrame:
    """Pages of conversations laid down as marked documents, one page for each turn."""
    c = S.table(spark, d, "conversations")
    marked = F.concat(F.lit("[[START OF PAGE "), F.col("turn").cast("string"), F.lit("]]\n"), F.col("text"), F.lit("\n[[END OF PAGE "), F.col("turn").cast("string"), F.lit("]]"))
    docs = c.groupBy("conv_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("turn", "role", marked.alias("m")))), lambda x: x["m"]), "\n").alias("body"))
    return I.pages(docs, "conv_id", "body").groupBy("conv_id", "page").agg(F.count("*").alias("n"), F.sum(F.length("page_text")).alias("chars"))


PAGE_MARKERS = r"SELECT conv_id, turn AS page, count(*) AS n, sum(length(regexp_replace(text, '^\s+|\s+$', '', 'g')))::BIGINT AS chars FROM conversations WHERE regexp_matches(text, '\S') GROUP BY 1, 2"


def token_windows(spark: SparkSession, d: str) -> DataFrame:
    words = F.regexp_extract_all(F.coalesce("text", F.lit("")), F.lit(r"[^ \t\n\r\f\x0B]+"), F.lit(0))
    return I.word_windows(S.table(spark, d, "documents"), "doc_id", words)


TOKEN_WINDOWS = r"""WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^ \t\n\r\f\x0B]+') AS ws FROM documents), s AS (SELECT *, unnest(range(0, greatest(len(ws), 1), 560)) AS start FROM w WHERE len(ws) > 0)
SELECT doc_id, start // 560 AS window_no, least(600, len(ws) - start) AS n_words, ws[start + 1] AS first_word, ws[least(start + 600, len(ws))] AS last_word FROM s WHERE start = 0 OR len(ws) - start > 40"""


def table_merge_islands(spark: SparkSession, d: str) -> DataFrame:
    """Table pieces on following pages with like columns are one table."""
    t = S.table(spark, d, "lineitem").selectExpr("l_orderkey AS doc", "l_linenumber AS page", "l_partkey AS piece", "l_suppkey AS part_no", "l_returnflag AS header", "l_quantity AS x0")
    joins = (F.col("page") - F.col("prev_page")).between(0, 1) & ((F.col("header") == F.col("prev_header")) | (F.abs(F.col("x0") - F.col("prev_x0")) <= 2))
    made = I.islands(t, ["doc"], ["page", "piece", "part_no"], joins)
    return made.groupBy("doc", "island").agg(F.count("*").alias("pieces"), F.min("page").alias("first_page"), F.max("page").alias("last_page"))


TABLE_MERGE = """WITH t AS (SELECT l_orderkey AS doc, l_linenumber AS page, l_partkey AS piece, l_suppkey AS part_no, l_returnflag AS header, l_quantity AS x0 FROM lineitem),
j AS (SELECT *, coalesce(page - lag(page) OVER w BETWEEN 0 AND 1 AND (header = lag(header) OVER w OR abs(x0 - lag(x0) OVER w) <= 2), false) AS joined FROM t WINDOW w AS (PARTITION BY doc ORDER BY page, piece, part_no)),
i AS (SELECT *, sum(CASE WHEN joined THEN 0 ELSE 1 END) OVER (PARTITION BY doc ORDER BY page, piece, part_no ROWS UNBOUNDED PRECEDING)::BIGINT AS island FROM j)
SELECT doc, island, count(*) AS pieces, min(page) AS first_page, max(page) AS last_page FROM i GROUP BY 1, 2"""


def asof_section(spark: SparkSession, d: str) -> DataFrame:
    """The last heading (a signup) at or before each event of a user."""
    e = S.table(spark, d, "events")
    made = I.latest_before(e, ["user_id"], [F.col("ts"), F.col("event_id")], F.when(F.col("event_type") == "signup", F.col("event_id")), "section")
    return made.select("event_id", "user_id", "section")


ASOF_SECTION = """SELECT event_id, user_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS section FROM events"""


def text_rows(spark: SparkSession, d: str) -> DataFrame:
    items = S.table(spark, d, "lineitem").selectExpr("l_orderkey AS page", "l_extendedprice AS y", "l_quantity AS x", "l_partkey * 100000 + l_suppkey AS item_id", "l_returnflag AS word")
    return I.text_rows(items, ["page"], 5000.0)


TEXT_ROWS = """SELECT l_orderkey AS page, round_even(l_extendedprice / 5000.0, 0) * 5000.0 AS row_y, string_agg(l_returnflag, ' ' ORDER BY l_quantity, l_partkey * 100000 + l_suppkey, l_returnflag) AS row_text, min(l_quantity) AS x0, max(l_quantity) AS x1 FROM lineitem GROUP BY 1, 2"""


def reading_order(spark: SparkSession, d: str) -> DataFrame:
    regions = S.table(spark, d, "part").selectExpr("p_partkey AS region_id", "p_brand AS page", "CASE p_size % 4 WHEN 0 THEN 'header' WHEN 1 THEN 'body' WHEN 2 THEN 'footer' ELSE 'aside' END AS zone", "p_retailprice AS y", "CAST(p_size AS DOUBLE) AS x")
    return I.reading_order(regions, ["page"], {"header": 0, "body": 1, "footer": 3}).select("region_id", "page", "reading_order", "before_id", "after_id")


READING_ORDER = """WITH r AS (SELECT p_partkey AS region_id, p_brand AS page, CASE p_size % 4 WHEN 0 THEN 0 WHEN 1 THEN 1 WHEN 2 THEN 3 ELSE 99 END AS zone, round(p_retailprice, 2) AS y, p_size AS x FROM part)
SELECT region_id, page, row_number() OVER w AS reading_order, lag(region_id) OVER w AS before_id, lead(region_id) OVER w AS after_id FROM r WINDOW w AS (PARTITION BY page ORDER BY zone, y, x, region_id)"""


def completeness(spark: SparkSession, d: str) -> DataFrame:
    """Share of required metadata that chunks have, by client."""
    c = S.chunks(spark, d)
    fields = ("document_name", "is_current", "version_rank", "text")
    present = sum((F.when(F.col(f).isNotNull(), 1).otherwise(0) for f in fields), F.lit(0)) / len(fields)
    return c.groupBy("client_id").agg(F.count("*").alias("chunks"), F.round(F.avg(present), 6).alias("completeness"))


COMPLETENESS = f"""WITH {S.CHUNKS_SQL} SELECT client_id, count(*) AS chunks, round(avg(((document_name IS NOT NULL)::INT + (is_current IS NOT NULL)::INT + (version_rank IS NOT NULL)::INT + (text IS NOT NULL)::INT) / 4), 6) AS completeness FROM chunks GROUP BY 1"""


QUERIES = {
    "text_signals": text_signals, "safe_values": safe_values, "metric_names": metric_names, "version_resolve": version_resolve, "supersede": supersede,
    "citation_labels": citation_labels, "previews": previews, "node_facets": node_facets, "document_candidates": document_candidates,
    "document_compare": document_compare, "node_search": node_search, "checksum_dedupe": checksum_dedupe, "page_markers": page_markers,
    "token_windows": token_windows, "table_merge_islands": table_merge_islands, "asof_section": asof_section, "text_rows": text_rows,
    "reading_order": reading_order, "metadata_completeness": completeness,
}
ORACLES = {
    "text_signals": TEXT_SIGNALS, "safe_values": SAFE_VALUES, "metric_names": METRIC_NAMES, "version_resolve": VERSION_RESOLVE, "supersede": SUPERSEDE,
    "citation_labels": CITATION_LABELS, "previews": PREVIEWS, "node_facets": NODE_FACETS, "document_candidates": DOCUMENT_CANDIDATES,
    "document_compare": DOCUMENT_COMPARE, "node_search": NODE_SEARCH, "checksum_dedupe": CHECKSUM_DEDUPE, "page_markers": PAGE_MARKERS,
    "token_windows": TOKEN_WINDOWS, "table_merge_islands": TABLE_MERGE, "asof_section": ASOF_SECTION, "text_rows": TEXT_ROWS,
    "reading_order": READING_ORDER, "metadata_completeness": COMPLETENESS,
}
