"""Queries of pages, tables, sections and question expansion, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intents, text as T
from ..operators import evaluation as E, layout as L, relational as R, retrieval as V
from ..sources import tables as S
from .search import _any


def _listed(terms) -> str:
    return ", ".join("'" + t.replace("'", "''") + "'" for t in terms)


def expansion_trigger(spark: SparkSession, d: str) -> DataFrame:
    return S.asked(spark, d).select("qid", intents.expands(F.col("question"), F.col("qid") % 2 == 0).alias("expands"), F.size(V.content_terms(F.col("question"))).cast("bigint").alias("terms"), F.array_join(V.subjects(F.col("question")), ",").alias("subjects"))


EXPANSION = f"""WITH {S.ASKED_SQL}, w AS (SELECT qid, lower(question) AS q, regexp_extract_all(lower(question), '[a-z0-9'']+') AS ws, regexp_extract_all(lower(question), '[a-z][a-z0-9-]+') AS cs, regexp_extract_all(lower(question), '[a-z][a-z-]+') AS ss FROM asked)
SELECT qid, {_any('q', intents.EXPANSION)} OR (qid % 2 = 0 AND ({_any('q', intents.FOLLOW_UP_PHRASES)} OR (len(ws) <= 10 AND list_has_any(ws, [{_listed(intents.FOLLOW_UP_WORDS)}])))) AS expands,
len(list_distinct(list_filter(cs, lambda x: length(x) >= 4 AND x NOT IN ({_listed(V.QUERY_STOPWORDS)})))) AS terms,
(SELECT string_agg(n, ',' ORDER BY k) FROM (SELECT n, min(k) AS k FROM (SELECT CASE WHEN x LIKE '%ies' AND length(x) > 4 THEN x[:-4] || 'y' WHEN x LIKE '%s' AND length(x) > 3 THEN x[:-2] ELSE x END AS n, k
  FROM (SELECT regexp_replace(unnest(ss), '^-+|-+$', '', 'g') AS x, generate_subscripts(ss, 1) AS k, unnest(ss) AS raw) WHERE length(raw) >= 4 AND raw NOT IN ({_listed(V.NO_METRIC)})) GROUP BY n)) AS subjects FROM w"""


def companion_queries(spark: SparkSession, d: str) -> DataFrame:
    made = S.asked(spark, d).select("qid", F.posexplode(intents.companions(F.col("question"))).alias("pos", "query"))
    return made.select("qid", F.col("pos").cast("bigint").alias("pos"), "query")


def entity_labels(spark: SparkSession, d: str) -> DataFrame:
    f = S.file_names(spark, d)
    words = intents.entity_words(F.col("file_name"))
    return f.select("file_id", F.array_join(words, " ").alias("label"), F.size(words).cast("bigint").alias("n"))


ENTITY_LABELS = rf"""WITH {S.FILES_SQL}, w AS (SELECT file_id, list_filter(string_split(trim(lower(regexp_replace(regexp_replace(regexp_replace(file_name, '\.[a-zA-Z0-9]{{2,5}}$', ''), '\([^)]*\)', ' ', 'g'), '[_\-.\s]+', ' ', 'g'))), ' '),
 lambda x: regexp_matches(x, '[a-z]') AND x NOT IN ({_listed(intents.NO_ENTITY)}))[1:3] AS ws FROM files)
SELECT file_id, array_to_string(ws, ' ') AS label, len(ws) AS n FROM w"""


def table_texts(spark: SparkSession, d: str) -> DataFrame:
    """Table-like documents as Markdown and as labelled rows (their digests), for all documents."""
    rows = S.table(spark, d, "documents").select("doc_id", L.parse_rows(F.col("text")).alias("rows"))
    return rows.select("doc_id", F.size("rows").cast("bigint").alias("n_rows"), F.coalesce(F.aggregate("rows", F.lit(0), lambda a, r: a + F.size(r)), F.lit(0)).cast("bigint").alias("n_cells"), F.sha2(F.when(F.size("rows") > 0, L.markdown(F.col("rows"))).otherwise(F.lit("")), 256).alias("markdown"))


TABLE_TEXTS = r"""WITH l AS (SELECT doc_id, list_filter(list_transform(string_split(coalesce(text, ''), chr(10)), lambda x: trim(x)), lambda x: x <> '') AS ls FROM documents),
r AS (SELECT doc_id, list_filter(list_transform(ls, lambda x: list_filter(list_transform(CASE WHEN contains(x, '|') THEN string_split(x, '|') WHEN contains(x, chr(9)) THEN string_split(x, chr(9)) ELSE regexp_split_to_array(x, '\s{2,}') END,
  lambda c: trim(regexp_replace(c, '\s+', ' ', 'g'))), lambda c: c <> '')), lambda z: len(z) >= 2) AS rs FROM l)
SELECT doc_id, len(rs) AS n_rows, coalesce(list_sum(list_transform(rs, lambda z: len(z))), 0)::BIGINT AS n_cells,
sha256(CASE WHEN len(rs) > 0 THEN '|' || array_to_string(rs[1], '|') || '|' || chr(10) || '|' || array_to_string(list_transform(rs[1], lambda c: '---'), '|') || '|' ||
  array_to_string(list_transform(rs[2:], lambda z: chr(10) || '|' || array_to_string(list_resize(z, len(rs[1]), ''), '|') || '|'), '') ELSE '' END) AS markdown FROM r"""


def _pages(spark: SparkSession, d: str) -> DataFrame:
    """A page for each order and line number, with how much of each kind is on it."""
    n = lambda test: F.count_if(F.expr(test))
    return S.table(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(
        n("l_returnflag = 'A'").alias("tables"), n("l_returnflag = 'R'").alias("images"), F.sum("l_quantity").cast("bigint").alias("vectors"), (F.sum("l_quantity") / 2).cast("bigint").alias("regions"), (n("l_linestatus = 'O'") > 0).alias("two_columns")
    )


def page_classes(spark: SparkSession, d: str) -> DataFrame:
    c = F.col
    made = _pages(spark, d).withColumn("complexity", L.page_complexity(c("two_columns"), c("tables"), c("images"), c("vectors"), c("regions")))
    made = made.withColumn("page_class", L.page_class(c("complexity"), c("tables"), c("images"), c("vectors"), c("regions")))
    # Pages worth a closer look: the most complex of a document that aren't simple.
    ranked = V.top_ranked(made.where("page_class <> 'simple_text_page'"), ["l_orderkey"], [F.desc("complexity"), F.asc("l_linenumber")], 5)
    return ranked.select("l_orderkey", "l_linenumber", F.round("complexity", 6).alias("complexity"), "page_class", "rank")


PAGE_CLASSES = """WITH p AS (SELECT l_orderkey, l_linenumber, count(*) FILTER (l_returnflag = 'A') AS tables, count(*) FILTER (l_returnflag = 'R') AS images, sum(l_quantity)::BIGINT AS vectors, trunc(sum(l_quantity) / 2)::BIGINT AS regions, count(*) FILTER (l_linestatus = 'O') > 0 AS two FROM lineitem GROUP BY 1, 2),
c AS (SELECT *, least(1.0, CASE WHEN two THEN 0.25 ELSE 0 END + CASE WHEN tables > 0 THEN 0.3 ELSE 0 END + CASE WHEN images > 0 OR vectors >= 20 THEN 0.25 ELSE 0 END + CASE WHEN regions >= 30 THEN 0.2 ELSE 0 END)::DOUBLE AS complexity FROM p),
k AS (SELECT *, CASE WHEN tables > 0 AND complexity >= 0.4 THEN 'table_heavy_page' WHEN images > 0 OR vectors >= 20 THEN 'visual_heavy_page' WHEN complexity >= 0.65 OR regions >= 45 THEN 'hard_page' ELSE 'simple_text_page' END AS page_class FROM c)
SELECT l_orderkey, l_linenumber, round(complexity, 6) AS complexity, page_class, row_number() OVER (PARTITION BY l_orderkey ORDER BY complexity DESC, l_linenumber) AS rank FROM k WHERE page_class <> 'simple_text_page' QUALIFY rank <= 5"""


def section_chunks(spark: SparkSession, d: str) -> DataFrame:
    """Messages of a conversation put together by role as one body each, with the windows it would make."""
    made = L.section_chunks(S.table(spark, d, "conversations"), ["conv_id"], ["turn"], "role", "text")
    return made.select("conv_id", "role", "regions", F.sha2("body", 256).alias("digest"), F.length("body").cast("bigint").alias("chars"))


SECTION_CHUNKS = """WITH b AS (SELECT conv_id, role, count(*) AS regions, string_agg(text, chr(10) ORDER BY turn, text) AS body FROM conversations GROUP BY 1, 2)
SELECT conv_id, role, regions, sha256(body) AS digest, length(body) AS chars FROM b"""


def nearest_text(spark: SparkSession, d: str) -> DataFrame:
    """The two nearest other regions of a brand's page for each small part, at most 40 apart in price."""
    p = S.table(spark, d, "part").selectExpr("p_brand AS page", "p_partkey AS region_id", "p_retailprice AS y", "p_size AS size")
    return L.nearest(p.where("size <= 10").withColumnRenamed("region_id", "figure_id"), p.where("size > 40"), ["page"], "y", 40.0, 2, "figure_id", "region_id").withColumn("distance", F.round("distance", 6))


NEAREST_TEXT = """WITH p AS (SELECT p_brand AS page, p_partkey AS id, p_retailprice AS y, p_size AS size FROM part)
SELECT a.page, a.id AS figure_id, b.id AS region_id, round(abs(a.y - b.y), 6) AS distance, row_number() OVER (PARTITION BY a.page, a.id ORDER BY abs(a.y - b.y), b.id) AS nth
FROM p a JOIN p b ON a.page = b.page AND abs(a.y - b.y) <= 40 WHERE a.size <= 10 AND b.size > 40 QUALIFY nth <= 2"""


def overlap_adjustment(spark: SparkSession, d: str) -> DataFrame:
    """Questions against the comment-like name of the part that their order's first line is about."""
    first = S.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("qid")).agg(F.min("l_partkey").alias("p_partkey"))
    rows = S.asked(spark, d).join(first, "qid").join(S.table(spark, d, "part"), "p_partkey")
    described = F.concat_ws(" ", "p_name", "p_type", F.lit("guidance outlook for the latest quarterly update, ranked assets, dividend yield and occupancy"))
    direct = F.array_contains(V.subjects(F.col("question")), "property")
    kind = F.when(F.col("p_size") % 2 == 0, "body_text").otherwise("full_table")
    return rows.select("qid", V.overlap_adjustment(F.col("question"), described).alias("overlap"), F.round(V.breakdown_adjustment(described, kind, direct), 6).alias("breakdown"))


OVERLAP = f"""WITH {S.ASKED_SQL}, f AS (SELECT l_orderkey AS qid, min(l_partkey) AS p_partkey FROM lineitem GROUP BY 1),
r AS (SELECT qid, lower(concat_ws(' ', p_name, p_type, 'guidance outlook for the latest quarterly update, ranked assets, dividend yield and occupancy')) AS t, p_size, lower(question) AS q,
  list_distinct(list_filter(regexp_extract_all(lower(question), '[a-z][a-z0-9-]+'), lambda x: length(x) >= 4 AND x NOT IN ({_listed(V.QUERY_STOPWORDS)}))) AS ts FROM asked JOIN f USING (qid) JOIN part USING (p_partkey)),
s AS (SELECT *, len(list_filter(ts, lambda x: contains(t, x))) / len(ts) AS share, {_any('t', V.BREAKDOWNS)} AS breaks, contains(q, 'properties') AS direct FROM r)
SELECT qid, CASE WHEN len(ts) >= 2 THEN CASE WHEN share >= 0.6 THEN 0.08 WHEN share >= 0.35 THEN 0.05 WHEN share >= 0.2 THEN 0.025 ELSE 0 END ELSE 0 END::DOUBLE AS overlap,
round((CASE WHEN direct THEN 0.34 + CASE WHEN p_size % 2 = 0 THEN 0.12 ELSE 0 END - CASE WHEN contains(t, 'global customers') THEN 0.06 ELSE 0 END ELSE 0 END
 - CASE WHEN breaks THEN CASE WHEN p_size % 2 = 0 THEN 0.12 ELSE 0.22 END ELSE 0 END)::DOUBLE, 6) AS breakdown FROM s"""


def ingestion_eval(spark: SparkSession, d: str) -> DataFrame:
    """Per client: parse and index success, chunks per document, and completeness of metadata."""
    c = S.chunks(spark, d).withColumn("words", F.size(F.split(F.coalesce("text", F.lit("")), " ")))
    made = c.withColumn("parsed", F.when(F.length("text") > 0, 1.0).otherwise(0.0)).withColumn("indexed", F.when(F.col("is_current").isNotNull(), 1.0).otherwise(0.0))
    return made.groupBy("client_id").agg(F.count("*").alias("cases"), E.mean_or_zero("parsed"), E.mean_or_zero("indexed"), E.mean_or_zero("words"))


INGESTION_EVAL = f"""WITH {S.CHUNKS_SQL} SELECT client_id, count(*) AS cases, round(avg(CASE WHEN length(text) > 0 THEN 1.0 ELSE 0.0 END), 6) AS parsed, round(avg(CASE WHEN is_current IS NOT NULL THEN 1.0 ELSE 0.0 END), 6) AS indexed,
round(avg(len(string_split(coalesce(text, ''), ' '))), 6) AS words FROM chunks GROUP BY 1"""


def fit_lines(spark: SparkSession, d: str) -> DataFrame:
    """Lines of each conversation that fit a budget of 120 words, from the first on."""
    lines = S.table(spark, d, "conversations").select("conv_id", "turn", "role", F.posexplode(F.split("text", "\n")).alias("line_no", "line"))
    lines = lines.withColumn("cost", F.regexp_count("line", F.lit(r"[^ \t\n\r\f\x0B]+")).cast("bigint"))
    kept = R.within_budget(lines, "conv_id", [F.col("turn"), F.col("role"), F.col("line_no")], F.col("cost"), 120)
    return kept.groupBy("conv_id").agg(F.count("*").alias("lines"), F.max("spent").alias("spent"))


FIT_LINES = r"""WITH l AS (SELECT conv_id, turn, role, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS line_no FROM conversations),
s AS (SELECT conv_id, (sum(len(regexp_extract_all(line, '[^ \t\n\r\f\x0B]+'))) OVER (PARTITION BY conv_id ORDER BY turn, role, line_no ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM l)
SELECT conv_id, count(*) AS lines, max(spent) AS spent FROM s WHERE spent <= 120 GROUP BY 1"""


def temporal_vantage(spark: SparkSession, d: str) -> DataFrame:
    """Version groups of a client whose chunks carry more than one publication date."""
    c = S.chunks(spark, d)
    return c.groupBy("client_id", "version_group").agg(F.count_distinct("published_at").alias("dates"), F.max_by("node_id", F.struct("version_rank", "node_id")).alias("newest")).where("dates >= 2")


TEMPORAL_VANTAGE = f"WITH {S.CHUNKS_SQL} SELECT client_id, version_group, count(DISTINCT published_at) AS dates, arg_max(node_id, (version_rank, node_id)) AS newest FROM chunks GROUP BY 1, 2 HAVING count(DISTINCT published_at) >= 2"


def missing_words(spark: SparkSession, d: str) -> DataFrame:
    """Values that stand for nothing become null; the first that is left wins."""
    e = S.table(spark, d, "events")
    n = F.col("event_id") % 4
    raw = F.when(n == 0, F.lit(" N/A ")).when(n == 1, F.lit("undefined")).when(n == 2, F.col("event_type")).otherwise(F.lit(""))
    return e.select("event_id", F.coalesce(T.clean_missing(raw), F.concat(F.lit("user-"), F.col("user_id").cast("string"))).alias("name"))


MISSING_WORDS = """SELECT event_id, CASE WHEN event_id % 4 = 2 THEN event_type ELSE 'user-' || user_id END AS name FROM events"""

QUERIES = {
    "expansion_trigger": expansion_trigger, "entity_labels": entity_labels, "table_texts": table_texts, "page_classes": page_classes,
    "section_chunks": section_chunks, "nearest_text": nearest_text, "overlap_adjustment": overlap_adjustment, "ingestion_eval": ingestion_eval,
    "fit_lines": fit_lines, "temporal_vantage": temporal_vantage, "missing_words": missing_words, "companion_queries": companion_queries,
}


def _companions_sql() -> str:
    from .search import _intent_sql

    flags = _intent_sql().split("SELECT qid, concat_ws")[0]
    topic = r"(SELECT CASE WHEN length(t) > 10 THEN t ELSE question END FROM (SELECT trim(regexp_replace(regexp_replace(question, '\bwhat(?:''s)?\s+changed\b.*?\bbetween\b\s*', '', 'gi'), '\bbetween\s+the\s+.*?\band\s+the\b.*$', '', 'gi')) AS t))"
    named = lambda form: "'" + form.replace("{topic}", f"' || {topic} || '").replace("{question}", "' || question || '") + "'"
    made = ", ".join(f"CASE WHEN {label} THEN trim(regexp_replace({named(form)}, '\\s+', ' ', 'g')) END" for label, form in intents.COMPANIONS)
    return f"""{flags}, c AS (SELECT qid, question, unnest([{made}]) AS q, unnest(range({len(intents.COMPANIONS)})) AS k FROM f JOIN asked USING (qid)),
d AS (SELECT qid, arg_min(q, k) AS query, min(k) AS k FROM c WHERE q IS NOT NULL AND lower(q) <> lower(question) GROUP BY qid, lower(q))
SELECT qid, row_number() OVER (PARTITION BY qid ORDER BY k) - 1 AS pos, query FROM d QUALIFY pos < 6"""


ORACLES = {
    "expansion_trigger": EXPANSION, "entity_labels": ENTITY_LABELS, "table_texts": TABLE_TEXTS, "page_classes": PAGE_CLASSES,
    "section_chunks": SECTION_CHUNKS, "nearest_text": NEAREST_TEXT, "overlap_adjustment": OVERLAP, "ingestion_eval": INGESTION_EVAL,
    "fit_lines": FIT_LINES, "temporal_vantage": TEMPORAL_VANTAGE, "missing_words": MISSING_WORDS, "companion_queries": _companions_sql(),
}
