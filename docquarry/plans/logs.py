"""Queries of the relational workload, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import relational as R
from ..sources.tables import table

STATUS = "CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'running' ELSE 'failed' END"


def query_logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "orders").selectExpr("o_orderkey AS query_id", "o_custkey AS client_id", "o_orderdate AS created_at", f"{STATUS} AS status", "CAST(floor(o_totalprice) AS BIGINT) AS latency_ms", "o_orderpriority AS question")


QUERY_LOGS = f"query_logs AS (SELECT o_orderkey AS query_id, o_custkey AS client_id, o_orderdate AS created_at, {STATUS} AS status, floor(o_totalprice)::BIGINT AS latency_ms, o_orderpriority AS question FROM orders)"


def retrieval_logs(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "lineitem").selectExpr("l_orderkey AS query_id", "l_partkey AS document_id", "l_suppkey AS node_id", "l_linenumber AS line", "l_discount AS score", "l_returnflag AS flag")


RETRIEVAL_LOGS = "retrieval_logs AS (SELECT l_orderkey AS query_id, l_partkey AS document_id, l_suppkey AS node_id, l_linenumber AS line, l_discount AS score, l_returnflag AS flag FROM lineitem)"


def jobs(spark: SparkSession, d: str) -> DataFrame:
    """Ingestion jobs; clicks are still queued and have not started."""
    return table(spark, d, "events").selectExpr(
        "event_id AS job_id", "user_id AS document_id", "CASE WHEN event_type <> 'click' THEN ts END AS started_at", "event_type AS parser_name",
        "CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'queued' ELSE 'running' END AS status", "value", "props",
    )


JOBS = """jobs AS (SELECT event_id AS job_id, user_id AS document_id, CASE WHEN event_type <> 'click' THEN ts END AS started_at, event_type AS parser_name,
  CASE event_type WHEN 'error' THEN 'failed' WHEN 'purchase' THEN 'completed' WHEN 'click' THEN 'queued' ELSE 'running' END AS status, value, props FROM events)"""


def history_list(spark: SparkSession, d: str) -> DataFrame:
    r = retrieval_logs(spark, d)
    out = R.history(query_logs(spark, d), r, r.where("flag = 'R'"))
    return out.select("query_id", "client_id", "status", "created_at", "retrievals", "conflicts")


HISTORY_LIST = f"""WITH {QUERY_LOGS}, {RETRIEVAL_LOGS},
r AS (SELECT query_id, count(*) AS n FROM retrieval_logs GROUP BY 1), c AS (SELECT query_id, count(*) AS n FROM retrieval_logs WHERE flag = 'R' GROUP BY 1)
SELECT q.query_id, q.client_id, q.status, q.created_at, coalesce(r.n, 0) AS retrievals, coalesce(c.n, 0) AS conflicts
FROM query_logs q LEFT JOIN r USING (query_id) LEFT JOIN c USING (query_id)"""


def history_page(spark: SparkSession, d: str) -> DataFrame:
    rows = query_logs(spark, d).where(R.history_filter(status="Completed", needle="HiGh"))
    return R.page(rows.select("query_id", "created_at", "question"), [F.desc("created_at"), F.desc("query_id")], limit=50, offset=50)


HISTORY_PAGE = f"""WITH {QUERY_LOGS} SELECT query_id, created_at, question FROM query_logs
WHERE status = 'completed' AND lower(question) LIKE '%high%' ORDER BY created_at DESC, query_id DESC LIMIT 50 OFFSET 50"""


def history_total(spark: SparkSession, d: str) -> DataFrame:
    return query_logs(spark, d).groupBy("client_id", "status").agg(F.count("*").alias("total"), F.max("created_at").alias("newest"))


HISTORY_TOTAL = f"WITH {QUERY_LOGS} SELECT client_id, status, count(*) AS total, max(created_at) AS newest FROM query_logs GROUP BY 1, 2"


def retrieval_citations(spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "part").selectExpr("p_partkey AS document_id", "p_name AS document_name")
    rows = retrieval_logs(spark, d).join(names, "document_id", "left")
    place = F.struct("line", "document_id", "node_id", F.coalesce("document_name", F.lit("")).alias("name"))
    made = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(place)).alias("c"))
    return made.select("query_id", F.size("c").cast("bigint").alias("n"), F.array_join(F.transform("c", lambda x: x["name"]), "; ").alias("document_names"))


RETRIEVAL_CITATIONS = f"""WITH {RETRIEVAL_LOGS} SELECT query_id, count(*) AS n,
string_agg(coalesce(p_name, ''), '; ' ORDER BY line, document_id, node_id, coalesce(p_name, '')) AS document_names
FROM retrieval_logs LEFT JOIN part ON p_partkey = document_id GROUP BY 1"""


def telemetry(spark: SparkSession, d: str) -> DataFrame:
    q, r = query_logs(spark, d), retrieval_logs(spark, d)
    per = r.groupBy("query_id").agg(F.count("*").alias("n"), F.max(F.when(F.col("flag") == "R", 1).otherwise(0)).alias("conflicting"))
    rows = q.join(per, "query_id", "left").groupBy("client_id").agg(
        F.count("*").alias("queries"), F.round(F.avg("latency_ms"), 4).alias("avg_latency"), F.sum(F.coalesce("conflicting", F.lit(0))).alias("conflicting_queries"), F.sum(F.coalesce("n", F.lit(0))).alias("retrievals")
    )
    return rows.withColumn("conflict_rate", F.round(F.try_divide("conflicting_queries", "queries"), 6))


TELEMETRY = f"""WITH {QUERY_LOGS}, {RETRIEVAL_LOGS}, per AS (SELECT query_id, count(*) AS n, max(CASE WHEN flag = 'R' THEN 1 ELSE 0 END) AS conflicting FROM retrieval_logs GROUP BY 1)
SELECT client_id, count(*) AS queries, round(avg(latency_ms), 4) AS avg_latency, sum(coalesce(conflicting, 0))::BIGINT AS conflicting_queries,
sum(coalesce(n, 0))::BIGINT AS retrievals, round(sum(coalesce(conflicting, 0)) / count(*), 6) AS conflict_rate
FROM query_logs LEFT JOIN per USING (query_id) GROUP BY 1"""


def client_counts(spark: SparkSession, d: str) -> DataFrame:
    q, r = query_logs(spark, d), retrieval_logs(spark, d)
    per = q.select("query_id", "client_id", "status").join(r.groupBy("query_id").agg(F.count("*").alias("nodes"), F.count_if(F.col("flag") == "N").alias("active")), "query_id", "left")
    counted = per.groupBy("client_id").agg(F.count("*").alias("queries"), F.count_if(F.col("status") == "completed").alias("completed"), F.sum(F.coalesce("nodes", F.lit(0))).alias("nodes"), F.sum(F.coalesce("active", F.lit(0))).alias("active_nodes"))
    clients = table(spark, d, "customer").selectExpr("c_custkey AS client_id", "c_name AS name")
    return clients.join(counted, "client_id", "left").fillna(0)


CLIENT_COUNTS = f"""WITH {QUERY_LOGS}, {RETRIEVAL_LOGS}, n AS (SELECT query_id, count(*) AS nodes, count(*) FILTER (flag = 'N') AS active FROM retrieval_logs GROUP BY 1),
q AS (SELECT client_id, count(*) AS queries, count(*) FILTER (status = 'completed') AS completed, sum(coalesce(nodes, 0))::BIGINT AS nodes, sum(coalesce(active, 0))::BIGINT AS active_nodes
  FROM query_logs LEFT JOIN n USING (query_id) GROUP BY 1)
SELECT c_custkey AS client_id, c_name AS name, coalesce(queries, 0) AS queries, coalesce(completed, 0) AS completed, coalesce(nodes, 0) AS nodes, coalesce(active_nodes, 0) AS active_nodes
FROM customer LEFT JOIN q ON client_id = c_custkey"""


def latest_job(spark: SparkSession, d: str) -> DataFrame:
    rows = R.latest(jobs(spark, d), ["document_id"], [F.desc_nulls_last("started_at"), F.desc("job_id")])
    return rows.select("document_id", "job_id", "status", "parser_name", "started_at")


LATEST_JOB = f"""WITH {JOBS} SELECT document_id, job_id, status, parser_name, started_at FROM jobs
QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC NULLS LAST, job_id DESC) = 1"""


def document_enrichment(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "part").selectExpr("p_partkey AS document_id", "p_name AS name", "p_brand AS embedding_model")
    active = retrieval_logs(spark, d).where("flag = 'N'").groupBy("document_id").agg(F.count("*").alias("active_nodes"), F.min("node_id").alias("first_node"))
    last = latest_job(spark, d).select("document_id", "status", "parser_name")
    made = docs.join(active, "document_id", "left").join(last, "document_id", "left")
    return made.select("document_id", "name", F.coalesce("active_nodes", F.lit(0)).alias("active_nodes"), "first_node", F.coalesce("status", F.lit("unknown")).alias("status"), "parser_name", (F.col("embedding_model") != "Brand#11").alias("is_stale"))


DOCUMENT_ENRICHMENT = f"""WITH {RETRIEVAL_LOGS}, {JOBS}, a AS (SELECT document_id, count(*) AS active_nodes, min(node_id) AS first_node FROM retrieval_logs WHERE flag = 'N' GROUP BY 1),
l AS (SELECT * FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC NULLS LAST, job_id DESC) = 1)
SELECT p_partkey AS document_id, p_name AS name, coalesce(active_nodes, 0) AS active_nodes, first_node, coalesce(status, 'unknown') AS status, parser_name, p_brand <> 'Brand#11' AS is_stale
FROM part LEFT JOIN a ON a.document_id = p_partkey LEFT JOIN l ON l.document_id = p_partkey"""


def job_state_last(spark: SparkSession, d: str) -> DataFrame:
    """State of each document's jobs and how many of each there are."""
    j = jobs(spark, d).where("started_at IS NOT NULL")
    top = F.struct("started_at", "job_id")
    return j.groupBy("document_id").agg(F.max_by("status", top).alias("status"), F.count("*").alias("jobs"), F.count_if(F.col("status") == "failed").alias("failed"), F.max("started_at").alias("last_at"))


JOB_STATE_LAST = f"""WITH {JOBS} SELECT document_id, arg_max(status, (started_at, job_id)) AS status, count(*) AS jobs, count(*) FILTER (status = 'failed') AS failed, max(started_at) AS last_at
FROM jobs WHERE started_at IS NOT NULL GROUP BY 1"""


def job_windows(spark: SparkSession, d: str) -> DataFrame:
    """Jobs by hour and kind: windowed telemetry over the event stream's table."""
    rows = table(spark, d, "events").groupBy(F.window("ts", "1 hour").alias("w"), "event_type")
    return rows.agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total")).select(F.col("w.start").alias("hour"), "event_type", "n", "total")


JOB_WINDOWS = "SELECT date_trunc('hour', ts) AS hour, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2"


def recent_turns(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").where("role <> 'system'")
    return R.last_in_order(c, "conv_id", [F.col("turn"), F.col("role")], 4).select("conv_id", "turn", "role", F.col("position").cast("bigint").alias("position"))


RECENT_TURNS = """WITH t AS (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) AS rn FROM conversations WHERE role <> 'system')
SELECT conv_id, turn, role, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS position FROM t WHERE rn <= 4"""


def sessions_recent(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations")
    rows = c.groupBy("conv_id").agg((F.max("turn") + 1).alias("next_turn"), F.count("*").alias("messages"), F.substring(F.min_by(F.when(F.col("role") == "user", F.col("text")), F.when(F.col("role") == "user", F.col("turn"))), 1, 80).alias("title"))
    return rows.select("conv_id", "next_turn", "messages", F.coalesce("title", F.lit("New chat")).alias("title"))


SESSIONS_RECENT = """SELECT conv_id, max(turn) + 1 AS next_turn, count(*) AS messages,
coalesce(substr(arg_min(text, turn) FILTER (role = 'user'), 1, 80), 'New chat') AS title FROM conversations GROUP BY 1"""


def history_budget(spark: SparkSession, d: str) -> DataFrame:
    c = table(spark, d, "conversations").withColumn("cost", F.regexp_count("text", F.lit(r"[^ \t\n\r\f\x0B]+")).cast("bigint") + 8)
    return R.within_budget(c, "conv_id", [F.desc("turn"), F.desc("role")], F.col("cost"), 200).select("conv_id", "turn", "role", "cost", "spent")


HISTORY_BUDGET = r"""WITH t AS (SELECT *, len(regexp_extract_all(text, '[^ \t\n\r\f\x0B]+')) + 8 AS cost FROM conversations),
s AS (SELECT conv_id, turn, role, cost, (sum(cost) OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC ROWS UNBOUNDED PRECEDING))::BIGINT AS spent FROM t)
SELECT * FROM s WHERE spent <= 200"""


def cascade_delete(spark: SparkSession, d: str) -> DataFrame:
    """Rows of each log left after the clients of one market segment are deleted."""
    gone = table(spark, d, "customer").where("c_mktsegment = 'BUILDING'").selectExpr("c_custkey AS client_id")
    q = query_logs(spark, d)
    kept = R.without(q, gone, "client_id")
    lost = q.join(gone, "client_id", "left_semi").select("query_id")
    r = R.without(retrieval_logs(spark, d), lost, "query_id")
    count = lambda df, name: df.agg(F.count("*").alias("n"), F.min("query_id").alias("first_query")).select(F.lit(name).alias("log"), "n", "first_query")
    return count(kept, "query_logs").unionByName(count(r, "retrieval_logs")).unionByName(count(r.where("flag = 'R'"), "conflict_logs"))


CASCADE_DELETE = f"""WITH {QUERY_LOGS}, {RETRIEVAL_LOGS}, k AS (SELECT * FROM query_logs WHERE client_id NOT IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')),
r AS (SELECT l.* FROM retrieval_logs l ANTI JOIN (SELECT query_id FROM query_logs WHERE client_id IN (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING')) x USING (query_id))
SELECT 'query_logs' AS log, count(*) AS n, min(query_id) AS first_query FROM k UNION ALL SELECT 'retrieval_logs', count(*), min(query_id) FROM r
UNION ALL SELECT 'conflict_logs', count(*), min(query_id) FROM r WHERE flag = 'R'"""


def collection_merge(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "documents")
    older = docs.select("doc_id", "source", "n_chars")
    newer = table(spark, d, "labels").select("doc_id", F.lit("labelled").alias("source"), F.col("quality").cast("bigint").alias("quality"))
    return R.merge_collections(older, newer, "doc_id").select("doc_id", "source", "n_chars", "quality")


COLLECTION_MERGE = """SELECT doc_id, source, NULL::BIGINT AS n_chars, quality FROM (SELECT doc_id, 'labelled' AS source, quality::BIGINT AS quality FROM labels)
UNION ALL SELECT doc_id, source, n_chars, NULL FROM documents ANTI JOIN labels USING (doc_id)"""


def orders_by_client_status(spark: SparkSession, d: str) -> DataFrame:
    """Facets of the query log by region and segment, in one pass."""
    geo = table(spark, d, "nation").join(table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey"))
    c = table(spark, d, "customer").join(geo, F.col("c_nationkey") == F.col("n_nationkey")).selectExpr("c_custkey AS client_id", "c_mktsegment AS segment", "r_name AS region")
    return R.facets(query_logs(spark, d).join(c, "client_id"), ["segment", "region", "status"])


CLIENT_FACETS = f"""WITH {QUERY_LOGS}, f AS (SELECT c_mktsegment AS segment, r_name AS region, status FROM query_logs JOIN customer ON c_custkey = client_id JOIN nation ON n_nationkey = c_nationkey JOIN region ON r_regionkey = n_regionkey)
SELECT 'segment' AS facet, segment AS value, count(*) AS n FROM f GROUP BY 2 UNION ALL SELECT 'region', region, count(*) FROM f GROUP BY 2 UNION ALL SELECT 'status', status, count(*) FROM f GROUP BY 2"""


QUERIES = {
    "history_list": history_list, "history_page": history_page, "history_total": history_total, "retrieval_citations": retrieval_citations,
    "telemetry": telemetry, "client_counts": client_counts, "latest_job": latest_job, "document_enrichment": document_enrichment,
    "job_state_last": job_state_last, "job_windows": job_windows, "recent_turns": recent_turns, "sessions_recent": sessions_recent,
    "history_budget": history_budget, "cascade_delete": cascade_delete, "collection_merge": collection_merge, "client_facets": orders_by_client_status,
}
ORACLES = {
    "history_list": HISTORY_LIST, "history_page": HISTORY_PAGE, "history_total": HISTORY_TOTAL, "retrieval_citations": RETRIEVAL_CITATIONS,
    "telemetry": TELEMETRY, "client_counts": CLIENT_COUNTS, "latest_job": LATEST_JOB, "document_enrichment": DOCUMENT_ENRICHMENT,
    "job_state_last": JOB_STATE_LAST, "job_windows": JOB_WINDOWS, "recent_turns": RECENT_TURNS, "sessions_recent": SESSIONS_RECENT,
    "history_budget": HISTORY_BUDGET, "cascade_delete": CASCADE_DELETE, "collection_merge": COLLECTION_MERGE, "client_facets": CLIENT_FACETS,
}
