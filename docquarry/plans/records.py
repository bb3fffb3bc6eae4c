"""Queries of log rows, states, deletions and manifests, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import records as R, relational
from ..sources.tables import table
from .logs import QUERY_LOGS, RETRIEVAL_LOGS, query_logs, retrieval_logs

NAMESPACE = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"


def retrieval_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Citations of each query written as log rows; those of returned lines name no document, so the registry's is taken."""
    r = retrieval_logs(spark, d).join(query_logs(spark, d).select("query_id", "client_id"), "query_id")
    registry = r.select("client_id", "node_id", "document_id", (F.col("flag") != "A").alias("is_active"))
    cited = r.withColumn("was", F.col("document_id")).withColumn("document_id", F.when(F.col("flag") != "R", F.col("document_id")))
    return R.retrieval_rows(cited, registry, [F.col("line"), F.col("was"), F.col("node_id"), F.col("score")], NAMESPACE)


RETRIEVAL_LOG_ROWS = f"""WITH {QUERY_LOGS}, {RETRIEVAL_LOGS}, r AS (SELECT l.*, client_id FROM retrieval_logs l JOIN query_logs USING (query_id)),
k AS (SELECT client_id, node_id, max(document_id) AS known FROM r WHERE flag <> 'A' GROUP BY 1, 2),
p AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY line, document_id, node_id, score) AS rank FROM r),
h AS (SELECT *, sha1(unhex('{NAMESPACE.replace("-", "")}') || encode(query_id || ':' || rank)) AS x FROM p LEFT JOIN k USING (client_id, node_id))
SELECT x[1:8] || '-' || x[9:12] || '-5' || x[14:16] || '-' || translate(x[17], '0123456789abcdef', '89ab89ab89ab89ab') || x[18:20] || '-' || x[21:32] AS log_id, query_id, node_id,
CASE WHEN flag <> 'R' THEN document_id ELSE known END AS document_id, rank, score AS retrieval_score FROM h"""


def _conflict_logs(spark: SparkSession, d: str) -> DataFrame:
    line = table(spark, d, "lineitem").where("l_returnflag = 'R'")
    kind = F.when(F.col("l_linenumber") % 2 == 0, F.lit("numeric_disagreement"))
    return line.select(F.col("l_orderkey").alias("query_id"), F.col("l_shipdate").alias("created_at"), kind.alias("conflict_type"), F.concat(F.lit("line "), F.col("l_linenumber").cast("string"), F.lit(" of "), F.col("l_partkey").cast("string")).alias("summary"))


def conflict_log_rows(spark: SparkSession, d: str) -> DataFrame:
    """Conflicts of each query in order of time, as one list."""
    rows = R.conflict_rows(_conflict_logs(spark, d))
    made = rows.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("created_at", "summary", "conflict_type"))).alias("c"))
    return made.select("query_id", F.size("c").cast("bigint").alias("conflicts"), F.array_join(F.transform("c", lambda x: F.concat_ws(": ", x["conflict_type"], x["summary"])), "; ").alias("listed"))


CONFLICT_LOG_ROWS = """WITH c AS (SELECT l_orderkey AS query_id, l_shipdate AS created_at, CASE WHEN l_linenumber % 2 = 0 THEN 'numeric_disagreement' ELSE 'unknown' END AS kind, 'line ' || l_linenumber || ' of ' || l_partkey AS summary FROM lineitem WHERE l_returnflag = 'R')
SELECT query_id, count(*) AS conflicts, string_agg(kind || ': ' || summary, '; ' ORDER BY created_at, summary, kind) AS listed FROM c GROUP BY 1"""


def query_log_states(spark: SparkSession, d: str) -> DataFrame:
    """Queries with their latest state: some still run, some failed with a long error, some ended with a long answer."""
    q = query_logs(spark, d)
    ended = q.where("status <> 'running'").select(
        "query_id", F.when(F.col("status") == "completed", F.repeat(F.col("question"), 700)).alias("answer"), F.when(F.col("status") == "failed", F.repeat(F.lit("timed out "), 60)).alias("error")
    )
    views = {"chars": F.length("answer").cast("bigint"), "begins": F.substring("answer", 1, 20)}
    return R.query_states(q.select("query_id", "client_id"), ended, views).select("query_id", "client_id", "status", "chars", "begins")


QUERY_LOG_STATES = f"""WITH {QUERY_LOGS}, a AS (SELECT *, CASE status WHEN 'completed' THEN repeat(question, 700)[:5000] WHEN 'failed' THEN 'Error: ' || repeat('timed out ', 60)[:500] END AS answer FROM query_logs)
SELECT query_id, client_id, status, length(answer) AS chars, answer[:20] AS begins FROM a"""


def _messages(spark: SparkSession, d: str) -> DataFrame:
    c, n = table(spark, d, "conversations"), F.col("conv_id") + F.col("turn")
    cited = F.when(n % 4 == 0, F.concat(F.lit('[{"rank": 1, "label": "a'), F.col("turn").cast("string"), F.lit('"}, 5, "x", {"rank": 2}]'))).when(n % 4 == 1, F.lit("[broken")).when(n % 4 == 2, F.lit("[]"))
    return c.select("conv_id", (F.col("conv_id") % 40).alias("query_id"), (F.col("conv_id") * 1000 + F.col("turn")).alias("message_id"), "turn", "role", cited.alias("citations_json"))


def history_messages(spark: SparkSession, d: str) -> DataFrame:
    """Citations that the last message of each query has; broken lists count as none."""
    q = table(spark, d, "orders").select((F.col("o_orderkey") % 30).alias("query_id"))
    made = R.citations_of(_messages(spark, d), q)
    return made.select("query_id", F.size("citations").cast("bigint").alias("n"), F.get_json_object(F.element_at("citations", 1), "$.label").alias("first_label"))


_MESSAGES = """m AS (SELECT conv_id, conv_id % 40 AS query_id, conv_id * 1000 + turn AS message_id, turn, role,
  CASE (conv_id + turn) % 4 WHEN 0 THEN '[{"rank": 1, "label": "a' || turn || '"}, 5, "x", {"rank": 2}]' WHEN 1 THEN '[broken' WHEN 2 THEN '[]' END AS citations_json FROM conversations)"""
HISTORY_MESSAGES = f"""WITH {_MESSAGES},
v AS (SELECT *, list_filter(CASE WHEN json_valid(citations_json) THEN citations_json ELSE '[]' END::JSON[], lambda x: json_type(x) = 'OBJECT') AS items FROM m WHERE role = 'assistant' AND query_id IN (SELECT o_orderkey % 30 FROM orders))
SELECT query_id, len(items) AS n, json_extract_string(items[1], '$.label') AS first_label FROM v WHERE len(items) > 0 QUALIFY row_number() OVER (PARTITION BY query_id ORDER BY turn DESC, message_id DESC) = 1"""


def delete_history_item(spark: SparkSession, d: str) -> DataFrame:
    """Messages once every seventh query is deleted: they stay, but name no query."""
    m = _messages(spark, d)
    gone = m.where("query_id % 7 = 3").select("query_id")
    return R.unlink(m, gone, "query_id").select("message_id", "query_id", "role")


DELETE_HISTORY = f"WITH {_MESSAGES} SELECT message_id, CASE WHEN query_id % 7 <> 3 THEN query_id END AS query_id, role FROM m"


def delete_session(spark: SparkSession, d: str) -> DataFrame:
    """Sessions left with their messages once some are cleared (no message stays) and some deleted (nothing does)."""
    m = _messages(spark, d)
    sessions = m.select("conv_id").distinct()
    deleted, cleared = sessions.where("conv_id % 5 = 0"), sessions.where("conv_id % 5 = 1")
    left = relational.without(m, deleted.unionByName(cleared), "conv_id").groupBy("conv_id").agg(F.count("*").alias("messages"), F.max("turn").alias("last_turn"))
    return relational.without(sessions, deleted, "conv_id").join(left, "conv_id", "left").select("conv_id", F.coalesce("messages", F.lit(0)).alias("messages"), "last_turn")


DELETE_SESSION = f"""WITH {_MESSAGES} SELECT conv_id, count(*) FILTER (conv_id % 5 <> 1) AS messages, max(turn) FILTER (conv_id % 5 <> 1) AS last_turn FROM m WHERE conv_id % 5 <> 0 GROUP BY 1"""


def delete_documents(spark: SparkSession, d: str) -> DataFrame:
    """Nodes of each document after a soft deletion of some and a hard one of others."""
    docs = table(spark, d, "part").selectExpr("p_partkey AS document_id", "'indexed' AS status")
    nodes = retrieval_logs(spark, d).select("document_id", "node_id", (F.col("flag") == "N").alias("is_active"))
    docs, nodes = R.delete_documents(docs, nodes, docs.where("document_id % 10 = 1"), hard=False)
    docs, nodes = R.delete_documents(docs, nodes, docs.where("document_id % 10 = 2"), hard=True)
    per = nodes.groupBy("document_id").agg(F.count("*").alias("nodes"), F.count_if("is_active").alias("active"))
    return docs.join(per, "document_id", "left").fillna(0, ["nodes", "active"])


DELETE_DOCUMENTS = f"""WITH {RETRIEVAL_LOGS}, n AS (SELECT document_id, count(*) AS nodes, count(*) FILTER (flag = 'N' AND document_id % 10 <> 1) AS active FROM retrieval_logs GROUP BY 1)
SELECT p_partkey AS document_id, CASE WHEN p_partkey % 10 = 1 THEN 'deleted' ELSE 'indexed' END AS status, coalesce(nodes, 0) AS nodes, coalesce(active, 0) AS active FROM part LEFT JOIN n ON document_id = p_partkey WHERE p_partkey % 10 <> 2"""


def delete_clients(spark: SparkSession, d: str) -> DataFrame:
    """Rows left in each of ten tables once the clients of one segment are deleted, through two levels of links."""
    clients = table(spark, d, "customer").selectExpr("c_custkey AS client_id", "c_mktsegment AS segment")
    owner = "CAST({0} % 120 + 1 AS BIGINT) AS client_id"
    q = query_logs(spark, d).select("query_id", "client_id")
    docs = table(spark, d, "part").selectExpr("p_partkey AS document_id", owner.format("p_partkey"))
    chats = table(spark, d, "conversations").selectExpr("conv_id", "turn")
    tables = {
        "clients": clients, "query_logs": q, "retrieval_logs": retrieval_logs(spark, d).select("query_id", "node_id"), "conflict_logs": _conflict_logs(spark, d).select("query_id"),
        "sessions": chats.select("conv_id").distinct().selectExpr("conv_id", owner.format("conv_id")), "messages": chats, "memory": chats.where("turn % 2 = 1"),
        "documents": docs, "registry": retrieval_logs(spark, d).select("document_id", "node_id"), "jobs": table(spark, d, "events").selectExpr("user_id AS document_id", "event_id"),
    }
    links = [("query_logs", "retrieval_logs", "query_id"), ("query_logs", "conflict_logs", "query_id"), ("sessions", "messages", "conv_id"), ("sessions", "memory", "conv_id"), ("documents", "registry", "document_id"), ("documents", "jobs", "document_id")]
    left = R.cascade(tables, links, clients.where("segment = 'BUILDING'"), "client_id")
    counts = [rows.agg(F.count("*").alias("left_over")).withColumn("log", F.lit(name)) for name, rows in left.items()]
    out = counts[0]
    for c in counts[1:]:
        out = out.unionByName(c)
    return out.select("log", "left_over")


DELETE_CLIENTS = f"""WITH {QUERY_LOGS}, {RETRIEVAL_LOGS}, gone AS (SELECT c_custkey FROM customer WHERE c_mktsegment = 'BUILDING'),
q AS (SELECT query_id FROM query_logs WHERE client_id IN (FROM gone)), s AS (SELECT DISTINCT conv_id FROM conversations WHERE conv_id % 120 + 1 IN (FROM gone)), p AS (SELECT p_partkey AS document_id FROM part WHERE p_partkey % 120 + 1 IN (FROM gone))
SELECT 'clients' AS log, count(*) AS left_over FROM customer WHERE c_mktsegment <> 'BUILDING' UNION ALL SELECT 'query_logs', count(*) FROM query_logs WHERE client_id NOT IN (FROM gone)
UNION ALL SELECT 'retrieval_logs', count(*) FROM retrieval_logs ANTI JOIN q USING (query_id) UNION ALL SELECT 'conflict_logs', count(*) FROM (SELECT l_orderkey AS query_id FROM lineitem WHERE l_returnflag = 'R') ANTI JOIN q USING (query_id)
UNION ALL SELECT 'sessions', count(*) FROM (SELECT DISTINCT conv_id FROM conversations) ANTI JOIN s USING (conv_id) UNION ALL SELECT 'messages', count(*) FROM conversations ANTI JOIN s USING (conv_id) UNION ALL SELECT 'memory', count(*) FROM (FROM conversations WHERE turn % 2 = 1) ANTI JOIN s USING (conv_id)
UNION ALL SELECT 'documents', count(*) FROM (SELECT p_partkey AS document_id FROM part) ANTI JOIN p USING (document_id) UNION ALL SELECT 'registry', count(*) FROM retrieval_logs ANTI JOIN p USING (document_id) UNION ALL SELECT 'jobs', count(*) FROM (SELECT user_id AS document_id FROM events) ANTI JOIN p USING (document_id)"""


def run_manifest(spark: SparkSession, d: str) -> DataFrame:
    o, n = table(spark, d, "orders"), F.col("o_orderkey")
    state = F.when(n % 11 == 0, "malformed").when(n % 13 == 0, "blank").when(F.col("o_orderstatus") == "P", "failed").otherwise("succeeded")
    return R.run_manifest(o.select(F.col("o_orderpriority").alias("run"), state.alias("state"), F.when(n % 3 == 0, n % 5 + 1).alias("passes")), ["run"])


RUN_MANIFEST = """WITH r AS (SELECT o_orderpriority AS run, CASE WHEN o_orderkey % 11 = 0 THEN 'malformed' WHEN o_orderkey % 13 = 0 THEN 'blank' WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'succeeded' END AS state, CASE WHEN o_orderkey % 3 = 0 THEN o_orderkey % 5 + 1 END AS passes FROM orders)
SELECT run, count(*) AS rows, count(*) FILTER (state = 'succeeded') AS succeeded, count(*) FILTER (state = 'failed') AS failed, count(*) FILTER (state = 'malformed') AS malformed, count(*) FILTER (state = 'blank') AS blank, count(passes) AS agentic,
round(avg(passes), 2) AS avg_passes, max(passes) AS max_passes, count(*) FILTER (passes > 1) AS looped, count(*) FILTER (state IN ('succeeded', 'failed')) AS processed, true AS complete FROM r GROUP BY 1"""


def model_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Clients without a model get the default; how many of each segment that are, and which model each resolves to."""
    n = F.col("c_custkey")
    c = table(spark, d, "customer").select("c_mktsegment", F.when(n % 3 != 0, F.concat(F.lit("m"), (n % 4).cast("string"))).alias("model"), F.when(n % 10 == 0, F.lit("own")).when(n % 10 == 1, F.lit(" ")).alias("user_model"))
    filled, updated, kept = R.backfilled(c, "model", "base")
    counts = c.groupBy("c_mktsegment").agg(updated.alias("updated"), kept.alias("already_set"))
    used = filled.groupBy("c_mktsegment", R.resolved_model(F.col("user_model"), F.col("model"), "base").alias("model")).agg(F.count("*").alias("clients"))
    return used.join(counts, "c_mktsegment").withColumnRenamed("c_mktsegment", "segment")


MODEL_BACKFILL = """WITH c AS (SELECT c_mktsegment AS segment, CASE WHEN c_custkey % 3 <> 0 THEN 'm' || c_custkey % 4 END AS model, CASE WHEN c_custkey % 10 = 0 THEN 'own' END AS own FROM customer),
n AS (SELECT segment, count(*) FILTER (model IS NULL) AS updated, count(model) AS already_set FROM c GROUP BY 1)
SELECT segment, coalesce(own, model, 'base') AS model, count(*) AS clients, any_value(updated) AS updated, any_value(already_set) AS already_set FROM c JOIN n USING (segment) GROUP BY 1, 2"""


def collection_structure(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("vec_id")
    points = table(spark, d, "embeddings").select(F.concat(F.lit("collection "), F.col("label").cast("string")).alias("collection"), F.when(F.col("label") % 3 == 2, F.slice("embedding", 1, 32)).otherwise(F.col("embedding")).alias("dense"), F.when((F.col("label") % 2 == 0) & (n % 2 == 0), F.array(F.lit(1))).alias("sparse"))
    return R.structure(points, "collection")


COLLECTION_STRUCTURE = """WITH p AS (SELECT 'collection ' || label AS collection, CASE WHEN label % 3 = 2 THEN 32 ELSE len(embedding) END AS size, label % 2 = 0 AND vec_id % 2 = 0 AS sparse FROM embeddings),
g AS (SELECT collection, count(*) AS points, CASE WHEN min(size) = max(size) THEN max(size) END AS dense_size, bool_or(sparse) AS has_sparse FROM p GROUP BY 1)
SELECT *, dense_size IS NOT DISTINCT FROM first_value(dense_size) OVER (ORDER BY collection) AND has_sparse = first_value(has_sparse) OVER (ORDER BY collection) AS like_first FROM g"""


def compare_requested(spark: SparkSession, d: str) -> DataFrame:
    """Documents asked for by id, some of them absent, in the order asked for: a request for each conversation."""
    c = table(spark, d, "conversations")
    asked = c.select(F.col("conv_id").alias("request_id"), F.col("turn").alias("pos"), ((F.col("conv_id") * 7 + F.col("turn") * 3) % 230).alias("doc_id"))
    docs = table(spark, d, "documents").where("doc_id % 40 <> 5").select("doc_id", "source", "n_chars")
    return R.requested(docs, asked, "doc_id").select("request_id", "pos", "doc_id", "source", "n_chars", "missing", "state")


COMPARE_REQUESTED = """WITH a AS (SELECT conv_id AS request_id, turn AS pos, (conv_id * 7 + turn * 3) % 230 AS doc_id FROM conversations), f AS (SELECT a.*, source, n_chars, d.doc_id IS NULL AS absent FROM a LEFT JOIN (FROM documents WHERE doc_id % 40 <> 5) d USING (doc_id))
SELECT request_id, pos, doc_id, source, n_chars, count(*) FILTER (absent) OVER w AS missing, CASE WHEN count(*) OVER w NOT BETWEEN 2 AND 4 THEN 'refused' WHEN count(*) FILTER (absent) OVER w > 0 THEN 'missing' ELSE 'ok' END AS state FROM f WINDOW w AS (PARTITION BY request_id)"""


def sessions_page(spark: SparkSession, d: str) -> DataFrame:
    """The newest sessions by their last message, then their first; a page of as many as may be asked for."""
    e = table(spark, d, "events").groupBy(F.col("user_id").alias("session_id")).agg(F.max("ts").alias("last_activity"), F.min("ts").alias("created_at"))
    return relational.page(e, [F.desc("last_activity"), F.desc("created_at"), F.desc("session_id")], limit=500, offset=0)


SESSIONS_PAGE = "SELECT user_id AS session_id, max(ts) AS last_activity, min(ts) AS created_at FROM events GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 DESC LIMIT 200"

QUERIES = {
    "retrieval_log_rows": retrieval_log_rows, "conflict_log_rows": conflict_log_rows, "query_log_states": query_log_states, "history_messages": history_messages, "delete_history_item": delete_history_item,
    "delete_session": delete_session, "delete_documents": delete_documents, "delete_clients": delete_clients, "run_manifest": run_manifest, "model_backfill": model_backfill, "collection_structure": collection_structure,
    "compare_requested": compare_requested, "sessions_page": sessions_page,
}
ORACLES = {
    "retrieval_log_rows": RETRIEVAL_LOG_ROWS, "conflict_log_rows": CONFLICT_LOG_ROWS, "query_log_states": QUERY_LOG_STATES, "history_messages": HISTORY_MESSAGES, "delete_history_item": DELETE_HISTORY,
    "delete_session": DELETE_SESSION, "delete_documents": DELETE_DOCUMENTS, "delete_clients": DELETE_CLIENTS, "run_manifest": RUN_MANIFEST, "model_backfill": MODEL_BACKFILL, "collection_structure": COLLECTION_STRUCTURE,
    "compare_requested": COMPARE_REQUESTED, "sessions_page": SESSIONS_PAGE,
}
