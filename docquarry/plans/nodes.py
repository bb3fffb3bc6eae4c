"""Queries of node keys, counts, figures, document status and histories, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import nodes as N, retrieval as V
from ..sources import tables as S
from .logs import JOBS, RETRIEVAL_LOGS, jobs, retrieval_logs
from .search import RERANKED, _any, reranked


def _sparse_nodes(spark: SparkSession, d: str) -> tuple[DataFrame, dict]:
    """Chunks with metadata of which each node lacks some."""
    c, n, text = S.chunks(spark, d), F.col("node_id"), lambda x: x.cast("string")
    given = {
        "node_id": F.when(n % 6 == 0, text(n)), "chunk_id": F.when(n % 6 == 1, F.concat(F.lit("c"), text(n))), "document_id": F.when(n % 6 == 2, F.concat(F.lit("d"), text(n % 50))), "document_name": F.when(n % 4 != 3, F.concat(F.lit(" Doc "), text(n % 9))),
        "file_name": F.when(n % 3 == 0, F.lit("f.pdf")), "source_file": F.when(n % 5 == 0, F.lit("s.pdf")), "version_label": F.when(n % 7 == 0, F.concat(F.lit(" V"), text(n % 3))).when(n % 7 == 1, F.lit("")), "version_group": F.when(n % 7 == 2, text(F.col("version_group") % 10)),
        "document_family": F.when(n % 7 == 3, F.lit("Family")), "citation_label": F.when(n % 6 == 3, F.concat(F.lit("label "), text(n))), "page_num": n % 4, "slide_num": n % 3, "rank": n % 20, "text": F.col("text"),
    }
    return c.select(n.alias("id"), *(v.alias(k) for k, v in given.items())), {k: F.col(k) for k in given}


_SPARSE = f"""{S.CHUNKS_SQL}, sn AS (SELECT node_id AS id, CASE WHEN node_id % 6 = 0 THEN node_id::VARCHAR END AS node, CASE WHEN node_id % 6 = 1 THEN 'c' || node_id END AS chunk_id, CASE WHEN node_id % 6 = 2 THEN 'd' || (node_id % 50) END AS doc, CASE WHEN node_id % 4 <> 3 THEN ' Doc ' || (node_id % 9) END AS dn,
  CASE WHEN node_id % 3 = 0 THEN 'f.pdf' END AS fn, CASE WHEN node_id % 5 = 0 THEN 's.pdf' END AS sf, CASE WHEN node_id % 7 = 0 THEN ' V' || (node_id % 3) END AS vl, CASE WHEN node_id % 7 = 2 THEN (version_group % 10)::VARCHAR END AS vg, CASE WHEN node_id % 7 = 3 THEN 'Family' END AS fam,
  CASE WHEN node_id % 6 = 3 THEN 'label ' || node_id END AS cl, node_id % 4 AS pg, node_id % 3 AS sl, node_id % 20 AS rk, coalesce(text, '') AS t FROM chunks),
su AS (SELECT *, coalesce(node, chunk_id, doc, cl, substr(t, 1, 80)) AS uq FROM sn)"""


def node_keys(spark: SparkSession, d: str) -> DataFrame:
    rows, columns = _sparse_nodes(spark, d)
    return rows.select("id", *((F.sha2(c, 256) if k == "fusion_key" else c).alias(k) for k, c in N.keys(columns).items()))


NODE_KEYS = f"""WITH {_SPARSE} SELECT id, sha256(coalesce(node, chunk_id, doc, coalesce(fn, 'unknown') || ':' || rk || ':' || substr(t, 1, 64))) AS fusion_key, uq AS unique_key,
coalesce('version:' || lower(trim(vl)), 'vg:' || lower(vg), 'doc:' || lower(trim(coalesce(dn, fn, sf))), 'node:' || uq) AS version_key, coalesce(doc, dn, sf, vl, vg, uq) AS document_key,
coalesce('version:' || lower(trim(vl)), 'group:' || lower(coalesce(vg, fam)), 'doc:' || doc, 'name:' || lower(trim(coalesce(dn, sf))), 'node:' || uq) AS diversity_key,
coalesce(lower(trim(coalesce(vl, vg))), '') || '|page:' || coalesce(CASE WHEN pg <> 0 THEN pg WHEN sl <> 0 THEN sl END::VARCHAR, '') AS page_key FROM su"""


def label_counts(spark: SparkSession, d: str) -> DataFrame:
    """Nodes by document and by version, in one pass."""
    rows, columns = _sparse_nodes(spark, d)
    pairs = F.array(*(F.struct(F.lit(k).alias("by"), c.alias("label")) for k, c in N.labels(columns).items()))
    return rows.select(F.inline(pairs)).groupBy("by", "label").agg(F.count("*").alias("n"))


LABEL_COUNTS = f"""WITH {_SPARSE} SELECT 'document_label' AS by, coalesce(dn, sf, doc, 'unknown') AS label, count(*) AS n FROM su GROUP BY 2
UNION ALL SELECT 'version_label', coalesce(vl, vg, fam, dn, doc, 'unknown'), count(*) FROM su GROUP BY 2"""


def metric_sources(spark: SparkSession, d: str) -> DataFrame:
    """Where ranked rows state the figures that questions on customers, markets and properties ask for."""
    n, q = F.col("node_id"), F.col("qid")
    names = F.array(F.lit("customers"), F.lit("Markets"), F.lit("properties"))
    pick = lambda k: F.element_at(names, (k % 3 + 1).cast("int"))
    said = F.concat(F.lit("We hold "), ((n % 6 + 1) * 1100).cast("string"), F.lit("+ global "), pick(n), F.lit(" and $1,"), (n % 3 * 100 + 250).cast("string"), F.lit("  million "), pick(n + 1), F.lit("."))
    rows = reranked(spark, d).select("qid", "rank", F.concat(F.lit("How many "), F.lower(pick(q)), F.lit(" are there?")).alias("question"), said.alias("text"))
    return N.metric_sources(rows)


METRIC_SOURCES = f"""WITH {RERANKED}, nm AS (SELECT ['customers', 'Markets', 'properties'] AS names),
mr AS (SELECT qid, rank, names[(qid % 3 + 1)::INT] AS asked, names[(node_id % 3 + 1)::INT] AS one, names[((node_id + 1) % 3 + 1)::INT] AS two, ((node_id % 6 + 1) * 1100) || '+ global ' AS fig1, '1' || (node_id % 3 * 100 + 250) || ' million ' AS fig2 FROM ranked, nm),
mv AS (SELECT qid, rank, 0 AS pos, fig1 || lower(one) AS value FROM mr WHERE one = asked UNION ALL SELECT qid, rank, 1, fig2 || lower(two) FROM mr WHERE two = asked)
SELECT qid, value, string_agg('[' || rank || ']', '' ORDER BY rank, pos) AS sources FROM mv GROUP BY 1, 2"""


def inspector_groups(spark: SparkSession, d: str) -> DataFrame:
    c, n = S.chunks(spark, d), F.col("node_id")
    points = c.select("client_id", "version_group", F.when(n % 5 != 4, F.col("chunk_type")).alias("chunk_type"), F.when(n % 3 == 0, F.array(F.col("page_num"), F.col("page_num") + 1)).alias("page_nums"), F.when(n % 4 != 0, F.col("page_num")).alias("page_num"))
    return N.grouped(points, ["client_id", "version_group"])


INSPECTOR_GROUPS = f"""WITH {S.CHUNKS_SQL}, p AS (SELECT client_id, version_group, CASE WHEN node_id % 5 <> 4 THEN chunk_type ELSE 'unknown' END AS kind, list_filter(CASE WHEN node_id % 3 = 0 THEN [page_num, page_num + 1] ELSE []::BIGINT[] END || [CASE WHEN node_id % 4 <> 0 THEN page_num END], lambda x: x IS NOT NULL) AS pages FROM chunks)
SELECT client_id, version_group, count(*) AS points, array_to_string(list_sort(list_distinct(list(kind))), ',') AS kinds, array_to_string(list_sort(list_distinct(flatten(list(pages)))), ',') AS pages FROM p GROUP BY 1, 2"""


def document_status(spark: SparkSession, d: str) -> DataFrame:
    docs = S.table(spark, d, "part").selectExpr("p_partkey AS document_id", "p_name AS name")
    r = retrieval_logs(spark, d)
    versions = S.table(spark, d, "lineitem").selectExpr("l_partkey AS document_id", "l_orderkey AS version_id", "concat('v', l_linenumber) AS version_label", "l_shipdate AS created_at", "l_linenumber").where("l_linenumber < 3")
    versions = versions.groupBy("document_id", "version_id", "created_at").agg(F.min("version_label").alias("version_label"))
    return N.document_status(docs, versions, r.select("document_id", (F.col("flag") == "N").alias("is_active")), jobs(spark, d))


DOCUMENT_STATUS = f"""WITH {RETRIEVAL_LOGS}, {JOBS}, v0 AS (SELECT l_partkey AS document_id, l_orderkey AS version_id, l_shipdate AS created_at, min('v' || l_linenumber) AS version_label FROM lineitem WHERE l_linenumber < 3 GROUP BY 1, 2, 3),
v AS (SELECT document_id, version_label FROM v0 QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY created_at, version_id) = 1), a AS (SELECT document_id, count(*) AS active_nodes FROM retrieval_logs WHERE flag = 'N' GROUP BY 1),
j AS (SELECT document_id, job_id, status FROM jobs QUALIFY row_number() OVER (PARTITION BY document_id ORDER BY started_at DESC NULLS LAST, job_id DESC) = 1)
SELECT p_partkey AS document_id, p_name AS name, version_label, coalesce(active_nodes, 0) AS active_nodes, job_id, coalesce(status, 'unknown') AS job_status FROM part LEFT JOIN v ON v.document_id = p_partkey LEFT JOIN a ON a.document_id = p_partkey LEFT JOIN j ON j.document_id = p_partkey"""


def client_updates(spark: SparkSession, d: str) -> DataFrame:
    """Updates of clients' models by name; names come with spaces, some of no client, some of inactive ones."""
    n = F.col("c_custkey")
    clients = S.table(spark, d, "customer").select(n.alias("client_id"), F.col("c_name").alias("name"), (n % 9 != 0).alias("is_active"), (n % 4).cast("string").alias("model"))
    updates = clients.select(F.when(F.col("client_id") % 11 == 0, F.lit("no such client")).otherwise(F.concat(F.lit("  "), "name")).alias("client_name"), F.when(F.col("client_id") % 2 == 0, F.col("model")).otherwise("new").alias("model"))
    documents = S.table(spark, d, "orders").select(F.col("o_custkey").alias("client_id"))
    return N.guarded_update(clients, updates, documents)


CLIENT_UPDATES = """WITH u AS (SELECT CASE WHEN c_custkey % 11 = 0 THEN 'no such client' ELSE '  ' || c_name END AS client_name, CASE WHEN c_custkey % 11 <> 0 AND c_custkey % 9 <> 0 THEN c_custkey END AS client_id, c_custkey % 2 = 0 AS same FROM customer)
SELECT client_name, client_id, CASE WHEN client_id IS NULL THEN 'missing' WHEN NOT same AND client_id IN (SELECT o_custkey FROM orders) THEN 'conflict' ELSE 'updated' END AS outcome FROM u"""


def recent_history(spark: SparkSession, d: str) -> DataFrame:
    c = S.table(spark, d, "conversations").withColumn("role", F.when(F.col("turn") % 3 == 0, F.upper("role")).otherwise(F.col("role")))
    return N.recent_history(c, "conv_id").select("conv_id", "place", "role", F.sha2("content", 256).alias("content"))


RECENT_HISTORY = r"""WITH t AS (SELECT conv_id, turn, lower(role) AS role, trim(regexp_replace(text, '\s+', ' ', 'g')) AS c FROM conversations WHERE lower(role) IN ('user', 'assistant')),
l AS (SELECT * FROM t WHERE c <> '' QUALIFY row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC, role DESC) <= 6)
SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role) AS place, role, sha256(CASE WHEN length(c) > 220 THEN rtrim(c[:217]) || '...' ELSE c END) AS content FROM l"""


def question_kinds(spark: SparkSession, d: str) -> DataFrame:
    """How many questions ask for each kind of thing."""
    kinds = N.question_kinds(F.col("question"))
    pairs = F.array(*(F.struct(F.lit(k).alias("kind"), c.alias("asked")) for k, c in kinds.items()))
    return S.asked(spark, d).select(F.inline(pairs)).groupBy("kind").agg(F.count_if("asked").alias("n"), F.count("*").alias("questions"))


_KINDS = {
    "comparative": _any("q", V.COMPARATIVE_TERMS), "balanced": _any("q", V.BALANCED_TERMS), "conflict": _any("q", V.CONFLICT_TERMS), "time_anchored": f"regexp_matches(q, '{V.YEAR}') OR {_any('q', V.TIME_TERMS)}",
    "wants_table": _any("q", V.TABLE_TERMS), "wants_chart": _any("q", V.CHART_TERMS), "wants_image": _any("q", V.IMAGE_TERMS), "wants_number": _any("q", V.NUMERIC_TERMS), "counts": _any("q", V.COUNT_TERMS),
}
QUESTION_KINDS = f"WITH {S.ASKED_SQL}, z AS (SELECT lower(question) AS q FROM asked) " + " UNION ALL ".join(f"SELECT '{k}' AS kind, count(*) FILTER ({test}) AS n, count(*) AS questions FROM z" for k, test in _KINDS.items())

QUERIES = {
    "node_keys": node_keys, "label_counts": label_counts, "metric_sources": metric_sources, "inspector_groups": inspector_groups, "document_status": document_status, "client_updates": client_updates,
    "recent_history": recent_history, "question_kinds": question_kinds,
}
ORACLES = {
    "node_keys": NODE_KEYS, "label_counts": LABEL_COUNTS, "metric_sources": METRIC_SOURCES, "inspector_groups": INSPECTOR_GROUPS, "document_status": DOCUMENT_STATUS, "client_updates": CLIENT_UPDATES,
    "recent_history": RECENT_HISTORY, "question_kinds": QUESTION_KINDS,
}
