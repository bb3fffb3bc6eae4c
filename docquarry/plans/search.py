"""Queries of search, ranking, evidence, conflicts and their measures, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intents, text as T
from ..operators import cells, evaluation as E, evidence, retrieval as V
from ..sources import tables as S

NOW = "2024-07-01"
DEPTH = 10


def _vectors(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Queries (every vector whose id 50 divides) and all vectors; label is the client, id modulo 10 the session."""
    v = S.table(spark, d, "embeddings").selectExpr("vec_id AS node_id", "embedding", "label AS client", "vec_id % 10 AS session")
    return v.where("node_id % 50 = 0").withColumnRenamed("node_id", "qid"), v


def dense_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.dense_topk(*_vectors(spark, d), DEPTH)


def tenant_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.dense_topk(*_vectors(spark, d), DEPTH, scope=("client",))


def chat_memory_search(spark: SparkSession, d: str) -> DataFrame:
    return V.dense_topk(*_vectors(spark, d), 4, scope=("client",), apart="session")


def cells_topk(spark: SparkSession, d: str) -> DataFrame:
    """The approximate counterpart of ``dense_topk``."""
    asked, held = _vectors(spark, d)
    fitted = cells.fit(held, DEPTH)
    return cells.search(asked, cells.index(held, fitted), fitted, DEPTH)


def _cosine(where: str, k: int) -> str:
    return f"""WITH e AS (SELECT vec_id, label AS client, vec_id % 10 AS session, embedding::DOUBLE[] AS v FROM embeddings),
s AS (SELECT q.vec_id AS qid, c.vec_id AS node_id, round(list_cosine_similarity(q.v, c.v), 6) + 0.0 AS score FROM e q JOIN e c ON q.vec_id % 50 = 0 {where})
SELECT qid, node_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM s
QUALIFY row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) <= {k}"""


def bm25_topk(spark: SparkSession, d: str) -> DataFrame:
    return V.sparse_topk(S.questions(spark, d), S.chunks(spark, d), DEPTH)


BM25 = """t AS (SELECT doc_id AS node_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
q AS (SELECT DISTINCT item_id AS qid, unnest(regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+')) AS term FROM benchmark),
l AS (SELECT node_id, len(ts) AS length FROM t), st AS (SELECT count(*) AS n, avg(length) AS average FROM l),
tf AS (SELECT node_id, term, count(*) AS tf FROM (SELECT node_id, unnest(ts) AS term FROM t) SEMI JOIN (SELECT DISTINCT term FROM q) z USING (term) GROUP BY 1, 2),
idf AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1),
bm AS (SELECT qid, node_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / (SELECT average FROM st)))), 6) AS score
  FROM tf JOIN l USING (node_id) JOIN idf USING (term) JOIN q USING (term) GROUP BY 1, 2),
sparse AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM bm QUALIFY rank <= 10)"""


def tenant_filter_search(spark: SparkSession, d: str) -> DataFrame:
    return V.sparse_topk(S.questions(spark, d), S.chunks(spark, d), 3, "client_id").select("qid", "client_id", "node_id", "score", "rank")


def _lists(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Two lists of the questions: sparse hits, and chunks by how many question terms they hold."""
    return V.sparse_lists(S.questions(spark, d), S.chunks(spark, d), DEPTH)


OVERLAP = """ov AS (SELECT qid, node_id, count(*)::DOUBLE AS score FROM (SELECT DISTINCT node_id, unnest(ts) AS term FROM t) JOIN q USING (term) GROUP BY 1, 2),
overlap AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM ov QUALIFY rank <= 10)"""


def hybrid_fusion(spark: SparkSession, d: str) -> DataFrame:
    sparse, other = _lists(spark, d)
    return V.blend(other, sparse)


HYBRID = f"""WITH {BM25}, {OVERLAP},
a AS (SELECT qid, node_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS x FROM overlap WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, node_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS x FROM sparse WINDOW w AS (PARTITION BY qid))
SELECT qid, node_id, round(0.5 * coalesce(a.x, 0.0) + 0.5 * coalesce(b.x, 0.0), 6) AS score FROM a FULL JOIN b USING (qid, node_id)"""


def fused(spark: SparkSession, d: str) -> DataFrame:
    sparse, other = _lists(spark, d)
    # Both lists lie by question, and Spark may take their union for rows by question where it runs one after the other; an exchange by other
    # columns isn't left out.
    both = sparse.withColumn("variant", F.lit(0)).unionByName(other.withColumn("variant", F.lit(1))).repartition("qid", "node_id")
    return V.top_ranked(V.fuse(both), ["qid"], [F.desc("score"), F.asc("node_id")], 15)


FUSED = f"""{BM25}, {OVERLAP},
fs AS (SELECT qid, node_id, round(sum(score + 1.0 / (60 + rank)), 6) AS score FROM (SELECT qid, node_id, score, rank FROM sparse UNION ALL SELECT qid, node_id, score, rank FROM overlap) GROUP BY 1, 2),
fused AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank FROM fs QUALIFY rank <= 15)"""


def _candidates(spark: SparkSession, d: str) -> DataFrame:
    """Fused candidates with their question and the metadata that ranking reads."""
    asked = S.questions(spark, d)
    rows = V.sent(fused(spark, d), asked).join(S.chunks(spark, d), "node_id").join(asked, "qid")
    return V.temporal_context(rows, ["qid"])


CONTEXT = f"""{S.CHUNKS_SQL}, {FUSED},
cand AS (SELECT f.qid, f.score, f.rank, c.*, b.text AS question FROM fused f JOIN chunks c USING (node_id) JOIN benchmark b ON b.item_id = f.qid),
g AS (SELECT *, max(CASE WHEN is_current THEN version_rank END) OVER w AS explicit_rank, max(version_rank) OVER w AS top_rank FROM cand WINDOW w AS (PARTITION BY qid, version_group)),
ctx AS (SELECT *, explicit_rank IS NULL AND version_rank = top_rank AS implicit_current, version_rank < coalesce(explicit_rank, top_rank) AS superseded FROM g),
adj AS (SELECT *, CASE WHEN coalesce(is_current, false) OR implicit_current THEN 0.1 WHEN is_current = false THEN -0.05 ELSE 0.0 END::DOUBLE
  + CASE WHEN superseded THEN -0.05 ELSE 0.0 END::DOUBLE + least(version_rank / 203012.0::DOUBLE, 1.0) * 0.15::DOUBLE
  + CASE WHEN DATE '2024-07-01' BETWEEN effective_from AND effective_to THEN 0.08::DOUBLE
         WHEN DATE '2024-07-01' > effective_to AND NOT (coalesce(is_current, false) OR implicit_current) THEN -least((DATE '2024-07-01' - effective_to) / 30.0::DOUBLE * 0.02, 0.10)
         WHEN DATE '2024-07-01' < effective_from THEN -0.03::DOUBLE ELSE 0.0::DOUBLE END
  + CASE WHEN DATE '2024-07-01' - published_at < 90 THEN 0.04 WHEN DATE '2024-07-01' - published_at < 365 THEN 0.015 WHEN DATE '2024-07-01' - published_at > 730 THEN -0.02 ELSE 0.0 END::DOUBLE AS temporal FROM ctx)"""


def temporal_context(spark: SparkSession, d: str) -> DataFrame:
    return V.temporal_context(S.chunks(spark, d), ["client_id"]).select("node_id", "client_id", "version_group", "implicit_current", "superseded")


TEMPORAL_CONTEXT = f"""WITH {S.CHUNKS_SQL}, g AS (SELECT *, max(CASE WHEN is_current THEN version_rank END) OVER w AS e, max(version_rank) OVER w AS m FROM chunks WINDOW w AS (PARTITION BY client_id, version_group))
SELECT node_id, client_id, version_group, e IS NULL AND version_rank = m AS implicit_current, version_rank < coalesce(e, m) AS superseded FROM g"""


def temporal_adjustment(spark: SparkSession, d: str) -> DataFrame:
    return _candidates(spark, d).select("qid", "node_id", F.round(V.temporal_adjustment(NOW), 6).alias("temporal"))


def structural_adjustment(spark: SparkSession, d: str) -> DataFrame:
    """Every kind of question against every kind of chunk, for the questions asked of each client's chunks."""
    asked = S.asked(spark, d)
    kinds = S.chunks(spark, d).groupBy("chunk_type").agg(F.count("*").alias("chunks"))
    rows = asked.withColumn("chunk_type", F.element_at(F.array(*map(F.lit, S.CHUNK_TYPES)), (F.col("qid") % 5 + 1).cast("int"))).join(kinds, "chunk_type")
    add = V.structural_adjustment(F.col("question"), F.col("chunk_type"), F.col("qid") % 2 == 0, (F.col("qid") % 10) / 20)
    return rows.select("qid", "chunk_type", "chunks", F.round(add, 6).alias("structural"))


def _any(column: str, terms: tuple[str, ...]) -> str:
    return "(" + " OR ".join(f"contains({column}, '{t.replace(chr(39), chr(39) * 2)}')" for t in terms) + ")"


STRUCTURAL = f"""WITH {S.CHUNKS_SQL}, {S.ASKED_SQL}, k AS (SELECT chunk_type, count(*) AS chunks FROM chunks GROUP BY 1),
a AS (SELECT qid, lower(question) AS ql, ['body_text', 'full_table', 'chart_context', 'reasoning_page', 'page_card'][(qid % 5 + 1)::INT] AS chunk_type FROM asked),
b AS (SELECT *, {_any('ql', V.TABLE_TERMS)} AS tb, {_any('ql', V.CHART_TERMS)} AS ch, {_any('ql', V.NUMERIC_TERMS)} AS nu,
  chunk_type = 'full_table' AS it, chunk_type = 'chart_context' AS ic, chunk_type LIKE 'reasoning\\_%' ESCAPE '\\' AS re FROM a JOIN k USING (chunk_type))
SELECT qid, chunk_type, chunks, round(least(greatest((CASE WHEN tb AND it THEN 0.12 ELSE 0 END + CASE WHEN ch AND ic THEN 0.12 ELSE 0 END + CASE WHEN (tb OR ch) AND re THEN 0.05 ELSE 0 END
 + CASE WHEN nu AND qid % 2 = 0 THEN 0.03 ELSE 0 END + CASE WHEN (tb OR ch) AND (it OR ic) THEN 0.06 ELSE 0 END
 + CASE WHEN nu THEN CASE WHEN (qid % 10) / 20 >= 0.25 THEN 0.045 WHEN (qid % 10) / 20 >= 0.08 THEN 0.025 ELSE 0 END ELSE 0 END)::DOUBLE, -0.25), 0.6), 6) AS structural FROM b"""


def reranked(spark: SparkSession, d: str) -> DataFrame:
    rows = _candidates(spark, d).withColumn("semantic", V.minmax("score", ["qid"]))
    rows = rows.withColumn("final", F.round(F.col("semantic") + V.temporal_adjustment(NOW), 6)).drop("rank")
    return V.top_ranked(rows, ["qid"], [F.desc("final"), F.asc("node_id")], 15)


def rerank_topk(spark: SparkSession, d: str) -> DataFrame:
    return reranked(spark, d).select("qid", "node_id", "final", "rank")


RERANKED = f"""{CONTEXT}, rr AS (SELECT * EXCLUDE (rank), round(CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END + temporal, 6) AS final FROM adj WINDOW w AS (PARTITION BY qid)),
ranked AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY final DESC, node_id) AS rank FROM rr QUALIFY rank <= 15)"""


def evidence_diverse(spark: SparkSession, d: str) -> DataFrame:
    return V.diverse_first(reranked(spark, d), ["qid"], "chunk_type", 8).select("qid", "node_id", "place")


EVIDENCE_DIVERSE = f"""WITH {RERANKED}, f AS (SELECT *, row_number() OVER (PARTITION BY qid, chunk_type ORDER BY rank) > 1 AS later FROM ranked)
SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY later, rank) AS place FROM f QUALIFY place <= 8"""


def evidence_quota(spark: SparkSession, d: str) -> DataFrame:
    return V.with_quota(reranked(spark, d), ["qid"], "chunk_type", 3, 2, 7).select("qid", "node_id", "place")


EVIDENCE_QUOTA = f"""WITH {RERANKED}, p AS (SELECT *, min(rank) OVER (PARTITION BY qid, chunk_type) AS lead_rank, row_number() OVER (PARTITION BY qid, chunk_type ORDER BY rank) AS nth FROM ranked),
n AS (SELECT *, dense_rank() OVER (PARTITION BY qid ORDER BY lead_rank) AS group_no FROM p),
c AS (SELECT * FROM n QUALIFY row_number() OVER (PARTITION BY qid ORDER BY NOT (group_no <= 3 AND nth <= 2), rank) <= 7)
SELECT qid, node_id, row_number() OVER (PARTITION BY qid ORDER BY rank) AS place FROM c"""


def evidence_numeric_first(spark: SparkSession, d: str) -> DataFrame:
    rows = reranked(spark, d).withColumn("plain", F.coalesce(T.number_count(F.col("text")), F.lit(0)) == 0).withColumnRenamed("rank", "given_rank")
    return V.top_ranked(rows, ["qid"], [F.asc("plain"), F.asc("given_rank")], 15).select("qid", "node_id", "plain", "rank")


NUMERIC_FIRST = rf"""WITH {RERANKED}, n AS (SELECT *, len(regexp_extract_all(coalesce(text, ''), '\b\d+[.,]?\d*%?\b')) = 0 AS plain FROM ranked)
SELECT qid, node_id, plain, row_number() OVER (PARTITION BY qid ORDER BY plain, n.rank) AS rank FROM n"""


def evidence_pipeline(spark: SparkSession, d: str) -> DataFrame:
    """All rules on the ranked rows of each question, by its own labels; a series of replacements, so there is no SQL for it.

    A question has 15 ranked rows, so the cap is 8 here: under ``retrieval.evidence_cap`` no row would have to give way.
    """
    rows = reranked(spark, d).withColumns({
        "labels": F.array_join(intents.labels(F.col("question")), ","), "cap": F.lit(8), "document": F.col("client_id"), "page": F.col("page_num").cast("string"),
        "version": F.col("version_rank").cast("string"), "score": F.col("final"), "images": F.col("chunk_type").isin("chart_context", "page_card"),
    })
    return evidence.select_evidence(rows.select("qid", "node_id", "rank", "labels", "cap", "document", "page", "version", "question", "text", "document_name", "chunk_type", "version_rank", "score", "images"))


def chunk_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Histogram of kinds and documents among ranked candidates of each question."""
    rows = reranked(spark, d)
    return rows.groupBy("qid", "chunk_type").agg(F.count("*").alias("n"), F.count_distinct("version_group").alias("groups"), F.max("final").alias("best"))


CHUNK_DIAGNOSTICS = f"WITH {RERANKED} SELECT qid, chunk_type, count(*) AS n, count(DISTINCT version_group) AS groups, max(final) AS best FROM ranked GROUP BY 1, 2"


def intent_labels(spark: SparkSession, d: str) -> DataFrame:
    labels = intents.labels(F.col("question"))
    return S.asked(spark, d).select("qid", F.array_join(labels, ",").alias("labels"), V.evidence_cap(labels).alias("evidence_cap"), V.prefetch_depth(labels).alias("prefetch_depth"))


def label_tests() -> dict[str, str]:
    """The SQL test of each label on a normalised question ``n``."""
    a = lambda t: _any("n", t)
    i = intents
    tests = [
        rf"regexp_matches(n, '{i.TIME_WORDS}') AND ({a(i.DELTA)} OR {a(i.PROJECTION)})",
        f"{a(i.IMPACT)} AND {a(i.COMMUNITY)}",
        f"{a(i.CAVEAT)} OR (contains(n, 'as of') AND {a(i.AS_OF_METRICS)}) OR ({a(i.SHARE_ASKED)} AND {a(i.SHARE_SUBJECTS)}) OR (contains(n, 'how big') AND {a(i.BIG_SUBJECTS)}) OR ({a(i.COUNT_ASKED)} AND {a(i.COUNT_SUBJECTS)})",
        a(i.OUTLOOK),
        a(i.BALANCED),
        f"NOT {a(i.BREADTH)} AND {a(i.LOOKUP)} AND {a(i.VERSIONED)}",
        a(i.VISUAL),
        a(i.CORPUS),
    ]
    return dict(zip(i.LABELS, tests, strict=True))


def _intent_sql() -> str:
    flags = ", ".join(f"({t}) AS {name}" for name, t in label_tests().items())
    names = ", ".join(f"CASE WHEN {name} THEN '{name}' END" for name in intents.LABELS)
    return rf"""WITH {S.ASKED_SQL}, z AS (SELECT qid, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS n FROM asked), f AS (SELECT qid, {flags} FROM z)
SELECT qid, concat_ws(',', {names}) AS labels, CASE WHEN caveat_inconsistency THEN 20 WHEN corpus_wide_scope THEN 25 WHEN temporal_delta THEN 22 WHEN balanced_scope THEN 20 ELSE 25 END::BIGINT AS evidence_cap,
(75 + CASE WHEN caveat_inconsistency THEN 10 ELSE 0 END + CASE WHEN balanced_scope THEN 20 ELSE 0 END + CASE WHEN corpus_wide_scope THEN 30 ELSE 0 END)::BIGINT AS prefetch_depth FROM f"""


def query_dedupe(spark: SparkSession, d: str) -> DataFrame:
    """Questions asked in different case or spacing, once each, the earliest kept."""
    rows = S.asked(spark, d).withColumn("norm", intents.normalised(F.col("question")))
    return rows.groupBy("norm").agg(F.min("qid").alias("qid"), F.count("*").alias("asked")).select("qid", "norm", "asked")


QUERY_DEDUPE = rf"""WITH {S.ASKED_SQL} SELECT min(qid) AS qid, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS norm, count(*) AS asked FROM asked GROUP BY 2"""


def retrieval_eval(spark: SparkSession, d: str) -> DataFrame:
    """Measures of the dense list, with the vectors of the query's label as gold, for each query and over all."""
    queries, vectors = _vectors(spark, d)
    members = vectors.select("client", "node_id").distinct()
    gold = members.groupBy("client").agg(F.count("*").alias("gold"))
    found = V.top_ranked(dense_topk(spark, d).groupBy("qid", "node_id").agg(F.min("rank").alias("given_rank")), ["qid"], [F.asc("given_rank")], DEPTH)
    rows = found.join(queries.select("qid", "client").distinct(), "qid").join(members.withColumn("hit", F.lit(True)), ["client", "node_id"], "left")
    hits = lambda k: F.count(F.when(F.col("hit") & (F.col("rank") <= k), 1))
    held = rows.groupBy("qid", "client").agg(
        hits(5).alias("in_5"), hits(10).alias("in_10"), F.count("hit").alias("right"), F.min(F.when(F.col("hit"), F.col("rank"))).alias("first"), F.count("*").alias("n")
    )
    share = lambda n: F.coalesce(F.col(n) / F.col("gold"), F.lit(0.0))
    each = held.join(gold, "client", "left").select(
        "qid", share("in_5").alias("recall_5"), share("in_10").alias("recall_10"), F.when(F.col("in_5") > 0, 1.0).otherwise(0.0).alias("hit_5"),
        F.coalesce(1.0 / F.col("first"), F.lit(0.0)).alias("mrr"), (F.col("right") / F.col("n")).alias("precision"),
    )
    names = ("recall_5", "recall_10", "hit_5", "mrr", "precision")
    one = each.select("qid", *(F.round(n, 6).alias(n) for n in names))
    return one.unionByName(each.agg(*(E.mean_or_zero(n) for n in names)).withColumn("qid", F.lit(None).cast("bigint")))


RETRIEVAL_EVAL = f"""WITH dense AS ({_cosine('', DEPTH)}), r AS (SELECT qid, rank, c.label = q.label AS hit, (SELECT count(*) FROM embeddings x WHERE x.label = q.label) AS gold FROM dense JOIN embeddings q ON q.vec_id = qid JOIN embeddings c ON c.vec_id = node_id),
e AS (SELECT qid, count(*) FILTER (hit AND rank <= 5) / any_value(gold) AS recall_5, count(*) FILTER (hit AND rank <= 10) / any_value(gold) AS recall_10, max(CASE WHEN hit AND rank <= 5 THEN 1.0 ELSE 0.0 END)::DOUBLE AS hit_5,
  coalesce(1 / min(rank) FILTER (hit), 0)::DOUBLE AS mrr, count(*) FILTER (hit) / count(*) AS precision FROM r GROUP BY 1)
SELECT qid, round(recall_5, 6) AS recall_5, round(recall_10, 6) AS recall_10, round(hit_5, 6) AS hit_5, round(mrr, 6) AS mrr, round(precision, 6) AS precision FROM e
UNION ALL SELECT NULL, round(avg(recall_5), 6), round(avg(recall_10), 6), round(avg(hit_5), 6), round(avg(mrr), 6), round(avg(precision), 6) FROM e"""


def factuality_rollup(spark: SparkSession, d: str) -> DataFrame:
    gold = S.table(spark, d, "labels").withColumn("verdict", F.when(F.col("toxic") == 1, "partially_correct").when(F.col("quality") == 1, "correct").otherwise("incorrect"))
    rows = gold.join(S.table(spark, d, "documents").select("doc_id", F.col("source").alias("category")), "doc_id").withColumn("score", E.verdict_score(F.col("verdict")))
    return E.factuality(rows)


FACTUALITY = """WITH r AS (SELECT source AS category, CASE WHEN toxic = 1 THEN 'partially_correct' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict FROM labels JOIN documents USING (doc_id))
SELECT category, count(*) AS total, count(*) FILTER (verdict = 'correct') AS correct, count(*) FILTER (verdict = 'partially_correct') AS partially_correct, count(*) FILTER (verdict = 'incorrect') AS incorrect,
round(avg(CASE verdict WHEN 'correct' THEN 1.0 WHEN 'partially_correct' THEN 0.5 ELSE 0.0 END), 6) AS score FROM r GROUP BY ROLLUP (category)"""

QUERIES = {
    "cells_topk": cells_topk,
    "dense_topk": dense_topk, "tenant_topk": tenant_topk, "chat_memory_search": chat_memory_search, "bm25_topk": bm25_topk,
    "tenant_filter_search": tenant_filter_search, "hybrid_fusion": hybrid_fusion, "rrf_fusion": fused, "temporal_context": temporal_context,
    "temporal_adjustment": temporal_adjustment, "structural_adjustment": structural_adjustment, "rerank_topk": rerank_topk,
    "evidence_diverse": evidence_diverse, "evidence_quota": evidence_quota, "evidence_numeric_first": evidence_numeric_first,
    "evidence_pipeline": evidence_pipeline, "chunk_diagnostics": chunk_diagnostics, "intent_labels": intent_labels, "query_dedupe": query_dedupe, "retrieval_eval": retrieval_eval, "factuality_rollup": factuality_rollup,
}
ORACLES = {
    "dense_topk": _cosine("", DEPTH), "tenant_topk": _cosine("AND q.client = c.client", DEPTH),
    "chat_memory_search": _cosine("AND q.client = c.client AND q.session <> c.session", 4),
    "bm25_topk": f"WITH {BM25} SELECT * FROM sparse",
    "tenant_filter_search": f"WITH {BM25} SELECT qid, source AS client_id, node_id, score, row_number() OVER (PARTITION BY qid, source ORDER BY score DESC, node_id) AS rank FROM bm JOIN documents ON doc_id = node_id QUALIFY rank <= 3",
    "hybrid_fusion": HYBRID, "rrf_fusion": f"WITH {FUSED} SELECT * FROM fused", "temporal_context": TEMPORAL_CONTEXT,
    "temporal_adjustment": f"WITH {CONTEXT} SELECT qid, node_id, round(temporal, 6) AS temporal FROM adj", "structural_adjustment": STRUCTURAL,
    "rerank_topk": f"WITH {RERANKED} SELECT qid, node_id, final, rank FROM ranked", "evidence_diverse": EVIDENCE_DIVERSE,
    "evidence_quota": EVIDENCE_QUOTA, "evidence_numeric_first": NUMERIC_FIRST, "chunk_diagnostics": CHUNK_DIAGNOSTICS,
    "intent_labels": _intent_sql(), "query_dedupe": QUERY_DEDUPE,
    "retrieval_eval": RETRIEVAL_EVAL, "factuality_rollup": FACTUALITY,
}
