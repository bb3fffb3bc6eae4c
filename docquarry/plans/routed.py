"""Queries of routed retrieval, vector collections, image evidence and judged answers, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import answers as A, evaluation as E, routing as R
from ..sources import collections as C, tables as S
from .search import BM25, OVERLAP, RERANKED, _lists, reranked

_MODEL = "stand-in"


def _routed_questions(spark: SparkSession, d: str) -> DataFrame:
    """Questions of all strategies: parts are sentences, rewrites a question's first and last words. Some have no parts, some only parts
    that no chunk holds a word of."""
    q, n = S.questions(spark, d), F.col("qid")
    words = F.split(F.trim(F.regexp_replace("question", r"[ \t\n\r\f\x0B]+", " ")), " ")
    rewrites = F.array(F.array_join(F.slice(words, 1, 6), " "), F.array_join(F.slice(words, -6, 6), " "))
    nowhere = F.array(F.concat(F.lit("zzqx"), n.cast("string")))
    parts = F.when(n % 4 == 1, None).when(n % 5 == 0, nowhere).otherwise(F.split("question", r"[.]"))
    strategy = F.when(n % 3 == 0, "direct").when(n % 3 == 1, "expanded").otherwise("decomposed")
    return q.select("qid", "question", strategy.alias("strategy"), parts.alias("parts"), F.when(F.size(words) > 6, rewrites).alias("rewrites"))


def routed_search(spark: SparkSession, d: str) -> DataFrame:
    return R.routed(_routed_questions(spark, d), S.chunks(spark, d))


ROUTED = r"""WITH b AS (SELECT item_id AS qid, text AS question, string_split(trim(regexp_replace(text, '[ \t\n\r\f\x0B]+', ' ', 'g')), ' ') AS ws FROM benchmark),
rq AS (SELECT qid, question, CASE qid % 3 WHEN 0 THEN 2 WHEN 1 THEN 1 ELSE 0 END AS wanted,
  CASE WHEN qid % 4 = 1 THEN []::VARCHAR[] WHEN qid % 5 = 0 THEN ['zzqx' || qid] ELSE string_split(question, '.') END AS parts,
  CASE WHEN len(ws) > 6 THEN [array_to_string(ws[1:6], ' '), array_to_string(ws[-6:], ' ')] ELSE []::VARCHAR[] END AS rewrites FROM b),
u AS (SELECT qid, 0 AS branch, unnest(parts) AS x, generate_subscripts(parts, 1) AS i FROM rq UNION ALL SELECT qid, 1, unnest(list_concat([question], rewrites)), unnest(range(len(rewrites) + 1)) FROM rq UNION ALL SELECT qid, 2, question, 0 FROM rq),
cl AS (SELECT qid, branch, trim(regexp_replace(x, '\s+', ' ', 'g')) AS query, i FROM u),
ud AS (SELECT qid, branch, arg_min(query, i) AS query, min(i) AS i FROM cl WHERE query <> '' GROUP BY qid, branch, lower(query)),
nb AS (SELECT qid, branch, query, row_number() OVER (PARTITION BY qid, branch ORDER BY i) - 1 AS variant, count(*) OVER (PARTITION BY qid, branch) AS of FROM ud),
ev AS (SELECT nb.*, CASE WHEN branch = 0 THEN 'decomposed' WHEN branch = 1 AND of > 1 THEN 'expanded' ELSE 'direct' END AS strategy, wanted FROM nb JOIN rq USING (qid) WHERE branch >= wanted AND variant < 4),
tx AS (SELECT doc_id AS node_id, regexp_extract_all(lower(coalesce(text, '')), '[a-z0-9]+') AS ts FROM documents),
vt AS (SELECT DISTINCT qid, branch, variant, unnest(regexp_extract_all(lower(query), '[a-z0-9]+')) AS term FROM ev),
tk AS (SELECT node_id, unnest(ts) AS term FROM tx), held AS (SELECT DISTINCT term FROM tk),
lv AS (SELECT qid, min(branch) AS branch FROM vt SEMI JOIN held USING (term) GROUP BY 1),
gv AS (SELECT qid, min(branch) AS given FROM ev GROUP BY 1),
st AS (SELECT count(*) AS n, avg(len(ts)) AS average FROM tx), ln AS (SELECT node_id, len(ts) AS length FROM tx),
tf AS (SELECT node_id, term, count(*) AS tf FROM tk SEMI JOIN vt USING (term) GROUP BY 1, 2), idf AS (SELECT term, ln(1 + ((SELECT n FROM st) - count(*) + 0.5) / (count(*) + 0.5)) AS idf FROM tf GROUP BY 1),
bm AS (SELECT qid, variant, node_id, round(sum(idf * tf * 2.2 / (tf + 1.2 * (1 - 0.75 + 0.75 * length / (SELECT average FROM st)))), 6) AS score FROM vt JOIN lv USING (qid, branch) JOIN tf USING (term) JOIN ln USING (node_id) JOIN idf USING (term) GROUP BY 1, 2, 3),
bt AS (SELECT *, row_number() OVER (PARTITION BY qid, variant ORDER BY score DESC, node_id) AS rank FROM bm QUALIFY rank <= 10),
fu AS (SELECT qid, node_id, round(sum(score + 1.0 / (60 + rank)), 6) AS score, string_agg(variant, ',' ORDER BY variant) AS origins FROM bt GROUP BY 1, 2),
ho AS (SELECT DISTINCT ev.qid, ev.strategy, CASE WHEN given > wanted THEN 'failed' WHEN branch > given THEN 'empty' END AS fallback FROM ev JOIN lv USING (qid, branch) JOIN gv USING (qid))
SELECT qid, node_id, score, row_number() OVER (PARTITION BY qid ORDER BY score DESC, node_id) AS rank, strategy, fallback, origins FROM fu JOIN ho USING (qid) QUALIFY rank <= 15"""


def hybrid_or_dense(spark: SparkSession, d: str) -> DataFrame:
    """Both lists blended; a third of the questions have no sparse list, as in a collection without sparse vectors."""
    sparse, other = _lists(spark, d)
    return R.with_mode(other, sparse.where("qid % 3 <> 1"))


HYBRID_OR_DENSE = f"""WITH {BM25}, {OVERLAP}, sp AS (SELECT * FROM sparse WHERE qid % 3 <> 1),
a AS (SELECT qid, node_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS x FROM overlap WINDOW w AS (PARTITION BY qid)),
b AS (SELECT qid, node_id, CASE WHEN max(score) OVER w > min(score) OVER w THEN (score - min(score) OVER w) / (max(score) OVER w - min(score) OVER w) ELSE 1.0 END AS x FROM sp WINDOW w AS (PARTITION BY qid))
SELECT qid, node_id, round(CASE WHEN qid IN (SELECT qid FROM sp) THEN 0.5 * coalesce(a.x, 0.0) + 0.5 * coalesce(b.x, 0.0) ELSE a.x END, 6) AS score, CASE WHEN qid IN (SELECT qid FROM sp) THEN 'hybrid' ELSE 'dense_fallback' END AS mode FROM a FULL JOIN b USING (qid, node_id)"""


def _collection(spark: SparkSession, d: str) -> C.Collection:
    """All embeddings as points, indexed in two batches that share some."""
    e, n = S.table(spark, d, "embeddings").where("embedding IS NOT NULL AND vec_id IS NOT NULL"), F.col("vec_id")
    payload = F.to_json(F.struct((n % 1000).cast("string").alias("document_id"), (n % 40).alias("page_num"), F.struct(F.lit("kept").alias("note")).alias("other")))
    points = e.select(F.coalesce(F.col("label").cast("string"), F.lit("none")).alias("client_id"), n.alias("point_id"), F.col("embedding").alias("dense"), F.create_map(F.concat(F.lit("t"), (n % 7).cast("string")), F.lit(1.0)).alias("sparse"), payload.alias("payload"))
    size = e.agg(F.max(F.size("embedding"))).first()[0] or 1
    made = C.Collection.open(spark, C.work_path(spark, "collection"), size)
    made.index(points.where("point_id % 10 < 6"))
    made.index(points.where("point_id % 10 > 3"))
    return made


def collection_registry(spark: SparkSession, d: str) -> DataFrame:
    """The registry's rows of an indexed collection."""
    return _collection(spark, d).registry(_MODEL).select("client_id", "document_id", "vector_node_id", "embedding_model", "is_active")


COLLECTION_REGISTRY = f"SELECT coalesce(label::VARCHAR, 'none') AS client_id, (vec_id % 1000)::VARCHAR AS document_id, vec_id AS vector_node_id, '{_MODEL}' AS embedding_model, true AS is_active FROM embeddings WHERE embedding IS NOT NULL"


def payload_backfill(spark: SparkSession, d: str) -> DataFrame:
    """Screenshots set in the payloads of every tenth point; other fields stay."""
    made = _collection(spark, d)
    shots = made.points().where("point_id % 10 = 0").select("client_id", "point_id", F.lit("screenshot").alias("field"), F.to_json(F.struct(F.concat(F.lit("p"), F.col("point_id").cast("string"), F.lit(".png")).alias("path"))).alias("value"))
    made.patch(shots)
    get = lambda path: F.get_json_object("payload", path)
    return made.points().select("client_id", "point_id", get("$.document_id").alias("document_id"), get("$.page_num").cast("bigint").alias("page_num"), get("$.other.note").alias("note"), get("$.screenshot.path").alias("screenshot"))


PAYLOAD_BACKFILL = "SELECT coalesce(label::VARCHAR, 'none') AS client_id, vec_id AS point_id, (vec_id % 1000)::VARCHAR AS document_id, vec_id % 40 AS page_num, 'kept' AS note, CASE WHEN vec_id % 10 = 0 THEN 'p' || vec_id || '.png' END AS screenshot FROM embeddings WHERE embedding IS NOT NULL"

def image_evidence(spark: SparkSession, d: str) -> DataFrame:
    """Images of the first ranked rows of each question: paths repeat, and so do contents under other paths; some aren't readable or no images."""
    rows, n = reranked(spark, d), F.col("node_id")
    asset = lambda path, digest: F.struct(path.alias("path"), digest.alias("digest"))
    text = lambda c: c.cast("string")
    one = asset(F.concat(F.lit("pages/"), text(n % 23), F.when(n % 9 == 4, ".pdf").otherwise(".PNG")), F.when(n % 7 != 3, F.concat(F.lit("d"), text(n % 19))))
    two = asset(F.concat(F.lit("figures/"), text(n % 13), F.lit(".jpeg")), F.concat(F.lit("d"), text(n % 29)))
    return A.image_evidence(rows.select("qid", "rank", F.array(one, two).alias("assets")))


IMAGE_EVIDENCE = f"""WITH RECURSIVE {RERANKED}, im AS (SELECT qid, rank, 1 AS i, 'pages/' || (node_id % 23) || '.PNG' AS path, 'd' || (node_id % 19) AS digest FROM ranked WHERE node_id % 7 <> 3 AND node_id % 9 <> 4
  UNION ALL SELECT qid, rank, 2, 'figures/' || (node_id % 13) || '.jpeg', 'd' || (node_id % 29) FROM ranked),
ie_o AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY rank, i) AS k FROM im),
ie_st AS (SELECT qid, 1::BIGINT AS k, [path] AS ps, [digest] AS ds FROM ie_o o WHERE k = 1
  UNION ALL SELECT qid, o.k, CASE WHEN list_contains(ps, path) OR list_contains(ds, digest) THEN ps ELSE list_append(ps, path) END, CASE WHEN list_contains(ps, path) OR list_contains(ds, digest) THEN ds ELSE list_append(ds, digest) END FROM ie_st JOIN ie_o o USING (qid) WHERE o.k = ie_st.k + 1),
fin AS (SELECT qid, arg_max(ps, k)[1:8] AS ps FROM ie_st GROUP BY 1)
SELECT qid, generate_subscripts(ps, 1) AS nth, unnest(ps) AS path FROM fin"""


def judged_answers(spark: SparkSession, d: str) -> DataFrame:
    """Labelled documents as questions with gold in several writings, and an answer for some."""
    l, n = S.table(spark, d, "labels").where("doc_id IS NOT NULL"), F.col("doc_id")
    word = F.when(F.col("toxic") == 1, "Partially Correct").when(F.col("quality") == 1, F.when(n % 2 == 0, " pass ").otherwise("CORRECT")).otherwise("wrong")
    gold = l.select(n.alias("id"), word.alias("verdict"), F.when(n % 5 == 0, (n % 30) / 10 - 1).alias("score"))
    questions = S.table(spark, d, "documents").join(l.select("doc_id").distinct(), "doc_id", "left_semi").select(n.alias("id"), F.col("source").alias("category"))
    return E.judged(questions, gold, l.where("doc_id % 3 = 0").select(n.alias("id"), F.concat(F.lit("answer "), n.cast("string")).alias("answer")))


JUDGED_ANSWERS = """SELECT doc_id AS id, source AS category, CASE WHEN toxic = 1 THEN 'partially_correct' WHEN quality = 1 THEN 'correct' ELSE 'incorrect' END AS verdict,
greatest(least(CASE WHEN doc_id % 5 = 0 THEN (doc_id % 30)::DOUBLE / 10 - 1 WHEN toxic = 1 THEN 0.5 WHEN quality = 1 THEN 1.0 ELSE 0.0 END, 1.0), 0.0)::DOUBLE AS score, CASE WHEN doc_id % 3 = 0 THEN 'answer ' || doc_id END AS answer FROM labels JOIN documents USING (doc_id)"""

QUERIES = {"routed_search": routed_search, "hybrid_or_dense": hybrid_or_dense, "collection_registry": collection_registry, "payload_backfill": payload_backfill, "image_evidence": image_evidence, "judged_answers": judged_answers}
ORACLES = {"routed_search": ROUTED, "hybrid_or_dense": HYBRID_OR_DENSE, "collection_registry": COLLECTION_REGISTRY, "payload_backfill": PAYLOAD_BACKFILL, "image_evidence": IMAGE_EVIDENCE, "judged_answers": JUDGED_ANSWERS}
