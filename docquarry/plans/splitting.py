"""Queries of body chunks, cut texts and semantic parts, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import splitting as P
from ..sources import tables as S

_BUDGET, _OVERLAP, _MOST = 120, 25, 50


def sentence_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = P.sentence_chunks(S.table(spark, d, "documents"), "doc_id", "text", _BUDGET, _OVERLAP)
    words = F.trim(F.regexp_replace("body", r"[ \t\n\r\f\x0B]+", " "))
    return made.select("doc_id", "chunk_no", "kind", "tokens", F.sha2(words, 256).alias("digest"))


SENTENCE_CHUNKS = rf"""WITH RECURSIVE d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{P.WORD}') AS ws FROM documents),
s0 AS (SELECT doc_id, regexp_extract_all(t, '{P.SENTENCE}') AS ss FROM d WHERE len(ws) > {_BUDGET}),
s AS (SELECT doc_id, generate_subscripts(ss, 1) AS i, regexp_extract_all(unnest(ss), '{P.WORD}') AS ws FROM s0),
c AS (SELECT *, len(ws) AS n, sum(len(ws)) OVER (PARTITION BY doc_id ORDER BY i) AS upto, max(i) OVER (PARTITION BY doc_id) AS last FROM s),
e AS (SELECT a.doc_id, a.i AS first, a.last, a.upto - a.n AS before, a.n > {_BUDGET} AS long, max(b.i) AS stop
  FROM c a JOIN c b ON b.doc_id = a.doc_id AND b.i >= a.i AND (b.i = a.i OR b.upto - (a.upto - a.n) <= {_BUDGET}) GROUP BY ALL),
o AS (SELECT e.doc_id, e.first, min(j.i) AS again FROM e JOIN c z ON z.doc_id = e.doc_id AND z.i = e.stop JOIN c x ON x.doc_id = e.doc_id AND x.i = e.stop + 1
  JOIN c j ON j.doc_id = e.doc_id AND j.i > e.first AND j.i <= e.stop AND NOT e.long AND z.upto - (j.upto - j.n) <= {_OVERLAP} AND x.upto - (j.upto - j.n) <= {_BUDGET} GROUP BY ALL),
f AS (SELECT e.*, CASE WHEN stop < last THEN coalesce(again, stop + 1) END AS next FROM e LEFT JOIN o USING (doc_id, first)),
way AS (SELECT doc_id, first, 0 AS step FROM f WHERE first = 1 UNION ALL SELECT way.doc_id, f.next, step + 1 FROM way JOIN f USING (doc_id, first) WHERE f.next IS NOT NULL),
p AS (SELECT doc_id, step, 0 AS w, 'sentences' AS kind, (SELECT flatten(list(c.ws ORDER BY c.i)) FROM c WHERE c.doc_id = f.doc_id AND c.i BETWEEN f.first AND f.stop) AS ws FROM way JOIN f USING (doc_id, first) WHERE NOT long
  UNION ALL SELECT doc_id, step, w, 'window', ws[w + 1:w + {_BUDGET}] FROM (SELECT way.doc_id, step, c.ws, unnest(range(0, c.n, {_BUDGET - _OVERLAP})) AS w FROM way JOIN f USING (doc_id, first) JOIN c ON c.doc_id = way.doc_id AND c.i = way.first WHERE f.long) WHERE w = 0 OR len(ws) - w > {_OVERLAP}
  UNION ALL SELECT doc_id, 0, 0, 'whole', ws FROM d WHERE len(ws) <= {_BUDGET})
SELECT doc_id, row_number() OVER (PARTITION BY doc_id ORDER BY step, w) - 1 AS chunk_no, kind, len(ws) AS tokens, sha256(array_to_string(ws, ' ')) AS digest FROM p"""


def truncated_texts(spark: SparkSession, d: str) -> DataFrame:
    """The first words of each document: how many characters they take, and their digest."""
    cut = P.truncated(F.coalesce("text", F.lit("")), _MOST)
    return S.table(spark, d, "documents").select("doc_id", F.length(cut).cast("bigint").alias("chars"), F.sha2(cut, 256).alias("digest"))


TRUNCATED_TEXTS = rf"""WITH t AS (SELECT doc_id, coalesce(text, '') AS t FROM documents), g AS (SELECT *, regexp_extract_all(t, '{P.WORD}') AS ws, regexp_split_to_array(t, '{P.WORD}') AS gaps FROM t),
c AS (SELECT doc_id, CASE WHEN len(ws) <= {_MOST} THEN t ELSE list_reduce(list_transform(ws[1:{_MOST}], lambda w, i: gaps[i] || w), lambda a, b: a || b) END AS cut FROM g)
SELECT doc_id, length(cut) AS chars, sha256(cut) AS digest FROM c"""


def semantic_chunks(spark: SparkSession, d: str) -> DataFrame:
    made = P.semantic_chunks(S.table(spark, d, "documents"), "doc_id", "text")
    return made.select("doc_id", "part", "sentences", F.sha2("body", 256).alias("digest"))


SEMANTIC_CHUNKS = rf"""WITH s0 AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{P.SENTENCE}') AS ss FROM documents), s AS (SELECT doc_id, unnest(ss) AS s, generate_subscripts(ss, 1) AS i, ss FROM s0),
g AS (SELECT doc_id, s, i, array_to_string(ss[greatest(i - 1, 1):i + 1], '') AS g FROM s),
v AS (SELECT doc_id, s, i, list_transform(range(97, 123), lambda c: (length(g) - length(replace(replace(g, chr(c::INT), ''), chr(c::INT - 32), '')))::DOUBLE) AS v FROM g),
b AS (SELECT doc_id, s, i, v, lag(v) OVER (PARTITION BY doc_id ORDER BY i) AS u FROM v),
n AS (SELECT doc_id, s, i, u IS NULL AS head, list_dot_product(u, v) AS uv, sqrt(list_dot_product(u, u)) * sqrt(list_dot_product(v, v)) AS scale FROM b),
x AS (SELECT doc_id, s, i, CASE WHEN NOT head THEN round(1 - CASE WHEN scale > 0 THEN uv / scale ELSE 0 END, 9) END AS distance FROM n),
l AS (SELECT doc_id, quantile_cont(distance, 0.95) AS most FROM x GROUP BY 1),
p AS (SELECT doc_id, s, i, sum(CASE WHEN distance > most THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS part FROM x JOIN l USING (doc_id))
SELECT doc_id, part::BIGINT AS part, count(*) AS sentences, sha256(string_agg(s, '' ORDER BY i)) AS digest FROM p GROUP BY 1, 2"""

QUERIES = {"sentence_chunks": sentence_chunks, "truncated_texts": truncated_texts, "semantic_chunks": semantic_chunks}
ORACLES = {"sentence_chunks": SENTENCE_CHUNKS, "truncated_texts": TRUNCATED_TEXTS, "semantic_chunks": SEMANTIC_CHUNKS}
