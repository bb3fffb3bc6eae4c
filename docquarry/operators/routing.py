"""Routed retrieval: each question takes the branch it is given, and the next one where that fails or finds nothing."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .retrieval import QUERY_BLOCK, RRF, held_once, sparse_topk, terms, top_ranked

#: The strategies, each giving way to those after it, and how many parts a question is taken apart into at most.
STRATEGIES = ("decomposed", "expanded", "direct")
MOST_PARTS = 4


def deduped(queries: Column) -> Column:
    """Queries with single spaces, without empty ones and without repeats in any case, in order."""
    clean = F.filter(F.transform(queries, lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))), lambda x: x != "")
    add = lambda kept, x: F.when(F.exists(kept, lambda y: F.lower(y) == F.lower(x)), kept).otherwise(F.concat(kept, F.array(x)))
    return F.aggregate(clean, F.array().cast("array<string>"), add)


def branches(questions: DataFrame) -> DataFrame:
    """(qid, branch, strategy, variant, query) of all branches that each question may take, its own strategy's first.

    ``questions`` has qid, question, strategy, parts and rewrites (arrays; null where the step that makes them failed). A question without
    parts has no decomposed branch, one without rewrites of its own is expanded to itself alone, which is the direct strategy.
    """
    own = F.array("question")
    parts, wide = F.slice(deduped(F.coalesce("parts", F.array().cast("array<string>"))), 1, MOST_PARTS), deduped(F.concat(own, F.coalesce("rewrites", F.array().cast("array<string>"))))
    of = lambda name, queries: F.struct(F.lit(STRATEGIES.index(name)).alias("branch"), F.lit(name).alias("strategy"), queries.alias("queries"))
    first = F.when(F.col("strategy") == "decomposed", 0).when(F.col("strategy") == "expanded", 1).otherwise(2)
    expanded = F.when(F.size(wide) > 1, of("expanded", wide)).otherwise(of("direct", deduped(own)))
    every = F.filter(F.array(of("decomposed", parts), expanded, of("direct", deduped(own))), lambda b: (b["branch"] >= first) & (F.size(b["queries"]) > 0))
    made = questions.select("qid", F.explode(every).alias("b"))
    return made.select("qid", "b.branch", "b.strategy", F.posexplode("b.queries").alias("variant", "query")).distinct()


def routed(questions: DataFrame, chunks: DataFrame, depth: int = 10, k: int = 15, query_block: int = QUERY_BLOCK) -> DataFrame:
    """(qid, node_id, score, rank, strategy, fallback, origins): the best ``k`` chunks of each question by the branch that it took.

    Which branch a question takes is settled by terms: the first one of which some query has a term that a chunk holds. Chunks are read for
    terms of all branches once; scores are only made for queries of the branch taken. Each query's best ``depth`` are fused by score and
    reciprocal rank. Up to ``query_block`` queries of branches taken are settled once, so texts aren't read again to tell them. ``fallback``
    says why the asked strategy wasn't taken (``failed``: it gave no query; ``empty``: its queries find nothing); ``origins`` are the
    queries, by number, that found the chunk.
    """
    every = branches(questions)
    asked = every.select("qid", "branch", F.explode(F.array_distinct(terms(F.col("query")))).alias("term"))
    held = chunks.select(F.explode(F.array_distinct(terms(F.col("text")))).alias("term")).join(asked.select("term").distinct(), "term", "left_semi").distinct()
    live = asked.join(held, "term").groupBy("qid").agg(F.min("branch").alias("branch"))
    taken = held_once(every.join(live, ["qid", "branch"]), query_block)
    given = every.groupBy("qid").agg(F.min("branch").alias("given"))
    # A query is scored under a number of its own: its question and its place.
    numbered = taken.select("qid", "branch", "strategy", "variant", F.col("query").alias("question"), F.struct("qid", "variant").alias("asked"))
    scored = sparse_topk(numbered.select(F.col("asked").alias("qid"), "question"), chunks.withColumn("terms", terms(F.col("text"))), depth, query_block=query_block)
    best = scored.select("qid.qid", "qid.variant", "node_id", "score", "rank")
    fused = best.groupBy("qid", "node_id").agg(F.round(F.sum(F.col("score") + 1 / (RRF + F.col("rank"))), 6).alias("score"), F.array_join(F.array_sort(F.collect_list("variant")), ",").alias("origins"))
    wanted = questions.select("qid", F.when(F.col("strategy") == "decomposed", 0).when(F.col("strategy") == "expanded", 1).otherwise(2).alias("wanted"))
    how = numbered.select("qid", "branch", "strategy").distinct().join(given, "qid").join(wanted, "qid")
    why = F.when(F.col("given") > F.col("wanted"), "failed").when(F.col("branch") > F.col("given"), "empty")
    how = how.select("qid", "strategy", why.alias("fallback"))
    return top_ranked(fused, ["qid"], [F.desc("score"), F.asc("node_id")], k).join(how, "qid").select("qid", "node_id", "score", "rank", "strategy", "fallback", "origins")


def with_mode(dense: DataFrame, sparse: DataFrame, alpha: float = 0.5) -> DataFrame:
    """(qid, node_id, score, mode): both lists blended (``hybrid``) where a question has a sparse list, its dense list alone
    (``dense_fallback``) where it has none. Scores are moved to 0 to 1 within each list first."""
    def scaled(rows: DataFrame, name: str) -> DataFrame:
        w = Window.partitionBy("qid")
        low, high = F.min("score").over(w), F.max("score").over(w)
        return rows.select("qid", "node_id", F.when(high > low, (F.col("score") - low) / (high - low)).otherwise(F.lit(1.0)).alias(name))

    has = sparse.select("qid").distinct().withColumn("_has", F.lit(True))
    both = scaled(dense, "d").join(scaled(sparse, "s"), ["qid", "node_id"], "full").join(has, "qid", "left")
    mixed = alpha * F.coalesce("d", F.lit(0.0)) + (1 - alpha) * F.coalesce("s", F.lit(0.0))
    return both.select("qid", "node_id", F.round(F.when(F.col("_has"), mixed).otherwise(F.col("d")), 6).alias("score"), F.when(F.col("_has"), "hybrid").otherwise("dense_fallback").alias("mode"))
