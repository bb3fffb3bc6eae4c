"""Places for models: embeddings, rewrites and cross-encoders as functions over batches, with deterministic stand-ins."""

from __future__ import annotations

import hashlib
import math
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .retrieval import minmax, terms, top_ranked

Embedder = Callable[[list[str]], list[list[float]]]
Scorer = Callable[[list[str], list[str]], list[float]]
STAND_IN_SIZE = 64


def hashed_words(texts: list[str]) -> list[list[float]]:
    """A stand-in for an embedding model: signed hashes of words, of length one."""
    out = []
    for text in texts:
        v = [0.0] * STAND_IN_SIZE
        for word in (text or "").lower().split():
            h = int.from_bytes(hashlib.blake2b(word.encode(), digest_size=4).digest(), "little")
            v[h % STAND_IN_SIZE] += 1.0 if h >> 31 else -1.0
        n = math.sqrt(sum(x * x for x in v)) or 1.0
        out.append([x / n for x in v])
    return out


def embed(text: Column, model: Embedder = hashed_words) -> Column:
    """Embeddings by a model that takes a batch of texts."""

    @F.pandas_udf("array<double>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(model(batch.fillna("").tolist()))

    return run(text)


def word_share(question: Column, text: Column) -> Column:
    """A stand-in for a cross-encoder: the share of the question's words that the text has."""
    asked = F.array_distinct(terms(question))
    return F.when(F.size(asked) > 0, F.size(F.array_intersect(asked, terms(text))) / F.size(asked)).otherwise(F.lit(0.0))


def cross_encode(question: Column, text: Column, model: Scorer | None = None) -> Column:
    if model is None:
        return word_share(question, text)

    @F.pandas_udf("double")
    def run(questions: pd.Series, texts: pd.Series) -> pd.Series:
        return pd.Series(model(questions.fillna("").tolist(), texts.fillna("").tolist()))

    return run(question, text)


def blended(rows: DataFrame, keys: list[str], model: Scorer | None = None, weight: float = 0.4, k: int = 15) -> DataFrame:
    """``rows`` (question, text, score, node_id) ranked by the model's and their own score, both normalised over all candidates."""
    scored = rows.withColumn("_ce", cross_encode(F.col("question"), F.col("text"), model))
    mixed = scored.withColumn("blend", F.round(weight * minmax("_ce", keys) + (1 - weight) * minmax("score", keys), 6)).drop("_ce")
    return top_ranked(mixed, keys, [F.desc("blend"), F.asc("node_id")], k)


def variants(questions: DataFrame, rewrite: Callable[[list[str]], list[list[str]]], most: int = 2) -> DataFrame:
    """(qid, variant_no, query): each question and up to ``most`` other rewrites of it, repeats in any case left out."""

    @F.pandas_udf("array<string>")
    def run(batch: pd.Series) -> pd.Series:
        return pd.Series(rewrite(batch.fillna("").tolist()))

    clean = lambda x: F.trim(F.regexp_replace(x, r"\s+", " "))
    every = F.transform(F.concat(F.array("question"), run("question")), clean)
    made = questions.select("qid", F.posexplode(every).alias("pos", "query")).where("query <> ''")
    first = made.groupBy("qid", F.lower("query").alias("_low")).agg(F.min_by("query", "pos").alias("query"), F.min("pos").alias("pos"))
    return top_ranked(first, ["qid"], [F.asc("pos")], most + 1).select("qid", (F.col("rank") - 1).alias("variant_no"), "query")


def agent_loop(questions: DataFrame, search: Callable[[DataFrame, int], DataFrame], enough: Callable[[DataFrame], DataFrame], passes: int = 5) -> DataFrame:
    """Search for the questions that lack evidence until all have enough or ``passes`` are over; nodes are found once.

    ``search`` gives (qid, node_id, score) for questions and a pass number, ``enough`` the qids that need no more.
    """
    seen, open_ = None, questions
    for k in range(passes):
        found = search(open_, k).select("qid", "node_id", "score").withColumn("pass_no", F.lit(k))
        if seen is not None:
            found = found.join(seen.select("qid", "node_id"), ["qid", "node_id"], "left_anti")
        seen = found if seen is None else seen.unionByName(found)
        open_ = open_.join(enough(seen).select("qid").distinct(), "qid", "left_anti")
        if open_.isEmpty():
            break
    return seen
