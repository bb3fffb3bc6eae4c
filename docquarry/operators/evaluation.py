"""Offline quality: recall, reciprocal rank, precision, completeness and factuality."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed value: score of each verdict.
VERDICTS = {"correct": 1.0, "partially_correct": 0.5, "incorrect": 0.0}


def first_distinct(ids: Column) -> Column:
    """Ids in order, each the first time it occurs in any case; blanks left out."""
    return F.array_distinct(F.transform(F.filter(ids, lambda x: F.trim(x) != ""), lambda x: F.lower(F.trim(x))))


def recall_at(ids: Column, gold: Column, k: int) -> Column:
    return F.when(F.size(gold) > 0, F.size(F.array_intersect(F.slice(ids, 1, k), gold)) / F.size(gold)).otherwise(F.lit(0.0))


def hit_at(ids: Column, gold: Column, k: int) -> Column:
    return F.when(F.arrays_overlap(F.slice(ids, 1, k), gold), 1.0).otherwise(0.0)


def reciprocal_rank(ids: Column, gold: Column) -> Column:
    places = F.transform(gold, lambda g: F.array_position(ids, g))
    best = F.array_min(F.filter(places, lambda p: p > 0))
    return F.coalesce(F.lit(1.0) / best, F.lit(0.0))


def precision(labels: Column, expected: Column) -> Column:
    """Share of labels that are expected; repeated ones count; 0 when none is expected or given."""
    right = F.size(F.filter(labels, lambda x: F.array_contains(expected, x)))
    return F.when((F.size(expected) > 0) & (F.size(labels) > 0), right / F.size(labels)).otherwise(F.lit(0.0))


def mean_or_zero(score: str) -> Column:
    return F.round(F.coalesce(F.avg(score), F.lit(0.0)), 6).alias(score)


def verdict_score(verdict: Column, given: Column | None = None) -> Column:
    v, out = F.lower(F.trim(verdict)), F.lit(None).cast("double")
    for name, score in VERDICTS.items():
        out = F.when(v == name, score).otherwise(out)
    out = out if given is None else F.coalesce(given.cast("double"), out)
    return F.greatest(F.least(out, F.lit(1.0)), F.lit(0.0))


def factuality(rows: DataFrame) -> DataFrame:
    """Totals by category and over all (category null) of rows (category, verdict, score)."""
    made = rows.withColumn("category", F.coalesce(F.nullif(F.trim("category"), F.lit("")), F.lit("uncategorized")))
    count = lambda v: F.sum(F.when(F.col("verdict") == v, 1).otherwise(0)).alias(v)
    return made.rollup("category").agg(F.count("*").alias("total"), *(count(v) for v in VERDICTS), mean_or_zero("score"))


#: Writings of each verdict.
VERDICT_WORDS = {
    "partially_correct": ("partial", "partially correct", "partially_correct"),
    "incorrect": ("incorrect", "wrong", "fail", "failed"),
    "correct": ("correct", "pass", "passed"),
}


def verdict_name(value: Column) -> Column:
    """The verdict that a writing stands for; any other one is an error when the row is reached."""
    low, out = F.lower(F.trim(F.coalesce(value, F.lit("")))), F.raise_error(F.concat(F.lit("unsupported verdict value: "), F.coalesce(value, F.lit("null")))).cast("string")
    for name, words in VERDICT_WORDS.items():
        out = F.when(low.isin(*words), name).otherwise(out)
    return out


def judged(questions: DataFrame, gold: DataFrame, answers: DataFrame) -> DataFrame:
    """Each question (id, category) with its gold verdict and score and, where there is one, its answer.

    A question without gold is an error when its row is reached, as is an unknown verdict; rows without an id are left out. Of several
    rows of one id in ``gold`` (id, verdict, score) or ``answers`` (id, answer) the greatest counts. A given score is held within
    0 and 1, a missing one is the verdict's.
    """
    one = lambda rows, *columns: rows.groupBy("id").agg(F.max(F.struct(*columns)).alias("g")).select("id", "g.*")
    made = questions.where("id IS NOT NULL").join(one(gold.withColumn("labelled", F.lit(True)), "labelled", "verdict", "score"), "id", "left").join(one(answers, "answer"), "id", "left")
    missing = F.raise_error(F.concat(F.lit("missing gold label for question "), F.col("id").cast("string"))).cast("string")
    made = made.withColumn("verdict", F.when(F.col("labelled"), verdict_name(F.col("verdict"))).otherwise(missing))
    return made.select("id", "category", "verdict", verdict_score(F.col("verdict"), F.col("score")).alias("score"), "answer")
