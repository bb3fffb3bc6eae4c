"""Logs, sessions, jobs and counts: the relational workload around retrieval."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def history(queries: DataFrame, retrievals: DataFrame, conflicts: DataFrame) -> DataFrame:
    """Queries with how many retrievals and conflicts each has. Sides are counted before the join, so rows never fan out."""
    n_r = retrievals.groupBy("query_id").agg(F.count("*").alias("retrievals"))
    n_c = conflicts.groupBy("query_id").agg(F.count("*").alias("conflicts"))
    return queries.join(n_r, "query_id", "left").join(n_c, "query_id", "left").fillna(0, ["retrievals", "conflicts"])


def history_filter(client: Column | None = None, status: str | None = None, needle: str | None = None) -> Column:
    """Client and status must match; in the needle ``%`` and ``_`` are wildcards. A blank status or ``all`` filters nothing."""
    test = F.lit(True)
    if client is not None:
        test = test & (F.col("client_id") == client)
    if (s := (status or "").strip().lower()) not in ("", "all"):
        test = test & (F.col("status") == s)
    if needle and needle.strip():
        test = test & F.lower("question").like(f"%{needle.strip().lower()}%")
    return test


def page(rows: DataFrame, order: list[Column], limit: int, offset: int, most: int = 200) -> DataFrame:
    return rows.orderBy(*order).offset(max(0, offset)).limit(min(max(1, limit), most))


def latest(rows: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in the order given."""
    return rows.withColumn("_rn", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("_rn = 1").drop("_rn")


def last_in_order(rows: DataFrame, key: str, order: list[Column], n: int) -> DataFrame:
    """The last ``n`` rows of each key, numbered from the oldest of them."""
    newest = Window.partitionBy(key).orderBy(*(o.desc() for o in order))
    kept = rows.withColumn("_rn", F.row_number().over(newest)).where(F.col("_rn") <= n)
    return kept.withColumn("position", F.row_number().over(Window.partitionBy(key).orderBy(*(o.asc() for o in order)))).drop("_rn")


def within_budget(rows: DataFrame, key: str, order: list[Column], cost: Column, budget: int) -> DataFrame:
    """Rows of each key in order until the first whose cost would pass the budget; nothing after it is taken."""
    run = Window.partitionBy(key).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    # Costs aren't negative, so once the running sum passes the budget it stays above it.
    return rows.withColumn("spent", F.sum(cost).over(run)).where(F.col("spent") <= budget)


def supersede(versions: DataFrame, keys: list[str], created: str, tie: str) -> DataFrame:
    """``versions`` with is_current only on the newest current version of each family."""
    newest = Window.partitionBy(*keys)
    top = F.max(F.when(F.col("is_current"), F.struct(created, tie))).over(newest)
    return versions.withColumn("is_current", F.col("is_current") & (F.struct(created, tie) == top))


def facets(rows: DataFrame, fields: list[str]) -> DataFrame:
    """(facet, value, n) of each field in one pass; missing values are left out."""
    pairs = F.array(*(F.struct(F.lit(f).alias("facet"), F.col(f).cast("string").alias("value")) for f in fields))
    return rows.select(F.inline(pairs)).where("value IS NOT NULL AND value <> ''").groupBy("facet", "value").agg(F.count("*").alias("n"))


def merge_collections(older: DataFrame, newer: DataFrame, key: str) -> DataFrame:
    """Union of two collections, the newer row of an id winning; columns that one lacks are null."""
    both = older.withColumn("_age", F.lit(1)).unionByName(newer.withColumn("_age", F.lit(0)), allowMissingColumns=True)
    return latest(both, [key], [F.col("_age")]).drop("_age")


def without(rows: DataFrame, gone: DataFrame, key: str) -> DataFrame:
    """Rows whose key isn't among those deleted."""
    return rows.join(gone.select(key).distinct(), key, "left_anti")


def agent_round(found: DataFrame, seen: DataFrame, keys: list[str]) -> tuple[DataFrame, DataFrame]:
    """One pass of the retrieval loop: what is new among ``found``, and all seen so far."""
    new = found.join(seen.select(*keys).distinct(), keys, "left_anti")
    return new, seen.unionByName(new, allowMissingColumns=True)
