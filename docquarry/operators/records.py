"""Rows that services append to their logs, what is left of them after deletions, and views of their latest state."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .relational import without

#: How much of an answer and of an error is kept, and of an answer's list of messages.
ANSWER_CHARS, ERROR_CHARS = 5000, 500


def uuid5(namespace: str, name: Column) -> Column:
    """The version 5 UUID of a name, so that writing a row again gives the same id."""
    digest = F.sha1(F.concat(F.unhex(F.lit(namespace.replace("-", ""))), name.cast("binary")))
    variant = F.translate(F.substring(digest, 17, 1), "0123456789abcdef", "89ab89ab89ab89ab")
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))


def retrieval_rows(citations: DataFrame, registry: DataFrame, order: list[Column], namespace: str) -> DataFrame:
    """Log rows of citations (query_id, client_id, node_id, document_id, score): rank by place, and the document that the citation or the
    registry (client_id, node_id, document_id, is_active) names; nodes are looked up within their client, active ones only."""
    known = registry.where("is_active").groupBy("client_id", "node_id").agg(F.max("document_id").alias("known"))
    placed = citations.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy(*order)).cast("bigint"))
    made = placed.join(known, ["client_id", "node_id"], "left")
    key = F.concat_ws(":", F.col("query_id").cast("string"), F.col("rank").cast("string"))
    return made.select(uuid5(namespace, key).alias("log_id"), "query_id", "node_id", F.coalesce("document_id", "known").alias("document_id"), "rank", F.col("score").alias("retrieval_score"))


def conflict_rows(conflicts: DataFrame) -> DataFrame:
    """Log rows of conflicts; one without a type is ``unknown``."""
    return conflicts.withColumn("conflict_type", F.coalesce("conflict_type", F.lit("unknown")))


def query_states(started: DataFrame, finished: DataFrame, views: dict[str, Column] | None = None) -> DataFrame:
    """The latest state of each query: running until it ends, then completed with an answer or failed with an error, both cut.

    Where only ``views`` of an answer are asked for (columns over ``answer``, by name), they are taken before states meet their queries, and
    no answer is moved.
    """
    failed = F.col("error").isNotNull()
    answer = F.when(failed, F.concat(F.lit("Error: "), F.substring("error", 1, ERROR_CHARS))).otherwise(F.substring("answer", 1, ANSWER_CHARS))
    ended = finished.select("query_id", F.when(failed, "failed").otherwise("completed").alias("ended"), answer.alias("answer"))
    if views is not None:
        ended = ended.select("query_id", "ended", *(view.alias(name) for name, view in views.items()))
    return started.join(ended, "query_id", "left").withColumn("status", F.coalesce("ended", F.lit("running"))).drop("ended")


def decoded_items(value: Column) -> Column:
    """The objects of a JSON list as texts; other items, and all of what is no list, are left out."""
    items = F.from_json(value, "array<string>")
    return F.coalesce(F.filter(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False))), F.expr("cast(array() as array<string>)"))


def citations_of(messages: DataFrame, queries: DataFrame) -> DataFrame:
    """(query_id, citations) of the last assistant message of each query that has any."""
    rows = messages.where("role = 'assistant'").join(queries.select("query_id").distinct(), "query_id", "left_semi")
    rows = rows.withColumn("citations", decoded_items(F.col("citations_json"))).where(F.size("citations") > 0)
    return rows.groupBy("query_id").agg(F.max_by("citations", F.struct("turn", "message_id")).alias("citations"))


def unlink(rows: DataFrame, gone: DataFrame, column: str) -> DataFrame:
    """``rows`` with null in ``column`` where it names a deleted row."""
    keys = gone.select(F.col(column).alias("_gone")).distinct()
    return rows.join(keys, F.col(column) == F.col("_gone"), "left").withColumn(column, F.when(F.col("_gone").isNull(), F.col(column))).drop("_gone")


def cascade(tables: dict[str, DataFrame], links: list[tuple[str, str, str]], gone: DataFrame, key: str) -> dict[str, DataFrame]:
    """What is left of each table once the owners of ``gone`` (with ``key``) are deleted.

    Tables with the key lose the owners' rows. ``links`` are (parent, child, column): rows of a child go with the parent rows of
    the same ``column``; parents come before their children.
    """
    lost = {name: rows.join(gone.select(key).distinct(), key, "left_semi") for name, rows in tables.items() if key in rows.columns}
    left = {name: without(rows, gone, key) if key in rows.columns else rows for name, rows in tables.items()}
    for parent, child, column in links:
        if parent in lost:
            going = lost[parent].select(column)
            taken = tables[child].join(going.distinct(), column, "left_semi")
            lost[child] = lost[child].unionByName(taken) if child in lost else taken
            left[child] = without(left[child], going, column)
    return left


def delete_documents(documents: DataFrame, nodes: DataFrame, gone: DataFrame, hard: bool) -> tuple[DataFrame, DataFrame]:
    """Documents and nodes once some documents are deleted: with all their rows (``hard``), else marked and their nodes inactive."""
    if hard:
        return without(documents, gone, "document_id"), without(nodes, gone, "document_id")
    marks = gone.select("document_id").distinct().withColumn("_gone", F.lit(True))
    flag = lambda rows, name, value: rows.join(marks, "document_id", "left").withColumn(name, F.when(F.col("_gone"), F.lit(value)).otherwise(F.col(name))).drop("_gone")
    return flag(documents, "status", "deleted"), flag(nodes, "is_active", False)


def backfilled(rows: DataFrame, column: str, default: str) -> tuple[DataFrame, Column, Column]:
    """``rows`` with the default where ``column`` is null, and how many rows that sets and leaves (aggregates over the input)."""
    return rows.withColumn(column, F.coalesce(column, F.lit(default))), F.count_if(F.col(column).isNull()), F.count(column)


def resolved_model(user: Column, client: Column, default: str) -> Column:
    """The user's model, else the client's, else the default; blanks name none."""
    named = lambda c: F.nullif(F.trim(c), F.lit(""))
    return F.coalesce(named(user), named(client), F.lit(default))


def run_manifest(results: DataFrame, keys: list[str]) -> DataFrame:
    """Counts of a run's questions by state (processed, malformed and blank rows make up all), and of the passes of those that looped."""
    made = results.groupBy(*keys).agg(
        F.count("*").alias("rows"), F.count_if(F.col("state") == "succeeded").alias("succeeded"), F.count_if(F.col("state") == "failed").alias("failed"),
        F.count_if(F.col("state") == "malformed").alias("malformed"), F.count_if(F.col("state") == "blank").alias("blank"), F.count("passes").alias("agentic"),
        F.round(F.avg("passes"), 2).alias("avg_passes"), F.max("passes").alias("max_passes"), F.count_if(F.col("passes") > 1).alias("looped"),
    )
    done = F.col("succeeded") + F.col("failed")
    return made.withColumn("processed", done).withColumn("complete", done + F.col("malformed") + F.col("blank") == F.col("rows"))


def structure(points: DataFrame, name: str) -> DataFrame:
    """One row for each collection: points, size of the dense vectors (null if they differ), whether there are sparse ones, and whether
    that structure is the first collection's."""
    made = points.groupBy(name).agg(F.count("*").alias("points"), F.when(F.min(F.size("dense")) == F.max(F.size("dense")), F.max(F.size("dense"))).cast("bigint").alias("dense_size"), F.max(F.coalesce(F.size("sparse") > 0, F.lit(False))).alias("has_sparse"))
    first = Window.orderBy(name).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    same = F.col("dense_size").eqNullSafe(F.first("dense_size").over(first)) & (F.col("has_sparse") == F.first("has_sparse").over(first))
    return made.withColumn("like_first", same)


def requested(rows: DataFrame, asked: DataFrame, key: str) -> DataFrame:
    """Rows in the order asked for: ``asked`` has request_id, pos and ``key``. Requests of fewer than two or more than four ids are
    refused, as are those with an id that no row has; ``missing`` counts these."""
    found = asked.join(rows.withColumn("found", F.lit(True)), key, "left")
    w = Window.partitionBy("request_id")
    out = found.withColumns({"n": F.count("*").over(w), "missing": F.count_if(F.col("found").isNull()).over(w)})
    state = F.when(~F.col("n").between(2, 4), "refused").when(F.col("missing") > 0, "missing").otherwise("ok")
    return out.withColumn("state", state).drop("found", "n")
