"""Keys, labels and counts of nodes, figures that they state, and what services ask of clients and documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from . import retrieval as V

#: Turns of a history that are kept, and characters of one.
HISTORY_TURNS, HISTORY_CHARS = 6, 220


def _first(*values: Column) -> Column:
    """The first value that is not empty, as text."""
    return F.coalesce(*(F.nullif(v.cast("string"), F.lit("")) for v in values))


def _low(value: Column) -> Column:
    return F.nullif(F.lower(F.trim(value.cast("string"))), F.lit(""))


def keys(n: dict[str, Column]) -> dict[str, Column]:
    """The keys that nodes go by. ``n`` has node_id, chunk_id, document_id, document_name, file_name, source_file, version_label,
    version_group, document_family, citation_label, page_num, slide_num, rank and text; each may be null.

    fusion: one node in several lists. unique: one node in a selection. version: vintages of a document. document: what quotas go by.
    diversity: what a first pass takes one of. page: a page of a version.
    """
    body = F.coalesce(n["text"], F.lit(""))
    unique = F.coalesce(_first(n["node_id"], n["chunk_id"], n["document_id"], n["citation_label"]), F.substring(body, 1, 80))
    named = lambda head, *values: F.concat(F.lit(head), F.coalesce(*values))
    label, alone = _low(n["version_label"]), F.concat(F.lit("node:"), unique)
    file = F.concat_ws(":", F.coalesce(n["file_name"], F.lit("unknown")), n["rank"].cast("string"), F.substring(body, 1, 64))
    page = F.coalesce(F.when(n["page_num"] != 0, n["page_num"]), F.when(n["slide_num"] != 0, n["slide_num"])).cast("string")
    return {
        "fusion_key": F.coalesce(_first(n["node_id"], n["chunk_id"], n["document_id"]), file),
        "unique_key": unique,
        "version_key": F.coalesce(named("version:", label), named("vg:", _low(n["version_group"])), named("doc:", _low(_first(n["document_name"], n["file_name"], n["source_file"]))), alone),
        "document_key": F.coalesce(_first(n["document_id"], n["document_name"], n["source_file"], n["version_label"], n["version_group"]), unique),
        "diversity_key": F.coalesce(
            named("version:", label), named("group:", _low(_first(n["version_group"], n["document_family"]))), named("doc:", _first(n["document_id"])), named("name:", _low(_first(n["document_name"], n["source_file"]))), alone
        ),
        "page_key": F.concat(F.coalesce(_low(_first(n["version_label"], n["version_group"])), F.lit("")), F.lit("|page:"), F.coalesce(page, F.lit(""))),
    }


def labels(n: dict[str, Column]) -> dict[str, Column]:
    """What nodes are counted by: their document, and their version."""
    unknown = F.lit("unknown")
    return {
        "document_label": F.coalesce(_first(n["document_name"], n["source_file"], n["document_id"]), unknown),
        "version_label": F.coalesce(_first(n["version_label"], n["version_group"], n["document_family"], n["document_name"], n["document_id"]), unknown),
    }


def search_text(*values: Column) -> Column:
    """All that a node can be found by, in lower case."""
    return F.lower(F.concat_ws(" ", *(F.coalesce(v, F.lit("")) for v in values)))


def stated_values(text: Column, subjects: Column) -> Column:
    """The figures of a text whose metric is among the subjects, in order, in one spelling."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.METRIC), F.lit(0))
    names = F.transform(F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(V.METRIC), F.lit(1)), T.singular)
    pairs = F.filter(F.zip_with(found, names, lambda f, s: F.struct(f.alias("f"), s.alias("s"))), lambda p: F.array_contains(subjects, p["s"]))
    return F.transform(pairs, lambda p: F.trim(F.regexp_replace(F.regexp_replace(F.lower(p["f"]), ",", ""), r"\s+", " ")))


def metric_sources(citations: DataFrame) -> DataFrame:
    """(qid, value, sources): where each figure of the question's metrics is stated, as places in brackets. ``citations`` has qid, rank, question and text."""
    values = citations.select("qid", "rank", F.posexplode(stated_values(F.col("text"), V.subjects(F.col("question")))).alias("at", "value"))
    made = values.groupBy("qid", "value").agg(F.array_sort(F.collect_list(F.struct("rank", "at"))).alias("r"))
    return made.select("qid", "value", F.array_join(F.transform("r", lambda x: F.concat(F.lit("["), x["rank"].cast("string"), F.lit("]"))), "").alias("sources"))


def grouped(points: DataFrame, key: list[str]) -> DataFrame:
    """Points put together to documents: how many, their pages (of lists and single ones, in order) and kinds. Sets of pages and kinds are
    small; texts aren't gathered."""
    pages = F.array_compact(F.concat(F.coalesce("page_nums", F.expr("cast(array() as array<bigint>)")), F.array("page_num")))
    each = points.groupBy(*key).agg(F.count("*").alias("points"), F.array_join(F.array_sort(F.collect_set(F.coalesce(F.nullif("chunk_type", F.lit("")), F.lit("unknown")))), ",").alias("kinds"))
    listed = points.select(*key, F.explode(pages).alias("page")).distinct().groupBy(*key).agg(F.array_join(F.array_sort(F.collect_list("page")).cast("array<string>"), ",").alias("pages"))
    return each.join(listed, key, "left").withColumn("pages", F.coalesce("pages", F.lit("")))


def document_status(documents: DataFrame, versions: DataFrame, nodes: DataFrame, jobs: DataFrame) -> DataFrame:
    """Each document's first version, active nodes and latest job; a document without any has nulls and no nodes."""
    first = versions.groupBy("document_id").agg(F.min_by(F.struct("version_id", "version_label"), F.struct("created_at", "version_id")).alias("v"))
    active = nodes.where("is_active").groupBy("document_id").agg(F.count("*").alias("active_nodes"))
    newest = F.struct(F.col("started_at").isNotNull(), "started_at", "job_id")
    last = jobs.groupBy("document_id").agg(F.max_by(F.struct("job_id", "status"), newest).alias("j"))
    made = documents.join(first, "document_id", "left").join(active, "document_id", "left").join(last, "document_id", "left")
    return made.select(*documents.columns, F.col("v.version_label").alias("version_label"), F.coalesce("active_nodes", F.lit(0)).alias("active_nodes"), F.col("j.job_id").alias("job_id"), F.coalesce("j.status", F.lit("unknown")).alias("job_status"))


def guarded_update(clients: DataFrame, updates: DataFrame, documents: DataFrame) -> DataFrame:
    """What becomes of updates (client_name, model) of a field that is locked once a client has documents: ``updated``, ``conflict``,
    or ``missing`` for a name that, trimmed, no active client has."""
    named = updates.withColumn("name", F.trim("client_name"))
    owners = documents.select("client_id").distinct().withColumn("locked", F.lit(True))
    found = named.join(clients.where("is_active").select("client_id", "name", F.col("model").alias("was")), "name", "left").join(owners, "client_id", "left")
    same = F.col("model").eqNullSafe(F.col("was"))
    outcome = F.when(F.col("client_id").isNull(), "missing").when(F.coalesce("locked", F.lit(False)) & ~same, "conflict").otherwise("updated")
    return found.select("client_name", "client_id", outcome.alias("outcome"))


def recent_history(turns: DataFrame, key: str) -> DataFrame:
    """(key, place, role, content): the last turns of users and assistants that say something, long ones cut with dots."""
    role = F.lower(F.trim(F.coalesce("role", F.lit(""))))
    content = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " "))
    said = turns.withColumns({"role": role, "content": content}).where("role IN ('user', 'assistant') AND content <> ''")
    newest = Window.partitionBy(key).orderBy(F.desc("turn"), F.desc("role"))
    last = said.withColumn("back", F.row_number().over(newest)).where(F.col("back") <= HISTORY_TURNS)
    short = F.when(F.length("content") > HISTORY_CHARS, F.concat(F.rtrim(F.substring("content", 1, HISTORY_CHARS - 3)), F.lit("..."))).otherwise(F.col("content"))
    place = F.row_number().over(Window.partitionBy(key).orderBy("turn", "role")).cast("bigint")
    return last.select(key, place.alias("place"), "role", short.alias("content"))


def question_kinds(question: Column) -> dict[str, Column]:
    """What a question asks for, by terms: comparison, several sides, conflicts, a given time, tables, charts, images, numbers, counts."""
    q = F.lower(F.coalesce(question, F.lit("")))
    has = lambda terms: T.contains_any(q, terms)
    return {
        "comparative": has(V.COMPARATIVE_TERMS), "balanced": has(V.BALANCED_TERMS), "conflict": has(V.CONFLICT_TERMS), "time_anchored": q.rlike(V.YEAR) | has(V.TIME_TERMS),
        "wants_table": has(V.TABLE_TERMS), "wants_chart": has(V.CHART_TERMS), "wants_image": has(V.IMAGE_TERMS), "wants_number": has(V.NUMERIC_TERMS), "counts": has(V.COUNT_TERMS),
    }
