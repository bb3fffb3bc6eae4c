"""Chunks of pages and figures, pages worth a closer look, and points that come as JSON or as pairs of a chat."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .records import uuid5

#: Weights of a page's charts, charts without numbers, tables and figures; kinds of page and figure that count for more.
CHART_WEIGHT, BARE_CHART_WEIGHT, TABLE_WEIGHT, FIGURE_WEIGHT = 3.0, 1.5, 2.5, 2.0
HEAVY_PAGES = ("visual_heavy_page", "hard_page", "table_heavy_page")
CHART_LIKE = ("chart", "diagram", "infographic")
#: Fixed value: the namespace of ids that are made of addresses.
NAMESPACE_URL = "6ba7b811-9dad-11d1-80b4-00c04fd430c8"
#: Captions that a page's card names.
CARD_CAPTIONS = 3


def figure_chunks(figures: DataFrame) -> DataFrame:
    """(figure_id, chunk_no, chunk_type, text): two to four chunks of each figure (figure_id, caption, nearby, proxy, figure_type, chart_type,
    trend, first_value, last_value): what stands at it, its description, and of charts their context and data points."""
    line = lambda *parts: F.trim(F.concat_ws("\n", *(F.nullif(p, F.lit("")) for p in parts)))
    c = F.col
    chart = c("figure_type").isin(*CHART_LIKE)
    known = c("first_value").isNotNull()
    value = lambda at, v: F.concat(F.lit(f"- derived_series | x={at} | y="), v.cast("string"), F.lit(" (approx)"))
    points = F.concat_ws(
        "\n", F.concat(F.lit("Chart type: "), F.when(c("chart_type") != "unknown", c("chart_type")).otherwise(c("figure_type"))), F.concat(F.lit("Title: "), c("caption")), F.concat(F.lit("Trend: "), c("trend")),
        F.when(known, F.concat_ws("\n", F.lit("Approximate datapoints:"), value("start", c("first_value")), value("end", c("last_value")))), F.lit("Note: numeric values may be approximate."),
    )
    made = F.array(
        F.struct(F.lit("figure_artifact").alias("chunk_type"), F.coalesce(F.nullif(line(c("caption"), c("nearby")), F.lit("")), c("proxy")).alias("text")),
        F.struct(F.lit("visual_proxy_text").alias("chunk_type"), c("proxy").alias("text")),
        F.when(chart & (c("nearby") != ""), F.struct(F.lit("chart_context").alias("chunk_type"), line(c("trend"), c("nearby")).alias("text"))),
        F.when(chart & (known | (c("caption") != "")), F.struct(F.lit("chart_data_points").alias("chunk_type"), points.alias("text"))),
    )
    return figures.select("figure_id", F.posexplode(F.array_compact(made)).alias("chunk_no", "k")).select("figure_id", F.col("chunk_no").cast("bigint").alias("chunk_no"), "k.chunk_type", "k.text")


def page_cards(pages: DataFrame, artifacts: DataFrame) -> DataFrame:
    """(page, text): a card for each page (page, page_class, confidence) that isn't plain text or holds tables or figures, with how many of
    them (artifacts: page, artifact_id, kind, caption) and the first captions of each."""
    nth = F.row_number().over(Window.partitionBy("page", "kind").orderBy("artifact_id"))
    first = artifacts.withColumn("nth", nth)
    of = lambda kind: F.array_join(F.transform(F.array_sort(F.collect_list(F.when((F.col("kind") == kind) & (F.col("nth") <= CARD_CAPTIONS), F.struct("nth", "caption")))), lambda x: x["caption"]), "; ")
    held = first.groupBy("page").agg(F.count_if(F.col("kind") == "table").alias("tables"), F.count_if(F.col("kind") == "figure").alias("figures"), of("table").alias("table_captions"), of("figure").alias("figure_captions"))
    rows = pages.join(held, "page", "left").fillna(0, ["tables", "figures"]).where("page_class <> 'simple_text_page' OR tables + figures > 0")
    said = lambda head, c: F.concat(F.lit(head), F.col(c).cast("string"))
    text = F.concat_ws(
        "\n", F.concat(said("Page ", "page"), F.lit(" summary")), said("Class: ", "page_class"), F.concat(F.lit("Layout confidence: "), F.col("confidence").cast("decimal(4,2)").cast("string")), said("Tables: ", "tables"), said("Figures: ", "figures"),
        F.when(F.col("tables") > 0, said("Table captions: ", "table_captions")), F.when(F.col("figures") > 0, said("Figure captions: ", "figure_captions")),
    )
    return rows.select("page", "tables", "figures", text.alias("text"))


def page_weight(page_class: Column, degraded: Column, complexity: Column) -> Column:
    return F.when(page_class.isin(*HEAVY_PAGES), 2.0).otherwise(1.0) + F.when(degraded, 1.0).otherwise(0.0) + complexity


def chosen_pages(pages: DataFrame, key: str, priority: Column, most: int) -> DataFrame:
    """The pages of each document with the highest priority, of equal ones the later; ``priority`` is null for pages that don't qualify."""
    ranked = pages.withColumn("priority", F.round(priority, 6)).where("priority IS NOT NULL")
    place = F.row_number().over(Window.partitionBy(key).orderBy(F.desc("priority"), F.desc("page")))
    return ranked.withColumn("place", place.cast("bigint")).where(F.col("place") <= most)


def pasted_points(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, point_no, point, state): points that were pasted as JSON: a list of objects, ``{"points": [...]}``, or one object. What is no JSON, or
    holds other things than objects, gives one row of state ``error``; blank texts give none."""
    t = F.trim(F.coalesce(F.col(text), F.lit("")))
    listed = F.from_json(F.when(t.startswith("["), t), "array<string>")
    inner = F.from_json(F.get_json_object(F.when(t.startswith("{"), t), "$.points"), "array<string>")
    one = F.when(t.startswith("{") & F.get_json_object(t, "$").isNotNull(), F.array(t))
    items = F.coalesce(listed, inner, one)
    good = items.isNotNull() & F.forall(items, lambda x: F.coalesce(x.startswith("{"), F.lit(False)))
    rows = texts.where(t != "").select(key, good.alias("good"), F.when(good, items).otherwise(F.array(F.lit(None).cast("string"))).alias("items"))
    return rows.select(key, F.posexplode("items").alias("point_no", "point"), F.when(F.col("good"), "ok").otherwise("error").alias("state"))


def chat_pairs(messages: DataFrame) -> DataFrame:
    """(point_id, client_id, conv_id, message_id, user_text, assistant_text): each assistant message with the user's message right before it;
    the id follows from client, session and message, so indexing again replaces. Pairs without text are left out."""
    w = Window.partitionBy("conv_id").orderBy("turn")
    rows = messages.withColumns({"before": F.lag("role").over(w), "user_text": F.lag("text").over(w)}).where("role = 'assistant' AND before = 'user'")
    rows = rows.where("trim(coalesce(user_text, '')) <> '' AND trim(coalesce(text, '')) <> ''")
    name = F.concat_ws(":", F.col("client_id").cast("string"), F.col("conv_id").cast("string"), F.col("message_id").cast("string"))
    return rows.select(uuid5(NAMESPACE_URL, name).alias("point_id"), "client_id", "conv_id", "message_id", "user_text", F.col("text").alias("assistant_text"))


def variant_counts(lists: DataFrame) -> DataFrame:
    """(qid, variant, found, own): how many nodes each variant of a question finds, and how many of them no other does."""
    alone = F.count("*").over(Window.partitionBy("qid", "node_id")) == 1
    return lists.withColumn("alone", alone).groupBy("qid", "variant").agg(F.count("*").alias("found"), F.count_if("alone").alias("own"))
