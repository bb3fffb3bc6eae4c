"""Entities of the retrieval system as projections of the given tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Fixed value: chunk types by number of document.
CHUNK_TYPES = ("body_text", "full_table", "chart_context", "reasoning_page", "page_card")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def chunks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Chunks with the metadata that ranking uses; dates count from 2024-01-01."""
    d, day = table(spark, sf_dir, "documents"), F.lit("2024-01-01").cast("date")
    n = F.col("doc_id")
    kind = F.element_at(F.array(*map(F.lit, CHUNK_TYPES)), (n % 5 + 1).cast("int"))
    return d.select(
        n.alias("node_id"),
        F.col("source").alias("client_id"),
        "text",
        (n % 100).alias("version_group"),
        (F.lit(202301).cast("bigint") + F.floor(n / 100) % 12).alias("version_rank"),
        kind.alias("chunk_type"),
        F.when(n % 7 == 0, True).when(n % 7 == 1, False).alias("is_current"),
        F.date_add(day, (n % 400).cast("int") - 200).alias("effective_from"),
        F.date_add(day, (n % 400).cast("int") - 110).alias("effective_to"),
        F.date_add(day, -(n % 1000).cast("int")).alias("published_at"),
        F.concat(F.lit("doc_"), n.cast("string"), F.lit("_v"), (n % 9).cast("string"), F.lit(".pdf")).alias("document_name"),
        (n % 40).alias("page_num"),
    )


#: The same projection for DuckDB, as the head of a WITH clause.
CHUNKS_SQL = """chunks AS (
  SELECT doc_id AS node_id, source AS client_id, text, doc_id % 100 AS version_group,
         202301 + (doc_id // 100) % 12 AS version_rank,
         ['body_text', 'full_table', 'chart_context', 'reasoning_page', 'page_card'][(doc_id % 5 + 1)::INT] AS chunk_type,
         CASE WHEN doc_id % 7 = 0 THEN true WHEN doc_id % 7 = 1 THEN false END AS is_current,
         DATE '2024-01-01' + ((doc_id % 400)::INT - 200) AS effective_from,
         DATE '2024-01-01' + ((doc_id % 400)::INT - 110) AS effective_to,
         DATE '2024-01-01' - (doc_id % 1000)::INT AS published_at,
         'doc_' || doc_id || '_v' || (doc_id % 9) || '.pdf' AS document_name,
         doc_id % 40 AS page_num
  FROM documents)"""


def questions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("qid"), F.col("text").alias("question"))


def asked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A question for each order, from templates that name its quarter, priority and status."""
    o = table(spark, sf_dir, "orders")
    quarter, year = F.quarter("o_orderdate").cast("string"), F.year("o_orderdate").cast("string")
    forms = [
        ("What changed between Q", quarter, " ", year, " and the latest update for ", F.col("o_orderpriority"), "?"),
        ("How many properties does client ", F.col("o_custkey").cast("string"), " hold as of ", year, "?"),
        ("Which company is best positioned across the sectors represented in these documents in ", year, "?"),
        ("What is the dividend yield and occupancy of ", F.col("o_orderpriority"), "?"),
        ("Show the guidance outlook and projected impact on local jobs for Q", quarter, " ", year),
        ("List the ranked named assets in the table for ", year),
        ("Is there a conflict in the footnote on NOI margin?",),
    ]
    text: Column = F.lit(None).cast("string")
    for k, form in enumerate(forms):
        text = F.when(F.col("o_orderkey") % len(forms) == k, F.concat(*(F.lit(p) if isinstance(p, str) else p for p in form))).otherwise(text)
    return o.select(F.col("o_orderkey").alias("qid"), text.alias("question"))


ASKED_SQL = """asked AS (
  SELECT o_orderkey AS qid, CASE o_orderkey % 7
    WHEN 0 THEN 'What changed between Q' || quarter(o_orderdate) || ' ' || year(o_orderdate) || ' and the latest update for ' || o_orderpriority || '?'
    WHEN 1 THEN 'How many properties does client ' || o_custkey || ' hold as of ' || year(o_orderdate) || '?'
    WHEN 2 THEN 'Which company is best positioned across the sectors represented in these documents in ' || year(o_orderdate) || '?'
    WHEN 3 THEN 'What is the dividend yield and occupancy of ' || o_orderpriority || '?'
    WHEN 4 THEN 'Show the guidance outlook and projected impact on local jobs for Q' || quarter(o_orderdate) || ' ' || year(o_orderdate)
    WHEN 5 THEN 'List the ranked named assets in the table for ' || year(o_orderdate)
    ELSE 'Is there a conflict in the footnote on NOI margin?' END AS question
  FROM orders)"""


def file_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A file name for each order in the writings that version resolution knows, years moved on by 25."""
    o = table(spark, sf_dir, "orders")
    key, year = F.col("o_orderkey"), (F.year("o_orderdate") + 25).cast("string")
    quarter, month = F.quarter("o_orderdate").cast("string"), F.date_format("o_orderdate", "MM")
    short = F.date_format("o_orderdate", "MMM")
    day = F.date_format("o_orderdate", "dd")
    group = F.lower(F.substring("o_orderpriority", 3, 20))
    name = (
        F.when(key % 6 == 0, F.concat(F.lit("report_"), group, F.lit(" Q"), quarter, F.lit(" "), year, F.lit("_v3.pdf")))
        .when(key % 6 == 1, F.concat(F.lit("policy_v2.1_final_"), group, F.lit(".pdf")))
        .when(key % 6 == 2, F.concat(F.lit("Company-Update-"), short, F.lit("-"), F.substring(year, 3, 2), F.lit("-vF.pdf")))
        .when(key % 6 == 3, F.concat(F.lit("budget_FY"), year, F.lit(".pdf")))
        .when(key % 6 == 4, F.concat(F.lit("policy_"), year, F.lit("-"), month, F.lit("-"), day, F.lit(".pdf")))
        .otherwise(F.concat(F.lit("plan_draft_v1_"), group, F.lit(".docx")))
    )
    return o.select(key.alias("file_id"), F.col("o_custkey").alias("client_id"), name.alias("file_name"), F.col("o_orderdate").alias("created_at"))


FILES_SQL = """files AS (
  SELECT o_orderkey AS file_id, o_custkey AS client_id, o_orderdate AS created_at, CASE o_orderkey % 6
    WHEN 0 THEN 'report_' || lower(substr(o_orderpriority, 3, 20)) || ' Q' || quarter(o_orderdate) || ' ' || (year(o_orderdate) + 25) || '_v3.pdf'
    WHEN 1 THEN 'policy_v2.1_final_' || lower(substr(o_orderpriority, 3, 20)) || '.pdf'
    WHEN 2 THEN 'Company-Update-' || strftime(o_orderdate, '%b') || '-' || substr((year(o_orderdate) + 25)::VARCHAR, 3, 2) || '-vF.pdf'
    WHEN 3 THEN 'budget_FY' || (year(o_orderdate) + 25) || '.pdf'
    WHEN 4 THEN 'policy_' || (year(o_orderdate) + 25) || '-' || strftime(o_orderdate, '%m-%d') || '.pdf'
    ELSE 'plan_draft_v1_' || lower(substr(o_orderpriority, 3, 20)) || '.docx' END AS file_name
  FROM orders)"""
