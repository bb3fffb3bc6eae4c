"""Metadata of chunks, citations and document keys as columns; payloads as JSON."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .retrieval import CHART_CHUNKS, TABLE_CHUNKS

#: Kinds of chunk whose text may be longer in citations, how much of a text is shown, and fields that enrich a citation.
RICH_CHUNKS = (
    "full_table", "table_segment", "table_summary_text", "figure_artifact", "chart_context", "chart_data_points", "visual_proxy_text",
    "reasoning_table", "reasoning_chart", "reasoning_figure", "reasoning_page",
)
SHOWN, SHOWN_RICH = 1400, 2600
ENRICHED = (
    "table_title", "chart_title", "excerpt_keywords", "key_chart_facts", "approx_datapoints", "trend_summary", "units", "as_of_date",
    "document_date", "metric_basis", "claims", "evidence_refs", "llm_page_summary", "llm_caption",
)
#: Items of a list that are written out, and characters of a nested value.
LISTED, NESTED = 8, 1200


def first_text(*values: Column) -> Column:
    """The first value that is not null, blank or a word for a missing value; trimmed."""
    return F.coalesce(*(T.clean_missing(v) for v in values))


def int_list(values: Column) -> Column:
    """Whole numbers of a list of texts, in order; what is none is left out, a null list is empty."""
    return F.coalesce(F.array_compact(F.transform(values, lambda v: v.try_cast("bigint"))), F.expr("cast(array() as array<bigint>)"))


def locations(page_nums: Column, page: Column, slide: Column) -> tuple[Column, Column]:
    """(page_nums, page_num): the list if it has any, else the page, else the slide; the page, else the first of the list. Zero counts as none."""
    one = lambda c: F.when(c != 0, F.array(c.cast("bigint")))
    pages = F.coalesce(F.when(F.size(page_nums) > 0, page_nums), one(page), one(slide), F.expr("cast(array() as array<bigint>)"))
    return pages, F.coalesce(F.when(page != 0, page.cast("bigint")), F.get(pages, F.lit(0)), page.cast("bigint"))


def signals(text: Column, chunk_type: Column, table: Column, chart: Column, numeric: Column, density: Column) -> dict[str, Column]:
    """The flags given as text where they say something, else what the kind of chunk and the text tell; the larger of both densities."""
    kind, body = F.coalesce(chunk_type, F.lit("")), F.coalesce(text, F.lit(""))
    told = lambda flag, own: F.coalesce(T.safe_bool(flag), own)
    return {
        "table_detected": told(table, kind.isin(*TABLE_CHUNKS) | T.has_table_signals(body)),
        "chart_detected": told(chart, kind.isin(*CHART_CHUNKS) | T.has_chart_signals(body)),
        "contains_numeric_data": told(numeric, T.has_numeric_data(body)),
        "numeric_density": F.greatest(T.safe_float(density, 0.0), T.numeric_density(body)),
    }


def normalised(chunks: DataFrame) -> DataFrame:
    """Canonical metadata of chunks: one name for each field whatever the parser called it.

    ``chunks`` has structs ``document``, ``chunk`` and ``version`` of texts, of which a later one wins where it says something, text
    and chunk_index (from 1). A field that no struct has is null; a missing kind is ``text``, a missing parser ``unknown``.
    """
    has = {s: {f.name for f in chunks.schema[s].dataType.fields} for s in ("document", "chunk", "version")}
    own = lambda name, *order: F.coalesce(*(F.col(f"{s}.{name}") for s in order if name in has[s]), F.lit(None).cast("string"))
    field = lambda name: own(name, "version", "chunk", "document")
    source = first_text(field("source_file"), field("file_name"), field("document_name"))
    page, slide = T.safe_int(field("page_num")), T.safe_int(field("slide_num"))
    pages, page_num = locations(int_list(F.split(field("page_nums"), ",")), page, slide)
    kind = F.coalesce(first_text(field("chunk_type")), F.lit("text"))
    rank = T.safe_int(field("version_rank"), 0)
    label = F.coalesce(first_text(field("citation_label")), T.citation_label(F.coalesce(source, F.lit("Source")), page_num, slide, F.col("chunk_index")))
    return chunks.select(
        "*",
        source.alias("source_file"),
        F.coalesce(first_text(field("file_name")), source).alias("file_name"),
        F.coalesce(first_text(field("document_name")), source).alias("document_name"),
        kind.alias("chunk_type"),
        F.coalesce(first_text(field("parser_name")), F.lit("unknown")).alias("parser_name"),
        F.coalesce(first_text(field("section_path")), F.lit("")).alias("section_path"),
        pages.alias("page_nums"),
        page_num.alias("page_num"),
        slide.alias("slide_num"),
        F.coalesce(first_text(field("source_artifact_type")), kind).alias("source_artifact_type"),
        first_text(field("version_label")).alias("version_label"),
        rank.alias("version_rank"),
        F.coalesce(T.safe_bool(field("is_current")), F.lit(False)).alias("is_current"),
        label.alias("citation_label"),
        *(c.alias(k) for k, c in signals(F.col("text"), kind, field("table_detected"), field("chart_detected"), field("contains_numeric_data"), field("numeric_density")).items()),
    )


def fallback_label(name: Column, rank: Column, page: Column, slide: Column, version: Column) -> Column:
    """``name — p.N — slide N — (version)``; without a name ``Source rank``, absent and zero parts are left out."""
    part = lambda head, c: F.when(c != 0, F.concat(F.lit(head), c.cast("string")))
    whom = F.coalesce(F.nullif(name, F.lit("")), F.concat(F.lit("Source "), rank.cast("string")))
    return F.concat_ws(" — ", whom, part("p.", page), part("slide ", slide), F.when(version != "", F.concat(F.lit("("), version, F.lit(")"))))


def enriched(values: dict[str, Column]) -> Column:
    """A map of those of the values (as text) that say something, trimmed."""
    pairs = F.array(*(F.struct(F.lit(k).alias("k"), F.trim(v).alias("v")) for k, v in values.items()))
    return F.map_from_entries(F.filter(pairs, lambda p: F.coalesce(p["v"] != "", F.lit(False))))


def formatted_list(values: Column) -> Column:
    """The first items joined by semicolons, and how many more there are."""
    shown = F.array_join(F.filter(F.transform(F.slice(values, 1, LISTED), lambda v: F.trim(F.regexp_replace(v, r"\s+", " "))), lambda v: v != ""), "; ")
    more = F.size(values) - LISTED
    return F.when(more > 0, F.concat(shown, F.lit("; [+"), more.cast("string"), F.lit(" more]"))).otherwise(shown)


def citations(ranked: DataFrame) -> DataFrame:
    """Citations of a question's ranked nodes: rank by place, score to four places, text cut by kind, and a label.

    ``ranked`` has qid, place, node_id, score, text and the normalised metadata; of asset_refs (an array) only those that no node before
    it in the question has are kept.
    """
    first = Window.partitionBy("qid", "ref").orderBy("place", "at")
    refs = ranked.select("qid", "place", F.posexplode("asset_refs").alias("at", "ref")).where("ref <> ''")
    refs = refs.withColumn("nth", F.row_number().over(first)).where("nth = 1").groupBy("qid", "place").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("at", "ref"))), lambda r: r["ref"]), ",").alias("assets"))
    cut = F.when(F.col("chunk_type").isin(*RICH_CHUNKS), SHOWN_RICH).otherwise(SHOWN)
    name = F.coalesce(first_text(F.col("document_name"), F.col("file_name"), F.col("source_file")), F.lit("Unknown"))
    label = F.coalesce(F.nullif("citation_label", F.lit("")), fallback_label(F.coalesce("document_name", "source_file"), F.col("place"), F.col("page_num"), F.col("slide_num"), F.col("version_label")))
    made = ranked.select(
        "qid", F.col("place").alias("rank"), F.round("score", 4).alias("score"), F.substring(F.coalesce("text", F.lit("")), F.lit(1), cut).alias("text"), F.col("node_id").alias("vector_node_id"),
        name.alias("document_name"), "source_file", "page_num", "slide_num", "chunk_type", "version_label", label.alias("citation_label"),
        enriched({k: F.col(k) for k in ENRICHED if k in ranked.columns}).alias("enriched_metadata"),
    )
    made = made.join(refs.withColumnRenamed("place", "rank"), ["qid", "rank"], "left")
    return made.withColumns({"assets": F.coalesce("assets", F.lit("")), "has_image_assets": F.col("assets").isNotNull()})


#: Columns of a document's identity, in order of name.
IDENTITY = ("client_id", "document_id", "document_name", "parser_name", "parser_version")


def encode_key(**parts: Column) -> Column:
    """A document's identity as base 64 for URLs, without padding, of JSON with its names in order; missing parts are null."""
    body = F.to_json(F.struct(*(parts[k].cast("string").alias(k) for k in sorted(parts))), {"ignoreNullFields": "false"})
    return F.translate(F.base64(body.cast("binary")), "+/=\r\n", "-_")


def decode_key(key: Column, names: tuple[str, ...] = IDENTITY) -> Column:
    """The struct that a key stands for; null for a text that is none."""
    whole = F.rpad(F.translate(key, "-_", "+/"), F.length(key) + F.pmod(-F.length(key), F.lit(4)), F.lit("="))
    body = F.try_to_binary(whole, F.lit("base64")).cast("string")
    made = F.from_json(body, ", ".join(f"{n} string" for n in names))
    return F.when(key.rlike("^[A-Za-z0-9_-]+$") & body.rlike(r"^\{"), made)


#: The nested part of a payload that holds the node.
_NODE = "text string, text_resource struct<text:string>, metadata map<string,string>"


def decoded_nodes(points: DataFrame) -> DataFrame:
    """Points (point_id, payload, dense, sparse) as flat nodes: text from the node, else from its resource, else from the payload; metadata
    of the node wins over the payload's; a preview; the length of the dense vector and whether there is a sparse one."""
    payload = F.from_json("payload", "map<string,string>")
    rows = points.withColumn("p", payload).withColumn("node", F.from_json(F.try_element_at("p", F.lit("_node_content")), _NODE))
    meta = lambda name: first_text(F.try_element_at("node.metadata", F.lit(name)), F.try_element_at("p", F.lit(name)))
    text = F.coalesce(F.nullif("node.text", F.lit("")), F.nullif("node.text_resource.text", F.lit("")), F.try_element_at("p", F.lit("text")), F.try_element_at("p", F.lit("chunk_text")), F.lit(""))
    dense, sparse = F.coalesce(F.size("dense"), F.lit(0)), F.coalesce(F.size("sparse") > 0, F.lit(False))
    kind = F.when((dense > 0) & sparse, "hybrid").when(dense > 0, "dense").when(sparse, "sparse")
    return rows.select(
        "point_id",
        *(meta(n).alias(n) for n in (*IDENTITY, "chunk_type")),
        T.safe_int(meta("page_num")).alias("page_num"),
        T.preview(text).alias("preview"),
        F.length(text).cast("bigint").alias("chars"),
        F.array_join(F.array_sort(F.map_keys(F.map_filter("p", lambda k, _: k != "_node_content"))), ",").alias("top_level"),
        dense.cast("bigint").alias("dense_size"),
        sparse.alias("has_sparse"),
        kind.alias("vector_kind"),
    )


def json_safe(value: Column) -> Column:
    """Null for numbers that JSON can't hold."""
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)
