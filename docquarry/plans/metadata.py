"""Queries of chunk metadata, citations, document keys and payloads, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import metadata as M, retrieval as V
from ..sources import tables as S
from .search import RERANKED, reranked


def _listed(terms) -> str:
    return ", ".join(f"'{t}'" for t in terms)


def _raw_metadata(spark: SparkSession, d: str) -> DataFrame:
    """Chunks with metadata as parsers leave it: texts, some missing, some only in the document's or the version's part."""
    n, text = F.col("node_id"), lambda c: F.col(c).cast("string")
    when = lambda m, r, value: F.when(n % m == r, value)
    document = {"source_file": F.when(n % 2 == 0, F.col("document_name")).otherwise("n/a"), "document_name": F.col("document_name"), "page_num": text("page_num"), "parser_name": F.lit("legacy")}
    chunk = {
        "chunk_type": F.when(n % 9 != 0, F.col("chunk_type")), "page_num": when(4, 2, F.lit("7")), "page_nums": when(4, 1, F.lit("3,x, 5 ,")), "slide_num": when(5, 1, (n % 12).cast("string")), "parser_name": when(3, 0, F.lit("layout")),
        "table_detected": when(10, 3, F.lit("yes")), "chart_detected": when(10, 4, F.lit("No")), "numeric_density": when(8, 0, F.lit("0.5")), "section_path": when(6, 0, F.lit(" Overview ")), "file_name": when(7, 3, F.lit("none")),
    }
    version = {"version_label": F.concat(F.lit("v"), text("version_rank")), "version_rank": text("version_rank"), "is_current": F.col("is_current").cast("string")}
    named = lambda parts: F.struct(*(c.cast("string").alias(k) for k, c in parts.items()))
    return S.chunks(spark, d).select("node_id", "text", (n % 6).alias("chunk_index"), named(document).alias("document"), named(chunk).alias("chunk"), named(version).alias("version"))


_FIELDS = ("source_file", "file_name", "document_name", "chunk_type", "parser_name", "section_path", "page_num", "slide_num", "source_artifact_type", "version_label", "version_rank", "is_current")
_SIGNALS = ("table_detected", "chart_detected", "contains_numeric_data", "numeric_density")


def metadata_normal(spark: SparkSession, d: str) -> DataFrame:
    return M.normalised(_raw_metadata(spark, d)).select("node_id", *_FIELDS, F.array_join(F.col("page_nums").cast("array<string>"), ",").alias("page_nums"), "citation_label", *_SIGNALS)


METADATA_NORMAL = rf"""WITH {S.CHUNKS_SQL},
r AS (SELECT node_id, text, node_id % 6 AS chunk_index, document_name, CASE WHEN node_id % 2 = 0 THEN document_name END AS given_source, coalesce(CASE WHEN node_id % 9 <> 0 THEN chunk_type END, 'text') AS kind,
  CASE WHEN node_id % 4 = 2 THEN 7 ELSE page_num END AS page, CASE WHEN node_id % 5 = 1 THEN node_id % 12 END AS slide, CASE WHEN node_id % 4 = 1 THEN [3, 5]::BIGINT[] ELSE []::BIGINT[] END AS listed, version_rank, is_current,
  len(regexp_extract_all(text, '\b\d+[.,]?\d*%?\b')) AS n, len(regexp_extract_all(text, '\S+')) AS w, lower(text) AS low,
  len(list_filter(string_split(trim(text), chr(10)), lambda x: contains(x, chr(9)) OR length(x) - length(replace(x, '|', '')) >= 2)) AS lines FROM chunks),
l AS (SELECT *, CASE WHEN len(listed) > 0 THEN listed WHEN page <> 0 THEN [page] WHEN slide <> 0 THEN [slide] ELSE []::BIGINT[] END AS pages, coalesce(given_source, document_name) AS source FROM r),
m AS (SELECT *, CASE WHEN page <> 0 THEN page ELSE coalesce(pages[1], page) END AS page_num FROM l)
SELECT node_id, source AS source_file, source AS file_name, document_name, kind AS chunk_type, CASE WHEN node_id % 3 = 0 THEN 'layout' ELSE 'legacy' END AS parser_name, CASE WHEN node_id % 6 = 0 THEN 'Overview' ELSE '' END AS section_path,
page_num, slide AS slide_num, kind AS source_artifact_type, 'v' || version_rank AS version_label, version_rank, coalesce(is_current, false) AS is_current, array_to_string(pages, ',') AS page_nums,
concat_ws(' - ', source, CASE WHEN page_num > 0 THEN 'p.' || page_num END, CASE WHEN slide > 0 THEN 'slide ' || slide END, CASE WHEN chunk_index > 0 THEN 'chunk ' || chunk_index END) AS citation_label,
CASE WHEN node_id % 10 = 3 THEN true ELSE kind IN ({_listed(V.TABLE_CHUNKS)}) OR lines >= 2 OR (lines = 1 AND (n >= 3 OR regexp_matches(low, '\b(q[1-4]|quarter|year|total|revenue|cost|amount|value)\b'))) END AS table_detected,
CASE WHEN node_id % 10 = 4 THEN false ELSE kind IN ({_listed(V.CHART_CHUNKS)}) OR regexp_matches(low, 'figure|chart|graph|plot|diagram|trend') END AS chart_detected, n >= 3 AS contains_numeric_data,
greatest(CASE WHEN node_id % 8 = 0 THEN 0.5 ELSE 0 END::DOUBLE, CASE WHEN w > 0 THEN round(least(1.0, n / w), 4) ELSE 0 END::DOUBLE) AS numeric_density FROM m"""


def citation_projection(spark: SparkSession, d: str) -> DataFrame:
    """Citations of the ranked rows of each question; texts as length and digest."""
    n = F.col("node_id")
    rows = reranked(spark, d).withColumns({
        "place": F.col("rank"), "score": F.col("final"), "source_file": F.when(n % 2 == 0, F.col("document_name")), "document_name": F.when(n % 3 != 0, F.col("document_name")), "file_name": F.lit("n/a"),
        "slide_num": n % 4, "version_label": F.when(n % 5 != 0, F.concat(F.lit("v"), F.col("version_rank").cast("string"))), "citation_label": F.when(n % 7 == 0, F.lit("own label")),
        "asset_refs": F.array(F.concat(F.lit("a"), (n % 9).cast("string")), F.lit(""), F.concat(F.lit("b"), (n % 4).cast("string"))), "table_title": F.when(n % 2 == 0, F.lit("  Rents ")), "units": F.when(n % 3 == 0, F.lit("%")).otherwise(" "),
    })
    made = M.citations(rows)
    listed = F.array_join(F.array_sort(F.transform(F.map_entries("enriched_metadata"), lambda e: F.concat(e["key"], F.lit("="), e["value"]))), ";")
    return made.select(
        "qid", "rank", "score", F.length("text").cast("bigint").alias("chars"), F.sha2("text", 256).alias("text_sha256"), "vector_node_id", "document_name", "source_file", "page_num", "slide_num", "chunk_type", "version_label", "citation_label", "assets", "has_image_assets", listed.alias("enriched"),
    )


CITATION_PROJECTION = f"""WITH {RERANKED},
x AS (SELECT *, CASE WHEN node_id % 2 = 0 THEN document_name END AS src, CASE WHEN node_id % 3 <> 0 THEN document_name END AS dn, node_id % 4 AS slide, CASE WHEN node_id % 5 <> 0 THEN 'v' || version_rank END AS vl,
  substr(coalesce(text, ''), 1, CASE WHEN chunk_type IN ({_listed(M.RICH_CHUNKS)}) THEN 2600 ELSE 1400 END) AS cut FROM ranked),
ex AS (SELECT qid, rank, unnest(['a' || (node_id % 9), '', 'b' || (node_id % 4)]) AS ref, unnest([0, 1, 2]) AS pos FROM x),
f AS (SELECT * FROM ex WHERE ref <> '' QUALIFY row_number() OVER (PARTITION BY qid, ref ORDER BY rank, pos) = 1), ga AS (SELECT qid, rank, string_agg(ref, ',' ORDER BY pos) AS assets FROM f GROUP BY 1, 2)
SELECT qid, x.rank, round(final, 4) AS score, length(cut) AS chars, sha256(cut) AS text_sha256, node_id AS vector_node_id, coalesce(dn, src, 'Unknown') AS document_name, src AS source_file, page_num, slide AS slide_num, chunk_type, vl AS version_label,
CASE WHEN node_id % 7 = 0 THEN 'own label' ELSE concat_ws(' — ', coalesce(dn, src, 'Source ' || x.rank), CASE WHEN page_num <> 0 THEN 'p.' || page_num END, CASE WHEN slide <> 0 THEN 'slide ' || slide END, CASE WHEN vl IS NOT NULL THEN '(' || vl || ')' END) END AS citation_label,
coalesce(assets, '') AS assets, assets IS NOT NULL AS has_image_assets, concat_ws(';', CASE WHEN node_id % 2 = 0 THEN 'table_title=Rents' END, CASE WHEN node_id % 3 = 0 THEN 'units=%' END) AS enriched
FROM x LEFT JOIN ga USING (qid, rank)"""


def document_keys(spark: SparkSession, d: str) -> DataFrame:
    """Keys of documents and what they decode to; a text that is no key decodes to nothing."""
    c = S.chunks(spark, d)
    key = M.encode_key(client_id=F.col("client_id"), document_id=F.col("node_id"), document_name=F.concat(F.col("document_name"), F.lit(" \"é\"")), parser_name=F.when(F.col("node_id") % 2 == 0, F.lit("layout")), parser_version=F.lit(None))
    rows = c.select("node_id", key.alias("document_key")).withColumn("made", M.decode_key(F.col("document_key")))
    broken = M.decode_key(F.concat(F.lit("!"), F.col("document_key")))
    return rows.select("node_id", "document_key", "made.client_id", "made.document_id", "made.document_name", "made.parser_name", "made.parser_version", broken.isNull().alias("refused"))


DOCUMENT_KEYS = f"""WITH {S.CHUNKS_SQL}, k AS (SELECT node_id, '{{"client_id":"' || client_id || '","document_id":"' || node_id || '","document_name":"' || document_name || ' \\"é\\"","parser_name":' || CASE WHEN node_id % 2 = 0 THEN '"layout"' ELSE 'null' END || ',"parser_version":null}}' AS j FROM chunks),
e AS (SELECT node_id, rtrim(translate(to_base64(encode(j)), '+/', '-_'), '=') AS document_key FROM k),
b AS (SELECT *, decode(from_base64(rpad(translate(document_key, '-_', '+/'), (ceil(length(document_key) / 4.0) * 4)::INT, '='))) AS j FROM e)
SELECT node_id, document_key, json_extract_string(j, '$.client_id') AS client_id, json_extract_string(j, '$.document_id') AS document_id, json_extract_string(j, '$.document_name') AS document_name,
json_extract_string(j, '$.parser_name') AS parser_name, json_extract_string(j, '$.parser_version') AS parser_version, true AS refused FROM b"""


def _points(spark: SparkSession, d: str) -> DataFrame:
    """Vectors with payloads as JSON; the node's part is JSON within it."""
    v, n = S.table(spark, d, "embeddings"), F.col("vec_id")
    quoted = lambda name, value: F.concat(F.lit(f'"{name}":"'), value, F.lit('"'))
    inner = F.concat(F.lit('{\\"'), F.when(n % 3 == 0, F.lit('text\\":\\"node text  of ')).otherwise(F.lit('other\\":\\"')), n.cast("string"), F.lit('\\",\\"metadata\\":{\\"document_name\\":\\"'), F.when(n % 4 == 0, F.lit("none")).otherwise(F.concat(F.lit("inner "), (n % 7).cast("string"))), F.lit('\\"}}'))
    payload = F.concat(
        F.lit("{"), quoted("document_id", (n % 50).cast("string")), F.lit(","), quoted("document_name", F.concat(F.lit("outer "), (n % 5).cast("string"))), F.lit(","), quoted("client_id", F.col("label").cast("string")), F.lit(","),
        quoted("page_num", F.when(n % 6 == 0, F.lit("x")).otherwise((n % 30).cast("string"))), F.lit(","), quoted("chunk_type", F.lit("body_text")), F.lit(","), quoted("text", F.concat(F.lit("payload text "), n.cast("string"))), F.lit(","), quoted("_node_content", inner), F.lit("}"),
    )
    return v.select(n.alias("point_id"), payload.alias("payload"), F.when(n % 8 != 0, F.col("embedding")).alias("dense"), F.when(n % 2 == 0, F.array(F.lit(1), F.lit(2))).alias("sparse"))


def node_projection(spark: SparkSession, d: str) -> DataFrame:
    return M.decoded_nodes(_points(spark, d)).select("point_id", "client_id", "document_id", "document_name", "chunk_type", "page_num", "preview", "chars", "top_level", "dense_size", "has_sparse", "vector_kind")


NODE_PROJECTION = r"""WITH p AS (SELECT vec_id AS point_id, '{"document_id":"' || (vec_id % 50) || '","document_name":"outer ' || (vec_id % 5) || '","client_id":"' || label || '","page_num":"' || CASE WHEN vec_id % 6 = 0 THEN 'x' ELSE (vec_id % 30)::VARCHAR END
  || '","chunk_type":"body_text","text":"payload text ' || vec_id || '","_node_content":"{\"' || CASE WHEN vec_id % 3 = 0 THEN 'text\":\"node text  of ' ELSE 'other\":\"' END || vec_id || '\",\"metadata\":{\"document_name\":\"'
  || CASE WHEN vec_id % 4 = 0 THEN 'none' ELSE 'inner ' || (vec_id % 7) END || '\"}}"}' AS payload, CASE WHEN vec_id % 8 <> 0 THEN embedding END AS dense, vec_id % 2 = 0 AS sparse FROM embeddings),
j AS (SELECT *, json_extract_string(payload, '$._node_content') AS node FROM p),
t AS (SELECT *, coalesce(nullif(json_extract_string(node, '$.text'), ''), json_extract_string(payload, '$.text')) AS text, nullif(json_extract_string(node, '$.metadata.document_name'), 'none') AS inner_name FROM j)
SELECT point_id, json_extract_string(payload, '$.client_id') AS client_id, json_extract_string(payload, '$.document_id') AS document_id, coalesce(inner_name, json_extract_string(payload, '$.document_name')) AS document_name,
json_extract_string(payload, '$.chunk_type') AS chunk_type, try_cast(json_extract_string(payload, '$.page_num') AS BIGINT) AS page_num, substr(trim(regexp_replace(text, '\s+', ' ', 'g')), 1, 500) AS preview, length(text) AS chars,
array_to_string(list_sort(list_filter(json_keys(payload), lambda k: k <> '_node_content')), ',') AS top_level, coalesce(len(dense), 0) AS dense_size, sparse AS has_sparse,
CASE WHEN dense IS NOT NULL AND sparse THEN 'hybrid' WHEN dense IS NOT NULL THEN 'dense' WHEN sparse THEN 'sparse' END AS vector_kind FROM t"""


def list_values(spark: SparkSession, d: str) -> DataFrame:
    """Numbers that JSON can't hold, lists of numbers as text, and long lists written out, for each event."""
    e = S.table(spark, d, "events")
    n = F.col("event_id")
    wild = F.when(n % 5 == 0, F.lit(float("nan"))).when(n % 5 == 1, F.lit(float("inf"))).otherwise(F.col("value"))
    listed = F.transform(F.sequence(F.lit(1), (n % 12 + 1).cast("int")), lambda i: F.concat(F.lit(" item  "), i.cast("string")))
    whole = M.int_list(F.array(n.cast("string"), F.lit("3.5"), F.concat(F.lit(" "), (n % 9).cast("string")), F.lit("x"), F.lit(None)))
    return e.select("event_id", M.json_safe(wild).alias("safe"), M.formatted_list(listed).alias("listed"), F.array_join(whole.cast("array<string>"), ",").alias("whole"))


LIST_VALUES = """SELECT event_id, CASE WHEN event_id % 5 > 1 THEN value END AS safe,
array_to_string(list_transform(range(1, least(event_id % 12 + 1, 8)::INT + 1), lambda i: 'item ' || i), '; ') || CASE WHEN event_id % 12 + 1 > 8 THEN '; [+' || (event_id % 12 + 1 - 8) || ' more]' ELSE '' END AS listed,
event_id || ',' || (event_id % 9) AS whole FROM events"""

QUERIES = {"metadata_normal": metadata_normal, "citation_projection": citation_projection, "document_keys": document_keys, "node_projection": node_projection, "list_values": list_values}
ORACLES = {"metadata_normal": METADATA_NORMAL, "citation_projection": CITATION_PROJECTION, "document_keys": DOCUMENT_KEYS, "node_projection": NODE_PROJECTION, "list_values": LIST_VALUES}
