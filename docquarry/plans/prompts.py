"""The query of prompts made from evidence, and the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import intents
from ..operators import metadata as M, prompts as P
from ..operators.evidence import MERGER
from ..operators.retrieval import METRIC
from ..sources import tables as S
from .search import _any, label_tests

_QUESTIONS = (
    "What changed between Q1 2025 and the latest update?", "How many customers does client hold as of 2024?", "Which company is best positioned across the sectors in these documents?",
    "What is the dividend yield and occupancy?", "What is the outlook for 2026?", "Projected impact on local jobs", "What is the number of Customers in the portfolio?", "a plain one",
)
_NAMES = ("Investor Presentation.pdf", "Company Update Alpha Rents 2024.pdf", "files/beta_tower_Q1.v2.docx", "", "the annual gamma.pdf")


def _cited(spark: SparkSession, d: str) -> DataFrame:
    """Documents as evidence: eight in a row belong to a question."""
    n, text = F.col("node_id"), lambda c: F.col(c).cast("string")
    when = lambda m, r, value: F.when(n % m == r, value)
    said = F.when(n % 4 == 0, F.concat(F.lit(" 5,"), (n % 3).cast("string"), F.lit("00+  Global Customers. "))).when(n % 4 == 1, F.concat(F.lit("5"), (n % 3).cast("string"), F.lit("00+ customers, "))).when(n % 16 == 2, F.lit("The Merger is on. ")).otherwise("")
    extra = {"as_of_date": when(12, 5, F.lit("2023-12-31")), "units": when(8, 1, F.lit("%")), "trend_summary": when(11, 2, F.lit(" up   5% "))}
    name = F.element_at(F.array(*map(F.lit, _NAMES)), (n % len(_NAMES) + 1).cast("int"))
    return S.chunks(spark, d).select(
        F.floor(n / 8).cast("bigint").alias("qid"), (n % 8 + 1).alias("rank"), F.concat(F.lit("d"), n.cast("string")).alias("document_id"), name.alias("document_name"), F.lit("source.pdf").alias("source_file"), when(7, 0, F.lit("own label")).alias("citation_label"),
        F.when(n % 5 != 0, F.concat(F.lit("v"), text("version_rank"))).alias("version_label"), F.when(n % 24 < 8, text("version_group")).when(n % 24 < 12, F.lit(" Unknown ")).when(n % 24 < 16, F.lit("Rents")).alias("version_group"), F.when(n % 9 != 0, F.col("chunk_type")).alias("chunk_type"), "page_num", (n % 3).alias("slide_num"),
        when(48, 16, text("published_at")).alias("document_date"), F.lit(None).cast("string").alias("as_of_date"), when(9, 2, F.lit("actual")).alias("metric_basis"), when(5, 3, text("effective_from")).alias("effective_from"), F.lit("").alias("effective_to"), when(10, 3, F.lit("Overview")).alias("section_title"),
        M.enriched(extra).alias("enriched_metadata"), F.concat(said, F.coalesce("text", F.lit(""))).alias("text"), (n % 8).alias("place"), F.when(n % 3 == 0, F.substring("text", 1, 60)).otherwise(" ").alias("summary"), (n % 4 != 3).alias("disputed"),
    )


def _context(spark: SparkSession, d: str) -> DataFrame:
    cited = _cited(spark, d)
    asked = cited.select("qid").distinct().withColumn("question", F.element_at(F.array(*map(F.lit, _QUESTIONS)), (F.col("qid") % len(_QUESTIONS) + 1).cast("int")))
    conflicts = cited.where("disputed AND qid % 5 <> 0").select("qid", "place", "summary")
    return P.prompt_context(asked.withColumn("labels", intents.labels(F.col("question"))), cited, conflicts)


def prompt_context(spark: SparkSession, d: str) -> DataFrame:
    """What the prompt of each question says, lines as number and digest."""
    digest = lambda name: F.sha2(F.array_join(name, "\n"), 256).alias(name)
    return _context(spark, d).select("qid", F.size("evidence_lines").cast("bigint").alias("n_lines"), digest("evidence_lines"), digest("conflict_lines"), F.array_join("note_names", ",").alias("note_names"), F.array_join("notes", "\n").alias("notes"))


def _listed(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _note(name: str) -> str:
    said = P.NOTES[name].replace("'", "''")
    return "'" + said.replace("{values}", "' || listed || '").replace("{documents}", "' || coalesce(nullif(documents, ''), 'see citations') || '") + "'"


_FLAGS = ", ".join(f"({t}) AS {name}" for name, t in label_tests().items())
_TEST = {
    "change": "temporal_delta", "vantage": "vantage", "dates": "stale_source OR dated", "scope": "outlook_scope AND scoped", "values": "caveat_inconsistency AND n_values >= 2", "corpus": "corpus_wide_scope", "versions": "multi_version_lookup",
}
PROMPT_CONTEXT = rf"""WITH {S.CHUNKS_SQL},
ci AS (SELECT node_id // 8 AS qid, node_id % 8 + 1 AS rank, [{_listed(_NAMES)}][node_id % {len(_NAMES)} + 1] AS name, CASE WHEN node_id % 7 = 0 THEN 'own label' END AS label, CASE WHEN node_id % 5 <> 0 THEN 'v' || version_rank END AS ver, 'd' || node_id AS doc,
  CASE WHEN node_id % 24 < 8 THEN version_group::VARCHAR WHEN node_id % 24 < 12 THEN ' Unknown ' WHEN node_id % 24 < 16 THEN 'Rents' END AS grp, CASE WHEN node_id % 9 <> 0 THEN chunk_type END AS kind, page_num, node_id % 3 AS slide, CASE WHEN node_id % 48 = 16 THEN published_at::VARCHAR END AS dd,
  CASE WHEN node_id % 9 = 2 THEN 'actual' END AS basis, CASE WHEN node_id % 5 = 3 THEN effective_from::VARCHAR END AS ef, CASE WHEN node_id % 10 = 3 THEN 'Overview' END AS sec, CASE WHEN node_id % 12 = 5 THEN '2023-12-31' END AS xa, CASE WHEN node_id % 8 = 1 THEN '%' END AS xu, CASE WHEN node_id % 11 = 2 THEN 'up 5%' END AS xt,
  CASE WHEN node_id % 4 = 0 THEN ' 5,' || (node_id % 3) || '00+  Global Customers. ' WHEN node_id % 4 = 1 THEN '5' || (node_id % 3) || '00+ customers, ' WHEN node_id % 16 = 2 THEN 'The Merger is on. ' ELSE '' END || coalesce(text, '') AS body,
  CASE WHEN node_id % 3 = 0 THEN text[:60] ELSE ' ' END AS summary, node_id % 4 <> 3 AND (node_id // 8) % 5 <> 0 AS disputed FROM chunks),
cx AS (SELECT *, concat_ws(chr(10), 'trend_summary: ' || xt, 'units: ' || xu, 'as_of_date: ' || xa) AS facts, concat_ws(' | ', 'document_date=' || dd, 'metric_basis=' || basis, 'version_group=' || grp, 'effective_from=' || ef, 'section=' || sec, 'as_of_date=' || xa, 'units=' || xu) AS ctx,
  regexp_replace(body, '^\s+|\s+$', '', 'g') AS tidy, CASE WHEN kind IN ({_listed(M.RICH_CHUNKS)}) THEN 2400 ELSE 1400 END AS most FROM ci),
cl AS (SELECT *, '[' || rank || '] ' || coalesce(label, nullif(name, ''), 'Source ' || rank) || ' | version=' || coalesce(ver, 'unknown') || ' | chunk_type=' || coalesce(kind, 'text') || CASE WHEN page_num <> 0 THEN ' | page=' || page_num WHEN slide <> 0 THEN ' | slide=' || slide ELSE '' END || chr(10)
  || CASE WHEN ctx <> '' THEN 'Source context: ' || ctx || chr(10) ELSE '' END || CASE WHEN facts <> '' THEN 'Extracted facts:' || chr(10) || facts || chr(10) ELSE '' END || 'Excerpt: ' || CASE WHEN length(tidy) <= most THEN tidy ELSE regexp_replace(tidy[:most], '\s+$', '') || chr(10) || '[...truncated]' END AS line,
  lower(concat_ws(' ', name, coalesce(label, ''), coalesce(sec, ''), coalesce(basis, ''), body, facts)) AS searched,
  list_filter(regexp_extract_all(lower(regexp_replace(regexp_replace(name, '^.*/', ''), '^(.+)\.[^.]*$', '\1')), '[a-z]+'), lambda w: w NOT IN ({_listed(P.NO_TOPIC)})) AS ws, lower(concat_ws(chr(31), dd, ef, ver, xa)) AS sg FROM cx),
ck AS (SELECT *, CASE WHEN lower(trim(coalesce(grp, ''))) NOT IN ('', 'unknown') THEN 'g:' || lower(trim(grp)) WHEN len(ws) > 0 THEN 't:' || array_to_string(ws[:2], ' ') END AS key, CASE WHEN sg <> '' THEN sg WHEN grp IS NOT NULL THEN 'd:' || doc END AS sign FROM cl),
va AS (SELECT DISTINCT qid FROM (SELECT qid FROM ck WHERE key IS NOT NULL GROUP BY qid, key HAVING count(DISTINCT sign) >= 2)),
qs AS (SELECT DISTINCT qid, [{_listed(_QUESTIONS)}][qid % {len(_QUESTIONS)} + 1] AS question FROM ci), qn AS (SELECT qid, question, trim(regexp_replace(lower(question), '\s+', ' ', 'g')) AS n FROM qs), qf AS (SELECT qid, question, {_FLAGS} FROM qn),
qw AS (SELECT DISTINCT qid, CASE WHEN w LIKE '%ies' AND length(w) > 4 THEN w[:-4] || 'y' WHEN w LIKE '%s' AND length(w) > 3 THEN w[:-2] ELSE w END AS subject FROM (SELECT qid, unnest(regexp_extract_all(lower(question), '[a-z][a-z-]+')) AS w FROM qf WHERE caveat_inconsistency) WHERE length(w) >= 4 AND w NOT IN ({_listed(P.NOT_SUBJECTS)})),
mv AS (SELECT qid, rank, unnest(regexp_extract_all(searched, '{METRIC}')) AS whole, unnest(regexp_extract_all(searched, '{METRIC}', 1)) AS w, generate_subscripts(regexp_extract_all(searched, '{METRIC}'), 1) AS pos FROM ck JOIN qf USING (qid) WHERE caveat_inconsistency),
ms AS (SELECT qid, rank, pos, trim(regexp_replace(replace(whole, ',', ''), '\s+', ' ', 'g')) AS value, CASE WHEN t LIKE '%ies' AND length(t) > 4 THEN t[:-4] || 'y' WHEN t LIKE '%s' AND length(t) > 3 THEN t[:-2] ELSE t END AS subject FROM (SELECT *, trim(w, '-') AS t FROM mv)),
mo AS (SELECT qid, rank, pos, value FROM ms JOIN qw USING (qid, subject)),
mr AS (SELECT *, row_number() OVER (PARTITION BY qid, value ORDER BY rank, pos) AS nth FROM mo),
mg AS (SELECT qid, value, min((rank, pos)) AS first, string_agg('[' || rank || ']', ', ' ORDER BY rank, pos) FILTER (nth <= 3) AS refs FROM mr GROUP BY 1, 2),
mn AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY first) AS k FROM mg), ml AS (SELECT qid, count(*) AS n_values, string_agg(value || ': ' || refs, '; ' ORDER BY k) FILTER (k <= 5) AS listed FROM mn GROUP BY 1),
dn AS (SELECT qid, string_agg(shown, ', ' ORDER BY r) AS documents FROM (SELECT qid, coalesce(nullif(name, ''), 'source.pdf') AS shown, min(rank) AS r FROM ci GROUP BY 1, 2) GROUP BY 1),
co AS (SELECT qid, string_agg('- ' || s, chr(10) ORDER BY k) FILTER (s <> '') AS told FROM (SELECT qid, trim(regexp_replace(coalesce(summary, ''), '\s+', ' ', 'g')) AS s, row_number() OVER (PARTITION BY qid ORDER BY rank) AS k FROM ci WHERE disputed) WHERE k <= 4 GROUP BY 1),
ev AS (SELECT qid, count(*) AS n_lines, string_agg(line, chr(10) ORDER BY rank) AS lines, bool_or(dd IS NOT NULL OR xa IS NOT NULL) AS dated, bool_or({_any('searched', MERGER)}) AS scoped FROM ck GROUP BY 1),
al AS (SELECT ev.qid AS qid, ev.* EXCLUDE (qid), qf.* EXCLUDE (qid), documents, n_values, listed, told, va.qid IS NOT NULL AS vantage FROM ev JOIN qf USING (qid) JOIN dn USING (qid) LEFT JOIN ml USING (qid) LEFT JOIN co USING (qid) LEFT JOIN va ON va.qid = ev.qid)
SELECT qid, n_lines, sha256(lines) AS evidence_lines, sha256(coalesce(told, '{P.NO_CONFLICTS}')) AS conflict_lines, concat_ws(',', {', '.join(f"CASE WHEN {t} THEN '{k}' END" for k, t in _TEST.items())}) AS note_names, concat_ws(chr(10), {', '.join(f"CASE WHEN {t} THEN {_note(k)} END" for k, t in _TEST.items())}) AS notes FROM al"""

QUERIES = {"prompt_context": prompt_context}
ORACLES = {"prompt_context": PROMPT_CONTEXT}
