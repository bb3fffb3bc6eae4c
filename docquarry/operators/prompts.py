"""What a prompt says of a question's evidence: a line for each citation and conflict, and notes on how the evidence is to be read.

A question's citations are its evidence, which is bounded (``retrieval.evidence_cap``), so they are put together by one shuffle and gone
through as arrays. Null and empty fields count as missing; a question without citations gets no lines and the notes that its labels
alone call for; of citations of equal rank the order is by their line. White space is that of ASCII.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as T
from .evidence import MERGER
from .metadata import ENRICHED, RICH_CHUNKS
from .retrieval import METRIC, NO_METRIC

#: Characters of an excerpt, and of one whose kind holds much; what marks a cut one.
EXCERPT, EXCERPT_RICH, CUT = 1400, 2400, "\n[...truncated]"
#: Fields that a line names, by what they are called there, and those that enrichment fills where they are missing.
CONTEXT = (
    ("document_date", "document_date"), ("as_of_date", "as_of_date"), ("metric_basis", "metric_basis"), ("version_group", "version_group"),
    ("effective_from", "effective_from"), ("effective_to", "effective_to"), ("section", "section_title"),
)
FILLED = ("document_date", "as_of_date", "metric_basis", "units")
#: Conflicts that are told, and what is said where there is none.
MOST_CONFLICTS, NO_CONFLICTS = 4, "- No high-confidence conflicts were detected in selected evidence."
#: Words of file names that tell no topic, words of a topic, and words for no value in a signature.
NO_TOPIC = (
    "investor", "presentation", "presentations", "appendix", "company", "update", "quarterly", "annual", "roadshow", "supplemental",
    "with", "and", "the", "pdf",
)
TOPIC_WORDS, NO_SIGN = 2, ("", "unknown", "none")
#: Values and citations of each that the note on values lists; words that aren't metrics.
LISTED_VALUES, LISTED_REFS = 5, 3
NOT_SUBJECTS = tuple(w for w in NO_METRIC if w not in ("digital", "realty"))
#: Notes in order, by what calls for them; ``{values}`` and ``{documents}`` stand for what the evidence holds.
NOTES = {
    "change": "- Order the answer by time: first what the older sources say, next what the newer ones say, then what stayed and what moved.",
    "vantage": "- The evidence looks at one subject from several dates or versions: answer from the newest that applies, and name older figures only where they explain a change.",
    "dates": "- Give the date or period that each dated figure belongs to; do not call a figure of an earlier year current.",
    "scope": "- Keep stand-alone guidance apart from what holds for a merger, pro forma or combined company.",
    "values": "- The evidence states several values of one metric ({values}): account for each, with its document, date and page.",
    "entities": "- Compare every named entity by the evidence found for it, and say where that is partial.",
    "corpus": "- The question covers the whole corpus: go through every entity in the evidence, say what is shown for each, then conclude. Documents: {documents}.",
    "versions": "- There may be several versions of a document: give each version's value with its date.",
}


def _given(name: str | Column) -> Column:
    value = F.col(name) if isinstance(name, str) else name
    return F.nullif(value.cast("string"), F.lit(""))


def _extra(name: str) -> Column:
    return _given(F.try_element_at("enriched_metadata", F.lit(name)))


def _squeezed(text: Column) -> Column:
    return F.trim(F.regexp_replace(text, r"\s+", " "))


def enriched_facts() -> Column:
    """A line for each fact of ``enriched_metadata`` (a map), in fixed order."""
    return F.concat_ws("\n", *(F.concat(F.lit(f"{name}: "), _squeezed(_extra(name))) for name in ENRICHED))


def excerpt(text: Column, chunk_type: Column) -> Column:
    body = F.regexp_replace(F.coalesce(text, F.lit("")), r"^\s+|\s+$", "")
    most = F.when(chunk_type.isin(*RICH_CHUNKS), EXCERPT_RICH).otherwise(EXCERPT)
    return F.when(F.length(body) <= most, body).otherwise(F.concat(F.regexp_replace(F.substring(body, F.lit(1), most), r"\s+$", ""), F.lit(CUT)))


def evidence_line() -> Column:
    """The line of a citation: its place and label, version, kind and page, dates and scope, extracted facts, excerpt."""
    at = F.col("rank").cast("string")
    label = F.coalesce(_given("citation_label"), _given("document_name"), F.concat(F.lit("Source "), at))
    page, slide = (F.when(F.col(c) != 0, F.concat(F.lit(f" | {head}="), F.col(c).cast("string"))) for c, head in (("page_num", "page"), ("slide_num", "slide")))
    own = [F.concat(F.lit(f"{name}="), _given(column)) for name, column in CONTEXT]
    held = {column for _, column in CONTEXT}
    filled = [F.concat(F.lit(f"{name}="), F.when(_given(name).isNull(), _extra(name)) if name in held else _extra(name)) for name in FILLED]
    context, facts = F.concat_ws(" | ", *own, *filled), enriched_facts()
    return F.concat(
        F.lit("["), at, F.lit("] "), label, F.lit(" | version="), F.coalesce(_given("version_label"), F.lit("unknown")), F.lit(" | chunk_type="), F.coalesce(_given("chunk_type"), F.lit("text")), F.coalesce(page, slide, F.lit("")), F.lit("\n"),
        F.when(context != "", F.concat(F.lit("Source context: "), context, F.lit("\n"))).otherwise(""), F.when(facts != "", F.concat(F.lit("Extracted facts:\n"), facts, F.lit("\n"))).otherwise(""),
        F.lit("Excerpt: "), excerpt(F.col("text"), F.coalesce("chunk_type", F.lit(""))),
    )


def vantage_key(version_group: Column, document_name: Column) -> Column:
    """What a citation is about: its version group, else the first words of its file's name that tell a topic; null where there are none."""
    group = F.lower(F.trim(F.coalesce(version_group.cast("string"), F.lit(""))))
    stem = F.regexp_replace(F.regexp_replace(F.lower(F.trim(F.coalesce(document_name, F.lit("")))), "^.*/", ""), r"^(.+)\.[^.]*$", "$1")
    words = F.filter(F.regexp_extract_all(stem, F.lit("[a-z]+"), F.lit(0)), lambda w: ~w.isin(*NO_TOPIC))
    topic = F.when(F.size(words) > 0, F.concat(F.lit("document_topic:"), F.array_join(F.slice(words, 1, TOPIC_WORDS), " ")))
    return F.when(~group.isin("", "unknown"), F.concat(F.lit("version_group:"), group)).otherwise(topic)


def vantage_signature() -> Column:
    """Dates and version of a citation as one text; without any its document, null if its group or document isn't known."""
    values = [F.col(c).cast("string") for c in ("document_date", "as_of_date", "effective_from", "effective_to", "version_label")] + [_extra("document_date"), _extra("as_of_date")]
    said = F.filter(F.transform(F.array_compact(F.array(*values)), lambda v: F.lower(F.trim(v))), lambda v: ~v.isin(*NO_SIGN))
    known = _given(F.trim(F.col("version_group").cast("string"))).isNotNull()
    document = F.when(known, F.concat(F.lit("document_id:"), F.lower(_given(F.trim(F.col("document_id").cast("string"))))))
    return F.when(F.size(said) > 0, F.array_join(said, "\x1f")).otherwise(document)


def _search_text() -> Column:
    fields = (F.coalesce(F.col(c), F.lit("")) for c in ("document_name", "citation_label", "section_title", "metric_basis", "text"))
    return F.lower(F.concat_ws(" ", *fields, enriched_facts()))


def metric_values(subjects: Column, text: Column) -> Column:
    """Figures of a lower-case text that state a metric of ``subjects``, in order, repeats kept; commas and odd spacing are taken out."""
    found = F.arrays_zip(F.regexp_extract_all(text, F.lit(METRIC), F.lit(0)).alias("whole"), F.regexp_extract_all(text, F.lit(METRIC), F.lit(1)).alias("subject"))
    of_question = F.filter(found, lambda m: F.array_contains(subjects, T.singular(m["subject"])))
    return F.transform(of_question, lambda m: _squeezed(F.replace(m["whole"], F.lit(","), F.lit(""))))


def asked_metrics(question: Column) -> Column:
    words = F.regexp_extract_all(F.lower(question), F.lit("[a-z][a-z-]+"), F.lit(0))
    return F.array_distinct(F.transform(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*NOT_SUBJECTS)), T.singular))


def conflict_lines(conflicts: DataFrame, most: int = MOST_CONFLICTS) -> DataFrame:
    """(qid, conflict_lines): the summaries of each question's first conflicts (qid, place, summary), blank ones left out."""
    place = F.row_number().over(Window.partitionBy("qid").orderBy("place", "summary"))
    first = conflicts.select("qid", "place", "summary").withColumn("place", place).where(F.col("place") <= most)
    said = _squeezed(F.coalesce("summary", F.lit("")))
    kept = F.collect_list(F.when(said != "", F.struct("place", F.concat(F.lit("- "), said).alias("line"))))
    return first.groupBy("qid").agg(F.transform(F.array_sort(kept), lambda x: x["line"]).alias("conflict_lines"))


def prompt_context(questions: DataFrame, citations: DataFrame, conflicts: DataFrame) -> DataFrame:
    """(qid, evidence_lines, conflict_lines, note_names, notes) of each question (qid, question, labels).

    ``citations`` has qid, rank, document_id, document_name, source_file, citation_label, version_label, version_group, chunk_type, page_num, slide_num,
    document_date, as_of_date, metric_basis, effective_from, effective_to, section_title, enriched_metadata (a map), text; ``conflicts`` as in
    ``conflict_lines``. Figures are looked for in whole texts, not in excerpts.
    """
    c = F.col
    asked = questions.select("qid", F.coalesce("question", F.lit("")).alias("question"), F.coalesce("labels", F.array().cast("array<string>")).alias("labels")).withColumn("subjects", asked_metrics(c("question")))
    metrics = asked.where(F.array_contains("labels", "caveat_inconsistency") & (F.size("subjects") > 0)).select("qid", "subjects")
    searched = _search_text()
    name = F.coalesce(_given("document_name"), _given("source_file"))
    values = F.when(c("subjects").isNotNull(), metric_values(c("subjects"), searched)).otherwise(F.array().cast("array<string>"))
    dated = F.coalesce(*(_given(x) for x in ("document_date", "as_of_date")), _extra("document_date"), _extra("as_of_date")).isNotNull()
    cited = citations.join(metrics, "qid", "left").select(
        "qid", F.struct(c("rank"), evidence_line().alias("line"), vantage_key(c("version_group"), c("document_name")).alias("key"), vantage_signature().alias("sign"), dated.alias("dated"), T.contains_any(searched, MERGER).alias("scoped"), name.alias("name"), values.alias("values")).alias("c")
    )
    rows = asked.join(cited.groupBy("qid").agg(F.array_sort(F.collect_list("c")).alias("cs")), "qid", "left").join(conflict_lines(conflicts), "qid", "left")
    none = F.array().cast("array<string>")
    cs = c("cs")
    keys = F.array_distinct(F.filter(F.transform(cs, lambda x: x["key"]), lambda k: k.isNotNull()))
    signs = lambda k: F.array_distinct(F.filter(F.transform(F.filter(cs, lambda x: x["key"] == k), lambda x: x["sign"]), lambda s: s.isNotNull()))
    stated = F.flatten(F.transform(cs, lambda x: F.transform(x["values"], lambda v: F.struct(v.alias("value"), F.concat(F.lit("["), x["rank"].cast("string"), F.lit("]")).alias("ref")))))
    once = F.array_distinct(F.transform(c("stated"), lambda s: s["value"]))
    refs = lambda v: F.array_join(F.slice(F.transform(F.filter(c("stated"), lambda s: s["value"] == v), lambda s: s["ref"]), 1, LISTED_REFS), ", ")
    documents = F.array_join(F.array_distinct(F.filter(F.transform(cs, lambda x: x["name"]), lambda n: n.isNotNull())), ", ")
    has = lambda label: F.array_contains("labels", label)
    any_of = lambda field: F.coalesce(F.exists(cs, lambda x: x[field]), F.lit(False))
    rows = rows.withColumn("stated", F.coalesce(stated, F.expr("cast(array() as array<struct<value:string,ref:string>>)"))).withColumn("once", once)
    calls = {
        "change": has("temporal_delta"), "vantage": F.coalesce(F.exists(keys, lambda k: F.size(signs(k)) >= 2), F.lit(False)), "dates": has("stale_source") | any_of("dated"), "scope": has("outlook_scope") & any_of("scoped"),
        "values": has("caveat_inconsistency") & (F.size("once") >= 2), "entities": has("named_entity_comparison"), "corpus": has("corpus_wide_scope"), "versions": has("multi_version_lookup"),
    }
    listed = F.array_join(F.transform(F.slice("once", 1, LISTED_VALUES), lambda v: F.concat(v, F.lit(": "), refs(v))), "; ")
    shown = {"{values}": listed, "{documents}": F.coalesce(F.nullif(documents, F.lit("")), F.lit("see citations"))}

    def worded(note: str) -> Column:
        for mark, value in shown.items():
            before, found, after = note.partition(mark)
            if found:
                return F.concat(F.lit(before), value, F.lit(after))
        return F.lit(note)

    made = F.array_compact(F.array(*(F.when(test, F.struct(F.lit(k).alias("name"), worded(NOTES[k]).alias("note"))) for k, test in calls.items())))
    told = F.coalesce("conflict_lines", none)
    return rows.withColumn("made", made).select(
        "qid", F.coalesce(F.transform(cs, lambda x: x["line"]), none).alias("evidence_lines"), F.when(F.size(told) > 0, told).otherwise(F.array(F.lit(NO_CONFLICTS))).alias("conflict_lines"),
        F.transform("made", lambda x: x["name"]).alias("note_names"), F.transform("made", lambda x: x["note"]).alias("notes"),
    )
