"""Literal cases of prompt lines, notes and vantage points."""

from docquarry.operators import prompts as P
from docquarry.plans import prompts as Q

CITED = """qid long, rank long, document_id string, document_name string, source_file string, citation_label string, version_label string, version_group string, chunk_type string, page_num long,
slide_num long, document_date string, as_of_date string, metric_basis string, effective_from string, effective_to string, section_title string, enriched_metadata map<string,string>, text string"""


def made(spark, question, labels, citations, conflicts=(), qid=1):
    names = ["qid", "rank", "document_id", "document_name", "source_file", "citation_label", "version_label", "version_group", "chunk_type", "page_num", "slide_num", "document_date", "as_of_date", "metric_basis", "effective_from", "effective_to", "section_title", "enriched_metadata", "text"]
    rows = [tuple({"qid": qid, "rank": k, **c}.get(n) for n in names) for k, c in enumerate(citations, 1)]
    asked = spark.createDataFrame([(qid, question, labels)], "qid long, question string, labels array<string>")
    told = spark.createDataFrame([(qid, k, s) for k, s in enumerate(conflicts)], "qid long, place long, summary string")
    (row,) = P.prompt_context(asked, spark.createDataFrame(rows, CITED), told).collect()
    return row


def test_line_names_dates_scope_and_facts(spark):
    row = made(spark, "q", [], [{"document_name": "a.pdf", "chunk_type": "full_table", "page_num": 3, "slide_num": 2, "document_date": "2018-11-01", "metric_basis": "annual impact study", "section_title": "Economic Impact", "enriched_metadata": {"key_chart_facts": "yield  was 5.47%", "as_of_date": "2017-12-31", "metric_basis": "other", "unlisted": "x"}, "text": "  body \n"}])
    assert row.evidence_lines == [
        "[1] a.pdf | version=unknown | chunk_type=full_table | page=3\nSource context: document_date=2018-11-01 | metric_basis=annual impact study | section=Economic Impact | as_of_date=2017-12-31\n"
        "Extracted facts:\nkey_chart_facts: yield was 5.47%\nas_of_date: 2017-12-31\nmetric_basis: other\nExcerpt: body"
    ]
    assert row.note_names == ["dates"]


def test_bare_citation_and_cut_excerpts(spark):
    row = made(spark, None, None, [{"text": "x" * 1399 + "  " + "y" * 9}, {"chunk_type": "reasoning_page", "slide_num": 4, "text": "z" * 2401}, {"citation_label": "L", "text": None}])
    lines = row.evidence_lines
    assert lines[0] == "[1] Source 1 | version=unknown | chunk_type=text\nExcerpt: " + "x" * 1399 + "\n[...truncated]"
    assert lines[1].startswith("[2] Source 2 | version=unknown | chunk_type=reasoning_page | slide=4\n") and lines[1].endswith("z" * 2400 + "\n[...truncated]")
    assert lines[2] == "[3] L | version=unknown | chunk_type=text\nExcerpt: " and row.note_names == [] and row.notes == []


def test_conflicts_are_four_blank_ones_left_out(spark):
    row = made(spark, "q", [], [], ["a  b", " ", None, "c", "d"])
    assert row.conflict_lines == ["- a b", "- c"] and row.evidence_lines == []
    assert made(spark, "q", [], [], [" "]).conflict_lines == [P.NO_CONFLICTS]


def test_values_of_one_metric_and_scope(spark):
    cited = [
        {"document_name": "Digital Realty March.pdf", "text": "5,500+ Customers as of December 31, 2025."},
        {"document_name": "Digital Realty March.pdf", "text": "5,000+ Global Customers in appendix table. 5000+ global customers again"},
        {"document_name": "PSA Merger.pdf", "text": "Merger expected to be FFO neutral in 2026 and accretive in 2027."},
    ]
    row = made(spark, "How many customers does Digital Realty have?", ["caveat_inconsistency"], cited)
    assert row.note_names == ["values"] and "(5500+ customers: [1]; 5000+ global customers: [2], [2])" in row.notes[0]
    assert made(spark, "What is PSA's outlook for 2026?", ["outlook_scope"], cited).note_names == ["scope"]
    assert made(spark, "Which company?", ["corpus_wide_scope"], cited).notes[0].endswith("Documents: Digital Realty March.pdf, PSA Merger.pdf.")
    assert made(spark, "Which company?", ["corpus_wide_scope"], []).notes[0].endswith("Documents: see citations.")


def test_vantage_needs_two_signatures_of_one_subject(spark):
    first = {"document_name": "BXP Investor Day 2025.pdf", "document_id": "a", "version_group": "bxp", "version_label": "Investor Day 2025"}
    other = {"document_name": "x.pdf", "document_id": "b", "version_group": " BXP ", "version_label": "Q4 2025"}
    names = lambda cited: made(spark, "q", [], cited).note_names
    assert names([first, other]) == ["vantage"] and names([first]) == [] and names([first, first]) == []
    assert names([{**first, "version_label": None}, {**other, "version_label": "unknown"}]) == ["vantage"]  # two documents
    assert names([{"document_name": "Company Alpha Rents v1.pdf", "version_label": "v1"}, {"document_name": "dir/alpha_rents-appendix.v2.pdf", "version_label": "v2", "version_group": "unknown"}]) == ["vantage"]
    assert names([{"document_name": "Annual Update.pdf", "version_label": "v1"}, {"document_name": "Annual Update.pdf", "version_label": "v2"}]) == []


def test_every_note_of_the_query_is_called_for_by_some_rows(spark):
    got = Q.prompt_context(spark, "/root/testdata/sf0.01").select("note_names").collect()
    assert {n for r in got for n in r.note_names.split(",")} - {""} == set(P.NOTES) - {"entities"}
    assert any("vantage" not in r.note_names for r in got) and any("values" not in r.note_names for r in got)
