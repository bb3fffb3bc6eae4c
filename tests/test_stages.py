"""Contracts of stages: what is refused before a job runs, and what replacing one changes."""

import pytest
from pyspark.sql import functions as F

from docquarry.operators import stages as I
from docquarry.plans import staged as Q

TEXT = "Annual Rents And Tenants\nplain words about leases and more\nyear | cost | total\n1 | 2 | 3\n \nthe chart of trend lines"


def documents(spark, rows):
    return {"documents": spark.createDataFrame(rows, "document_id long, text string")}


def test_line_makes_units_of_texts(spark):
    units = I.ingestion().run(documents(spark, [(1, TEXT), (2, None), (3, " \n\t\n"), (4, "word")]))["units"].orderBy("document_id", "chunk_no").collect()
    assert [(u.document_id, u.chunk_no, u.unit_type) for u in units] == [(1, 1, "body_text"), (1, 2, "full_table"), (1, 3, "page_card"), (4, 1, "body_text")]
    assert units[1].raw_text == "row_1: year=1; cost=2; total=3" and units[1].table_detected and not units[0].table_detected and units[1].contains_numeric_data
    assert len({u.unit_id for u in units}) == 4 and units[3].raw_text == "word" and units[3].page_class == "simple_text_page"


def test_empty_table_gives_no_units(spark):
    assert I.ingestion().run(documents(spark, []))["units"].collect() == []


def test_further_columns_do_not_clash(spark):
    plain = documents(spark, [(1, TEXT)])
    wide = {"documents": plain["documents"].withColumns({n: F.lit("x") for n in ("page", "kind", "rows", "n", "chunk_no", "section")})}
    rows = lambda t: I.ingestion().run(t)["units"].orderBy("chunk_no").collect()
    assert rows(plain) == rows(wide)


def test_replacing_makes_another_line_and_says_what_it_is_about(spark):
    own = I.ingestion()
    other = own.with_stage("enrich", Q.counted_tables)
    kinds = lambda line: {u.unit_type for u in line.run(documents(spark, [(1, TEXT)]))["units"].collect()}
    assert "reasoning_table" in kinds(other) and "reasoning_table" not in kinds(own)


def test_reasoning_of_an_unknown_kind_or_page(spark):
    def reasons(pages, tables):
        made = pages.sparkSession.createDataFrame([("9:1", 9, 1, "r", "figure_reasoning", "why"), ("9:1", 9, 1, "s", None, "so"), ("9:1", 9, 1, "t", "x", " ")], I.REASONED["reasoning"])
        return {"reasoning": made}

    units = I.ingestion().with_stage("enrich", reasons).run(documents(spark, [(1, "word")]))["units"].where("document_id = 9").orderBy("chunk_no").collect()
    assert [(u.unit_type, u.raw_text, u.page_class, u.layout_confidence) for u in units] == [("reasoning_figure", "why", "unknown", 0.0), ("reasoning_page", "so", "unknown", 0.0)]


def test_wrong_replacements_are_refused_when_set():
    line = I.ingestion()
    takes = line.contract("artifacts").takes
    with pytest.raises(I.ContractError, match="no stage named chunks; there are extract"):
        line.with_stage("chunks", I.make_chunks)
    with pytest.raises(I.ContractError, match="can't be called"):
        line.with_stage("chunk", None)
    with pytest.raises(I.ContractError, match="tables.confidence is string, not double"):
        line.with_stage("artifacts", I.declares(takes, {"tables": I.TABLES["tables"].replace("confidence double", "confidence string")})(lambda typed, detected: {}))
    with pytest.raises(I.ContractError, match="typed.colour is missing, not string"):
        line.with_stage("artifacts", I.declares({"typed": "colour string"}, I.TABLES)(lambda typed: {}))
    with pytest.raises(I.ContractError, match="scans.page is missing"):
        line.with_stage("artifacts", I.declares({"scans": "page string"}, I.TABLES)(lambda scans: {}))


def test_lines_that_do_not_fit_are_refused_before_any_stage(spark):
    called = []
    line = I.ingestion().with_stage("extract", lambda documents: called.append(1))
    with pytest.raises(I.ContractError, match="stage extract takes documents: text is missing, not string"):
        line.run({"documents": spark.createDataFrame([(1,)], "document_id long")})
    with pytest.raises(I.ContractError, match="stage structure takes regions"):
        I.Line(I.INGESTION[1:], line.stages).run(documents(spark, [(1, "a")]))
    with pytest.raises(I.ContractError, match="stage units is missing"):
        I.Line(I.INGESTION, {k: v for k, v in I.ingestion().stages.items() if k != "units"}).run(documents(spark, [(1, "a")]))
    assert called == []


def test_stages_that_give_something_else_are_refused_without_a_job(spark):
    tables = documents(spark, [(1, "a")])
    with pytest.raises(I.ContractError, match="stage enrich gives no reasoning"):
        I.ingestion().with_stage("enrich", lambda pages, tables: {}).run(tables)
    with pytest.raises(I.ContractError, match="stage enrich gives reasoning: .*text is bigint, not string"):
        I.ingestion().with_stage("enrich", lambda pages, tables: {"reasoning": pages.withColumns({"reasoning_id": F.lit("a"), "reasoning_type": F.lit("b"), "text": F.lit(1).cast("bigint")})}).run(tables)


def test_kept_tables_are_read_again(spark, tmp_path):
    tables, order = documents(spark, [(k, TEXT) for k in range(5)]), ["document_id", "chunk_no"]
    kept = I.ingestion().run(tables, I.kept_in(str(tmp_path)))
    assert kept["units"].orderBy(*order).collect() == I.ingestion().run(tables)["units"].orderBy(*order).collect()
    assert {p.name for p in tmp_path.iterdir()} == {"regions", "detected", "typed", "pages", "tables", "reasoning", "chunks", "units"}
    assert "Window" not in kept["units"]._jdf.queryExecution().optimizedPlan().toString()
