"""Ingestion as a line of stages with declared tables, any of which may be replaced by name.

A stage is a function from named tables to named tables that only builds plans. What it takes and gives is declared as DDL; a line that doesn't fit
together, a replacement that declares too little, and a stage that gives something else than it declares are refused before any job runs.
Stages see the declared columns of their tables and no others, so further columns, whatever their names, neither reach nor disturb them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field, replace

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions import text as X
from . import artifacts as K, layout as L, regions as G
from .chunks import NAMESPACE_URL, page_cards
from .records import uuid5

Tables = Mapping[str, DataFrame]
Stage = Callable[..., Tables]


class ContractError(ValueError):
    """A stage or a table that isn't as declared."""


def _fields(ddl: str) -> dict[str, str]:
    return {f.name: f.dataType.simpleString() for f in T.StructType.fromDDL(ddl).fields}


def _lacks(have: Mapping[str, str], ddl: str) -> list[str]:
    """What is missing or of another type than declared."""
    return [f"{name} is {have.get(name, 'missing')}, not {kind}" for name, kind in _fields(ddl).items() if have.get(name) != kind]


@dataclass(frozen=True)
class Contract:
    """The tables that a stage takes and gives, by name, as DDL."""

    name: str
    takes: Mapping[str, str]
    gives: Mapping[str, str]


def declares(takes: Mapping[str, str], gives: Mapping[str, str]) -> Callable[[Stage], Stage]:
    """Say what a replacement takes and gives, so that it is checked when it is set."""

    def mark(stage: Stage) -> Stage:
        stage.declared = (dict(takes), dict(gives))
        return stage

    return mark


@dataclass(frozen=True)
class Line:
    """Stages in order. A line isn't changed by replacing a stage; that makes another one."""

    contracts: tuple[Contract, ...]
    stages: Mapping[str, Stage] = field(default_factory=dict)

    def contract(self, name: str) -> Contract:
        for made in self.contracts:
            if made.name == name:
                return made
        raise ContractError(f"no stage named {name}; there are {', '.join(c.name for c in self.contracts)}")

    def with_stage(self, name: str, stage: Stage) -> Line:
        """The line with another stage of that name; refused if it declares tables or columns that it won't get, or less than it must give."""
        contract = self.contract(name)
        if not callable(stage):
            raise ContractError(f"stage {name} can't be called")
        takes, gives = getattr(stage, "declared", (contract.takes, contract.gives))
        wrong = [f"{t}.{x}" for t, ddl in takes.items() for x in _lacks(_fields(contract.takes[t]) if t in contract.takes else {}, ddl)]
        wrong += [f"{t}.{x}" for t, ddl in contract.gives.items() for x in _lacks(_fields(gives[t]) if t in gives else {}, ddl)]
        if wrong:
            raise ContractError(f"stage {name}: {'; '.join(wrong)}")
        return replace(self, stages={**self.stages, name: stage})

    def check(self, given: Mapping[str, Mapping[str, str]]) -> None:
        """Whether every stage is there and gets what it takes from the tables ``given`` (columns and types by table) and the stages before it."""
        known = {name: dict(columns) for name, columns in given.items()}
        for contract in self.contracts:
            if contract.name not in self.stages:
                raise ContractError(f"stage {contract.name} is missing")
            for table, ddl in contract.takes.items():
                if wrong := _lacks(known.get(table, {}), ddl):
                    raise ContractError(f"stage {contract.name} takes {table}: {'; '.join(wrong)}")
            known |= {table: _fields(ddl) for table, ddl in contract.gives.items()}

    def run(self, tables: Tables, keep: Callable[[str, DataFrame], DataFrame] | None = None) -> dict[str, DataFrame]:
        """All tables after the last stage. ``keep`` may write a stage's table and give it back as read, to cut lineage and to go on from there."""
        known = dict(tables)
        self.check({name: dict((f.name, f.dataType.simpleString()) for f in frame.schema.fields) for name, frame in known.items()})
        for contract in self.contracts:
            got = self.stages[contract.name](**{t: known[t].select(*_fields(ddl)) for t, ddl in contract.takes.items()})
            for table, ddl in contract.gives.items():
                if table not in got:
                    raise ContractError(f"stage {contract.name} gives no {table}")
                if wrong := _lacks({f.name: f.dataType.simpleString() for f in got[table].schema.fields}, ddl):
                    raise ContractError(f"stage {contract.name} gives {table}: {'; '.join(wrong)}")
                made = got[table].select(*_fields(ddl))
                known[table] = keep(table, made) if keep else made
        return known


def kept_in(folder: str, only: tuple[str, ...] | None = None) -> Callable[[str, DataFrame], DataFrame]:
    """Write tables (all, or those of ``only``) as Parquet in ``folder``, a shared one, and read them again."""

    def keep(name: str, rows: DataFrame) -> DataFrame:
        if only is not None and name not in only:
            return rows
        conf, setting = rows.sparkSession.conf, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
        before = conf.get(setting, None)
        # The shuffle files of the writing are given back when it ends.
        conf.set(setting, "true")
        try:
            rows.write.mode("overwrite").option("compression", "zstd").parquet(f"{folder}/{name}")
        finally:
            conf.set(setting, before) if before is not None else conf.unset(setting)
        return rows.sparkSession.read.schema(rows.schema).parquet(f"{folder}/{name}")

    return keep


#: Lines of a page and where they stand on it: clear of where headers and footers are looked for, as plain text has none. Kinds of a body.
PAGE_LINES, PAGE_TOP, LINE_STEP, LINE_HEIGHT, LETTER, PAGE_HEIGHT = 40, 100.0, 15.0, 12.0, 5.0, 800.0
BODY_KINDS = ("body_text", "title", "section_heading", "subsection_heading", "figure_region", "caption", "footnote")
#: Tables that several stages read, so that making them once pays.
SHARED = ("typed", "pages", "tables")
#: Kinds of chunk that reasoning makes, artifacts of a page that are reasoned about, kinds of chunk that hold tables and charts.
REASONING = {"table_reasoning": "reasoning_table", "chart_reasoning": "reasoning_chart", "figure_reasoning": "reasoning_figure", "page_reasoning": "reasoning_page"}
REASONING_SECTION = "Reasoning Enrichment"
TABLE_UNITS, CHART_UNITS = ("full_table", "table_segment", "table_summary_text"), ("figure_artifact", "chart_context", "visual_proxy_text", "chart_data_points")

_PLACE = "page string, document_id bigint, page_num bigint"
_REGION = f"{_PLACE}, region_id bigint, x0 double, y0 double, x1 double, y1 double, text string"
DOCUMENTS = {"documents": "document_id bigint, text string"}
EXTRACTED = {"regions": _REGION, "detected": "page string, table_id string, x0 double, y0 double, x1 double, y1 double, rows array<array<string>>"}
STRUCTURED = {"typed": f"{_REGION}, kind string, section string"}
CLASSIFIED = {"pages": f"{_PLACE}, page_class string, complexity double, layout_confidence double"}
TABLES = {"tables": f"{_PLACE}, table_id string, caption string, section string, units string, text string, confidence double"}
REASONED = {"reasoning": f"{_PLACE}, reasoning_id string, reasoning_type string, text string"}
CHUNKS = {"chunks": f"{_PLACE}, chunk_no bigint, chunk_type string, section_path string, source_artifact_type string, source_artifact_id string, text string, page_class string, complexity double, layout_confidence double"}
UNITS = {"units": "unit_id string, document_id bigint, page_num bigint, chunk_no bigint, unit_type string, section_path string, raw_text string, table_detected boolean, chart_detected boolean, contains_numeric_data boolean, page_class string, complexity double, layout_confidence double"}

INGESTION = (
    Contract("extract", DOCUMENTS, EXTRACTED),
    Contract("structure", {"regions": _REGION}, STRUCTURED),
    Contract("classify", STRUCTURED, CLASSIFIED),
    Contract("artifacts", STRUCTURED | CLASSIFIED | {"detected": EXTRACTED["detected"]}, TABLES),
    Contract("enrich", CLASSIFIED | TABLES, REASONED),
    Contract("chunk", STRUCTURED | CLASSIFIED | TABLES | REASONED, CHUNKS),
    Contract("units", CHUNKS, UNITS),
)


def extract_lines(documents: DataFrame) -> Tables:
    """Lines that aren't blank as regions of pages of PAGE_LINES lines; no detected tables. Null and blank texts have no region."""
    line = documents.select("document_id", F.posexplode(F.split(F.coalesce("text", F.lit("")), "\n")).alias("n", "text")).where("trim(text) <> ''")
    y0 = PAGE_TOP + F.col("n") % PAGE_LINES * LINE_STEP
    number = (F.floor(F.col("n") / PAGE_LINES) + 1).cast("bigint")
    regions = line.select(
        F.concat_ws(":", F.col("document_id").cast("string"), number.cast("string")).alias("page"), "document_id", number.alias("page_num"), F.col("n").cast("bigint").alias("region_id"),
        F.lit(0.0).alias("x0"), y0.alias("y0"), (F.length("text") * LETTER).alias("x1"), (y0 + LINE_HEIGHT).alias("y1"), "text",
    )
    detected = documents.sparkSession.createDataFrame([], EXTRACTED["detected"])
    return {"regions": regions, "detected": detected}


def structure_pages(regions: DataFrame) -> Tables:
    """Kinds of regions, and the heading that each stands under (``Document`` before the first)."""
    kind = G.region_kind(F.col("text"), F.col("y0"), F.col("y1"), F.lit(PAGE_HEIGHT), F.lit(None).cast("string"))
    before = Window.partitionBy("document_id").orderBy("page_num", "region_id").rowsBetween(Window.unboundedPreceding, 0)
    section = F.last(F.when(F.col("kind").isin(*K.HEADINGS), F.trim("text")), ignorenulls=True).over(before)
    return {"typed": regions.withColumn("kind", kind).withColumn("section", F.coalesce(section, F.lit("Document")))}


def classify_pages(typed: DataFrame) -> Tables:
    """The class and complexity of each page, and how sure its regions' kinds are on the mean."""
    of = lambda name: F.count_if(F.col("kind") == name)
    held = typed.groupBy("page", "document_id", "page_num").agg(F.count("*").alias("n"), of("table_region").alias("t"), of("figure_region").alias("f"), F.round(F.avg(G.region_confidence(F.col("kind"), F.lit(False))), 4).alias("layout_confidence"))
    whole = L.page_complexity(F.lit(False), F.col("t"), F.col("f"), F.lit(0), F.col("n"))
    return {"pages": held.withColumn("complexity", F.round(whole, 6)).withColumn("page_class", L.page_class(F.col("complexity"), F.col("t"), F.col("f"), F.lit(0), F.col("n")))}


def table_records(typed: DataFrame, pages: DataFrame, detected: DataFrame) -> Tables:
    regions = typed.withColumn("reading_order", F.col("region_id"))
    made = K.table_artifacts(K.table_candidates(detected, regions), regions)
    return {"tables": made.join(pages.select("page", "document_id", "page_num"), "page")}


def no_reasoning(pages: DataFrame, tables: DataFrame) -> Tables:
    return {"reasoning": pages.sparkSession.createDataFrame([], REASONED["reasoning"])}


def make_chunks(pages: DataFrame, typed: DataFrame, tables: DataFrame, reasoning: DataFrame) -> Tables:
    """Body text by page and section (with what looked like a table where none was made of it), tables with their captions, cards of pages that aren't plain text, reasoning; numbered within a document by
    page, in this order, then by first region or id. Each has the class, complexity and confidence of its page (``unknown`` and 0 without one)."""
    c, place = F.col, ("page", "document_id", "page_num")
    tabled = typed.join(tables.select("page", F.lit(True).alias("tabled")).distinct(), "page", "left")
    parts = tabled.where(c("kind").isin(*BODY_KINDS) | ((c("kind") == "table_region") & c("tabled").isNull()))
    texts = F.transform(F.array_sort(F.collect_list(F.struct("region_id", "text"))), lambda r: r["text"])
    body = parts.groupBy(*place, "section").agg(F.array_join(texts, "\n").alias("body"), F.min("region_id").alias("at"))
    one = lambda rows, n, kind, section, source, source_id, text, at: rows.select(*place, F.lit(n).alias("k"), at.cast("string").alias("at"), kind.alias("chunk_type"), section.alias("section_path"), F.lit(source).alias("source_artifact_type"), source_id.cast("string").alias("source_artifact_id"), text.alias("text"))
    cards = page_cards(pages.withColumn("confidence", c("layout_confidence")), tables.select("page", c("table_id").alias("artifact_id"), F.lit("table").alias("kind"), "caption")).join(pages.select(*place), "page")
    kinds = F.create_map(*(F.lit(x) for pair in REASONING.items() for x in pair))
    every = (
        one(body, 0, F.lit("body_text"), c("section"), "text", c("page"), c("body"), F.lpad(c("at").cast("string"), 12, "0"))
        .unionByName(one(tables, 1, F.lit("full_table"), c("section"), "table", c("table_id"), F.trim(F.concat_ws("\n", F.nullif("caption", F.lit("")), "text")), c("table_id")))
        .unionByName(one(cards, 2, F.lit("page_card"), F.lit("Page"), "page", c("page"), c("text"), c("page")))
        .unionByName(one(reasoning, 3, F.coalesce(F.try_element_at(kinds, c("reasoning_type")), F.lit("reasoning_page")), F.lit(REASONING_SECTION), "reasoning", c("reasoning_id"), c("text"), c("reasoning_id")))
    )
    every = every.where(F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"\s+", " ")) != "")
    # Rows of pages go with their chunks by document, so that texts are shuffled once for both the number and what is known of the page.
    told = F.struct("page_class", "complexity", "layout_confidence")
    known = every.withColumn("told", F.lit(None).cast("struct<page_class:string,complexity:double,layout_confidence:double>")).unionByName(pages.select(*place, F.lit(-1).alias("k"), told.alias("told")), allowMissingColumns=True)
    so_far = Window.partitionBy("document_id").orderBy("page_num", "k", "at", "chunk_type", "text").rowsBetween(Window.unboundedPreceding, 0)
    numbered = known.withColumn("chunk_no", F.sum(F.when(c("k") >= 0, 1).otherwise(0)).over(so_far).cast("bigint"))
    placed = numbered.withColumn("told", F.max("told").over(Window.partitionBy("document_id", "page_num"))).where(c("k") >= 0)
    return {"chunks": placed.withColumns({"page_class": F.coalesce("told.page_class", F.lit("unknown")), "complexity": F.coalesce("told.complexity", F.lit(0.0)), "layout_confidence": F.coalesce("told.layout_confidence", F.lit(0.0))})}


def make_units(chunks: DataFrame) -> Tables:
    """A unit of the registry for each chunk; its id follows from document and number, so ingesting again replaces."""
    text = F.regexp_replace("text", r"^\s+|\s+$", "")
    name = F.concat_ws(":", F.col("document_id").cast("string"), F.col("chunk_no").cast("string"))
    return {"units": chunks.select(
        uuid5(NAMESPACE_URL, name).alias("unit_id"), "document_id", "page_num", "chunk_no", F.col("chunk_type").alias("unit_type"), "section_path", text.alias("raw_text"), F.col("chunk_type").isin(*TABLE_UNITS).alias("table_detected"),
        F.col("chunk_type").isin(*CHART_UNITS).alias("chart_detected"), X.has_numeric_data(text).alias("contains_numeric_data"), "page_class", "complexity", "layout_confidence",
    )}


def ingestion() -> Line:
    """The stages from texts to units, each of which may be replaced by name."""
    return Line(INGESTION, {"extract": extract_lines, "structure": structure_pages, "classify": classify_pages, "artifacts": table_records, "enrich": no_reasoning, "chunk": make_chunks, "units": make_units})
