"""Charts read by a model under a limit of time and number, and by their words where the model isn't asked or fails."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .bounded import TIMEOUT, Work, bounded_map
from .chunks import BARE_CHART_WEIGHT, CHART_WEIGHT, page_weight
from .regions import figure_fields

#: What a reader gives; all of it may be missing.
READ = "chart_type string, trend string, facts array<string>, confidence double"
#: Pages of a document whose charts are read, charts of a page, how sure a reader is that doesn't say.
MOST_PAGES, MOST_CHARTS, SURE = 3, 3, 0.75


def analysed_charts(figures: DataFrame, pages: DataFrame, read: Work, seconds: float, most_pages: int = MOST_PAGES, most_charts: int = MOST_CHARTS) -> DataFrame:
    """Charts among figures (document_id, page, page_num, figure_no, candidate, caption, nearby), each with the state of its reading, the kind
    of chart, trend, facts and confidence.

    Read are the first charts of the pages of each document that have most to gain (pages: page, page_class, degraded, complexity); ``read`` takes
    caption and texts nearby and gives a JSON object. state is ``success``, ``failed``, ``timeout_fallback``, or ``skipped`` for charts not
    read; these and readings without facts take the numbers of their texts. parsed is ``success`` if a reading says something, else ``partial``.
    Charts of pages that aren't in ``pages`` are skipped.
    """
    c = F.col
    fields = figure_fields(c("caption"), c("nearby"), c("candidate"))
    charts = figures.where(fields["is_chart"]).select("document_id", "page", "page_num", "figure_no", "caption", "nearby", "candidate", fields["figure_type"].alias("figure_type"))
    # No chart has numbers before it is read, so all of a page count as bare. Charts carry their page's count and place, so they are made once.
    by_page = Window.partitionBy("document_id", "page")
    priority = c("n") * (CHART_WEIGHT + BARE_CHART_WEIGHT) + page_weight(c("page_class"), c("degraded"), c("complexity"))
    known = pages.select("page", "page_class", "degraded", "complexity", F.lit(True).alias("known"))
    rows = charts.withColumns({"n": F.count("*").over(by_page), "nth": F.row_number().over(by_page.orderBy("figure_no"))}).join(known, "page", "left").withColumn("priority", F.round(priority, 6))
    # Every chart of a page has its page's priority, so pages are numbered by dense rank; those without one come last.
    place = F.dense_rank().over(Window.partitionBy("document_id").orderBy(c("priority").desc_nulls_last(), F.desc("page")))
    asked = c("known").isNotNull() & c("priority").isNotNull() & (place <= most_pages) & (c("nth") <= most_charts)
    rows = rows.withColumn("asked", asked).drop("n", "priority", "known", "page_class", "degraded", "complexity")
    shown = F.concat_ws("\n", *(F.nullif(name, F.lit("")) for name in ("caption", "nearby")))
    rows = rows.withColumn("_shown", F.when(c("asked"), shown))
    said = bounded_map(rows, "_shown", read, seconds, result="_result", error="_error").withColumn("_said", F.from_json("_result", READ))
    useful = F.exists(F.array("_said.chart_type", "_said.trend", F.array_join("_said.facts", ""), c("_said.confidence").cast("string")), lambda x: x.isNotNull())
    state = F.when(c("_shown").isNull(), "skipped").when(c("_error") == TIMEOUT, "timeout_fallback").when(c("_error").isNotNull() | ~F.coalesce(useful, F.lit(False)), "failed").otherwise("success")
    words = figure_fields(c("caption"), c("nearby"), c("candidate"))
    number = lambda v: F.format_string("%.2f", v)
    own = F.when(words["first_value"].isNotNull(), F.array(F.concat(F.lit("Approximate range: "), number(words["first_value"]), F.lit(" to "), number(words["last_value"]))))
    facts = F.filter(F.coalesce("_said.facts", F.array().cast("array<string>")), lambda x: F.trim(x) != "")
    done = said.withColumn("state", state).withColumn("facts", F.when((c("state") == "success") & (F.size(facts) > 0), facts))
    taken = (c("state") == "success") & c("facts").isNotNull()
    trend = F.when(taken, c("_said.trend")).otherwise(F.coalesce(F.when(c("state") == "success", c("_said.trend")), words["trend"]))
    kind = F.coalesce(F.when(c("state") == "success", F.nullif(c("_said.chart_type"), F.lit("unknown"))), words["chart_type"])
    sure = F.when(c("state") == "success", F.coalesce("_said.confidence", F.lit(SURE))).otherwise(words["confidence"])
    speaks = (c("state") == "success") & (c("facts").isNotNull() | c("_said.trend").isNotNull())
    return done.select(
        "document_id", "page", "page_num", "figure_no", "figure_type", "state", F.when(speaks, "success").otherwise("partial").alias("parsed"), kind.alias("chart_type"), trend.alias("trend"),
        F.when(taken, c("facts")).otherwise(F.coalesce(own, F.array().cast("array<string>"))).alias("facts"), sure.alias("confidence"), "_error",
    ).withColumnRenamed("_error", "error")
