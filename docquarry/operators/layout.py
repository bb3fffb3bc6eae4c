"""Pages, tables and sections: what chunk building needs to know of a page, and chunks of its text."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def parse_rows(text: Column) -> Column:
    """Table-like lines as rows of cells: split at bars, else tabs, else two or more spaces; rows need two cells."""
    squeeze = lambda c: F.trim(F.regexp_replace(c, r"\s+", " "))
    lines = F.filter(F.transform(F.split(F.coalesce(text, F.lit("")), "\n"), lambda x: F.trim(x)), lambda x: x != "")
    cells = lambda x: F.when(x.contains("|"), F.split(x, r"\|")).when(x.contains("\t"), F.split(x, "\t")).otherwise(F.split(x, r"\s{2,}"))
    rows = F.transform(lines, lambda x: F.filter(F.transform(cells(x), squeeze), lambda c: c != ""))
    return F.filter(rows, lambda r: F.size(r) >= 2)


def markdown(rows: Column) -> Column:
    """Rows as a table in Markdown, cut or filled to the width of the first."""
    width = F.size(rows[0])
    line = lambda cells: F.concat(F.lit("|"), F.array_join(cells, "|"), F.lit("|"))
    fill = lambda r: F.slice(F.concat(r, F.array_repeat(F.lit(""), F.greatest(width - F.size(r), F.lit(0)))), F.lit(1), width)
    rest = F.transform(F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0))), lambda r: line(fill(r)))
    rule = line(F.array_repeat(F.lit("---"), width))
    return F.when(F.size(rows) > 0, F.array_join(F.concat(F.array(line(rows[0]), rule), rest), "\n")).otherwise(F.lit(""))


def labelled_rows(rows: Column) -> Column:
    """Rows as ``row_1: header=value; ...`` lines; a value beyond the header is under its column's number."""
    header = rows[0]
    key = lambda k: F.coalesce(F.get(header, k), F.concat(F.lit("column_"), (k + 1).cast("string")))
    pairs = lambda r: F.array_join(F.transform(r, lambda v, k: F.concat(key(k), F.lit("="), v)), "; ")
    body = F.slice(rows, 2, F.greatest(F.size(rows) - 1, F.lit(0)))
    lines = F.transform(body, lambda r, k: F.concat(F.lit("row_"), (k + 1).cast("string"), F.lit(": "), pairs(r)))
    alone = F.concat(F.lit("header: "), F.array_join(header, "; "))
    return F.when(F.size(rows) > 1, F.array_join(lines, "\n")).when(F.size(rows) == 1, alone).otherwise(F.lit(""))


def page_complexity(two_columns: Column, tables: Column, images: Column, vectors: Column, regions: Column) -> Column:
    add = lambda test, x: F.when(test, F.lit(x)).otherwise(F.lit(0.0))
    return F.least(F.lit(1.0), add(two_columns, 0.25) + add(tables > 0, 0.3) + add((images > 0) | (vectors >= 20), 0.25) + add(regions >= 30, 0.2))


def page_class(complexity: Column, tables: Column, images: Column, vectors: Column, regions: Column) -> Column:
    return (
        F.when((tables > 0) & (complexity >= 0.4), "table_heavy_page")
        .when((images > 0) | (vectors >= 20), "visual_heavy_page")
        .when((complexity >= 0.65) | (regions >= 45), "hard_page")
        .otherwise("simple_text_page")
    )


def section_chunks(regions: DataFrame, keys: list[str], order: list[str], section: str, text: str) -> DataFrame:
    """Texts of a section put together in reading order: keys, section, regions, body."""
    made = regions.groupBy(*keys, section).agg(F.array_sort(F.collect_list(F.struct(*order, text))).alias("r"))
    return made.select(*keys, section, F.size("r").cast("bigint").alias("regions"), F.array_join(F.transform("r", lambda x: x[text]), "\n").alias("body"))


def nearest(left: DataFrame, right: DataFrame, keys: list[str], place: str, within: float, n: int, left_id: str, right_id: str) -> DataFrame:
    """Up to ``n`` rows of ``right`` nearest to each row of ``left`` along ``place``, at most ``within`` away; ties go to the smaller ``right_id``.

    Right rows are dealt to their band of that width and its neighbours, left rows to their own. A band is sorted once upwards and once
    downwards, each right row carries the ``n`` last right rows up to itself, and a left row takes those of the last right row before it, so rows
    grow by n on each side and no pair is made that isn't a candidate. Rows without a key or place are near nothing.
    """
    band, at = F.floor(F.col(place) / within), F.col(place).alias("_at")
    known = lambda rows: rows.where(" AND ".join(f"`{c}` IS NOT NULL" for c in (*keys, place)))
    key = F.struct(F.lit(0).alias("_all"), *keys).alias("_key")
    a = known(left).select(key, band.alias("_band"), at, F.col(left_id).alias("_left"), F.lit(False).alias("_is_right"))
    b = known(right).select(key, F.explode(F.array(*(band + k for k in (-1, 0, 1)))).alias("_band"), at, F.col(right_id).alias("_right"), F.lit(True).alias("_is_right"))
    group, found = Window.partitionBy("_key", "_band"), []
    # Upwards a right row at a left row's own place comes before it, downwards after it, so that each is met once. Of equal places the smaller id comes last.
    for along, at_place in ((F.asc("_at"), F.desc("_is_right")), (F.desc("_at"), F.asc("_is_right"))):
        among = group.orderBy(along, F.desc("_right"))
        taken = F.array_compact(F.array(F.struct("_right", "_at"), *(F.lag(F.struct("_right", "_at"), k).over(among) for k in range(1, n))))
        rows = a.unionByName(b.withColumn("_last", taken), allowMissingColumns=True)
        before = group.orderBy(along, at_place, F.desc("_right")).rowsBetween(Window.unboundedPreceding, 0)
        met = rows.withColumn("_last", F.last("_last", ignorenulls=True).over(before)).where("NOT _is_right")
        found.append(met.select("_key", "_left", F.col("_at").alias("_from"), F.inline("_last")))
    pairs = found[0].unionByName(found[1]).withColumn("distance", F.abs(F.col("_from") - F.col("_at"))).where(F.col("distance") <= within)
    nth = F.row_number().over(Window.partitionBy("_key", "_left").orderBy("distance", "_right")).cast("bigint")
    best = pairs.withColumn("nth", nth).where(F.col("nth") <= n)
    return best.select(*(F.col("_key")[k].alias(k) for k in keys), F.col("_left").alias(left_id), F.col("_right").alias(right_id), "distance", "nth")


def semantic_breaks(rows: DataFrame, keys: list[str], order: str, distance: str, share: float = 0.95) -> DataFrame:
    """``rows`` with part: a new part begins where the distance to the row before is above the document's percentile."""
    limit = rows.groupBy(*keys).agg(F.percentile(distance, share).alias("_limit"))
    w = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)
    cut = F.when(F.col(distance) > F.col("_limit"), 1).otherwise(0)
    return rows.join(limit, keys).withColumn("part", F.sum(cut).over(w)).drop("_limit")
