"""From raw texts to chunks: pages, windows, tables, sections and rows of text items."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Fixed value: marks around a page.
PAGE = r"(?s)\[\[START OF PAGE (\d+)\]\](.*?)\[\[END OF PAGE \d+\]\]"
SPLIT_WORDS, OVERLAP = 600, 40


def pages(texts: DataFrame, key: str, text: str) -> DataFrame:
    """(key, page, page_text) of the marked pages; without marks the whole is page 1; empty and unclosed pages go."""
    found = F.regexp_extract_all(F.col(text), F.lit(PAGE), F.lit(1))
    body = F.regexp_extract_all(F.col(text), F.lit(PAGE), F.lit(2))
    marked = F.col(text).contains("[[START OF PAGE ")
    whole = F.array(F.struct(F.lit("1").alias("page"), F.col(text).alias("body")))
    rows = F.when(marked, F.zip_with(found, body, lambda p, b: F.struct(p.alias("page"), b.alias("body")))).otherwise(whole)
    return texts.select(key, F.inline(rows)).select(key, F.col("page").cast("bigint").alias("page"), F.trim(F.regexp_replace("body", r"^\s+|\s+$", "")).alias("page_text")).where("page_text <> ''")


def word_windows(texts: DataFrame, key: str, words: Column, size: int = SPLIT_WORDS, overlap: int = OVERLAP) -> DataFrame:
    """(key, window_no, n_words, first_word, last_word): windows of ``size`` words that overlap; the last may be shorter."""
    n = F.size("words")
    starts = F.sequence(F.lit(0), F.greatest(n - 1, F.lit(0)), F.lit(size - overlap))
    # A window that only holds the overlap of the one before it isn't needed.
    starts = F.filter(starts, lambda s: (s == 0) | (n - s > overlap))
    # Windows are cut before they are dealt to rows, so that no row carries the whole text.
    last = lambda s: F.least(s + size, n)
    one = lambda s, k: F.struct(k.cast("bigint").alias("window_no"), (last(s) - s).cast("bigint").alias("n_words"), F.get("words", s).alias("first_word"), F.get("words", last(s) - 1).alias("last_word"))
    return texts.select(key, words.alias("words")).where(n > 0).select(key, F.inline(F.transform(starts, one)))


def islands(rows: DataFrame, keys: list[str], order: list[str], joins: Column) -> DataFrame:
    """``rows`` with island: rows for which ``joins`` (over lagged columns ``prev_*``) holds stay with the row before."""
    w = Window.partitionBy(*keys).orderBy(*order)
    lagged = rows.withColumns({f"prev_{c}": F.lag(c).over(w) for c in rows.columns if c not in keys})
    new = F.when(F.coalesce(joins, F.lit(False)), 0).otherwise(1)
    out = lagged.withColumn("island", F.sum(new).over(w.rowsBetween(Window.unboundedPreceding, 0)).cast("bigint"))
    return out.drop(*(f"prev_{c}" for c in rows.columns))


def latest_before(rows: DataFrame, keys: list[str], order: list[Column], mark: Column, name: str) -> DataFrame:
    """``rows`` with the last non-null ``mark`` at or before each row: an as-of join without a join."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return rows.withColumn(name, F.last(mark, ignorenulls=True).over(w))


def reading_order(regions: DataFrame, keys: list[str], zones: dict[str, int]) -> DataFrame:
    """``regions`` with reading_order, and the ids before and after: by zone, then place from the top, then from the left."""
    zone = F.lit(99)
    for name, k in zones.items():
        zone = F.when(F.col("zone") == name, k).otherwise(zone)
    w = Window.partitionBy(*keys).orderBy(zone, F.round("y", 2), F.round("x", 2), "region_id")
    return regions.withColumns({"reading_order": F.row_number().over(w).cast("bigint"), "before_id": F.lag("region_id").over(w), "after_id": F.lead("region_id").over(w)})


def text_rows(items: DataFrame, keys: list[str], step: float = 6.0) -> DataFrame:
    """Text items put together to rows of like height; items of a row run from the left."""
    bucket = F.bround(F.col("y") / step) * step
    made = items.groupBy(*keys, bucket.alias("row_y")).agg(F.array_sort(F.collect_list(F.struct("x", "item_id", "word"))).alias("items"), F.min("x").alias("x0"), F.max("x").alias("x1"))
    return made.select(*keys, "row_y", F.array_join(F.transform("items", lambda i: i["word"]), " ").alias("row_text"), "x0", "x1")


def iou(a: tuple[Column, ...], b: tuple[Column, ...]) -> Column:
    """Intersection over union of two boxes (x0, y0, x1, y1)."""
    wide = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), F.lit(0.0))
    high = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), F.lit(0.0))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    both = wide * high
    return F.when(area(a) + area(b) - both > 0, both / (area(a) + area(b) - both)).otherwise(F.lit(0.0))
