"""Signals, coercions and labels of chunk texts as columns."""

from __future__ import annotations

import re

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Patterns of numbers in texts, words of charts and of periods in tables, and words for missing values.
NUMBER = r"\b\d+[.,]?\d*%?\b"
CHART_WORDS = ("figure", "chart", "graph", "plot", "diagram", "trend")
TABLE_WORDS = r"\b(q[1-4]|quarter|year|total|revenue|cost|amount|value)\b"
MISSING_WORDS = ("", "none", "null", "n/a", "na", "undefined")


def contains_any(text: Column, terms: tuple[str, ...]) -> Column:
    """Whether any term is a substring; one pass over the text and one small expression however many terms there are."""
    return text.rlike("|".join(re.escape(t) for t in terms))


def clean_missing(value: Column) -> Column:
    """Null for words that stand for no value."""
    return F.when(~F.lower(F.trim(value)).isin(*MISSING_WORDS), F.trim(value))


def number_count(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(NUMBER))


def has_numeric_data(text: Column) -> Column:
    return number_count(text) >= 3


def numeric_density(text: Column) -> Column:
    """Numbers per token, at most 1, to four places."""
    tokens = F.regexp_count(F.coalesce(text, F.lit("")), F.lit(r"\S+"))
    return F.when(tokens > 0, F.round(F.least(F.lit(1.0), number_count(text) / tokens), 4)).otherwise(F.lit(0.0))


def has_table_signals(text: Column) -> Column:
    lines = F.split(F.trim(F.coalesce(text, F.lit(""))), "\n")
    n = F.size(F.filter(lines, lambda x: x.contains("\t") | (F.length(x) - F.length(F.translate(x, "|", "")) >= 2)))
    return (n >= 2) | ((n == 1) & (has_numeric_data(text) | F.lower(text).rlike(TABLE_WORDS)))


def has_chart_signals(text: Column) -> Column:
    return contains_any(F.lower(F.coalesce(text, F.lit(""))), CHART_WORDS)


def units(text: Column) -> Column:
    """Units named in a text, sorted and comma-joined."""
    low = F.lower(text)
    found = [("$", text.contains("$")), ("%", text.contains("%")), ("USD", low.contains("usd")), ("billion", low.contains("billion")), ("million", low.contains("million"))]
    return F.concat_ws(",", *(F.when(test, F.lit(name)) for name, test in found))


def singular(token: Column) -> Column:
    """A metric's name without plural ending and hyphens around it."""
    t = F.regexp_replace(F.lower(token), "^-+|-+$", "")
    return (
        F.when(t.endswith("ies") & (F.length(t) > 4), F.regexp_replace(t, "ies$", "y"))
        .when(t.endswith("s") & (F.length(t) > 3), F.regexp_replace(t, "s$", ""))
        .otherwise(t)
    )


def safe_int(value: Column, default: int | None = None) -> Column:
    """A whole number written as a string, else the default."""
    return F.coalesce(value.try_cast("bigint"), F.lit(default).cast("bigint"))


def safe_float(value: Column, default: float | None = None) -> Column:
    return F.coalesce(value.try_cast("double"), F.lit(default).cast("double"))


def safe_bool(value: Column, default: bool | None = None) -> Column:
    t = F.lower(F.trim(value))
    return F.when(t.isin("true", "1", "yes"), True).when(t.isin("false", "0", "no"), False).otherwise(F.lit(default).cast("boolean"))


def preview(text: Column, n: int = 500) -> Column:
    return F.substring(F.trim(F.regexp_replace(text, r"\s+", " ")), 1, n)


def natural_key(value: Column) -> Column:
    """A string that sorts as its digit runs do by number: each run padded to twelve places."""
    parts = F.regexp_extract_all(value, F.lit(r"\d+|\D+"), F.lit(0))
    return F.array_join(F.transform(parts, lambda p: F.when(p.rlike(r"^\d"), F.lpad(p, 12, "0")).otherwise(F.lower(p))), "")


def citation_label(name: Column, page: Column, slide: Column, chunk: Column) -> Column:
    """``file - p.N - slide N - chunk i``; absent and zero parts are left out."""
    part = lambda head, c: F.when(c > 0, F.concat(F.lit(head), c.cast("string")))
    return F.concat_ws(" - ", clean_missing(name), part("p.", page), part("slide ", slide), part("chunk ", chunk))


def document_key(*parts: Column) -> Column:
    """Base 64 for URLs, without padding, of the parts joined by a unit separator."""
    joined = F.concat_ws("\x1f", *(F.coalesce(p.cast("string"), F.lit("")) for p in parts))
    return F.translate(F.base64(joined.cast("binary")), "+/=\r\n", "-_")
