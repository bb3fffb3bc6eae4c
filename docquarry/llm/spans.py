"""Spans of regular expressions in code points, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

SPAN = "array<struct<at:bigint,kind_no:int,until:bigint,kind:string,value:string>>"


def none_found() -> Column:
    return F.expr(f"cast(array() as {SPAN})")


#: Matches of a text that are numbered at a time: a longer text's spans are put together from arrays of so many.
CHUNK = 256


def _let(value: Column, use) -> Column:
    """``use(value)`` with ``value`` evaluated once."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def find(text: Column, kind: str, kind_no: int, pattern: str, hint: str | None = None) -> Column:
    """All leftmost non-overlapping matches of ``pattern``; ``hint`` is a substring without which nothing can match.

    What lies between matches is split off, so a match begins after the lengths of all that came before it.
    """
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    between = F.split(text, pattern, -1)

    def step(acc: Column, x: Column) -> Column:
        at = acc["pos"] + F.length(x["0"])
        until = at + F.length(x["1"])
        span = F.struct(at.alias("at"), F.lit(kind_no).alias("kind_no"), until.alias("until"), F.lit(kind).alias("kind"), x["1"].alias("value"))
        return F.struct(until.alias("pos"), F.concat(acc["out"], F.array(span)).alias("out"))

    zipped = F.zip_with(F.slice(between, 1, F.size(found)), found, lambda gap, value: F.struct(gap.alias("0"), value.alias("1")))

    def chunk(acc: Column, no: Column) -> Column:
        begin = F.struct(acc["pos"].alias("pos"), none_found().alias("out"))
        part = F.aggregate(F.slice(acc["all"], no * CHUNK + 1, F.lit(CHUNK)), begin, step)
        return _let(part, lambda p: F.struct(p["pos"].alias("pos"), acc["all"].alias("all"), F.concat(acc["out"], F.array(p["out"])).alias("out")))

    start = F.struct(F.lit(0).cast("bigint").alias("pos"), zipped.alias("all"), F.expr(f"cast(array() as array<{SPAN}>)").alias("out"))
    chunks = F.sequence(F.lit(0), F.expr("cast(0 as int)") + ((F.size(found) - 1) / F.lit(CHUNK)).cast("int"))
    spans = F.aggregate(chunks, start, chunk, lambda acc: F.flatten(acc["out"]))
    test = F.size(found) > 0
    if hint is not None:
        test = F.contains(text, F.lit(hint)) & test
    return F.when(test, spans).otherwise(none_found())


def joined(spans: Column) -> Column:
    """``kind:start:end`` of each span in the order given, comma-joined."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["at"].cast("string"), s["until"].cast("string"))), ",")


def overlaps(span: Column, others: Column) -> Column:
    return F.exists(others, lambda o: (o["at"] < span["until"]) & (span["at"] < o["until"]))


def count(spans: Column, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind)).cast("bigint")
