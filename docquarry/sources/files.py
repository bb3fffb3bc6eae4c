"""Files: raw documents through named parsers, question sets as JSON lines, and their sinks."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: File types that are taken, the largest file, and the order in which parsers are tried.
TYPES = ("pdf", "docx", "pptx", "txt", "md")
LARGEST = 100 * 1024 * 1024

Parser = Callable[[bytes, str], list[tuple[int, str]]]
PARSERS: dict[str, Parser] = {}


def parser(name: str) -> Callable[[Parser], Parser]:
    """Register a function from (content, file name) to numbered pages; it raises on what it can't read."""

    def keep(f: Parser) -> Parser:
        PARSERS[name] = f
        return f

    return keep


@parser("plain")
def plain(content: bytes, name: str) -> list[tuple[int, str]]:
    if not name.lower().endswith((".txt", ".md")):
        raise ValueError("not a text file")
    return [(1, content.decode("utf-8"))]


def checked(files: DataFrame) -> DataFrame:
    """``files`` (path, length) with the reason why a file isn't taken, null if it is."""
    kind = F.lower(F.regexp_extract("path", r"\.([^./]+)$", 1))
    reason = F.when(~kind.isin(*TYPES), "type").when(F.col("length") <= 0, "empty").when(F.col("length") > LARGEST, "too large")
    return files.withColumn("rejected", reason)


def read_documents(spark: SparkSession, folder: str, preferred: str | None = None, parsers: dict[str, Parser] | None = None) -> DataFrame:
    """(path, parser, page, text, error): pages of each file by the first parser that reads it.

    A parser named as preferred is used alone. A file that none reads gives one row with the error.
    """
    known = dict(PARSERS if parsers is None else parsers)
    if preferred is not None and preferred not in known:
        raise ValueError(f"no parser named {preferred}")
    order = [preferred] if preferred else list(known)

    def pages(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            out = []
            for path, content in zip(batch["path"], batch["content"]):
                errors = []
                for name in order:
                    try:
                        out += [(path, name, n, text, None) for n, text in known[name](bytes(content), path) if text.strip()]
                        break
                    except Exception as e:  # noqa: BLE001  a parser may fail in any way; the next one is tried
                        errors.append(f"{name}: {e}")
                else:
                    out.append((path, None, None, None, "; ".join(errors)))
            yield pd.DataFrame(out, columns=["path", "parser", "page", "text", "error"])

    taken = checked(spark.read.format("binaryFile").load(folder)).where("rejected IS NULL").select("path", "content")
    return taken.mapInPandas(pages, "path string, parser string, page long, text string, error string")


QUESTION = "id bigint, category string, difficulty string, question string"


def read_questions(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """Questions of a file of JSON lines, and one row of counts: lines, malformed, without an id, blank."""
    lines = spark.read.text(path).where(F.trim("value") != "")
    parsed = lines.select(F.from_json("value", f"{QUESTION}, _bad string", {"columnNameOfCorruptRecord": "_bad"}).alias("q")).select("q.*")
    bad, no_id = F.col("_bad").isNotNull(), F.col("id").isNull()
    blank = F.trim(F.coalesce("question", F.lit(""))) == ""
    stats = parsed.agg(F.count("*").alias("lines"), F.count_if(bad).alias("malformed"), F.count_if(~bad & no_id).alias("without_id"), F.count_if(~bad & ~no_id & blank).alias("blank"))
    return parsed.where(~bad & ~no_id & ~blank).drop("_bad"), stats


def read_strict(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """JSON lines that must all be of the schema."""
    return spark.read.schema(schema).option("mode", "FAILFAST").json(path)


def write_sorted(rows: DataFrame, path: str, order: str) -> None:
    """JSON lines in order over the folder's files; the commit replaces the folder at once."""
    rows.orderBy(order).write.mode("overwrite").json(path)


def write_bundle(artifacts: DataFrame, path: str) -> None:
    """Artifacts of documents, a folder for each document."""
    artifacts.write.mode("overwrite").partitionBy("document_id").parquet(path)
