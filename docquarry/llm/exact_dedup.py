"""Exact duplicates through a log-structured merge index of digests.

Every task gathers its rows in memtables of bounded size, which keep the best row and the number of rows of each digest; those of a
flush make a run of level 0 in digest order. A level that is full is merged into one run of the next; merging keeps the row that
stays. Each run has a filter, a bitmap of its digests: a lookup sends only digests that a run's filter marks to the exact join
with that run. A hit, a row whose digest another row holds, is verified byte by byte against the text that stays; rows that
share a digest but not the bytes form groups of their own by the bytes themselves.

``report`` and ``dedup`` load a table into a new index in FLUSHES parts: each part is looked up in the runs that are there before its
own run is added, so copies are found as the index grows; ``admit`` adds tables one after another to an index that stays.

Texts are equal when they are the same after deleting ASCII white space. The row with the most code points in its original
text stays, then the smallest doc_id; a null doc_id counts as larger than all others. Edge cases: a null text counts as
empty (all such rows are one group); of rows alike in doc_id and text one stays; an empty table gives an empty result;
columns other than doc_id and text are carried as they are, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from . import common

#: Rows of a memtable, runs of a level that are merged into one of the next, and the same where a table is loaded in FLUSHES parts.
MEMTABLE_ROWS, FANOUT, FLUSHES, LOAD_FANOUT = 200_000, 4, 5, 2
#: Bits of a run's filter for each digest, and at most.
BITS_PER_DIGEST, MOST_BITS = 8, 1 << 26
BEST = "struct<minus_chars:bigint,no_id:boolean,doc_id:bigint>"
_DELETED = " \t\n\x0b\x0c\r"


def normalised(text: Column) -> Column:
    return F.translate(F.coalesce(text, F.lit("")), _DELETED, "")


def digest_of(text: Column, bits: int = 256) -> Column:
    """The first ``bits`` of the SHA-256 digest of the normalised text, in hexadecimal."""
    full = F.sha2(normalised(text), 256)
    return full if bits == 256 else F.substring(full, 1, bits // 4)


def _order() -> Column:
    """Smallest first: most code points, then smallest doc_id, null last."""
    return F.struct((-F.col("n_chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("no_id"), F.col("doc_id").alias("doc_id"))


def _memtables(rows: DataFrame) -> DataFrame:
    """(digest, best, n) from (digest, doc_id, n_chars): each memtable's digests in order, each once; no shuffle."""
    flat = rows.select("digest", (-F.col("n_chars")).alias("minus_chars"), F.col("doc_id").isNull().alias("no_id"), "doc_id")
    schema = T.StructType([*flat.schema.fields, T.StructField("n", T.LongType())])
    keys = [(c, "ascending") for c in flat.columns]

    def flushed(parts: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        table = pa.Table.from_batches(parts).sort_by(keys)
        if not table.num_rows:
            return
        digest = table.column("digest").combine_chunks()
        fresh = np.concatenate(([True], pc.not_equal(digest[1:], digest[:-1]).to_numpy(zero_copy_only=False)))
        at = np.flatnonzero(fresh)
        yield from table.take(at).append_column("n", pa.array(np.diff(np.append(at, len(digest))), pa.int64())).combine_chunks().to_batches()

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts, size = [], 0
        for batch in batches:
            parts.append(batch)
            size += batch.num_rows
            if size >= MEMTABLE_ROWS:
                yield from flushed(parts)
                parts, size = [], 0
        if parts:
            yield from flushed(parts)

    made = common.map_arrow(flat, per_task, schema)
    return made.select("digest", F.struct("minus_chars", "no_id", "doc_id").alias("best"), "n")


def _bits(digests: int) -> int:
    """Bits of a bitmap of so many digests, a power of two."""
    return min(max(common.MARK_BITS, 1 << (digests * BITS_PER_DIGEST).bit_length()), MOST_BITS)


class DigestIndex:
    """Levels of runs of (digest, best, n). ``best`` orders rows as ``_order`` does; ``n`` is how many rows the digest has.

    The driver holds the runs' names and filters: FANOUT - 1 runs a level at most, and as many levels as the logarithm of the
    number of flushes.
    """

    def __init__(self, spark: SparkSession, fanout: int | None = None):
        self.spark, self.fanout = spark, fanout or FANOUT
        self.levels: list[list[DataFrame]] = [[]]
        self.filters: dict[int, np.ndarray] = {}

    def _merged(self, runs: list[DataFrame]) -> DataFrame:
        rows = runs[0]
        for run in runs[1:]:
            rows = rows.unionByName(run)
        return rows.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n")).sortWithinPartitions("digest")

    def _add(self, level: int, run: DataFrame) -> None:
        if level == len(self.levels):
            self.levels.append([])
        self.levels[level].append(run)
        if len(self.levels[level]) >= self.fanout:
            full, self.levels[level] = self.levels[level], []
            self._add(level + 1, common.stage(self._merged(full), f"run-{level + 1}"))
            for run in full:
                self._drop(run)

    def _drop(self, run: DataFrame) -> None:
        self.filters.pop(id(run), None)
        common.discard(run)

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def flush(self, rows: DataFrame) -> DataFrame:
        """Write rows of (digest, doc_id, n_chars) as a run of level 0, and merge levels that are full.

        Gives the digests that are in the index more than once now and have a row among these: those that several of these rows
        share, and those that an earlier run holds.
        """
        new = common.stage(self._merged([_memtables(rows)]), "run-0")
        again = new.where("n > 1").select("digest")
        for run in self.runs():
            marked = common.with_mark(new.select("digest"), ["digest"], self._filter(run), True)
            again = again.unionByName(marked.join(run, "digest", "left_semi"))
        again = common.stage(again, "again")  # before merging deletes a run
        self._add(0, new)
        return again

    def compact(self) -> DataFrame:
        """Merge all runs into one of the last level: one row for each digest with the smallest ``best``."""
        runs = self.runs()
        whole = common.stage(self._merged(runs), "compacted")
        for run in runs:
            self._drop(run)
        self.levels = [*([] for _ in self.levels[1:]), [whole]]
        return whole

    def _filter(self, run: DataFrame) -> np.ndarray:
        if id(run) not in self.filters:
            self.filters[id(run)] = common.marks(run.select("digest"), _bits(run.count()))
        return self.filters[id(run)]

    def lookup(self, rows: DataFrame) -> DataFrame:
        """``rows`` (with a column digest) that some run holds, with the entry's ``best`` and ``n`` over all runs."""
        found = None
        for run in self.runs():
            some = common.with_mark(rows.select("digest"), ["digest"], self._filter(run), True).distinct()
            held = run.join(some, "digest", "left_semi")
            found = held if found is None else found.unionByName(held)
        if found is None:
            return rows.selectExpr("*", f"cast(null as {BEST}) AS best", "cast(null as bigint) AS n").where("false")
        entries = found.groupBy("digest").agg(F.min("best").alias("best"), F.sum("n").alias("n"))
        return rows.join(entries, "digest")


def _texts(documents: DataFrame, bits: int) -> DataFrame:
    """(digest, doc_id, n_chars, body) of every row."""
    text = F.col("text")
    return documents.select(digest_of(text, bits).alias("digest"), "doc_id", _chars().alias("n_chars"), normalised(text).alias("body"))


def _chars() -> Column:
    return F.length(F.coalesce(F.col("text"), F.lit(""))).cast("bigint")


def _verified(texts: DataFrame, shared: DataFrame) -> DataFrame:
    """(digest, same) of every row whose digest is shared: whether its bytes equal those of the row that stays.

    ``texts`` holds rows of shared digests, and by chance some others, which the joins drop. Both sides of the last join are
    tables that are shuffled for it alone, so a hot digest's rows are split over tasks.
    """
    stays = shared.select(F.col("digest").alias("d"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.minus_chars")).alias("keep_chars"))
    match = (F.col("d") == F.col("digest")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    kept = texts.join(stays, match).groupBy("digest").agg(F.min("body").alias("keep_body"))
    kept = common.stage(kept, "kept-texts")
    return texts.join(kept, "digest").select("digest", (F.col("body") == F.col("keep_body")).alias("same"))


class Groups:
    """Groups of equal texts. ``hits``: digest, body_no, best, top, n of each row of a digest that several rows have; ``stays``
    one row for each such group with copies (rows alike in doc_id and text); ``shared`` marks the digests of hits."""

    def __init__(self, documents: DataFrame, bits: int = 256):
        # Written once: texts are digested here and not again for lookups.
        part = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(FLUSHES)).alias("part")
        keys = documents.select("doc_id", digest_of(F.col("text"), bits).alias("digest"), _chars().alias("n_chars"), part)
        keys = common.stage(keys, "digests", ["part"])
        self.keys = keys.drop("part")
        index = DigestIndex(documents.sparkSession, LOAD_FANOUT)
        again = [index.flush(keys.where(F.col("part") == k).drop("part")) for k in range(FLUSHES)]
        several = common.stage(index.lookup(reduce(DataFrame.unionByName, again).distinct()), "several")
        for table in (*again, *index.runs()):
            common.discard(table)
        self.shared = common.marks(several.select("digest"), _bits(several.count()))
        texts = common.with_mark(_texts(documents, bits), ["digest"], self.shared, True)
        checked = common.stage(_verified(texts, several), "verified")
        rows = common.with_mark(self.keys, ["digest"], self.shared, True).select("digest", _order().alias("best"))
        held = rows.join(several.withColumnRenamed("best", "top"), "digest")
        no_body = F.lit(None).cast("string").alias("body_no")
        columns = ["digest", "body_no", "best", "top", "n"]
        if checked.where("not same").isEmpty():
            hits = held.select("digest", no_body, "best", "top", "n")
        else:
            # Digests that hold more than one text: their groups go by the bytes.
            mixed = common.stage(checked.where("not same").select("digest").distinct(), "mixed")
            apart = common.stage(texts.join(mixed, "digest", "left_semi").select("digest", _order().alias("best"), "body"), "apart")
            found = common.stage(apart.groupBy("digest", "body").agg(F.min("best").alias("top"), F.count("*").alias("n")), "tops")
            resolved = apart.join(found, ["digest", "body"]).withColumn("body_no", F.sha2("body", 256)).select(columns)
            hits = held.join(mixed, "digest", "left_anti").withColumn("body_no", F.lit(None).cast("string")).select(columns).unionByName(resolved)
        self.hits = common.stage(hits, "hits")
        self.stays = common.stage(self.hits.where("best = top").groupBy(*columns).agg(F.count("*").alias("copies")), "stays")
        self.several = several

    def alone(self) -> DataFrame:
        """digest and best of the rows whose digest no other row has; those that the bitmap marks by chance are told apart by a join."""
        clear = common.with_mark(self.keys, ["digest"], self.shared, False)
        by_chance = common.with_mark(self.keys, ["digest"], self.shared, True).join(self.several, "digest", "left_anti")
        return clear.unionByName(by_chance).select("digest", _order().alias("best"))


def _public(rows: DataFrame, kept) -> DataFrame:
    return rows.select(
        F.col("best.doc_id").alias("doc_id"),
        F.col("top.doc_id").alias("keep_id"),
        F.col("n").alias("group_size"),
        kept.alias("kept"),
        F.coalesce("body_no", "digest").alias("text_sha256"),
    )


def report(documents: DataFrame, bits: int = 256) -> DataFrame:
    """One row for each row of ``documents``: doc_id, keep_id, group_size, kept, text_sha256 (the digest of ``bits`` when fewer)."""
    groups = Groups(documents, bits)
    no_body, one = F.lit(None).cast("string").alias("body_no"), F.lit(1).cast("bigint").alias("n")
    alone = groups.alone().select("digest", no_body, "best", F.col("best").alias("top"), one)
    gone = groups.hits.where("best <> top")
    stays = groups.stays.select("*", F.explode(F.sequence(F.lit(1).cast("bigint"), F.col("copies"))).alias("copy"))
    return _public(alone, F.lit(True)).unionByName(_public(gone, F.lit(False))).unionByName(_public(stays, F.col("copy") == 1))


def dedup(documents: DataFrame) -> DataFrame:
    """``documents`` with one row of each group, all columns. Rows of groups of one pass without a shuffle."""
    groups = Groups(documents)
    rows = common.packed(documents, digest=digest_of(F.col("text")), n_chars=_chars(), doc_id=F.col("doc_id"))
    alone = common.with_mark(rows, ["digest"], groups.shared, False)
    marked = common.with_mark(rows, ["digest"], groups.shared, True)
    by_chance = marked.join(groups.several, "digest", "left_anti").select(*rows.columns)
    keep = groups.stays.select(F.col("digest").alias("d"), F.col("best.doc_id").alias("keep_id"), (-F.col("best.minus_chars")).alias("keep_chars"))
    match = (F.col("digest") == F.col("d")) & F.col("doc_id").eqNullSafe(F.col("keep_id")) & (F.col("n_chars") == F.col("keep_chars"))
    # Texts whose bytes differ under one digest stay apart, which only a collision of SHA-256 could bring about.
    several = marked.join(keep, match, "left_semi")
    if not groups.stays.where("copies > 1").isEmpty():
        several = several.withColumn("body", F.sha2(normalised(F.col("row.text")), 512)).dropDuplicates(["digest", "body"]).drop("body")
    return common.unpacked(alone.unionByName(by_chance).unionByName(several), documents)


def admit(documents: DataFrame, index: DigestIndex, store: DataFrame) -> DataFrame:
    """The rows of ``documents``, one of each group, whose text ``store`` (rows that ``index`` holds) doesn't have; they go into the index.

    A row of an earlier call stays even where a later one has more code points. Hits are verified against the stored text; doc_ids of
    the store are taken to be unique.
    """
    new = common.stage(dedup(documents), "new-rows")
    keys = new.select("doc_id", digest_of(F.col("text")).alias("digest"), _chars().alias("n_chars"))
    hits = index.lookup(keys).select("digest", F.col("best.doc_id").alias("held_id"))
    held = store.select(F.col("doc_id").alias("held_id"), normalised(F.col("text")).alias("held_body")).join(hits, "held_id").select("digest", "held_body")
    rows = common.packed(new, digest=digest_of(F.col("text")), body=normalised(F.col("text")))
    fresh = rows.join(held, (rows["digest"] == held["digest"]) & (rows["body"] == held["held_body"]), "left_anti")
    fresh = common.stage(common.unpacked(fresh, new), "admitted")
    index.flush(fresh.select("doc_id", digest_of(F.col("text")).alias("digest"), _chars().alias("n_chars")))
    return fresh


#: DuckDB's form of ``report`` where rows alike in doc_id and text are absent.
SQL = """
WITH t AS (
  SELECT doc_id, length(coalesce(text, '')) AS n_chars,
         sha256(regexp_replace(coalesce(text, ''), '[\\x20\\x09-\\x0D]', '', 'g')) AS text_sha256
  FROM documents),
w AS (
  SELECT *, first_value(doc_id) OVER (PARTITION BY text_sha256 ORDER BY n_chars DESC, doc_id) AS keep_id,
         count(*) OVER (PARTITION BY text_sha256) AS group_size
  FROM t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, text_sha256 FROM w
"""
