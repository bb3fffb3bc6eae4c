"""Document fingerprints: threshold-scaled sketches of word shingles, and how alike two documents are by them.

A sketch holds every shingle hash below a fixed fraction of the hash space. So that short texts leave evidence too, it also holds the
FLOOR smallest hashes and says up to which hash it is complete (its limit). Two sketches are compared below the smaller of
their limits, where both are complete; the union of sketches, cut at the smallest limit, is the sketch of the texts put together, so
sketches of parts can be merged, and of a short and a very long text one tells how much of the short one the long one holds.

``report`` also fingerprints each text with its last quarter replaced by the next document's beginning. Documents are dealt by ranges of
their order, whose bounds are documents; each range also gets the document that follows its last one, so neighbours meet in one
shuffle and no task orders more than its range.

Edge cases: a null text counts as empty; a text without words has an empty sketch, is wholly like another such text and not at all like any
other; fewer words than a shingle make one shingle of the whole. Rows that share a doc_id are ordered by their text's hash, rows without one come last;
repeated rows each have a row in the result and are each other's next. A single document is its own next one. An empty table
gives an empty result; only doc_id and text are read.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textarrays import shingles, slices, spread

WORDS = 5
#: One of this many shingle hashes is kept, and how many of the smallest in any case.
SCALE, FLOOR = 16, 64
_ALL = (1 << 64) - 1
#: Bytes of text in a range.
RANGE_BYTES = 24_000_000
#: Bytes of text that a task works on at a time.
WORK_BYTES = 4_000_000

SCHEMA = "doc_id bigint, n_chars bigint, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, in_edited double, in_next double"


class Sketches:
    """Sketches of many texts: the kept ``hashes`` (ascending for each), where each one's begin, and up to which hash each is complete."""

    def __init__(self, hashes: np.ndarray, offs: np.ndarray, limits: np.ndarray):
        self.hashes, self.offs, self.limits = hashes, offs, limits

    @classmethod
    def of(cls, texts: pa.Array) -> Sketches:
        hashes, counts, limits = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)], [np.zeros(0, np.uint64)]
        for flat in slices(texts):
            value, offs = shingles(flat.lower(), WORDS)
            n = np.diff(offs)
            # Of texts with more than FLOOR shingles the sketch ends at the fraction, or at the last of the FLOOR smallest.
            more = n > FLOOR
            limit = np.full(flat.n, _ALL, np.uint64)
            limit[more] = np.maximum(np.uint64(_ALL // SCALE), value[(offs[:-1] + FLOOR - 1)[more]])
            owner = np.repeat(np.arange(flat.n), n)
            kept = value <= limit[owner]
            hashes.append(value[kept])
            counts.append(np.bincount(owner[kept], minlength=flat.n))
            limits.append(limit)
        return cls(np.concatenate(hashes), np.concatenate(([0], np.cumsum(np.concatenate(counts)))).astype(np.int64), np.concatenate(limits))

    def __len__(self) -> int:
        return len(self.limits)

    def take(self, which: np.ndarray) -> Sketches:
        lengths = (self.offs[1:] - self.offs[:-1])[which]
        return Sketches(self.hashes[spread(self.offs[which], lengths)], np.concatenate(([0], np.cumsum(lengths))), self.limits[which])

    def strings(self) -> list[str]:
        """The limit and the hashes, 16 hexadecimal digits each."""
        digits, ends = self.hashes.astype(">u8").tobytes().hex(), (self.offs * 16).tolist()
        return [f"{limit:016x}{digits[a:b]}" for limit, a, b in zip(self.limits.tolist(), ends, ends[1:])]


def parsed(fingerprints: list[str]) -> Sketches:
    """Sketches back from their strings."""
    counts = np.array([len(x) // 16 - 1 for x in fingerprints], np.int64)
    hashes = np.frombuffer(bytes.fromhex("".join(x[16:] for x in fingerprints)), ">u8").astype(np.uint64)
    return Sketches(hashes, np.concatenate(([0], np.cumsum(counts))).astype(np.int64), np.array([int(x[:16], 16) for x in fingerprints], np.uint64))


def merged(parts: list[str]) -> str:
    """The fingerprint of texts together, from their fingerprints: all hashes up to the smallest limit. (Shingles over the seams are in none.)"""
    sketches = parsed(parts)
    limit = sketches.limits.min()
    hashes = np.unique(sketches.hashes)
    hashes = hashes[hashes <= limit]
    return Sketches(hashes, np.array([0, len(hashes)]), np.array([limit])).strings()[0]


def likeness(a: Sketches, b: Sketches) -> tuple[np.ndarray, np.ndarray]:
    """Estimated similarity (shared of all shingles) of the i-th sketches, and containment (shared of the first one's)."""
    limit = np.minimum(a.limits, b.limits)
    owner = np.concatenate((np.repeat(np.arange(len(a)), np.diff(a.offs)), np.repeat(np.arange(len(b)), np.diff(b.offs))))
    value = np.concatenate((a.hashes, b.hashes))
    first = np.arange(len(value)) < len(a.hashes)
    kept = value <= limit[owner]
    owner, value, first = owner[kept], value[kept], first[kept]
    order = np.lexsort((value, owner))
    owner, value = owner[order], value[order]
    twice = (owner[1:] == owner[:-1]) & (value[1:] == value[:-1])
    shared = np.bincount(owner[1:][twice], minlength=len(a))
    of_a, both = np.bincount(owner[first[order]], minlength=len(a)), np.bincount(owner, minlength=len(a)) - shared
    return np.where(both > 0, shared / np.maximum(both, 1), 1.0), np.where(of_a > 0, shared / np.maximum(of_a, 1), np.where(both > 0, 0.0, 1.0))


def fingerprints(documents: DataFrame) -> DataFrame:
    """doc_id and fingerprint of each row; no shuffle."""

    def per_batch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(Sketches.of(batch.column(1)).strings(), pa.string())], ["doc_id", "fingerprint"])

    return common.map_arrow(documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text"), per_batch, "doc_id bigint, fingerprint string")


def _in_order(documents: DataFrame) -> DataFrame:
    """(doc_id, text, copy) in the order of documents within each partition; after its last document a range has the one that follows, as a copy."""
    spark = documents.sparkSession
    rows = documents.select(F.col("doc_id").isNull().alias("none"), F.coalesce(F.col("doc_id").cast("bigint"), F.lit(0)).alias("id"), F.xxhash64("text").alias("h"), "doc_id", "text")
    keys = common.stage(rows.select("none", "id", "h", F.octet_length("text").alias("size")), "order-keys")
    n = 1 + (keys.agg(F.sum("size")).first()[0] or 0) // RANGE_BYTES
    # The first document of each range; as many rows as ranges reach the driver.
    ranged = keys.repartitionByRange(n, "none", "id", "h").select(F.spark_partition_id().alias("part"), F.struct("none", "id", "h").alias("key"))
    bounds = sorted(tuple(x.key) for x in ranged.groupBy("part").agg(F.min("key").alias("key")).collect())
    if not bounds:
        return documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text", F.lit(False).alias("copy"))
    shared = spark.sparkContext.broadcast(np.array(bounds, np.int64))

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bounds = shared.value
        for batch in batches:
            key = np.stack([batch.column(k).to_numpy(zero_copy_only=False).astype(np.int64) for k in range(3)], axis=1)
            # The place of each key among the bounds: all are sorted together, equal ones behind their bound.
            both = np.concatenate((bounds, key))
            order = np.lexsort((np.arange(len(both)), both[:, 2], both[:, 1], both[:, 0]))
            place = np.empty(len(both), np.int64)
            place[order] = np.cumsum(order < len(bounds)) - 1
            part = place[len(bounds) :]
            first = np.flatnonzero((bounds[part] == key).all(axis=1))
            which = np.concatenate((np.arange(len(part)), first))
            copy = np.arange(len(which)) >= len(part)
            to = np.concatenate((part, (part[first] - 1) % len(bounds)))
            out = batch.take(pa.array(which))
            yield pa.RecordBatch.from_arrays([pa.array(to), pa.array(copy), *out.columns], ["part", "copy", *batch.schema.names])

    dealt = common.map_arrow(rows, deal, "part bigint, copy boolean, none boolean, id bigint, h bigint, doc_id bigint, text string")
    order = ("part", "copy", "none", "id", "h")
    return dealt.repartitionById(n, F.col("part").cast("int")).sortWithinPartitions(*order).select("doc_id", "text", "copy")


def report(documents: DataFrame) -> DataFrame:
    """SCHEMA's columns for every row."""
    names = [x.split()[0] for x in SCHEMA.split(", ")]

    def worked(ids: list, texts: list[str], copies: list[bool]) -> pa.RecordBatch:
        """Rows of all documents but the last and those that are copies; each one's next is the row behind it."""
        own = np.flatnonzero(~np.array(copies[:-1], bool))
        edited = []
        for i in own.tolist():
            cut = len(texts[i]) // 4
            edited.append(texts[i][: len(texts[i]) - cut] + texts[i + 1][:cut])
        sketches, changed = Sketches.of(pa.array(texts, pa.large_string())), Sketches.of(pa.array(edited, pa.large_string()))
        mine = sketches.take(own)
        near_edited, in_edited = likeness(mine, changed)
        near_next, in_next = likeness(mine, sketches.take(own + 1))
        columns = ([ids[i] for i in own], [len(texts[i]) for i in own], [hashlib.sha256(x.encode()).hexdigest() for x in edited], mine.strings(), changed.strings(), near_edited, near_next, in_edited, in_next)
        kinds = (pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), *[pa.float64()] * 4)
        return pa.RecordBatch.from_arrays([pa.array(x, kind) for x, kind in zip(columns, kinds)], names)

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, texts, copies, held = [], [], [], 0
        for batch in batches:
            for doc_id, text, copy in zip(*(batch.column(k) for k in range(3))):
                ids.append(doc_id.as_py())
                texts.append(text.as_py() or "")
                copies.append(copy.as_py())
                held += len(texts[-1])
                if held >= WORK_BYTES and len(ids) > 1:
                    yield worked(ids, texts, copies)
                    ids, texts, copies, held = ids[-1:], texts[-1:], copies[-1:], 0
        if len(ids) > 1:
            yield worked(ids, texts, copies)

    return common.map_arrow(_in_order(documents), per_task, SCHEMA)
