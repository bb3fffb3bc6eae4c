"""Packing documents into fixed-length training sequences, online and in bounded space.

Each task keeps a fixed number of open windows. A document's full windows go out at once; the rest is placed into the window
that it fills best. When none has room the fullest one is emitted, first filled up from the piece if the gap is worth a cut.
What is still open when tasks end is merged: the leftovers of all tasks, laid end to end, are cut at every full length, so
only the very last sequence is short.

Edge cases: a null text counts as empty and has the end id alone; repeated rows are packed each; an empty table gives no
piece; only doc_id and text are read. A very long text fills windows of its own as it is cut.
"""

from __future__ import annotations

import bisect
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common
from .textarrays import slices
from .tokens import encoder

LENGTH, OPEN_WINDOWS, END_ID = 2048, 64, 1
#: Smallest gap that is filled by cutting a piece; smaller gaps are padded.
LEAST_CUT = 16
#: Sequences of merged leftovers are numbered from here.
MERGED_FROM = 1 << 62
PIECES = "doc_id bigint, start bigint, length bigint, ids binary, doc_tokens bigint, task int, window bigint, offset bigint, closed boolean"
_NAMES = [x.split()[0] for x in PIECES.split(", ")]


class Windows:
    """The open windows of a task: ``place`` returns nothing, ``out`` gathers the pieces of emitted windows."""

    def __init__(self, task: int, length: int, n_open: int, least_cut: int):
        self.task, self.length, self.n_open, self.least_cut = task, length, n_open, least_cut
        self.by_free: list[tuple[int, int]] = []  # (free, window), sorted
        self.pieces: dict[int, list[tuple]] = {}
        self.next = 0
        self.out: list[tuple] = []

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        total, start = len(ids), 0
        while total - start >= self.length:
            self._emit_alone((doc_id, start, self.length, ids[start : start + self.length], total))
            start += self.length
        if start < total:
            self._place(doc_id, start, ids, total)

    def _emit_alone(self, piece: tuple) -> None:
        self.out.append((*piece[:3], piece[3].tobytes(), piece[4], self.task, self.next, 0, True))
        self.next += 1

    def _place(self, doc_id: int | None, start: int, ids: np.ndarray, total: int) -> None:
        need = total - start
        i = bisect.bisect_left(self.by_free, (need, -1))
        if i == len(self.by_free) and len(self.by_free) == self.n_open:
            free, window = self.by_free.pop(0)  # the fullest
            if free >= self.least_cut:
                self._put(window, free, doc_id, start, free, ids, total)
                start, need = start + free, need - free
            self._close(window)
            i = bisect.bisect_left(self.by_free, (need, -1))
        if i < len(self.by_free):
            free, window = self.by_free.pop(i)
        else:
            free, window = self.length, self.next
            self.next += 1
        self._put(window, free, doc_id, start, need, ids, total)
        if free == need:
            self._close(window)
        else:
            bisect.insort(self.by_free, (free - need, window))

    def _put(self, window: int, free: int, doc_id: int | None, start: int, n: int, ids: np.ndarray, total: int) -> None:
        self.pieces.setdefault(window, []).append((doc_id, start, n, ids[start : start + n].tobytes(), total, self.task, window, self.length - free))

    def _close(self, window: int) -> None:
        self.out += [(*p, True) for p in self.pieces.pop(window)]

    def finish(self) -> None:
        """The leftovers, their offsets running through all windows of the task in order of number."""
        at = 0
        for window in sorted(self.pieces):
            for p in self.pieces[window]:
                self.out.append((*p[:7], at, False))
                at += p[2]
        self.pieces.clear()

    def batch(self) -> pa.RecordBatch:
        kinds = [pa.int64(), pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.bool_()]
        columns = list(zip(*self.out)) or [()] * len(kinds)
        self.out = []
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], _NAMES)


def pack(documents: DataFrame, vocabulary: str, keeps_space: bool = False, end_id: int = END_ID, length: int = LENGTH, n_open: int = OPEN_WINDOWS, least_cut: int = LEAST_CUT) -> DataFrame:
    """One row for each piece: doc_id, start, length, ids (little-endian unsigned 32-bit), doc_tokens, sequence_id, offset."""

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        windows = Windows(TaskContext.get().partitionId(), length, n_open, least_cut)
        encode = encoder(vocabulary, keeps_space).encode
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for flat in slices(batch.column(1)):
                ids, offs = encode(flat)
                for d in range(flat.n):
                    windows.add(docs[flat.first + d], np.append(ids[offs[d] : offs[d + 1]], np.uint32(end_id)).astype("<u4"))
                if windows.out:
                    yield windows.batch()
        windows.finish()
        if windows.out:
            yield windows.batch()

    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    pieces = common.stage(common.map_arrow(source, per_task, PIECES), "pieces", ["closed"])
    done = pieces.where("closed").select("doc_id", "start", "length", "ids", "doc_tokens", (F.col("task").cast("bigint") * (1 << 32) + F.col("window")).alias("sequence_id"), "offset")
    return done.unionByName(merge_leftovers(pieces.where("not closed"), length))


def merge_leftovers(left: DataFrame, length: int) -> DataFrame:
    """Lay the leftovers of all tasks end to end and cut them at every ``length``."""
    base = common.running_totals(left.groupBy("task").agg(F.sum("length").alias("n")), "task", "n")
    placed = left.join(common.broadcast_if_small(base, base.count()), "task").withColumn("at", F.col("base") + F.col("offset"))
    first, last = F.floor(F.col("at") / length), F.floor((F.col("at") + F.col("length") - 1) / length)
    parts = placed.withColumn("part", F.explode(F.sequence(first, last)))
    begin = F.greatest(F.col("part") * length, F.col("at"))
    size = F.least((F.col("part") + 1) * length, F.col("at") + F.col("length")) - begin
    skip = (begin - F.col("at")).cast("int")
    return parts.select(
        "doc_id",
        (F.col("start") + skip).cast("bigint").alias("start"),
        size.cast("bigint").alias("length"),
        F.substring(F.col("ids"), skip * 4 + 1, (size * 4).cast("int")).alias("ids"),
        "doc_tokens",
        (F.lit(MERGED_FROM) + F.col("part")).cast("bigint").alias("sequence_id"),
        (begin - F.col("part") * length).cast("bigint").alias("offset"),
    )


def report(documents: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's columns."""
    return pack(documents, vocabulary).select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens", "sequence_id", "offset")
