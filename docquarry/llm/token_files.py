"""Token ids of a corpus as files of independently decodable blocks, in ascending doc_id order.

Documents are dealt to files by ranges of doc_id, encoded, and coded in blocks of whole documents. The blocks of a shard (a
bounded run of one file's documents) share one frequency table, counted over all of the shard's ids. A file is a Parquet
file whose rows are shards, so writing has Spark's commit protocol and a lost executor costs its own files only.

Edge cases: a null text counts as empty and has the end id alone; rows that repeat a doc_id are kept, next to each other
and in the order of a hash of their text; a null doc_id comes first; an empty table gives no block; only doc_id and text are
read. A single very long text is one block, whose checkpoints let it be decoded in parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common, rans
from .textarrays import slices
from .tokens import encoder

#: Ids of a block and of a shard (which has one frequency table), before the document that passes it; bytes of text of a file.
BLOCK_IDS, SHARD_IDS, FILE_BYTES = 300_000, 4_000_000, 24_000_000
#: Files at most; those of a larger corpus grow.
MOST_FILES = 20_000
END_ID = 2
SCHEMA = "file_no int, shard_no int, start bigint, n_ids bigint, table binary, blocks array<binary>, doc_ids array<bigint>, lengths array<bigint>"


class _Shards:
    """Gathers the documents of one task and gives out the rows of full shards."""

    def __init__(self, file_no: int):
        self.file_no, self.shard_no, self.start = file_no, 0, 0
        self._clear()

    def _clear(self) -> None:
        self.docs: list[int | None] = []
        self.ids: list[np.ndarray] = []
        self.n = 0

    def add(self, doc_id: int | None, ids: np.ndarray) -> None:
        self.docs.append(doc_id)
        self.ids.append(ids)
        self.n += len(ids)

    def flush(self) -> Iterator[pa.RecordBatch]:
        if not self.docs:
            return
        table = rans.Table.from_counts(*np.unique(np.concatenate(self.ids), return_counts=True))
        blocks, begin, size = [], 0, 0
        for i, ids in enumerate(self.ids):
            size += len(ids)
            if size >= BLOCK_IDS or i == len(self.ids) - 1:
                blocks.append(rans.encode(np.concatenate(self.ids[begin : i + 1]), table))
                begin, size = i + 1, 0
        row = {"file_no": self.file_no, "shard_no": self.shard_no, "start": self.start, "n_ids": self.n, "table": table.to_bytes(), "blocks": blocks}
        row |= {"doc_ids": self.docs, "lengths": [len(x) for x in self.ids]}
        yield pa.RecordBatch.from_pylist([row], _ARROW)
        self.start, self.shard_no = self.start + self.n, self.shard_no + 1
        self._clear()


_ARROW = pa.schema(
    [("file_no", pa.int32()), ("shard_no", pa.int32()), ("start", pa.int64()), ("n_ids", pa.int64()), ("table", pa.binary()), ("blocks", pa.list_(pa.binary()))]
    + [("doc_ids", pa.list_(pa.int64())), ("lengths", pa.list_(pa.int64()))]
)


def write(documents: DataFrame, path: str, vocabulary: str, keeps_space: bool = True, end_id: int = END_ID) -> None:
    """Encode every text and write the files under ``path``."""
    source = documents.select(F.col("doc_id").cast("bigint").alias("doc_id"), "text")
    size = source.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n_files = min(max(1, -(-size // FILE_BYTES)), MOST_FILES)
    dealt = source.withColumn("tie", F.xxhash64("text")).repartitionByRange(n_files, "doc_id", "tie").sortWithinPartitions("doc_id", "tie")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shards = _Shards(TaskContext.get().partitionId())
        encode = encoder(vocabulary, keeps_space).encode
        for batch in batches:
            docs = batch.column(0).to_pylist()
            for flat in slices(batch.column(1)):
                ids, offs = encode(flat)
                for d in range(flat.n):
                    shards.add(docs[flat.first + d], np.append(ids[offs[d] : offs[d + 1]], np.uint32(end_id)))
                    if shards.n >= SHARD_IDS:
                        yield from shards.flush()
        yield from shards.flush()

    common.map_arrow(dealt.select("doc_id", "text"), per_task, SCHEMA).write.option("compression", "uncompressed").parquet(path)


def read_documents(spark, path: str) -> DataFrame:
    """Decode the files: doc_id, start (ids of all documents before it), ids (little-endian unsigned 32-bit) of each document."""
    files = spark.read.parquet(path)
    base = common.running_totals(files.groupBy("file_no").agg(F.sum("n_ids").alias("n")), "file_no", "n")
    files = files.join(common.broadcast_if_small(base, base.count()), "file_no")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                table = rans.Table.from_bytes(row["table"])
                ids = np.concatenate([rans.decode(x, table) for x in row["blocks"]]).astype("<u4")
                offs = np.concatenate(([0], np.cumsum(row["lengths"])))
                raw = ids.tobytes()
                starts = row["base"] + row["start"] + offs[:-1]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(row["doc_ids"], pa.int64()), pa.array(starts, pa.int64()), pa.array([raw[4 * a : 4 * b] for a, b in zip(offs[:-1], offs[1:])], pa.binary())],
                    ["doc_id", "start", "ids"],
                )

    return common.map_arrow(files, per_task, "doc_id bigint, start bigint, ids binary")


def report(documents: DataFrame, vocabulary: str) -> DataFrame:
    """The contract's columns, from the files read back."""
    spark = documents.sparkSession
    path = common.new_path(spark, "token-files")
    write(documents, path, vocabulary)
    return read_documents(spark, path).select("doc_id", "start", (F.octet_length("ids") / 4).cast("bigint").alias("n_tokens"), F.crc32("ids").alias("ids_crc32"))
