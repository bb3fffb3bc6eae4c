"""Approximate vector search: vectors dealt to cells around centres, of which a query meets the nearest few; scores are exact.

Centres are fitted on a bounded sample of vectors and every vector is in the cell of its nearest one. How many cells a query meets is
chosen on the sample, as the fewest by which the sample's own nearest neighbours are found to ``target``; on all vectors, where
neighbours are nearer, more of them are found. ``dense_topk`` stays for exact answers.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .retrieval import QUERY_BLOCK, VECTOR_BLOCK, _Best, _FOUND, _unit, top_ranked

#: Vectors that centres are fitted on and cells, at most; rounds of fitting; sample vectors that stand for queries.
SAMPLE, MOST_CELLS, ROUNDS, TRIALS = 20_000, 2_048, 12, 400


@dataclass(frozen=True)
class Cells:
    """Centres (rows of length 1) and how many of the nearest a query meets."""

    centres: np.ndarray
    probes: int

    def nearest(self, unit: np.ndarray, n: int) -> np.ndarray:
        """The ``n`` nearest cells of each row, nearest first."""
        return np.argsort(-(unit @ self.centres.T), axis=1, kind="stable")[:, :n]


def _centres(unit: np.ndarray, n: int) -> np.ndarray:
    """``n`` centres by rounds of means; a centre that loses all its vectors stays where it is."""
    centres = unit[np.random.default_rng(7).choice(len(unit), n, replace=False)]
    for _ in range(ROUNDS):
        own = np.argmax(unit @ centres.T, axis=1)
        sums = np.zeros_like(centres)
        np.add.at(sums, own, unit)
        length = np.linalg.norm(sums, axis=1, keepdims=True)
        centres = np.where(length > 0, sums / np.maximum(length, 1e-300), centres)
    return centres


def fit(vectors: DataFrame, k: int = 10, target: float = 0.98, sample: int = SAMPLE) -> Cells:
    """Fit cells on the ``sample`` vectors of the least hashes of node_id; the driver holds no more than these."""
    held = vectors.where("embedding IS NOT NULL")
    rows = held.orderBy(F.xxhash64("node_id"), "node_id").select("embedding").limit(sample).toArrow()
    if not rows.num_rows:
        return Cells(np.zeros((1, 1)), 1)
    unit = _unit(rows.column("embedding"))
    n = int(np.clip(np.sqrt(held.count()), 1, min(MOST_CELLS, max(1, len(unit) // 8))))
    cells = Cells(_centres(unit, n), n)
    asked = np.linspace(0, len(unit) - 1, min(TRIALS, len(unit))).astype(int)
    score = unit[asked] @ unit.T
    score[np.arange(len(asked)), asked] = -np.inf
    best = np.argsort(-score, axis=1)[:, :k]
    place = np.argsort(cells.nearest(unit[asked], n), axis=1)  # at which place a query meets each cell
    needed = np.take_along_axis(place, cells.nearest(unit, 1)[:, 0][best], axis=1)
    share = np.cumsum(np.bincount(needed.ravel(), minlength=n)) / needed.size
    return Cells(cells.centres, int(np.searchsorted(share, target)) + 1)


def _with_cells(rows: DataFrame, cells: Cells, n: int) -> DataFrame:
    """``rows`` with a column cell, ``n`` times each."""
    shared = rows.sparkSession.sparkContext.broadcast(cells)  # MOST_CELLS centres at most
    schema = T.StructType([*rows.schema.fields, T.StructField("cell", T.IntegerType())])
    at = rows.columns.index("embedding")

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                near = shared.value.nearest(_unit(batch.column(at)), n)
                again = batch.take(pa.array(np.repeat(np.arange(len(near)), near.shape[1])))
                yield pa.RecordBatch.from_arrays([*again.columns, pa.array(near.ravel().astype(np.int32))], schema.names)

    return rows.mapInArrow(per_task, schema)


def index(vectors: DataFrame, cells: Cells) -> DataFrame:
    """(node_id, embedding, cell) of every vector; rows without one are in none."""
    return _with_cells(vectors.where("embedding IS NOT NULL").select("node_id", "embedding"), cells, 1)


def search(queries: DataFrame, indexed: DataFrame, cells: Cells, k: int, query_block: int = QUERY_BLOCK, vector_block: int = VECTOR_BLOCK) -> DataFrame:
    """(qid, node_id, score, rank): the best ``k`` of the vectors in each query's nearest cells, by exact scores.

    A task joins a block of a cell's queries with a block of its vectors; large cells have many blocks, so no cell is one task's. The
    numbers of blocks are counted; the driver holds a row for each cell.
    """
    asked = _with_cells(queries.where("embedding IS NOT NULL").select("qid", "embedding"), cells, cells.probes)
    of = lambda rows, size, name: rows.groupBy("cell").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    blocks = of(indexed, vector_block, "v_blocks").join(of(asked, query_block, "q_blocks"), "cell")
    blocks = F.broadcast(queries.sparkSession.createDataFrame(blocks.toPandas(), "cell int, v_blocks int, q_blocks int"))  # MOST_CELLS rows at most
    every = lambda c: F.explode(F.sequence(F.lit(0), F.col(c) - 1))
    block = lambda key, c: F.pmod(F.xxhash64(key), F.col(c)).cast("int")
    left = asked.join(blocks, "cell").withColumn("q_block", block("qid", "q_blocks")).withColumn("v_block", every("v_blocks")).select("qid", "embedding", "cell", "q_block", "v_block")
    right = indexed.join(blocks, "cell").withColumn("v_block", block("node_id", "v_blocks")).withColumn("q_block", every("q_blocks")).select("node_id", "embedding", "cell", "q_block", "v_block")

    def pair(some: pa.Table, rows: pa.Table) -> pa.Table:
        if not some.num_rows or not rows.num_rows:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["qid", "node_id", "score"])
        best = _Best(some, k, [], None)
        for batch in rows.to_batches(max_chunksize=8192):
            best.add(batch)
        return best.found()

    keys = ["cell", "q_block", "v_block"]
    found = left.groupBy(*keys).cogroup(right.groupBy(*keys)).applyInArrow(pair, _FOUND)
    return top_ranked(found, ["qid"], [F.desc("score"), F.asc("node_id")], k)
