"""Connected components of a graph given as pairs, by alternating stars; every step is a written table."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import common

#: Pairs that are few enough for one task: a bounded rest needs no rounds over all tasks.
ONE_TASK = 200_000


def _in_one_task(pairs: DataFrame) -> DataFrame:
    """(a, b) with b the smallest of a's component, from at most ONE_TASK pairs."""

    def solve(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order = lambda x: tuple(x.values()) if isinstance(x, dict) else x
        root: dict = {}
        value: dict = {}

        def find(x):
            while root[x] != x:
                root[x] = x = root[root[x]]
            return x

        for batch in batches:
            for x, y in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                ends = []
                for z in (x, y):
                    key = order(z)
                    root.setdefault(key, key)
                    value[key] = z
                    ends.append(find(key))
                root[max(ends)] = min(ends)
        found = [(value[x], value[find(x)]) for x in root if find(x) != x]
        if found:
            types = [batch.schema.field(0).type, batch.schema.field(1).type]
            yield pa.RecordBatch.from_arrays([pa.array(column, kind) for column, kind in zip(zip(*found), types)], ["a", "b"])

    return common.map_arrow(pairs.repartition(1), solve, pairs.schema)


def connected_components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of ``edges`` (a, b) that is not its component's smallest, which is the root.

    Each round joins every node's neighbours to the smallest of them (larger neighbours first, then smaller ones); it needs
    about the logarithm of the longest path. Minima are written before they are joined, so that the rows of a node with very
    many neighbours are split over tasks. At most ONE_TASK pairs are solved in a task; larger graphs are never gathered in one place.
    """
    pairs = edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct()
    pairs = common.stage(pairs, "pairs")
    before = None
    while True:
        state = tuple(pairs.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if state[0] <= ONE_TASK and state != before:
            pairs = common.stage(_in_one_task(pairs), "components")
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        if state == before:
            return pairs.select(F.col("a").alias("node"), F.col("b").alias("root"))
        before = state
        # Large star: neighbours above u go to the least of u and its neighbours.
        both = pairs.unionByName(pairs.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = common.stage(both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m")), "least")
        large = both.join(least, "a").where(F.col("b") > F.col("a")).select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        large, done = common.stage(large, "large-star"), [pairs, least]
        # Small star: neighbours below u, and u, go to the least of them.
        least = common.stage(large.groupBy("a").agg(F.min("b").alias("m")), "least")
        small = large.join(least, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        pairs = common.stage(small.unionByName(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        for table in (*done, large, least):
            common.discard(table)
