"""Helpers that the operators of this subpackage share: staging of tables and seeds of hashes."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

#: Bits of a bitmap of marked keys (1 MB at any size of the input); what it marks by chance is settled by a join.
MARK_BITS = 1 << 23


def shared_dir(spark: SparkSession) -> str:
    """The folder that the cluster names in spark.checkpoint.dir. Where it is unset a session on one machine gets a new local
    folder; on several machines that would be a different folder on each, so it is an error there."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/docquarry-{name}-{uuid.uuid4().hex}"


#: Whether shuffle files go as soon as the query that made them ends, instead of when the driver happens to collect its garbage.
_CLEANUP_CONF = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def stage(df: DataFrame, name: str, partition_by: list[str] | None = None) -> DataFrame:
    """Write ``df`` to the shared folder and read it again: lineage ends there and lost executors cost a re-read only. The shuffle files of
    the writing are of no more use then and are given back."""
    path = new_path(df.sparkSession, name)
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(*partition_by)
    conf = df.sparkSession.conf
    before = conf.get(_CLEANUP_CONF, None)
    conf.set(_CLEANUP_CONF, "true")
    try:
        writer.parquet(path)
    finally:
        conf.set(_CLEANUP_CONF, before) if before is not None else conf.unset(_CLEANUP_CONF)
    staged = df.sparkSession.read.schema(df.schema).parquet(path)
    staged.__dict__["staged_at"] = path
    return staged


def discard(staged: DataFrame | None) -> None:
    """Delete the files of a table that ``stage`` gave and that nothing reads any more."""
    where = staged.__dict__.get("staged_at") if staged is not None else None
    if where:
        path = staged.sparkSession._jvm.org.apache.hadoop.fs.Path(where)
        path.getFileSystem(staged.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def fresh_name(df: DataFrame, name: str) -> str:
    """``name``, or a longer one where ``df`` has a column of that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def quoted(name: str) -> str:
    """A column's name as it is written in expressions, whatever characters it has."""
    return "`" + name.replace("`", "``") + "`"


def packed(df: DataFrame, **more: Column) -> DataFrame:
    """The whole row of ``df`` as one struct ``row``, and ``more`` columns: no name of the table can clash with them."""
    return df.select(F.struct(*(F.col(quoted(c)) for c in df.columns)).alias("row"), *(c.alias(k) for k, c in more.items()))


def unpacked(df: DataFrame, like: DataFrame) -> DataFrame:
    """The rows of ``packed`` back as columns."""
    return df.select(*(F.col("row").getField(c).alias(c) for c in like.columns))


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def broadcast_if_small(small: DataFrame, rows: int, limit: int = 50_000) -> DataFrame:
    """Hint a broadcast when the counted ``rows`` are within ``limit``; beyond it Spark shuffles and splits skewed keys."""
    return F.broadcast(small) if rows <= limit else small


#: Numbers of a range whose running sums are taken together.
RANGE = 256


def running_totals(totals: DataFrame, key: str, amount: str) -> DataFrame:
    """(key, base): the sum of ``amount`` over all smaller keys (whole numbers, one row each). Sums are taken over ranges of RANGE keys
    first, so no task sees more than that many keys or all ranges."""
    ranged = totals.select(F.col(key).cast("bigint").alias(key), F.col(amount).alias("amount")).withColumn("range", F.expr(f"{key} div {RANGE}"))
    ranged = stage(ranged, "ranged")
    sums = ranged.groupBy("range").agg(F.sum("amount").alias("whole"))
    earlier = Window.orderBy("range").rowsBetween(Window.unboundedPreceding, -1)
    sums = sums.select("range", F.coalesce(F.sum("whole").over(earlier), F.lit(0)).alias("before"))
    within = Window.partitionBy("range").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    base = F.col("before") + F.coalesce(F.sum("amount").over(within), F.lit(0))
    return stage(ranged.join(sums, "range").select(key, base.cast("bigint").alias("base")), "running-totals")


#: Rows of a batch sent to a Python worker. Texts are long, and a batch is held several times over on its way.
BATCH_ROWS = 2_000
_BATCH_CONF = "spark.sql.execution.arrow.maxRecordsPerBatch"


def map_arrow(rows: DataFrame, function: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]], schema) -> DataFrame:
    """``rows.mapInArrow`` with batches of BATCH_ROWS at most; a worker gives back the memory of a task that ends.

    The size of batches is a setting of the session that is read when a plan runs, so it stays lowered for the session.
    """
    conf = rows.sparkSession.conf
    if not 0 < int(conf.get(_BATCH_CONF, "10000")) <= BATCH_ROWS:
        conf.set(_BATCH_CONF, BATCH_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from function(batches)
        pa.default_memory_pool().release_unused()

    return rows.mapInArrow(run, schema)


def marks(keys: DataFrame, bits: int = MARK_BITS) -> np.ndarray:
    """A bitmap with a bit set for each row of ``keys``; the driver gets ``bits`` bits."""
    slot = f"cast(pmod(xxhash64({', '.join(map(quoted, keys.columns))}), {bits}) as int)"
    rows = keys.selectExpr(f"{slot} div 32 AS w", f"shiftleft(1L, {slot} % 32) AS b").groupBy("w").agg(F.bit_or("b").alias("b")).toArrow()
    words = np.zeros(bits // 32, np.uint64)
    words[rows.column("w").to_numpy()] = rows.column("b").to_numpy().astype(np.uint64)
    return words


def with_mark(rows: DataFrame, columns: list[str], bitmap: np.ndarray, marked: bool) -> DataFrame:
    """The rows whose key is marked (or not marked); no shuffle. A key that was put into the bitmap is always marked."""
    shared = rows.sparkSession.sparkContext.broadcast(bitmap)  # of a fixed number of bits
    slot = F.expr(f"cast(pmod(xxhash64({', '.join(map(quoted, columns))}), {len(bitmap) * 32}) as int)")
    slotted = rows.select("*", slot.alias(fresh_name(rows, "slot")))

    def per_task(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            slot = batch.column(batch.num_columns - 1).to_numpy()
            bit = ((shared.value[slot // 32] >> (slot % 32).astype(np.uint64)) & np.uint64(1)).astype(bool)
            out = batch.filter(pa.array(bit == marked))
            yield out.select(list(range(batch.num_columns - 1)))

    return map_arrow(slotted, per_task, rows.schema)
