"""Vector collections: tables of points with a checked vector size, dealt to buckets of clients; appended to, patched and read by client."""

from __future__ import annotations

import json
import tempfile
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Buckets that clients are dealt to, which are the folders of a collection.
BUCKETS = 16
POINT = "client_id string, point_id bigint, dense array<float>, sparse map<string,double>, payload string, bucket int"


def work_path(spark: SparkSession, name: str) -> str:
    """A new folder beside the cluster's checkpoints, or in a new local one where a session on one machine names none."""
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
        where = tempfile.mkdtemp(prefix="spark-", dir="/tmp")
        spark.conf.set("spark.checkpoint.dir", where)
    return f"{where.rstrip('/')}/{name}-{uuid.uuid4().hex}"


def bucket_of(client) -> Column:
    return F.pmod(F.xxhash64(client), F.lit(BUCKETS)).cast("int")


@dataclass
class Collection:
    """Points (client_id, point_id, dense, sparse, payload) under ``path``; ``size`` is the length that every dense vector has."""

    spark: SparkSession
    path: str
    size: int
    hybrid: bool

    @classmethod
    def open(cls, spark: SparkSession, path: str, size: int, hybrid: bool = True) -> Collection:
        """Create a collection, or take the one that is there: of another size it is refused; whether it has sparse vectors is its own matter."""
        spec = spark._jvm.org.apache.hadoop.fs.Path(f"{path}/spec")
        if spec.getFileSystem(spark._jsc.hadoopConfiguration()).exists(spec):
            own = spark.read.schema("size int, hybrid boolean").parquet(f"{path}/spec").first()
            if own.size != size:
                raise ValueError(f"the collection has vectors of size {own.size}, {size} are asked for")
            return cls(spark, path, own.size, own.hybrid)
        spark.createDataFrame([], POINT).write.partitionBy("bucket").parquet(f"{path}/points")
        spark.createDataFrame([(size, hybrid)], "size int, hybrid boolean").write.parquet(f"{path}/spec")
        return cls(spark, path, size, hybrid)

    def points(self, client: str | None = None) -> DataFrame:
        """All points, or one client's: its bucket alone is read."""
        rows = self.spark.read.schema(POINT).parquet(f"{self.path}/points")
        if client is None:
            return rows.drop("bucket")
        bucket = self.spark.range(1).select(bucket_of(F.lit(client)).alias("b")).first().b
        return rows.where((F.col("bucket") == bucket) & (F.col("client_id") == client)).drop("bucket")

    def index(self, points: DataFrame) -> int:
        """Append the points whose client and id are not there yet, one of each, and say how many.

        A vector that is missing or of another size refuses the whole batch before anything is written. Only buckets of the batch's clients
        are read for ids. Of points with one client and id that of the least payload goes in.
        """
        wrong = points.where(F.col("dense").isNull() | (F.size("dense") != self.size) | F.col("client_id").isNull() | F.col("point_id").isNull())
        if not wrong.isEmpty():
            raise ValueError(f"points must have a client, an id and a dense vector of size {self.size}")
        sparse = F.col("sparse") if self.hybrid and "sparse" in points.columns else F.lit(None).cast("map<string,double>")
        rows = points.select("client_id", "point_id", F.col("dense").cast("array<float>").alias("dense"), sparse.alias("sparse"), "payload", bucket_of("client_id").alias("bucket"))
        touched = [r.bucket for r in rows.select("bucket").distinct().collect()]  # BUCKETS at most
        there = self.spark.read.schema(POINT).parquet(f"{self.path}/points").where(F.col("bucket").isin(touched)).select("bucket", "client_id", "point_id")
        once = rows.groupBy("bucket", "client_id", "point_id").agg(F.min(F.struct("payload", "dense")).alias("p"), F.min_by("sparse", F.struct("payload", "dense")).alias("sparse"))
        new = once.select("client_id", "point_id", "p.dense", "sparse", "p.payload", "bucket").join(there, ["bucket", "client_id", "point_id"], "left_anti")
        # Written aside first: what is counted is what is appended.
        aside = work_path(self.spark, "points")
        new.select("client_id", "point_id", "dense", "sparse", "payload", "bucket").write.parquet(aside)
        staged = self.spark.read.schema(POINT).parquet(aside)
        n = staged.count()
        if n:
            staged.write.mode("append").partitionBy("bucket").parquet(f"{self.path}/points")
        return n

    def registry(self, model: str | None = None) -> DataFrame:
        """A row for each point as the registry of nodes has it."""
        name = self.path.rstrip("/").rsplit("/", 1)[-1]
        return self.points().select("client_id", F.get_json_object("payload", "$.document_id").alias("document_id"), F.lit(name).alias("vector_collection"), F.col("point_id").alias("vector_node_id"), F.lit(model).cast("string").alias("embedding_model"), F.lit(True).alias("is_active"))

    def patch(self, patches: DataFrame) -> int:
        """Set fields of payloads: ``patches`` has client_id, point_id, field, value (JSON text). Gives the number of points changed.

        Other fields stay as they are. Only buckets that hold a point whose payload changes are written anew; where nothing changes nothing
        is written. Of patches of one field the greatest value counts; points that aren't there are left out.
        """
        wanted = patches.groupBy("client_id", "point_id", "field").agg(F.max("value").alias("value")).groupBy("client_id", "point_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("field", "value")))).alias("fields"))
        wanted = wanted.withColumn("bucket", bucket_of("client_id"))
        rows = self.spark.read.schema(POINT).parquet(f"{self.path}/points")
        schema = self.spark.createDataFrame([], "client_id string, point_id bigint, bucket int, payload string").schema

        def merged(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                keep, payloads = [], []
                for i, (payload, fields) in enumerate(zip(batch.column(3).to_pylist(), batch.column(4).to_pylist())):
                    old = json.loads(payload) if payload else {}
                    new = old | {k: json.loads(v) for k, v in fields}
                    if new != old:
                        keep.append(i)
                        payloads.append(json.dumps(new, ensure_ascii=False))
                out = batch.take(pa.array(keep, pa.int64()))
                yield pa.RecordBatch.from_arrays([*out.columns[:3], pa.array(payloads, pa.string())], schema.names)

        hit = rows.join(wanted, ["bucket", "client_id", "point_id"]).select("client_id", "point_id", "bucket", "payload", "fields")
        aside = work_path(self.spark, "patched")
        hit.mapInArrow(merged, schema).write.parquet(f"{aside}/new")
        changed = self.spark.read.schema(schema).parquet(f"{aside}/new")
        touched = [r.bucket for r in changed.select("bucket").distinct().collect()]  # BUCKETS at most
        if not touched:
            return 0
        new = changed.withColumnRenamed("payload", "new_payload").drop("bucket")
        whole = rows.where(F.col("bucket").isin(touched)).join(new, ["client_id", "point_id"], "left")
        whole = whole.select("client_id", "point_id", "dense", "sparse", F.coalesce("new_payload", "payload").alias("payload"), "bucket")
        whole.write.parquet(f"{aside}/whole")
        again = self.spark.read.schema(POINT).parquet(f"{aside}/whole")
        again.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("bucket").parquet(f"{self.path}/points")
        return changed.count()
