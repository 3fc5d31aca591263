"""A keyed table on files that a stream keeps up to date, bucket by bucket."""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

from ..operators.upsert import upsert

BUCKETS = 64


class BucketTable:
    """The latest row per key, in buckets of keys; a batch rewrites the buckets it touches and no others.

    A batch writes each touched bucket anew as partition (bucket, batch) and then one small
    file with the buckets it wrote: the commit.  Readers take the last committed batch of each
    bucket.  A batch whose commit is there is skipped when it is replayed; one that failed
    half-way has no commit, is seen by nobody, and its replay overwrites just its own
    partitions (dynamic partition overwrite).  Older partitions stay for readers that began
    earlier until :meth:`stale` names them for removal.  One writer at a time, as a stream is.
    """

    def __init__(self, spark: SparkSession, path: str, schema: StructType, key: list[str], version: str, buckets: int = BUCKETS) -> None:
        self.spark, self.schema, self.key, self.version, self.buckets = spark, schema, key, version, buckets
        self.rows, self.commits = os.path.join(path, "rows"), os.path.join(path, "commits")

    def _bucket(self):
        return F.pmod(F.xxhash64(*self.key), F.lit(self.buckets)).cast("int")

    def _committed(self) -> DataFrame:
        # An empty write makes the folder, so that the first read finds it.
        if not getattr(self, "_made", False):
            self.spark.createDataFrame([], "batch long, bucket int").write.mode("append").parquet(self.commits)
            self.spark.createDataFrame([], StructType([*self.schema.fields])).withColumn("bucket", F.lit(0)).withColumn("batch", F.lit(0).cast("long")).limit(
                0).write.mode("append").partitionBy("bucket", "batch").parquet(self.rows)
            self._made = True
        return self.spark.read.schema("batch long, bucket int").parquet(self.commits)

    def _stored(self) -> DataFrame:
        return self.spark.read.schema(f"{', '.join(f'`{f.name}` {f.dataType.simpleString()}' for f in self.schema)}, bucket int, batch long").parquet(self.rows)

    def _current(self, latest: list) -> DataFrame:
        """Rows of the given (bucket, batch): both are folders, so nothing else is read."""
        where = F.lit(False)
        if latest:
            # At most one entry per bucket.
            where = F.array_contains(F.array(*[F.lit(f"{r['bucket']}:{r['batch']}") for r in latest]), F.concat_ws(":", "bucket", "batch"))
            where = where & F.col("bucket").isin([r["bucket"] for r in latest]) & F.col("batch").isin(sorted({r["batch"] for r in latest}))
        return self._stored().where(where).select(*self.schema.names)

    def _latest(self) -> list:
        return self._committed().groupBy("bucket").agg(F.max("batch").alias("batch")).collect()

    def apply(self, batch: DataFrame, batch_id: int) -> None:
        """Merge one micro-batch; for ``foreachBatch``."""
        if not self._committed().where(F.col("batch") == batch_id).isEmpty():
            return
        rows = batch.select(*self.schema.names)
        touched = {r["b"] for r in rows.select(self._bucket().alias("b")).distinct().collect()}
        if not touched:
            return
        old = self._current([r for r in self._latest() if r["bucket"] in touched])
        merged = upsert(old, rows, self.key, self.version).withColumn("bucket", self._bucket()).withColumn("batch", F.lit(batch_id).cast("long"))
        merged.repartition(min(len(touched), self.buckets), "bucket").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy(
            "bucket", "batch").parquet(self.rows)
        self.spark.createDataFrame([(batch_id, b) for b in sorted(touched)], "batch long, bucket int").coalesce(1).write.mode("append").parquet(self.commits)

    def read(self) -> DataFrame:
        """The latest committed row of every key."""
        return self._current(self._latest())

    def stale(self) -> DataFrame:
        """(bucket, batch): committed partitions that a later batch replaced."""
        done = self._committed()
        return done.join(F.broadcast(done.groupBy("bucket").agg(F.max("batch").alias("last"))), "bucket").where("batch < last").select("bucket", "batch")


def keep_latest(stream: DataFrame, table: BucketTable, checkpoint: str):
    """A writer of ``stream`` into ``table``: start() it."""
    return stream.writeStream.foreachBatch(table.apply).option("checkpointLocation", checkpoint)
