"""Helpers of the corpus operators: written tables, hot keys, components."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.session import ship, shared_path

#: A key is hot when it holds more than this share of the rows, so at most HOT_KEYS keys are.
HOT_KEYS = 1000


#: Bytes of a batch of texts on its way to Python and back, whatever the session says: a row can hold a whole text.
BATCH_BYTES = "8m"


def ready(spark: SparkSession) -> None:
    """The settings that the operators rely on; a pipeline stage can be called in any session."""
    ship(spark)
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)


def put(df: DataFrame, name: str) -> DataFrame:
    """``df`` as a Parquet table in the shared folder: computed once, safe from lost executors."""
    path = shared_path(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


def meet(rows: DataFrame, table: DataFrame, key: str, count: str, total: int) -> DataFrame:
    """Inner join of ``rows`` with ``table`` (one row per ``key``; ``count`` is the key's number of rows).

    The few hot keys, HOT_KEYS at most whatever the size, are broadcast, so that the rows
    of a hot key are never dealt to one task; all others meet in a shuffled join.
    """
    limit = max(total // HOT_KEYS, 10_000)
    if total <= limit:
        return rows.join(table, key)
    hot, cold = table.where(F.col(count) > limit), table.where(F.col(count) <= limit)
    return rows.join(F.broadcast(hot), key).unionByName(
        rows.join(F.broadcast(hot.select(key)), key, "left_anti").join(cold, key))


#: Bits of the map of wanted ids: 1 MB whatever the size.
_MAP_BITS = 1 << 23


def among(rows: DataFrame, key: str, wanted: DataFrame, wanted_key: str) -> DataFrame:
    """``rows`` whose ``key`` may be among the wanted ids: a filter before a shuffle, never after it.

    The map of hashed ids has a fixed size and is broadcast; with very many ids it lets
    more rows through, but never holds back a wanted one.
    """
    def place(name: str):
        return F.pmod(F.xxhash64(F.col(name).cast("long")), F.lit(_MAP_BITS)) + 1

    maps = wanted.select(place(wanted_key).alias("_at")).groupBy(F.bitmap_bucket_number("_at").alias("_bucket")).agg(
        F.bitmap_construct_agg(F.bitmap_bit_position("_at")).alias("_map"))
    bit = F.bitmap_bit_position("_at")
    byte = F.conv(F.hex(F.substring(F.col("_map"), (F.floor(bit / 8) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return (rows.withColumn("_at", place(key)).withColumn("_bucket", F.bitmap_bucket_number("_at"))
            .join(F.broadcast(maps), "_bucket").where(F.getbit(byte, (bit % 8).cast("int")) == 1).drop("_at", "_bucket", "_map"))
