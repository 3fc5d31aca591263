"""Are records and files still what the registry says?"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import canonical


def file_integrity(expected: DataFrame, found: DataFrame, code: str) -> DataFrame:
    """(id, code, state) of expected files (id, sha256) that are 'missing' or 'changed' among the found ones (id, sha256).

    An id with several found files is whole only if all of them have the expected digest; an
    expected digest that is null is never met.
    """
    have = found.groupBy("id").agg(F.min("sha256").alias("_lo"), F.max("sha256").alias("_hi"))
    same = (F.col("_lo") == F.col("sha256")) & (F.col("_hi") == F.col("sha256"))
    state = F.when(F.col("_lo").isNull(), "missing").when(~F.coalesce(same, F.lit(False)), "changed")
    return expected.join(have, "id", "left").select("id", F.lit(code).alias("code"), state.alias("state")).where("state IS NOT NULL")


def record_integrity(records: DataFrame, stored: str, *columns: str, code: str = "source-record-integrity") -> DataFrame:
    """(id, code, state) of records whose canonical text no longer has the digest stored with them."""
    now: Column = F.sha2(canonical(*columns), 256)
    return records.where(~F.col(stored).eqNullSafe(now)).select("id", F.lit(code).alias("code"), F.lit("changed").alias("state"))
