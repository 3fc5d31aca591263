"""Near duplicates kept up to date: a stored block index that only new codes look into.

What two codes are to each other never changes, so their distance is found once, when the
later of them is first seen, and kept.  What changes is which pages hold which code; that is a
log of (page, revision, code), of which the highest revision counts and a null code is a
page's tombstone.  A generation costs reads in proportion to its changes: new codes look into
the index folders that their own blocks fall into, and into no others.
"""

from __future__ import annotations

import os

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..plans.session import keep
from .pairs import NEAR_BITS, Blocks, choose_blocks

PARTS = 256


class NearIndex:
    """Pages and their codes below ``path``, by generation; see the module.

    ``expected`` is about how many distinct codes will come; it sets the number of blocks, for
    good.  A generation is visible once its commit is written; one that failed before is
    overwritten when sent again, one that is committed is skipped.
    """

    SCHEMAS = {"members": "page long, revision long, code long", "codes": "code long", "keys": "code long, choice int, value long",
               "pairs": "left long, right long, distance int"}

    def __init__(self, spark: SparkSession, path: str, expected: int, k: int = NEAR_BITS, bits: int = 64, parts: int = PARTS) -> None:
        self.spark, self.path, self.parts = spark, path, parts
        self.cut = Blocks(choose_blocks(expected, bits, k), k, bits)
        self.commits = os.path.join(path, "commits")
        spark.createDataFrame([], "gen int").write.mode("append").parquet(self.commits)
        for name in self.SCHEMAS:
            spark.createDataFrame([], f"{self.SCHEMAS[name]}, part int, gen int").write.mode("append").partitionBy("part", "gen").parquet(os.path.join(path, name))

    def _part(self, *names: str) -> Column:
        return F.pmod(F.xxhash64(*names), F.lit(self.parts)).cast("int")

    def generations(self) -> list[int]:
        return sorted(r.gen for r in self.spark.read.schema("gen int").parquet(self.commits).distinct().collect())

    def _read(self, name: str, parts: list[int] | None = None) -> DataFrame:
        """Committed rows of a table; of the given folders only."""
        rows = self.spark.read.schema(f"{self.SCHEMAS[name]}, part int, gen int").parquet(os.path.join(self.path, name))
        rows = rows.where(F.col("gen").isin(self.generations()))
        return rows if parts is None else rows.where(F.col("part").isin(parts))

    def _write(self, name: str, rows: DataFrame, part: Column, gen: int) -> None:
        rows.withColumn("part", part).withColumn("gen", F.lit(gen)).repartition("part").write.mode("overwrite").option(
            "partitionOverwriteMode", "dynamic").partitionBy("part", "gen").parquet(os.path.join(self.path, name))

    def _parts_of(self, rows: DataFrame, *names: str) -> list[int]:
        """The folders of ``rows``: numbers below ``parts``, so few."""
        return sorted(r.p for r in rows.select(self._part(*names).alias("p")).distinct().collect())

    def held(self, keys: DataFrame) -> DataFrame:
        """Index rows of the folders that ``keys`` fall into."""
        return self._read("keys", self._parts_of(keys, "choice", "value")).select("code", "choice", "value")

    def update(self, changes: DataFrame, gen: int) -> None:
        """Take in (page, revision, code) of new and changed pages; a null code takes the page out."""
        if gen in self.generations():
            return
        changes = keep(changes.select("page", "revision", "code"))
        codes = keep(changes.where("code IS NOT NULL").select("code").distinct())
        known = self._read("codes", self._parts_of(codes, "code")).select("code")
        born = keep(codes.join(known, "code", "left_anti"))
        keys = keep(self.cut.keyed(born))
        old = self.cut.meet(keys, self.held(keys)).select(F.least("left", "right").alias("left"), F.greatest("left", "right").alias("right"), "distance")
        self._write("pairs", self.cut.meet(keys, keys).unionByName(old), self._part("left"), gen)
        self._write("keys", keys, self._part("choice", "value"), gen)
        self._write("codes", born, self._part("code"), gen)
        self._write("members", changes, self._part("page"), gen)
        self.spark.createDataFrame([(gen,)], "gen int").coalesce(1).write.mode("append").parquet(self.commits)

    def members(self) -> DataFrame:
        """(page, code) as of now."""
        last = self._read("members").groupBy("page").agg(F.max_by("code", F.struct("revision", "gen")).alias("code"))
        return last.where("code IS NOT NULL")

    def pairs(self) -> DataFrame:
        """(left, right, distance, pages_left, pages_right): near codes that pages hold now, and how many."""
        holders = keep(self.members().groupBy("code").agg(F.count(F.lit(1)).alias("pages")))
        rows = self._read("pairs").select("left", "right", "distance")
        for side in ("left", "right"):
            rows = rows.join(holders.select(F.col("code").alias(side), F.col("pages").alias(f"pages_{side}")), side)
        return rows.select("left", "right", "distance", "pages_left", "pages_right")
