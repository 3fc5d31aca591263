"""Snapshots as trees of digests over key prefixes, compared without reading what agrees.

A row's place is the SHA-256 of its key, its content the SHA-256 of its values.  A leaf is the
digest of the rows whose place begins with the same hex digits, in the order of place; a node
is the digest of its children in order, one digit shorter; the root names the snapshot.
Places are uniform whatever the keys, so leaves are small and alike in size.
"""

from __future__ import annotations

import os

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.scalar import canonical
from ..plans.session import keep

#: Hex digits of a leaf's prefix, and of the folders that rows are stored in.
DIGITS, FOLDER = 4, 2


def placed(rows: DataFrame, key: str) -> DataFrame:
    """``rows`` with (place, content); keys are unique and not null."""
    return rows.select("*", F.sha2(F.col(key).cast("string"), 256).alias("place"), F.sha2(canonical(*sorted(rows.columns)), 256).alias("content"))


def tree(rows: DataFrame, digits: int = DIGITS) -> DataFrame:
    """(prefix, digest, rows) of all nodes of :func:`placed` rows, the root with the empty prefix."""
    level = keep(rows.groupBy(F.substring("place", 1, digits).alias("prefix")).agg(
        F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "content"))), lambda r: r["content"]), ""), 256).alias("digest"),
        F.count(F.lit(1)).alias("rows")))
    nodes = level
    for size in range(digits - 1, -1, -1):
        # At most sixteen children a node.
        level = level.groupBy(F.substring("prefix", 1, size).alias("prefix")).agg(
            F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("prefix", "digest"))), lambda c: c["digest"]), ""), 256).alias("digest"),
            F.sum("rows").alias("rows"))
        nodes = nodes.unionByName(level)
    return nodes


def write(rows: DataFrame, key: str, path: str, digits: int = DIGITS) -> None:
    """Store a snapshot: rows by folders of places, and the tree above them by prefix length."""
    found = placed(rows, key).withColumn("folder", F.substring("place", 1, FOLDER))
    found.repartition("folder").write.mode("errorifexists").partitionBy("folder").parquet(os.path.join(path, "rows"))
    stored = rows.sparkSession.read.parquet(os.path.join(path, "rows"))
    # The tree is of what was stored, not of what was to be stored.
    tree(stored.select("place", "content"), digits).withColumn("level", F.length("prefix")).write.mode("errorifexists").partitionBy("level").parquet(
        os.path.join(path, "tree"))


def root(spark: SparkSession, path: str) -> DataFrame:
    """(rows, digest) of a stored snapshot; an empty one has no root."""
    return _nodes(spark, path, 0).select("rows", "digest")


def _nodes(spark: SparkSession, path: str, level: int) -> DataFrame:
    return spark.read.schema("prefix string, digest string, rows long, level int").parquet(os.path.join(path, "tree")).where(F.col("level") == level)


def differing(spark: SparkSession, old: str, new: str, digits: int = DIGITS) -> DataFrame:
    """(prefix) of the leaves that differ, found from the root down; nodes below equal ones are not looked at."""
    open_ = None
    for level in range(digits + 1):
        a, b = _nodes(spark, old, level), _nodes(spark, new, level)
        if open_ is not None:
            parent = F.substring("prefix", 1, level - 1)
            a, b = (x.join(open_.withColumnRenamed("prefix", "_p"), parent == F.col("_p"), "left_semi") for x in (a, b))
        both = a.select("prefix", F.col("digest").alias("x")).join(b.select("prefix", F.col("digest").alias("y")), "prefix", "full_outer")
        open_ = keep(both.where("NOT x <=> y").select("prefix"))
    return open_


def folders(leaves: DataFrame) -> list[str]:
    """The folders of leaves: 256 at most."""
    return sorted(r.f for r in leaves.select(F.substring("prefix", 1, FOLDER).alias("f")).distinct().collect())


def changes(spark: SparkSession, old: str, new: str, key: str, digits: int = DIGITS) -> DataFrame:
    """(key, state): 'changed', 'missing' (in the old snapshot only) or 'extra', from the differing leaves alone."""
    leaves = differing(spark, old, new, digits)
    opened = folders(leaves)

    def rows(path: str, name: str) -> DataFrame:
        stored = spark.read.parquet(os.path.join(path, "rows")).where(F.col("folder").cast("string").isin(opened))
        return stored.join(leaves, F.substring("place", 1, digits) == F.col("prefix"), "left_semi").select(key, F.col("content").alias(name))

    both = rows(old, "x").join(rows(new, "y"), key, "full_outer")
    state = F.when(F.col("y").isNull(), "missing").when(F.col("x").isNull(), "extra").when(F.col("x") != F.col("y"), "changed")
    return both.select(key, state.alias("state")).where("state IS NOT NULL")
