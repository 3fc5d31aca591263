"""Keyed writes as table algebra: insert-if-absent, immutable insert, latest wins, agreement."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def insert_absent(old: DataFrame, new: DataFrame, key: list[str], order: list[str]) -> DataFrame:
    """Rows to append: the first new row per key that ``old`` does not hold."""
    columns = [c for c in new.columns if c not in key]
    first = new.groupBy(*key).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("_v"))
    return (first.select(*key, *[F.col(f"_v.{c}").alias(c) for c in columns]).select(*new.columns)
            .join(old.select(*key), key, "left_anti"))


def immutable_insert(old: DataFrame, new: DataFrame, key: str, digest: str) -> DataFrame:
    """Judge each key: 'insert', 'same' (no-op) or 'conflict' with a held or another new record."""
    asked = new.groupBy(key).agg(F.min(digest).alias("_lo"), F.max(digest).alias("_hi"))
    held = old.select(key, F.col(digest).alias("_held"))
    outcome = (F.when(F.col("_lo") != F.col("_hi"), "conflict").when(F.col("_held").isNull(), "insert")
               .when(F.col("_held") == F.col("_lo"), "same").otherwise("conflict"))
    return asked.join(held, key, "left").select(key, outcome.alias("outcome"))


def upsert(old: DataFrame, new: DataFrame, key: list[str], version: str) -> DataFrame:
    """The new snapshot: the row of highest version per key, new rows winning ties."""
    columns = [c for c in old.columns if c not in key]
    rows = old.withColumn("_new", F.lit(0)).unionByName(new.withColumn("_new", F.lit(1)))
    best = rows.groupBy(*key).agg(F.max_by(F.struct(*columns), F.struct(version, "_new")).alias("_v"))
    return best.select(*key, *[F.col(f"_v.{c}").alias(c) for c in columns]).select(*old.columns)


def agreement(expected: DataFrame, actual: DataFrame, key: list[str], values: list[str]) -> DataFrame:
    """Keys on which two tables disagree, with the reason; an empty result is agreement."""
    e = expected.select(*key, F.struct(*values).alias("_e"))
    a = actual.select(*key, F.struct(*values).alias("_a"))
    joined = e.join(a, key, "full_outer")
    reason = (F.when(F.col("_a").isNull(), "missing").when(F.col("_e").isNull(), "unexpected")
              .when(~F.col("_e").eqNullSafe(F.col("_a")), "different"))
    return joined.select(*key, reason.alias("reason")).where("reason is not null")


def set_differences(left: DataFrame, right: DataFrame) -> DataFrame:
    """Rows on one side only, each once per surplus copy."""
    return (left.exceptAll(right).withColumn("side", F.lit("left"))
            .unionByName(right.exceptAll(left).withColumn("side", F.lit("right"))))


def control_completeness(expected: DataFrame, actual: DataFrame, key: list[str]) -> DataFrame:
    """Missing, unexpected and repeated controls."""
    seen = actual.groupBy(*key).agg(F.count(F.lit(1)).alias("_n"))
    wanted = expected.select(*key).distinct()
    return (wanted.join(seen, key, "left_anti").withColumn("reason", F.lit("missing"))
            .unionByName(seen.join(wanted, key, "left_anti").select(*key).withColumn("reason", F.lit("unexpected")))
            .unionByName(seen.where("_n > 1").select(*key).withColumn("reason", F.lit("repeated"))))


def overlay(predictions: DataFrame, corrections: DataFrame, key: list[str]) -> DataFrame:
    """Lay human corrections over re-scored squares.

    ``predictions``: key, square, label, geometry; ``corrections``: key, square, label,
    geometry.  The model's label stays beside the shown one.  A board whose geometry moved
    since a correction is refused whole and keeps only its codes.
    """
    moved = (corrections.select(*key, F.col("geometry").alias("_g")).distinct()
             .join(predictions.select(*key, "geometry").distinct(), key)
             .where(~F.col("_g").eqNullSafe(F.col("geometry"))).select(*key).distinct()
             .withColumn("_moved", F.lit(True)))
    edits = corrections.select(*key, "square", F.col("label").alias("_edit"))
    out = predictions.join(edits, [*key, "square"], "left").join(moved, key, "left")
    state = (F.when(F.col("_moved"), "refused").when(F.col("_edit").isNotNull(), "corrected").otherwise("model"))
    return out.select(*key, "square", F.when(F.col("_moved").isNull(), F.coalesce("_edit", "label")).alias("shown"),
                      F.col("label").alias("model_label"), state.alias("state"))


