"""Immutable snapshots, their identity and the validation report."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..functions.scalar import canonical
from ..sources.manifests import files
from . import pairs as P

EXPORTED = ["train", "dev"]  # fixed values: qualification and regression never leave


def selection(samples: DataFrame, sources: DataFrame, exclusions: DataFrame, dropped: DataFrame) -> DataFrame:
    """Accepted train/dev pages of active sources without the b side of confirmed duplicates.

    ``exclusions`` is the closure over lineage (``components.exclusion_closure``), not its seeds alone.
    """
    return (samples.where("accepted").join(dropped, "id", "left_anti")
            .join(exclusions.select("source"), "source", "left_anti")
            .join(sources.where(F.col("split").isin(EXPORTED)).select(F.col("id").alias("source"), "split"), "source")
            .withColumn("detector_eligible", F.col("kind").isin("boards", "negative")))


def fingerprint(df: DataFrame, *columns: str) -> DataFrame:
    """Order-independent digest of a table in one row.

    Each row is hashed; the digest is the SHA-256 of the row count and of the sums of four
    60-bit pieces of the hashes.  Sums combine before the shuffle, so nothing but a handful
    of numbers moves, at any size.
    """
    h = F.sha2(canonical(*(columns or df.columns)), 256)
    return _summed(df.select(h.alias("h")))


def fingerprint_of_hashes(df: DataFrame, column: str) -> DataFrame:
    return _summed(df.select(F.col(column).alias("h")))


def _summed(hashes: DataFrame) -> DataFrame:
    def piece(i: int) -> Column:
        part = F.conv(F.substring("h", 1 + 15 * i, 15), 16, 10).cast("decimal(20,0)")
        return F.coalesce(F.sum(part), F.lit(0)).cast("decimal(38,0)").alias(f"s{i}")

    sums = hashes.agg(F.count(F.lit(1)).alias("n"), *[piece(i) for i in range(4)])
    text = F.concat_ws(":", *[F.col(c).cast("string") for c in ("n", "s0", "s1", "s2", "s3")])
    return sums.select(F.col("n").alias("rows"), F.sha2(text, 256).alias("digest"))


def label_lines(pages: DataFrame) -> DataFrame:
    """(sample, text): detector label text per eligible page; empty for negatives.

    A page holds at most 64 boards, so its lines are built from its own array.
    """
    def line(b: Column) -> Column:
        box = G.centre_box(b["corners"], F.col("width"), F.col("height"))
        return F.concat_ws(" ", F.lit("0"), *[F.format_string("%s", _nine(v)) for v in box.values()])

    lines = F.array_join(F.transform("boards", line), "\n")
    return pages.where("detector_eligible").select(
        F.col("id").alias("sample"), F.when(F.size("boards") > 0, F.concat(lines, F.lit("\n"))).otherwise("").alias("text"))


def _nine(value: Column) -> Column:
    """Nine significant digits, without trailing zeros."""
    places = F.greatest(F.lit(0), F.lit(8) - F.floor(F.log10(F.greatest(F.abs(value), F.lit(1e-300))))).cast("int")
    out = F.lit(None).cast("string")
    for p in range(0, 17):
        out = F.when(places == p, F.format_string(f"%.{p}f", value)).otherwise(out)
    trimmed = F.when(out.contains("."), F.regexp_replace(F.regexp_replace(out, "0+$", ""), r"\.$", "")).otherwise(out)
    return F.when(value == 0, "0").otherwise(trimmed)


def write_snapshot(rows: DataFrame, base: str, recipe: dict[str, str]) -> str:
    """Write rows below ``base/<identity>``, partitioned by split; an existing one is refused.

    The identity covers the recipe and the rows, so equal content has one path.  Spark's
    commit protocol makes the write atomic per task and the folder final at job commit.
    """
    spark = rows.sparkSession
    content = fingerprint(rows).first()["digest"]
    text = "\n".join([f"{k}={v}" for k, v in sorted(recipe.items())] + [content])
    export_id = spark.range(1).select(F.sha2(F.lit(text), 256).alias("d")).first()["d"]
    path = f"{base.rstrip('/')}/{export_id}"
    rows.write.mode("errorifexists").partitionBy("split").parquet(path)
    return path


def write_manifest(spark: SparkSession, path: str, target: str) -> None:
    """Hash every file of an output; the manifest goes beside it."""
    files(spark, path, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "length", "sha256") \
        .write.mode("errorifexists").json(target)


def validation_report(sources: DataFrame, samples: DataFrame, exclusions: DataFrame, sided: DataFrame,
                      reviews: DataFrame, jobs: DataFrame, rule_violations: DataFrame) -> DataFrame:
    """(code, rows) of everything that blocks an export, from one union of rule outputs.

    ``rule_violations`` brings the codes of row rules and integrity joins (column code).
    """
    active = sources.join(exclusions.select(F.col("source").alias("id")), "id", "left_anti")
    pages = samples.join(exclusions.select("source"), "source", "left_anti")
    lineage = P.cross_split_lineage(active).select(F.lit("cross-split-lineage").alias("code"))
    duplicates = P.blockers(sided).select("code")
    human = reviews.where("human").select(F.col("sample").alias("id"), "revision", "content")
    counted = pages.where("accepted").join(P.dropped_duplicates(sided), "id", "left_anti")
    unreviewed = counted.join(human, ["id", "revision", "content"], "left_anti").select(F.lit("review-integrity").alias("code"))
    waiting = (jobs.join(exclusions.select("source"), "source", "left_anti").where("state <> 'done'")
               .select(F.lit("acquisition-incomplete").alias("code")))
    found = lineage
    for part in (duplicates, unreviewed, waiting, rule_violations.select("code")):
        found = found.unionByName(part)
    return found.groupBy("code").agg(F.count(F.lit(1)).alias("rows"))
