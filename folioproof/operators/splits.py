"""Freeze components into splits by ratio, exactly, without one task that sees them all."""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from ..plans.ordered import running

DEFAULT_RATIOS = {"train": 0.6, "development": 0.2, "calibration": 0.2}


def _earlier(priority: np.ndarray, own: int, other: int, start: np.ndarray, size: np.ndarray,
             target: Sequence[float], limit: np.ndarray) -> np.ndarray:
    """How many turns of split ``other`` come before a turn of ``own`` at ``priority``.

    The j-th turn of a split has priority (start + j*size)/target; equal priorities go to
    the split named first.  The count is solved directly, then corrected by comparing the
    very quotients a step-by-step run would compare.
    """
    def first(j: np.ndarray) -> np.ndarray:
        p = (start[other] + j * size) / target[other]
        return p <= priority if other < own else p < priority

    j = np.floor((priority * target[other] - start[other]) / size).astype(np.int64)
    j = np.clip(j, -1, limit)
    for _ in range(2):
        j = np.where((j >= 0) & ~first(np.maximum(j, 0)), j - 1, j)
    for _ in range(2):
        j = np.where((j < limit) & first(j + 1), j + 1, j)
    return np.minimum(j + 1, limit)


def _rank(own: int, j: np.ndarray, start: np.ndarray, size: np.ndarray, target: Sequence[float],
          limit: np.ndarray) -> np.ndarray:
    """0-based place of the j-th turn of ``own`` among all turns of a run of equal sizes."""
    priority = (start[own] + j * size) / target[own]
    place = j.copy()
    for other in range(len(target)):
        if other != own:
            place = place + _earlier(priority, own, other, start, size, target, limit)
    return place


def turn_owner(rank: np.ndarray, start: np.ndarray, size: np.ndarray, target: Sequence[float],
               limit: np.ndarray) -> np.ndarray:
    """Split that takes the component at ``rank`` of its run (all arguments per row)."""
    owner = np.full(len(rank), -1)
    for own in range(len(target)):
        lo, hi = np.zeros(len(rank), dtype=np.int64), limit.astype(np.int64).copy()
        for _ in range(64):
            if not (lo < hi).any():
                break
            mid = (lo + hi) // 2
            below = _rank(own, mid, start, size, target, limit) < rank
            lo, hi = np.where(below, mid + 1, lo), np.where(below, hi, mid)
        owner = np.where(_rank(own, lo, start, size, target, limit) == rank, own, owner)
    return owner


def _taken(run: int, start: np.ndarray, size: int, target: Sequence[float]) -> np.ndarray:
    """Components each split takes from a run of ``run`` equal ones."""
    one = np.array([run], dtype=np.int64)
    at, sz = start.reshape(-1, 1), np.array([size], dtype=np.int64)
    out = []
    for own in range(len(target)):
        lo, hi = 0, run
        while lo < hi:
            mid = (lo + hi) // 2
            if _rank(own, np.array([mid], dtype=np.int64), at, sz, target, one)[0] < run:
                lo = mid + 1
            else:
                hi = mid
        out.append(lo)
    return np.array(out, dtype=np.int64)


def freeze(sizes: DataFrame, seed: int | str, ratios: dict[str, float] | None = None) -> DataFrame:
    """(component, size, split): largest first, ties by seeded SHA-256, each component to the
    most under-filled split, split order breaking ties.

    The greedy rule looks sequential, but components of one size form a run in which the
    splits take turns in a computable order.  So only the histogram of sizes (at most
    sqrt(2 * items) rows, because distinct sizes must add up to the items) is folded on the
    driver; each component then finds its owner from its place in its run.
    """
    ratios = ratios or DEFAULT_RATIOS
    names = list(ratios)
    histogram = sizes.groupBy("size").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("size")).collect()
    total = sum(r["size"] * r["n"] for r in histogram)
    target = [total * float(ratios[n]) for n in names]
    counts = np.zeros(len(names), dtype=np.int64)
    starts = []
    for row in histogram:
        starts.append((row["size"], row["n"], [int(c) for c in counts]))
        counts = counts + _taken(row["n"], counts, row["size"], target) * row["size"]
    spark = sizes.sparkSession
    runs = spark.createDataFrame(starts, "size long, run long, start array<long>")
    keyed = sizes.withColumn("order", F.sha2(F.concat(F.lit(f"{seed}:"), F.col("component").cast("string")), 256))
    placed = running(keyed, ["size"], [F.col("order"), F.col("component")], number="place")

    @F.pandas_udf("string")
    def owner(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for place, size, run, start in parts:
            if len(place):
                at = np.stack([np.asarray(s, dtype=np.int64) for s in start]).T
                found = turn_owner(place.to_numpy(np.int64) - 1, at, size.to_numpy(np.int64), target,
                                   run.to_numpy(np.int64))
                yield pd.Series([names[i] for i in found])
            else:
                yield pd.Series([], dtype=object)

    return (placed.join(F.broadcast(runs), "size")
            .select("component", "size", owner("place", "size", "run", "start").alias("split")))


def component_sizes(found: DataFrame) -> DataFrame:
    return found.groupBy("component").agg(F.count(F.lit(1)).alias("size"))


def summary(pages: DataFrame, boards: DataFrame) -> DataFrame:
    """Per split: page and board counts, domains seen and the gates a split must pass.

    ``pages`` has split, page, kind, effect, layout; ``boards`` has split, set,
    position_kind, orientation.  The sets are domains of a few values.
    """
    def domain(c: str) -> F.Column:
        return F.array_join(F.array_sort(F.collect_set(c)), ",").alias(c + "s")

    p = pages.groupBy("split").agg(
        F.count(F.lit(1)).alias("pages"),
        F.count_if(F.col("kind") == "boards").alias("positive_pages"),
        F.count_if(F.col("kind") == "negative").alias("negative_pages"),
        F.count_if(F.col("kind") == "partial").alias("partial_pages"), domain("effect"), domain("layout"))
    b = boards.groupBy("split").agg(
        F.count(F.lit(1)).alias("boards"), domain("set"), domain("position_kind"),
        F.count_if(F.col("orientation") == "white-bottom").alias("white_bottom"),
        F.count_if(F.col("orientation") == "black-bottom").alias("black_bottom"))
    out = p.join(b, "split", "left").fillna(0, ["boards", "white_bottom", "black_bottom"]).fillna(
        "", ["sets", "position_kinds"])
    return out.withColumn("failed_gates", F.array_join(F.array_compact(F.array(
        F.when(F.col("boards") == 0, F.lit("no-boards")),
        F.when(F.col("negative_pages") == 0, F.lit("no-negatives")),
        *[F.when(F.col(c) == "", F.lit(f"missing-{c}")) for c in ("sets", "effects", "layouts", "position_kinds")],
        F.when((F.col("white_bottom") == 0) | (F.col("black_bottom") == 0), F.lit("missing-orientation")))), ","))
