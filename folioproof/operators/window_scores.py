"""Scoring of large pages window by window; what a seam cuts or doubles comes out once."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions.geometry import window_starts
from ..plans.session import keep
from . import stripes as S
from .components import linked_components
from .detect import _survivors, suppress
from .scoring import Registry

EDGES = ("x0", "y0", "x1", "y1")


def score_windows(windows: DataFrame, registry: Registry, localizer: str, nms: float = 0.5, least_score: float = 0.0) -> DataFrame:
    """One row per found box of ``stripes.windows``, in page pixels, and one per window that failed.

    ``locate`` gets a row with raster, width and height of the window and returns dicts with x0,
    y0, x1, y1 in window pixels, score and class_id.  Boxes below ``least_score`` go, then those a
    better one of their class covers at an IoU above ``nms``: seams are closed between the best
    boxes of windows only.  Columns: page, width, height, x, y,
    area_width, area_height, rank (order within the window), the box, ``error`` (null unless the
    window failed or returned something that is no box).
    """
    load, _ = registry.get("localization", localizer)
    places = ["page", "width", "height", "x", "y", "area_width", "area_height"]
    types = ", ".join(f"{c} {windows.schema[c].dataType.simpleString()}" for c in places)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder = load()
        for pdf in parts:
            made = []
            seen = pdf[["page", "raster"]].assign(width=pdf["area_width"], height=pdf["area_height"])
            for place, window in zip(pdf[places].itertuples(index=False), seen.itertuples(index=False)):
                try:
                    boxes = [(i, *(float(b[c]) + o for c, o in zip(EDGES, (place.x, place.y) * 2)), float(b["score"]), int(b["class_id"]), None)
                             for i, b in enumerate(finder.locate(window))]
                    if not all(map(math.isfinite, (v for b in boxes for v in b[1:6]))):
                        raise ValueError("a box or score is not finite")
                    boxes = sorted((b for b in boxes if b[5] >= least_score), key=lambda b: (-b[5], b[0]))
                    kept = _survivors(np.array([(*b[1:5], b[6]) for b in boxes], dtype=float).reshape(-1, 5), nms, None)
                    boxes = [boxes[i] for i in kept]
                except Exception as error:  # noqa: BLE001 - a window's failure is data
                    boxes = [(None, None, None, None, None, None, None, f"{type(error).__name__}: {error}"[:300])]
                made += [(*place, *b) for b in boxes]
            yield pd.DataFrame(made, columns=[*places, "rank", *EDGES, "score", "class_id", "error"])

    return windows.select(*places, "raster").mapInPandas(
        run, f"{types}, rank int, x0 double, y0 double, x1 double, y1 double, score double, class_id int, error string")


def _least(wanted: Column, order: list[Column]) -> Column:
    return F.min_by(wanted, F.struct(*[c.alias(f"_{i}") for i, c in enumerate(order)]))


def across_seams(found: DataFrame, tile: int = 1024, overlap: int = 128, alike: float = 0.5, slack: float = 1.0) -> DataFrame:
    """(page, class_id, id, x0, y0, x1, y1, score, windows): boxes of different windows that show the same thing, as one.

    Two windows see the same thing where both look: boxes of one class are linked when, clipped to
    the area common to their windows, their IoU is at least ``alike``.  Links are transitive.  A box
    that ends within ``slack`` of an inner edge of its window is cut.  Of linked boxes the uncut one
    with the highest score stands for all (ties: smaller y, x, rank of the window); if all are cut,
    the box around them does, with their highest score.  A box meets only windows it reaches into,
    so the join has one small group per class and pair of neighbouring windows.
    """
    boxes = found.where("error IS NULL AND x1 > x0 AND y1 > y0").withColumn("id", F.concat_ws(":", "page", "y", "x", "rank"))
    near = (((F.col("x") > 0) & (F.col("x0") <= F.col("x") + slack)) | ((F.col("y") > 0) & (F.col("y0") <= F.col("y") + slack))
            | ((F.col("x") + F.col("area_width") < F.col("width")) & (F.col("x1") >= F.col("x") + F.col("area_width") - slack))
            | ((F.col("y") + F.col("area_height") < F.col("height")) & (F.col("y1") >= F.col("y") + F.col("area_height") - slack)))
    boxes = boxes.withColumn("cut", near)

    reached = boxes
    for axis, side in (("x", "width"), ("y", "height")):
        low, high, span = F.col(f"{axis}0"), F.col(f"{axis}1"), F.col(f"area_{side}")
        starts = F.filter(window_starts(F.col(side), tile, overlap), lambda s: (s < high) & (s + span > low))
        reached = reached.withColumn(f"_{axis}", F.explode(starts))
    own, other = F.struct("y", "x"), F.struct(F.col("_y").alias("y"), F.col("_x").alias("x"))
    reached = reached.where(own != other).select(
        "page", "class_id", "id", (own < other).alias("_first"), F.least(own, other).alias("_low"), F.greatest(own, other).alias("_high"),
        *[F.greatest(F.col(f"{a}0"), F.col(a), F.col(f"_{a}")).alias(f"{a}0") for a in "xy"],
        *[F.least(F.col(f"{a}1"), F.col(a) + F.col(f"area_{s}"), F.col(f"_{a}") + F.col(f"area_{s}")).alias(f"{a}1") for a, s in (("x", "width"), ("y", "height"))],
    ).where("x1 > x0 AND y1 > y0")

    def side(first: bool, p: str) -> DataFrame:
        return reached.where(F.col("_first") == first).select(
            "page", "class_id", "_low", "_high", *[F.col(c).alias(p + c) for c in ("id", *EDGES)])

    links = (side(True, "l_").join(side(False, "r_"), ["page", "class_id", "_low", "_high"])
             .where(G.box_iou(G.box("l_"), G.box("r_")) >= alike).select(F.col("l_id").alias("u"), F.col("r_id").alias("v")))
    heads = linked_components(links).select(F.col("u").alias("id"), F.col("v").alias("_head"))
    grouped = boxes.join(heads, "id", "left").withColumn("_head", F.coalesce("_head", "id"))
    whole = F.when(~F.col("cut"), F.struct(*EDGES, "score"))
    around = F.struct(*[(F.min if c.endswith("0") else F.max)(c).alias(c) for c in EDGES], F.max("score").alias("score"))
    best = grouped.groupBy("page", "class_id", "_head").agg(
        _least(whole, [F.col("cut"), -F.col("score"), F.col("y"), F.col("x"), F.col("rank")]).alias("_whole"),
        around.alias("_around"), F.count(F.lit(1)).alias("windows"))
    return best.withColumn("_b", F.coalesce("_whole", "_around")).select(
        "page", "class_id", F.col("_head").alias("id"), *[F.col(f"_b.{c}").alias(c) for c in (*EDGES, "score")], "windows")


def score_large_pages(stripes: DataFrame, registry: Registry, localizer: str, tile: int = 1024, overlap: int = 128,
                      tall: int = S.TALL, nms: float = 0.5, at_most: int | None = None, least_score: float = 0.0) -> DataFrame:
    """(page, status, boxes, warnings) of every striped page, its windows scored apart from each other.

    ``boxes`` are sorted by falling score; after seams are closed, overlapping boxes of one class
    are suppressed at ``nms`` and the first ``at_most`` kept.  Status: 'ok', 'unsupported' (no box),
    'error' (a window failed; boxes of the others stay, warnings name the windows) or
    'too-many-windows' (over 64: not scored).
    """
    sizes = keep(S.page_sizes(stripes))
    found = keep(score_windows(S.windows(stripes, tile, overlap, tall), registry, localizer, nms, least_score))
    closed = across_seams(found, tile, overlap)
    # A rank that does not depend on how rows are laid out.
    ranked = closed.withColumn("rank", F.struct("y0", "x0", "y1", "x1", "class_id", "id"))
    kept = suppress(keep(ranked), nms, by_class=True, at_most=at_most)
    boxes = kept.groupBy("page").agg(F.transform(F.array_sort(F.collect_list(F.struct(
        (-F.col("score")).alias("turn"), "rank", F.struct("class_id", *EDGES, "score", "windows").alias("box")))), lambda b: b["box"]).alias("boxes"))
    faults = found.where("error IS NOT NULL").groupBy("page").agg(F.array_sort(F.collect_list(
        F.concat_ws(" ", F.concat_ws(",", "x", "y"), "error"))).alias("warnings"))
    out = (sizes.select("page").join(boxes, "page", "left").join(faults, "page", "left")
           .join(S.too_many(sizes, tile, overlap).withColumn("_many", F.lit(True)), "page", "left"))
    status = (F.when(F.col("_many"), "too-many-windows").when(F.col("warnings").isNotNull(), "error")
              .when(F.col("boxes").isNull(), "unsupported").otherwise("ok"))
    empty = F.array()
    kind = boxes.schema["boxes"].dataType
    return out.select("page", status.alias("status"), F.coalesce("boxes", empty.cast(kind)).alias("boxes"),
                      F.coalesce("warnings", empty.cast("array<string>")).alias("warnings"))

