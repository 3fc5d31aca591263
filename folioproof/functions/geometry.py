"""Geometry of corners and boxes as Column expressions.

A quad is ``array<struct<x:double,y:double>>`` in the order TL, TR, BR, BL of image
coordinates (y grows downwards); a box is four edge columns.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T

DETECTOR_SIZE = 416
STRIDES = [8, 16, 32]  # fixed values: detector strides


def point(x: Column, y: Column) -> Column:
    return F.struct(x.cast("double").alias("x"), y.cast("double").alias("y"))


def _edges(quad: Column) -> list[tuple[Column, Column]]:
    return [(quad[i], quad[(i + 1) % 4]) for i in range(4)]


def cross_products(quad: Column) -> Column:
    """Turn at each corner; all positive for a convex clockwise quad."""
    out = []
    for i in range(4):
        a, b, c = quad[i], quad[(i + 1) % 4], quad[(i + 2) % 4]
        out.append((b["x"] - a["x"]) * (c["y"] - b["y"]) - (b["y"] - a["y"]) * (c["x"] - b["x"]))
    return F.array(*out)


def convex_clockwise(quad: Column, more_than: float = 1.0) -> Column:
    return F.array_min(cross_products(quad)) > more_than


def distance(a: Column, b: Column) -> Column:
    return F.sqrt((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"]))


def edge_lengths(quad: Column) -> Column:
    return F.array(*[distance(a, b) for a, b in _edges(quad)])


def polygon_area(quad: Column) -> Column:
    """Signed shoelace area; positive for clockwise image order."""
    return sum((a["x"] * b["y"] - b["x"] * a["y"] for a, b in _edges(quad)), F.lit(0.0)) / 2


def mean_edge(quad: Column) -> Column:
    return sum((distance(a, b) for a, b in _edges(quad)), F.lit(0.0)) / 4


def square_width(quad: Column) -> Column:
    return mean_edge(quad) / 8


def corner_error(reference: Column, candidate: Column) -> Column:
    """Mean corner distance in pixels."""
    return sum((distance(reference[i], candidate[i]) for i in range(4)), F.lit(0.0)) / 4


def corner_displacement(reference: Column, candidate: Column) -> Column:
    """Mean corner distance in square widths of the reference."""
    return corner_error(reference, candidate) / F.greatest(F.lit(1e-9), square_width(reference))


def image_ordered(quad: Column) -> Column:
    """TL-TR above BR-BL and TL-BL left of TR-BR."""
    return ((quad[0]["y"] + quad[1]["y"] < quad[2]["y"] + quad[3]["y"])
            & (quad[0]["x"] + quad[3]["x"] < quad[1]["x"] + quad[2]["x"]))


def bounds(quad: Column) -> dict[str, Column]:
    xs, ys = [quad[i]["x"] for i in range(4)], [quad[i]["y"] for i in range(4)]
    return {"x0": F.least(*xs), "y0": F.least(*ys), "x1": F.greatest(*xs), "y1": F.greatest(*ys)}


def centre_box(quad: Column, width: Column, height: Column) -> dict[str, Column]:
    """Normalised centre box of a quad."""
    b = bounds(quad)
    return {"cx": (b["x0"] + b["x1"]) / 2 / width, "cy": (b["y0"] + b["y1"]) / 2 / height,
            "w": (b["x1"] - b["x0"]) / width, "h": (b["y1"] - b["y0"]) / height}


def letterbox_scale(width: Column, height: Column, size: int = DETECTOR_SIZE) -> Column:
    return F.least(F.lit(float(size)) / width, F.lit(float(size)) / height)


def letterbox_box(box: dict[str, Column], width: Column, height: Column,
                  size: int = DETECTOR_SIZE) -> dict[str, Column]:
    """A normalised centre box in the frame of the letterboxed page."""
    s = letterbox_scale(width, height, size)
    return {"cx": box["cx"] * width * s, "cy": box["cy"] * height * s,
            "w": box["w"] * width * s, "h": box["h"] * height * s}


def box_area(b: dict[str, Column]) -> Column:
    return (b["x1"] - b["x0"]) * (b["y1"] - b["y0"])


def box_intersection(a: dict[str, Column], b: dict[str, Column]) -> Column:
    w = F.greatest(F.lit(0.0), F.least(a["x1"], b["x1"]) - F.greatest(a["x0"], b["x0"]))
    h = F.greatest(F.lit(0.0), F.least(a["y1"], b["y1"]) - F.greatest(a["y0"], b["y0"]))
    return w * h


def box_iou(a: dict[str, Column], b: dict[str, Column]) -> Column:
    shared = box_intersection(a, b)
    return shared / F.greatest(F.lit(1e-9), box_area(a) + box_area(b) - shared)


def box_overlap(a: dict[str, Column], b: dict[str, Column]) -> Column:
    """Shared area over the smaller area."""
    return box_intersection(a, b) / F.least(box_area(a), box_area(b))


def box(prefix: str = "") -> dict[str, Column]:
    return {k: F.col(prefix + k) for k in ("x0", "y0", "x1", "y1")}


def size_bucket(b: dict[str, Column], size: int = DETECTOR_SIZE) -> Column:
    relative = F.sqrt(box_area(b)) / size
    return F.when(relative < 0.4, "small").when(relative < 0.7, "medium").otherwise("large")


def expanded(b: dict[str, Column], width: Column, height: Column, fraction: float) -> dict[str, Column]:
    pad = F.greatest(b["x1"] - b["x0"], b["y1"] - b["y0"]) * fraction
    return {"x0": F.greatest(F.lit(0.0), b["x0"] - pad), "y0": F.greatest(F.lit(0.0), b["y0"] - pad),
            "x1": F.least(width, b["x1"] + pad), "y1": F.least(height, b["y1"] + pad)}


def project(matrix: list[Column], p: Column) -> Column:
    """Homography of a point; null where the denominator is not positive."""
    z = matrix[6] * p["x"] + matrix[7] * p["y"] + matrix[8]
    return F.when(z > 0, point((matrix[0] * p["x"] + matrix[1] * p["y"] + matrix[2]) / z,
                               (matrix[3] * p["x"] + matrix[4] * p["y"] + matrix[5]) / z))


def shear_rotate(p: Column, width: Column, height: Column, shear: Column, degrees: Column) -> Column:
    """Horizontal shear, then rotation about the page centre."""
    dx = p["x"] + shear * p["y"] - width / 2
    dy = p["y"] - height / 2
    c, s = F.cos(F.radians(degrees)), F.sin(F.radians(degrees))
    return point(width / 2 + dx * c - dy * s, height / 2 + dx * s + dy * c)


def window_starts(length: Column, tile: int, overlap: int) -> Column:
    """Left edges of overlapping windows along one axis; the last one is flush."""
    step = tile - overlap
    last = F.greatest(F.lit(0), length - tile)
    count = F.ceil(last / step).cast("int")
    return F.transform(F.sequence(F.lit(0), count), lambda i: F.least(i * step, last))


def page_windows(pages: DataFrame, tile: int = 1024, overlap: int = 128) -> DataFrame:
    """One row per window of a page (columns ``width``, ``height``); pages needing more
    than 64 windows come out once, with ``violation`` set and no window."""
    axes = (pages.withColumn("_xs", window_starts(F.col("width"), tile, overlap))
            .withColumn("_ys", window_starts(F.col("height"), tile, overlap))
            .withColumn("violation", F.when(F.size("_xs") * F.size("_ys") > 64, "too-many-windows")))
    grid = F.flatten(F.transform("_ys", lambda y: F.transform(
        F.col("_xs"), lambda x: F.struct(x.alias("x"), y.alias("y")))))
    return (axes.withColumn("_w", F.explode_outer(F.when(F.col("violation").isNull(), grid)))
            .select(*pages.columns, "violation", F.col("_w.x").alias("x"), F.col("_w.y").alias("y"),
                    F.when(F.col("_w").isNotNull(), F.least(F.lit(tile), F.col("width"))).alias("tile_width"),
                    F.when(F.col("_w").isNotNull(), F.least(F.lit(tile), F.col("height"))).alias("tile_height")))


def decode_rows(raw: DataFrame, size: int = DETECTOR_SIZE) -> DataFrame:
    """Raw detector rows to boxes in the detector frame.

    ``raw`` has ``row`` (0-based anchor), offsets ``dx dy dw dh``, ``objectness`` and
    ``class_probabilities``.  The anchor of a row is arithmetic, so no table is joined.
    """
    counts = [(size // s) ** 2 for s in STRIDES]
    row, n0, n1 = F.col("row"), counts[0], counts[0] + counts[1]
    stride = F.when(row < n0, STRIDES[0]).when(row < n1, STRIDES[1]).otherwise(STRIDES[2])
    inside = F.when(row < n0, row).when(row < n1, row - n0).otherwise(row - n1)
    side = F.when(row < n0, size // STRIDES[0]).when(row < n1, size // STRIDES[1]).otherwise(size // STRIDES[2])
    probability = F.array_max("class_probabilities")
    out = (raw.withColumn("_s", stride).withColumn("_i", inside).withColumn("_n", side)
           .withColumn("_cx", (F.col("dx") + F.col("_i") % F.col("_n")) * F.col("_s"))
           .withColumn("_cy", (F.col("dy") + F.floor(F.col("_i") / F.col("_n"))) * F.col("_s"))
           .withColumn("_w", F.exp("dw") * F.col("_s")).withColumn("_h", F.exp("dh") * F.col("_s"))
           .withColumn("score", F.col("objectness") * probability)
           .withColumn("class_id", (F.array_position("class_probabilities", probability) - 1).cast("int"))
           .withColumn("x0", F.greatest(F.lit(0.0), F.col("_cx") - F.col("_w") / 2))
           .withColumn("y0", F.greatest(F.lit(0.0), F.col("_cy") - F.col("_h") / 2))
           .withColumn("x1", F.least(F.lit(float(size)), F.col("_cx") + F.col("_w") / 2))
           .withColumn("y1", F.least(F.lit(float(size)), F.col("_cy") + F.col("_h") / 2)))
    return out.where("x1 > x0 and y1 > y0").drop("_s", "_i", "_n", "_cx", "_cy", "_w", "_h")


def raw_violations(raw: DataFrame, size: int = DETECTOR_SIZE) -> DataFrame:
    """Rows of a raw detector output that cannot be decoded, with the reason."""
    numbers = [F.col(c) for c in ("dx", "dy", "dw", "dh", "objectness")]
    finite = F.lit(True)
    for c in numbers:
        finite = finite & c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    rows = sum((size // s) ** 2 for s in STRIDES)
    codes = F.array_compact(F.array(
        F.when(~F.col("row").between(0, rows - 1), F.lit("row")), F.when(~finite, F.lit("not-finite")),
        F.when(~F.col("objectness").between(0, 1), F.lit("objectness")),
        F.when(F.exists("class_probabilities", lambda p: ~p.between(0, 1)), F.lit("class-probability"))))
    return raw.withColumn("code", F.explode(codes))


def to_source(detections: DataFrame, size: int = DETECTOR_SIZE) -> DataFrame:
    """Detector-frame boxes to page pixels (columns ``width``, ``height``), tiny ones dropped."""
    s = letterbox_scale(F.col("width"), F.col("height"), size)
    right = F.greatest(F.lit(1), F.floor(F.col("width") * s)).cast("double")
    bottom = F.greatest(F.lit(1), F.floor(F.col("height") * s)).cast("double")

    def clip(c: Column, top: Column) -> Column:
        return F.greatest(F.lit(0.0), F.least(top, c)) / s

    moved = detections.select(
        *[c for c in detections.columns if c not in ("x0", "y0", "x1", "y1")],
        clip(F.col("x0"), right).alias("x0"), clip(F.col("y0"), bottom).alias("y0"),
        clip(F.col("x1"), right).alias("x1"), clip(F.col("y1"), bottom).alias("y1"))
    return moved.where("x1 - x0 > 1 and y1 - y0 > 1")


def _clip_areas(subject: np.ndarray, clip: np.ndarray) -> np.ndarray:
    """Shared area of quad pairs, shape (n, 4, 2): one half-plane at a time, all rows at once.

    Each row holds its polygon in a padded buffer; cutting a convex polygon by a half
    plane adds at most one vertex, so eight slots suffice.
    """
    n = len(subject)
    poly = np.zeros((n, 9, 2))
    poly[:, :4] = subject
    size = np.full(n, 4)
    slots = np.arange(9)
    for e in range(4):
        start, end = clip[:, e], clip[:, (e + 1) % 4]
        edge = end - start
        valid = slots[None, :] < size[:, None]
        following = np.where(slots[None, :] + 1 < size[:, None], slots[None, :] + 1, 0)
        nxt = np.take_along_axis(poly, following[:, :, None], axis=1)

        def side(p: np.ndarray) -> np.ndarray:
            return (edge[:, None, 0] * (p[:, :, 1] - start[:, None, 1])
                    - edge[:, None, 1] * (p[:, :, 0] - start[:, None, 0]))

        d0, d1 = side(poly), side(nxt)
        keep_here = valid & (d0 >= 0)
        crosses = valid & ((d0 >= 0) != (d1 >= 0))
        gap = np.where(crosses, d0 - d1, 1.0)
        cut = poly + (d0 / gap)[:, :, None] * (nxt - poly)
        both = np.zeros((n, 18, 2))
        both[:, 0::2], both[:, 1::2] = poly, cut
        marks = np.zeros((n, 18), dtype=bool)
        marks[:, 0::2], marks[:, 1::2] = keep_here, crosses
        order = np.argsort(~marks, axis=1, kind="stable")[:, :9]
        poly = np.take_along_axis(both, order[:, :, None], axis=1)
        size = np.minimum(marks.sum(axis=1), 9)
    valid = slots[None, :] < size[:, None]
    following = np.where(slots[None, :] + 1 < size[:, None], slots[None, :] + 1, 0)
    nxt = np.take_along_axis(poly, following[:, :, None], axis=1)
    area = np.where(valid, poly[:, :, 0] * nxt[:, :, 1] - nxt[:, :, 0] * poly[:, :, 1], 0).sum(axis=1) / 2
    return np.where(size >= 3, np.abs(area), 0.0)


def _quads(series: pd.Series) -> np.ndarray:
    flat = np.concatenate([np.asarray(v, dtype=float) for v in series]) if len(series) else np.zeros(0)
    return flat.reshape(len(series), 4, 2)


@F.pandas_udf(T.DoubleType())
def _polygon_iou(pairs: Iterator[tuple[pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for a, b in pairs:
        p, q = _quads(a), _quads(b)
        shared = _clip_areas(p, q)

        def area(z: np.ndarray) -> np.ndarray:
            x, y = z[:, :, 0], z[:, :, 1]
            return np.abs((x * np.roll(y, -1, 1) - np.roll(x, -1, 1) * y).sum(1) / 2)

        union = area(p) + area(q) - shared
        yield pd.Series(np.where(union > 0, shared / np.where(union > 0, union, 1), 0.0))


def flat(quad: Column) -> Column:
    """Corners as eight numbers, the shape the Arrow kernels take."""
    return F.flatten(F.transform(quad, lambda p: F.array(p["x"], p["y"])))


def polygon_iou(a: Column, b: Column) -> Column:
    """IoU of two convex quads (Arrow kernel)."""
    return _polygon_iou(flat(a), flat(b))


def solve_homographies(corners: np.ndarray, edge: float) -> np.ndarray:
    """Homographies from the square (0,0)-(edge,edge) to each quad: (n, 4, 2) -> (n, 9).

    Rows whose system has no solution come back as NaN.
    """
    n = len(corners)
    grid = np.array([[0, 0], [edge, 0], [edge, edge], [0, edge]], dtype=float)
    system, right = np.zeros((n, 8, 8)), np.zeros((n, 8))
    for i, (u, v) in enumerate(grid):
        x, y = corners[:, i, 0], corners[:, i, 1]
        system[:, 2 * i, :3] = (u, v, 1)
        system[:, 2 * i + 1, 3:6] = (u, v, 1)
        system[:, 2 * i, 6], system[:, 2 * i, 7] = -u * x, -v * x
        system[:, 2 * i + 1, 6], system[:, 2 * i + 1, 7] = -u * y, -v * y
        right[:, 2 * i], right[:, 2 * i + 1] = x, y
    out = np.full((n, 9), np.nan)
    fine = np.abs(np.linalg.det(system)) > 1e-10 if edge > 0 else np.zeros(n, dtype=bool)
    if fine.any():
        out[fine, :8] = np.linalg.solve(system[fine], right[fine][:, :, None])[:, :, 0]
        out[fine, 8] = 1.0
    return out


def homography(quad: Column, edge: float) -> Column:
    """Nine coefficients of the square-to-quad homography; null when degenerate."""
    @F.pandas_udf("array<double>")
    def solve(flat_corners: pd.Series) -> pd.Series:
        found = solve_homographies(_quads(flat_corners), edge)
        return pd.Series([None if np.isnan(h[0]) else h for h in found])

    return solve(flat(quad))
