"""Large rasters as row stripes, and areas cut out of them.

A page of 24 million pixels is 72 MB in one row.  As stripes of ``tall`` rows no row exceeds
``tall`` times a page's width, and an area (a window, the surroundings of a board) is put
together from the pieces of the stripes it crosses.  Stripes are cut where they lie: only
pieces are shuffled, so the bytes moved are those of the areas.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import raster as R
from ..functions.geometry import flat, page_windows, polygon_area, solve_homographies, window_starts
from .images import _emit, _type

TALL = 64
EMPTY = "CAST('' AS BINARY)"


def striped(pages: DataFrame, tall: int = TALL) -> DataFrame:
    """(page, width, height, stripe, band): the rows of a page in stripes of ``tall`` rows.

    ``pages`` has page, raster, width, height.  A page whose raster is null, or whose length is
    not three or four bytes a pixel, has no stripes; ``images.raster_violations`` names it.
    """
    sound = pages.where("width > 0 AND height > 0 AND octet_length(raster) IN (3L * width * height, 4L * width * height)")
    line = F.expr("CAST(octet_length(raster) div height AS INT)")
    return (sound.select("page", "width", "height", "raster", line.alias("_line"),
                         F.explode(F.expr(f"sequence(0, CAST((height - 1) div {tall} AS INT))")).alias("stripe"))
            .select("page", "width", "height", "stripe",
                    F.expr(f"substring(raster, stripe * {tall} * _line + 1, least({tall}, CAST(height AS INT) - stripe * {tall}) * _line)").alias("band")))


def page_sizes(stripes: DataFrame) -> DataFrame:
    """(page, width, height) of all striped pages; the scan needs no band."""
    return stripes.where("stripe = 0").select("page", "width", "height")


def _joined(bytes_list: Column) -> Column:
    return F.aggregate(bytes_list, F.expr(EMPTY), lambda done, piece: F.concat(done, piece))


def _areas(located: DataFrame, keys: list[str], tall: int) -> DataFrame:
    """(keys, x, y, area_width, area_height, raster) from rows of a stripe beside an area that crosses it."""
    line = "octet_length(band) div {rows}".format(rows=f"least({tall}, CAST(height AS INT) - stripe * {tall})")
    known = located.withColumn("_line", F.expr(f"CAST({line} AS INT)")).withColumn("_deep", F.expr("CAST(_line div width AS INT)"))
    piece = F.expr(f"""aggregate(sequence(greatest(0, y - stripe * {tall}), least({tall} - 1, y + area_height - 1 - stripe * {tall})), {EMPTY},
      (done, r) -> concat(done, substring(band, r * _line + x * _deep + 1, area_width * _deep)))""")
    cells = known.select(*keys, "x", "y", "area_width", "area_height", "stripe", piece.alias("piece"))
    whole = cells.groupBy(*keys, "x", "y", "area_width", "area_height").agg(F.array_sort(F.collect_list(F.struct("stripe", "piece"))).alias("_p"))
    return whole.select(*keys, "x", "y", "area_width", "area_height", _joined(F.transform("_p", lambda p: p["piece"])).alias("raster"))


def crops(stripes: DataFrame, areas: DataFrame, tall: int = TALL) -> DataFrame:
    """Rasters of ``areas`` (page, x, y, area_width, area_height, any keys), each made from its own stripes.

    Areas must lie inside their pages and be distinct; an area of a page without stripes gives no row.
    Stripes and areas meet in a sorted join: a plan made before a band is seen takes it for a few
    bytes and would send all of them through the driver.
    """
    keys = [c for c in areas.columns if c not in ("x", "y", "area_width", "area_height")]
    ints = [F.col(c).cast("int").alias(c) for c in ("x", "y", "area_width", "area_height")]
    wanted = areas.where("area_width > 0 AND area_height > 0").select(*keys, *ints).withColumn(
        "stripe", F.explode(F.expr(f"sequence(y div {tall}, (y + area_height - 1) div {tall})").cast("array<int>")))
    return _areas(stripes.hint("merge").join(wanted, ["page", "stripe"]), keys, tall)


def windows(stripes: DataFrame, tile: int = 1024, overlap: int = 128, tall: int = TALL) -> DataFrame:
    """(page, width, height, x, y, area_width, area_height, raster): the overlapping windows of every page.

    The plan is that of ``geometry.page_windows``, worked out beside each stripe, so nothing is
    joined.  Pages that need more than 64 windows give none; ``too_many`` names them.
    """
    top, bottom = F.col("stripe") * tall, F.col("stripe") * tall + tall
    rows = (stripes.withColumn("_xs", window_starts(F.col("width"), tile, overlap))
            .withColumn("_ys", window_starts(F.col("height"), tile, overlap)).where("size(_xs) * size(_ys) <= 64")
            .withColumn("_ys", F.filter("_ys", lambda y: (y < bottom) & (y + tile > top))))
    grid = F.flatten(F.transform("_ys", lambda y: F.transform("_xs", lambda x: F.struct(x.alias("x"), y.alias("y")))))
    located = rows.withColumn("_w", F.explode(grid)).select(
        "page", "width", "height", "stripe", "band", F.col("_w.x").cast("int").alias("x"), F.col("_w.y").cast("int").alias("y"),
        F.least(F.lit(tile), "width").cast("int").alias("area_width"), F.least(F.lit(tile), "height").cast("int").alias("area_height"))
    return _areas(located, ["page", "width", "height"], tall)


def too_many(sizes: DataFrame, tile: int = 1024, overlap: int = 128) -> DataFrame:
    """(page) of the pages (page, width, height) that need more than 64 windows."""
    return page_windows(sizes, tile, overlap).where("violation IS NOT NULL").select("page")


def rectified(stripes: DataFrame, boards: DataFrame, size: int = R.GRID, tall: int = TALL) -> DataFrame:
    """(page, number, grid) as ``images.rectified`` makes it, each board from the stripes it lies on.

    The positions a grid reads are worked out from the corners first; their bounds are the area
    that is cut.  Positions outside the page read its edge.  Boards without a usable homography
    come out with a null grid, boards of pages without stripes not at all.
    """
    ok = F.coalesce(polygon_area(F.col("corners")) > 1e-6, F.lit(False))
    sized = boards.join(page_sizes(stripes), "page").select(
        "page", F.col("number").cast("long").alias("number"), "width", "height", flat(F.col("corners")).alias("corners"), ok.alias("ok"))
    kind = _type(stripes)
    at_y, at_x = np.indices((size, size), dtype=np.float64)

    def plan(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = []
            for r in pdf.itertuples(index=False):
                area, h = (0, 0, 0, 0), None
                if r.ok:
                    corners = R.edge_corners(np.array(r.corners, dtype=float).reshape(1, 4, 2), r.width, r.height)
                    h = solve_homographies(corners, size - 1)[0]
                    z = h[6] * at_x + h[7] * at_y + h[8]
                    with np.errstate(all="ignore"):
                        xs, ys = (h[0] * at_x + h[1] * at_y + h[2]) / z, (h[3] * at_x + h[4] * at_y + h[5]) / z
                    if np.isfinite(xs).all() and np.isfinite(ys).all():
                        (x0, x1), (y0, y1) = ((int(np.clip(np.floor(v.min()), 0, n - 1)), int(np.clip(np.floor(v.max()) + 1, 0, n - 1)))
                                              for v, n in ((xs, r.width), (ys, r.height)))
                        area = (x0, y0, x1 - x0 + 1, y1 - y0 + 1)
                made.append((r.page, r.number, None if area[2] == 0 else list(h), *area))
            yield pd.DataFrame(made, columns=["page", "number", "h", "x", "y", "area_width", "area_height"])

    planned = sized.mapInPandas(plan, f"page {kind}, number long, h array<double>, x int, y int, area_width int, area_height int")

    def cut(row: dict) -> Iterator[tuple]:
        rgb = R.as_rgb(row["raster"], row["area_width"], row["area_height"])
        yield row["page"], row["number"], R.rectify(rgb, np.array(row["h"]), size, (row["x"], row["y"])).tobytes()

    grids = _emit(crops(stripes, planned.where("h IS NOT NULL"), tall), cut, f"page {kind}, number long, grid binary")
    return grids.unionByName(planned.where("h IS NULL").select("page", "number", F.lit(None).cast("binary").alias("grid")))
