"""Large pages: rasters as stripes, windows scored apart, boards rectified from their stripes."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..operators import stripes as S, window_scores as W
from ..operators.scoring import Registry
from ..sources import views as V
from . import evaluation  # noqa: F401  (its views are used here)
from .registry import Tables, query, view

WIDE, HIGH, SHRINK = 200, 150, 8
#: Pages drawn at once, about 8 MB: a page is a hundred times its boards, so a batch of boards is no measure.
DRAWN = (8 << 20) // (3 * WIDE * HIGH)


def pieces(parts: Iterator[pd.DataFrame], rows: int) -> Iterator[pd.DataFrame]:
    """The frames cut to ``rows`` rows at most."""
    for pdf in parts:
        for i in range(0, len(pdf), rows):
            yield pdf.iloc[i:i + rows]


def drawn(t: Tables) -> DataFrame:
    """Pages of four boards at an eighth of their size: a bit of red per board, green and blue tell the position."""
    boards = V.boxes(t.embeddings).groupBy("page").agg(F.collect_list(F.struct(
        "number", *[F.col(c).alias(c) for c in ("x0", "y0", "x1", "y1")])).alias("boards"))

    def draw(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in pieces(parts, DRAWN):
            made = []
            for boards in pdf["boards"]:
                page = np.zeros((HIGH, WIDE, 3), dtype=np.uint8)
                page[..., 1], page[..., 2] = np.arange(WIDE)[None, :], np.arange(HIGH)[:, None]
                for b in boards:
                    x0, y0, x1, y1 = (max(0, int(v)) for v in (np.floor(b["x0"] / SHRINK), np.floor(b["y0"] / SHRINK),
                                                               np.ceil(b["x1"] / SHRINK), np.ceil(b["y1"] / SHRINK)))
                    page[y0:y1, x0:x1, 0] |= 1 << int(b["number"])
                made.append(page.tobytes())
            yield pd.DataFrame({"page": pdf["page"], "raster": made, "width": WIDE, "height": HIGH})

    return boards.mapInPandas(draw, "page long, raster binary, width int, height int")


class Bits:
    """A stand-in localiser: the bounds of each bit of red, and once more a pixel smaller with a lower score."""

    def locate(self, window: object) -> list[dict]:
        red = np.frombuffer(window.raster, np.uint8).reshape(window.height, window.width, 3)[..., 0]
        found = []
        for bit in range(4):
            ys, xs = np.nonzero(red >> bit & 1)
            if len(xs):
                x0, y0, x1, y1 = xs.min(), ys.min(), xs.max() + 1, ys.max() + 1
                found.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "score": 0.9, "class_id": bit})
                if min(x1 - x0, y1 - y0) > 6:
                    found.append({"x0": x0 + 1, "y0": y0 + 1, "x1": x1 - 1, "y1": y1 - 1, "score": 0.6, "class_id": bit})
        return found


view("shown", f"""SELECT page, number, greatest(0, least({WIDE}, floor(x0 / {SHRINK}))) AS x0, greatest(0, least({HIGH}, floor(y0 / {SHRINK}))) AS y0,
  greatest(0, least({WIDE}, ceil(x1 / {SHRINK}))) AS x1, greatest(0, least({HIGH}, ceil(y1 / {SHRINK}))) AS y1 FROM {{bx}}""")


@query("SELECT page, 'ok' AS status, number, x0, y0, x1, y1, 0.9::DOUBLE AS score FROM shown WHERE x1 > x0 AND y1 > y0", "shown")
def window_boxes(t: Tables) -> DataFrame:
    """Windows of 64 pixels that overlap by 16: each drawn board comes out once, whatever seams cut it."""
    registry = Registry()
    registry.register("localization", "bits", Bits, "2" * 64)
    out = W.score_large_pages(S.striped(drawn(t), 32), registry, "bits", 64, 16, 32)
    return out.select("page", "status", F.explode("boxes").alias("b")).select(
        "page", "status", F.col("b.class_id").cast("long").alias("number"), *[F.col(f"b.{c}").alias(c) for c in ("x0", "y0", "x1", "y1", "score")])


# A grid position (u, v) in the unit square lies at a projective mix of the corners; its weights have a closed form.
view("fitted", "SELECT page, number, " + ", ".join(f"least({edge - 1}, q[{2 * i + k}] / {SHRINK}) AS {name}{i}" for i in range(4) for k, name, edge in ((1, "a", WIDE), (2, "b", HIGH)))
     + " FROM {qd}")
view("bent", """SELECT *, ((a0 - a1 + a2 - a3) * (b3 - b2) - (a3 - a2) * (b0 - b1 + b2 - b3)) / ((a1 - a2) * (b3 - b2) - (a3 - a2) * (b1 - b2)) AS g,
  ((a1 - a2) * (b0 - b1 + b2 - b3) - (a0 - a1 + a2 - a3) * (b1 - b2)) / ((a1 - a2) * (b3 - b2) - (a3 - a2) * (b1 - b2)) AS h FROM {fitted}""")


@query(f"""SELECT page, number, round(avg(floor(greatest(0, least({WIDE - 1}, (u * (a1 - a0 + g * a1) + v * (a3 - a0 + h * a3) + a0) / (g * u + h * v + 1))) + 0.5)), 6) AS green,
  round(avg(floor(greatest(0, least({HIGH - 1}, (u * (b1 - b0 + g * b1) + v * (b3 - b0 + h * b3) + b0) / (g * u + h * v + 1))) + 0.5)), 6) AS blue
  FROM bent, (SELECT i / 15.0::DOUBLE AS u, j / 15.0::DOUBLE AS v FROM range(16) x(i), range(16) y(j)) GROUP BY 1, 2""", "bent")
def striped_grids(t: Tables) -> DataFrame:
    """Skewed boards rectified from stripes of ten rows; green and blue of a grid tell where its pixels came from."""
    small = F.transform("corners", lambda p: G.point(p["x"] / SHRINK, p["y"] / SHRINK))
    boards = V.boards(t.embeddings).select("page", "number", small.alias("corners"))
    grids = S.rectified(S.striped(drawn(t), 10), boards, 16, 10)
    cells = grids.select("page", "number", F.posexplode(F.expr("transform(sequence(1, 256), i -> substring(grid, 3 * i - 1, 2))")).alias("_i", "pixel"))

    def byte(at: int) -> Column:
        return F.conv(F.hex(F.expr(f"substring(pixel, {at}, 1)")), 16, 10).cast("double")

    return cells.groupBy("page", "number").agg(F.round(F.avg(byte(1)), 6).alias("green"), F.round(F.avg(byte(2)), 6).alias("blue"))
