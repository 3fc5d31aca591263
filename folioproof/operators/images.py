"""Image preparation as distributed jobs.

``pages`` carries a decoded raster per row: ``raster`` (RGB or RGBA bytes), ``width``,
``height``.  Kernels run on Arrow batches inside ``mapInArrow``, so pages spread over
tasks as they are partitioned.  Keep ``spark.sql.execution.arrow.maxRecordsPerBatch``
small enough that a batch of rasters stays under about 64 MB.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..functions import raster as R
from ..functions.geometry import flat, polygon_area, solve_homographies
from ..functions.labels import class_id, parity

BATCH_BYTES = 16 * 1024 * 1024
#: Bytes that a tuple of a few values holds in Python beside its data; a small vector is mostly this.
ROW_BYTES = 500
MAX_EDGE, MAX_PIXELS = 8192, 24_000_000  # fixed values: limits of a decoded page


def _type(df: DataFrame) -> str:
    return df.schema["page"].dataType.simpleString()


def raster_violations(pages: DataFrame) -> DataFrame:
    """Pages whose raster breaks the size limits or does not fit its stated size."""
    n = F.octet_length("raster")
    area = F.col("width").cast("long") * F.col("height")
    return pages.select("page", F.explode(F.array_compact(F.array(
        F.when(~(F.col("width").between(1, MAX_EDGE) & F.col("height").between(1, MAX_EDGE)), F.lit("edge")),
        F.when(area > MAX_PIXELS, F.lit("pixels")),
        F.when(~((n == area * 3) | (n == area * 4)), F.lit("length"))))).alias("code"))


@F.pandas_udf(T.LongType())
def _dhash(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
    for raster, width, height in parts:
        yield pd.Series([R.difference_hash(R.as_rgb(r, w, h)) for r, w, h in zip(raster, width, height)], dtype="int64")


def difference_hash(raster: Column, width: Column, height: Column) -> Column:
    """64-bit difference hash of a raster column."""
    return _dhash(raster, width, height)


def _emit(rows: DataFrame, kernel: Callable[[dict], Iterator[tuple]], schema: str) -> DataFrame:
    """Run ``kernel`` on every row and send its tuples back as Arrow batches of about BATCH_BYTES in Python.

    Values are scalars, bytes, None, or numpy vectors, which become list columns without a
    detour through Python objects.
    """
    types = T.StructType.fromDDL(schema)
    arrow = to_arrow_schema(types)

    def pack(made: list[tuple]) -> pa.RecordBatch:
        columns = []
        for field, values in zip(arrow, zip(*made)):
            if pa.types.is_list(field.type):
                ends = np.cumsum([0, *[len(v) for v in values]], dtype=np.int32)
                flat_values = pa.array(np.concatenate(values), type=field.type.value_type)
                columns.append(pa.ListArray.from_arrays(pa.array(ends), flat_values).cast(field.type))
            else:
                columns.append(pa.array(values, type=field.type))
        return pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        made, size = [], 0
        for batch in batches:
            for i in range(batch.num_rows):
                row = {n: batch.column(n)[i].as_py() for n in batch.schema.names}
                for out in kernel(row):
                    made.append(out)
                    size += ROW_BYTES + sum(getattr(v, "nbytes", len(v) if isinstance(v, bytes) else 8) for v in out)
                    if size > BATCH_BYTES:
                        yield pack(made)
                        made, size = [], 0
        if made:
            yield pack(made)

    return rows.mapInArrow(run, types)


def rectified(pages: DataFrame, boards: DataFrame, size: int = R.GRID) -> DataFrame:
    """(page, number, grid): every board cut out of its page as a size x size RGB grid.

    ``boards`` has page, number, corners.  The boards of a page travel in one array beside
    its raster, so the raster is shuffled once and never repeated per board.  Boards
    without a usable homography come out with a null grid.
    """
    ok = F.coalesce(polygon_area(F.col("corners")) > 1e-6, F.lit(False))
    # A valid page has at most 64 boards; more of them come in lists of 64.
    grouped = boards.groupBy("page", F.floor(F.col("number") / 64).alias("_list")).agg(F.collect_list(F.struct(
        F.col("number").cast("long").alias("number"), F.when(ok, flat(F.col("corners"))).otherwise(F.array_repeat(F.lit(0.0), 8)).alias("corners"), ok.alias("ok"))).alias("boards")).drop("_list")
    joined = pages.select("page", "raster", "width", "height").join(grouped, "page")

    def cut(row: dict) -> Iterator[tuple]:
        rgb = R.as_rgb(row["raster"], row["width"], row["height"])
        corners = np.array([b["corners"] for b in row["boards"]], dtype=float).reshape(-1, 4, 2)
        found = solve_homographies(R.edge_corners(corners, row["width"], row["height"]), size - 1)
        for h, b in zip(found, row["boards"]):
            fits = b["ok"] and not np.isnan(h[0])
            yield row["page"], b["number"], R.rectify(rgb, h, size).tobytes() if fits else None

    return _emit(joined, cut, f"page {_type(pages)}, number long, grid binary")


def square_tensors(grids: DataFrame, size: int = R.GRID) -> DataFrame:
    """(page, number, square, tensor): one row per square, channel first, normalised."""
    def cut(row: dict) -> Iterator[tuple]:
        for i, t in enumerate(R.tiles(R.as_rgb(row["grid"], size, size)).reshape(64, -1)):
            yield row["page"], row["number"], i, t

    return _emit(grids.where("grid is not null").select("page", "number", "grid"), cut,
                 f"page {_type(grids)}, number long, square int, tensor array<float>")


def inner_tiles(grids: DataFrame, size: int = R.GRID, margin: int = 3, side: int = 24) -> DataFrame:
    """(page, number, square, tile): averaged bytes of the inside of each square."""
    def cut(row: dict) -> Iterator[tuple]:
        for i, t in enumerate(R.inner_tiles(R.as_rgb(row["grid"], size, size), margin, side)):
            yield row["page"], row["number"], i, t

    return _emit(grids.where("grid is not null").select("page", "number", "grid"), cut,
                 f"page {_type(grids)}, number long, square int, tile array<int>")


def letterboxed(pages: DataFrame, size: int = 416, channels: str = "rgb", preprocessing: str | None = None) -> DataFrame:
    """(page, scale, tensor): detector input; ``preprocessing`` 'unit' or 'imagenet' scales it."""
    def box(row: dict) -> Iterator[tuple]:
        canvas = R.letterbox(R.as_rgb(row["raster"], row["width"], row["height"]), size, channels)
        out = canvas if preprocessing is None else R.detector_scaled(canvas, preprocessing)
        yield row["page"], min(size / row["width"], size / row["height"]), out.ravel()

    return _emit(pages.select("page", "raster", "width", "height"), box, f"page {_type(pages)}, scale double, tensor array<float>")


def tensor_violations(tensors: DataFrame, low: float = 0.0, high: float = 255.0) -> DataFrame:
    """Raw detector inputs with values out of range."""
    bad = F.exists("tensor", lambda x: x.isNull() | F.isnan(x) | ~x.between(low, high))
    return tensors.where(bad).select("page", F.lit("range").alias("code"))


def degraded(pages: DataFrame) -> DataFrame:
    """Pages with their effect applied; the struct column ``degradation`` says which."""
    def apply(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in parts:
            made = []
            for row in pdf.itertuples(index=False):
                c = row.degradation
                made.append(R.degrade(R.as_rgb(row.raster, row.width, row.height), c["variant"], int(c["seed"]),
                                      c["paper_noise"], c["ink_fade"], c["illumination"], c["blur_radius"]).tobytes())
            yield pdf.assign(raster=made)

    return pages.mapInPandas(apply, pages.schema)


def greyscale(pages: DataFrame, width: int, height: int) -> DataFrame:
    """(page, grey): float luminance sampled to one size."""
    def shrink(row: dict) -> Iterator[tuple]:
        grey = R.luminance(R.as_rgb(row["raster"], row["width"], row["height"]))
        yield row["page"], R.sample_resize(grey, width, height).astype(np.float32).ravel()

    return _emit(pages.select("page", "raster", "width", "height"), shrink, f"page {_type(pages)}, grey array<float>")


def centre_crops(pages: DataFrame, short: int = 256, crop: int = 224) -> DataFrame:
    """(page, tensor): bicubic resize, central crop, ImageNet normalisation."""
    def make(row: dict) -> Iterator[tuple]:
        yield row["page"], R.normalised(R.centre_crop(R.as_rgb(row["raster"], row["width"], row["height"]), short, crop)).ravel()

    return _emit(pages.select("page", "raster", "width", "height"), make, f"page {_type(pages)}, tensor array<float>")


def tile_errors(tiles: DataFrame, controls: DataFrame, ceiling: float) -> DataFrame:
    """Mean absolute error per board against a control: mean and max over squares, and the verdict."""
    other = controls.select("page", "number", "square", F.col("tile").alias("_c"))
    off = F.aggregate(F.zip_with("tile", "_c", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    rows = tiles.join(other, ["page", "number", "square"]).select("page", "number", (off / F.size("tile")).alias("mae"))
    return rows.groupBy("page", "number").agg(
        F.count(F.lit(1)).alias("tiles"), F.avg("mae").alias("mean_mae"), F.max("mae").alias("max_mae"),
        (F.max("mae") <= ceiling).alias("passed"))


def template_distances(tiles: DataFrame, templates: DataFrame) -> DataFrame:
    """Distance of each square to every template of its colour.

    ``tiles``: key columns, square, tile, label.  ``templates``: parity, label, tile; the
    format holds 13 x 2 of them, which bounds the broadcast.
    """
    t = templates.select("parity", F.col("label").alias("template"), F.col("tile").alias("_t"))
    off = F.aggregate(F.zip_with("tile", "_t", lambda a, b: F.abs(a - b)), F.lit(0).cast("long"), lambda s, x: s + x)
    return (tiles.withColumn("parity", parity(F.col("square")).cast("int")).join(F.broadcast(t), "parity")
            .withColumn("distance", off).drop("_t", "tile"))


def class_margins(distances: DataFrame, key: list[str]) -> DataFrame:
    """Per square: nearest template (the first class on ties) and margin to other classes."""
    own = F.col("template") == F.col("label")
    return distances.groupBy(*key, "label").agg(
        F.min_by("template", F.struct(F.col("distance"), class_id(F.col("template")))).alias("nearest"),
        (F.min(F.when(~own, F.col("distance"))) - F.min(F.when(own, F.col("distance")))).alias("margin"))
