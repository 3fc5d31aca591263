"""Striped rasters and window scoring against whole pages."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioproof.operators import images as I, stripes as S, window_scores as W
from folioproof.operators.scoring import Registry

PAGE = "page long, raster binary, width int, height int"


def picture(seed, width, height, deep=3):
    return np.random.default_rng(seed).integers(0, 256, (height, width, deep), dtype=np.uint8)


def test_crops_and_windows_are_slices(spark):
    held = {1: picture(1, 50, 70), 2: picture(2, 33, 16, 4), 3: picture(3, 7, 1)}
    rows = [(k, v.tobytes(), v.shape[1], v.shape[0]) for k, v in held.items()]
    rows += [(4, None, 5, 5), (5, b"123", 5, 5), (6, b"", 0, 0)]
    stripes = S.striped(spark.createDataFrame(rows, PAGE), 16)
    assert {(r.page, r.n) for r in stripes.groupBy("page").agg(F.count("*").alias("n")).collect()} == {(1, 5), (2, 1), (3, 1)}
    areas = spark.createDataFrame([(1, "a", 3, 10, 20, 30), (1, "b", 0, 0, 50, 70), (1, "c", 49, 69, 1, 1), (2, "d", 2, 3, 9, 9), (9, "e", 0, 0, 1, 1)],
                                  "page long, name string, x int, y int, area_width int, area_height int")
    got = {r.name: bytes(r.raster) for r in S.crops(stripes, areas, 16).collect()}
    assert got == {r.name: held[r.page][r.y:r.y + r.area_height, r.x:r.x + r.area_width].tobytes() for r in areas.where("page < 9").collect()}
    seen = S.windows(stripes, 20, 5, 16).collect()
    for r in seen:
        assert bytes(r.raster) == held[r.page][r.y:r.y + r.area_height, r.x:r.x + r.area_width].tobytes()
    assert sorted((r.x, r.y) for r in seen if r.page == 1) == sorted((x, y) for x in (0, 15, 30) for y in (0, 15, 30, 45, 50))
    assert [r.page for r in S.too_many(S.page_sizes(stripes), 6, 1).collect()] == [1] and {r.page for r in S.windows(stripes, 6, 1, 16).collect()} == {2, 3}


def test_boards_from_stripes_equal_whole_pages(spark):
    rng = np.random.default_rng(8)
    pages, boards = [], []
    for page in range(4):
        w, h = (int(v) for v in rng.integers(60, 140, 2))
        pages.append((page, picture(page, w, h).tobytes(), w, h))
        for number in range(6):
            at, span = rng.uniform(-5, 40, 2), rng.uniform(20, 110, 2)
            square = np.array([[0, 0], [1, 0], [1, 1], [0, 1]]) * span + at + rng.uniform(-9, 9, (4, 2))
            boards.append((page, number, [{"x": float(x), "y": float(y)} for x, y in square]))
    boards += [(0, 90, [{"x": 1.0, "y": 1.0}] * 4), (0, 91, None),
               (0, 92, [{"x": x, "y": y} for x, y in ((0.0, 0.0), (50.0, 50.0), (50.0, 0.0), (0.0, 50.0))])]
    df = spark.createDataFrame(pages, PAGE)
    marked = spark.createDataFrame(boards, "page long, number long, corners array<struct<x:double,y:double>>")
    whole = {(r.page, r.number): r.grid for r in I.rectified(df, marked, 24).collect()}
    striped = {(r.page, r.number): r.grid for r in S.rectified(S.striped(df, 8), marked, 24, 8).collect()}
    assert len(whole) == len(boards) and striped == whole


class Painted:
    """Each bit of the first channel is a board; finds it twice, once a little smaller."""

    def locate(self, window):
        value = np.frombuffer(window.raster, np.uint8).reshape(window.height, window.width, 3)[..., 0]
        if (value == 255).any():
            raise RuntimeError("smudge")
        out = []
        for bit in range(7):
            ys, xs = np.nonzero(value >> bit & 1)
            if len(xs):
                x0, y0, x1, y1 = xs.min(), ys.min(), xs.max() + 1, ys.max() + 1
                out.append({"x0": x0, "y0": y0, "x1": x1, "y1": y1, "score": 0.9, "class_id": bit})
                if min(x1 - x0, y1 - y0) > 10:
                    out.append({"x0": x0 + 1, "y0": y0 + 1, "x1": x1 - 1, "y1": y1 - 1, "score": 0.6, "class_id": bit})
        return out


@pytest.fixture
def registry():
    r = Registry()
    r.register("localization", "painted", Painted, "0" * 64)
    return r


def painted(boards, width=200, height=150):
    page = np.zeros((height, width, 3), np.uint8)
    for bit, (x0, y0, x1, y1) in enumerate(boards):
        page[y0:y1, x0:x1, 0] |= 1 << bit
    return page


def test_seams(spark, registry):
    held = {1: [(10, 10, 40, 30), (50, 40, 90, 60), (0, 0, 200, 150), (60, 60, 64, 64), (3, 100, 190, 110), (100, 20, 120, 140)],
            2: [], 3: [(0, 0, 5, 5)], 4: [(i * 7, i * 11, i * 7 + 60, i * 11 + 50) for i in range(7)]}
    rows = [(k, painted(v).tobytes(), 200, 150) for k, v in held.items()]
    bad = painted([(0, 0, 20, 20)])
    bad[140, 190, 0] = 255
    rows += [(5, bad.tobytes(), 200, 150), (6, painted([], 3000, 2).tobytes(), 3000, 2), (7, painted([(0, 0, 9, 2)], 3100, 2).tobytes(), 3100, 2)]
    stripes = S.striped(spark.createDataFrame(rows, PAGE), 32)
    got = {r.page: r for r in W.score_large_pages(stripes, registry, "painted", 64, 16, 32, least_score=0.1).collect()}
    assert {k: r.status for k, r in got.items()} == {1: "ok", 2: "unsupported", 3: "ok", 4: "ok", 5: "error", 6: "unsupported", 7: "too-many-windows"}
    for page, boards in held.items():
        assert sorted((b.class_id, b.x0, b.y0, b.x1, b.y1) for b in got[page].boxes) == [(i, *map(float, b)) for i, b in enumerate(boards)]
        assert all(b.score == 0.9 for b in got[page].boxes)
    assert len(got[5].boxes) == 1 and got[5].warnings == ["136,86 RuntimeError: smudge"]
    few = {r.page: r for r in W.score_large_pages(stripes, registry, "painted", 64, 16, 32, at_most=2).collect()}
    assert len(few[1].boxes) == 2
    assert W.score_large_pages(stripes.where("page > 99"), registry, "painted", 64, 16, 32).collect() == []
