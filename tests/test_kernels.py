"""Kernels and column functions on small literal rows."""

import math
from types import SimpleNamespace

import numpy as np
import pytest
from pyspark.sql import functions as F

from folioproof.functions import geometry as G, labels as L, raster as R
from folioproof.operators import export as E, images as I, ledger as B, scoring as P, upsert as U
from folioproof.sources import manifests as M
from folioproof.streaming.reviews import EMPTY, judge


def test_rectify_follows_the_bilinear_rule():
    rng = np.random.default_rng(1)
    rgb = rng.integers(0, 256, (9, 11, 3), dtype=np.uint8)
    corners = np.array([[[1.0, 1.5], [9.0, 0.5], [10.0, 8.0], [0.5, 7.0]]])
    h = G.solve_homographies(corners, 15)[0]
    got = R.rectify(rgb, h, 16)
    for y in range(16):
        for x in range(16):
            z = h[6] * x + h[7] * y + h[8]
            sx, sy = (h[0] * x + h[1] * y + h[2]) / z, (h[3] * x + h[4] * y + h[5]) / z
            x0, y0 = min(10, max(0, math.floor(sx))), min(8, max(0, math.floor(sy)))
            x1, y1 = min(10, x0 + 1), min(8, y0 + 1)
            fx, fy = min(1, max(0, sx - x0)), min(1, max(0, sy - y0))
            for c in range(3):
                v = (rgb[y0, x0, c] * (1 - fx) + rgb[y0, x1, c] * fx) * (1 - fy) + (rgb[y1, x0, c] * (1 - fx) + rgb[y1, x1, c] * fx) * fy
                assert got[y, x, c] == math.floor(v + 0.5)


def test_grain_is_even_and_its_own():
    g = R.grain(7, 300, 200)
    assert (g == R.grain(7, 300, 200)).all() and (g[:50, :60] == R.grain(7, 50, 60)).all()
    assert g.min() >= -1 and g.max() < 1 and abs(g.mean()) < 0.01 and abs(g.std() - 6 ** -0.5) < 0.01
    other = R.grain(8, 300, 200)
    assert abs(np.corrcoef(g.ravel(), other.ravel())[0, 1]) < 0.02 and abs(np.corrcoef(g[:-1].ravel(), g[1:].ravel())[0, 1]) < 0.02


def test_degrade_properties():
    rng = np.random.default_rng(1)
    page = rng.integers(0, 256, (40, 30, 3), dtype=np.uint8)
    assert (R.degrade(page, "blank", 5, 3, 0.5, 0.5, 2) == page).all()
    assert (R.degrade(page, "paper", 5, 0, 0, 0, 0) == np.maximum(page, 1)).all()
    noisy = R.degrade(page, "paper", 5, 3, 0, 0, 0).astype(int) - np.maximum(page, 1)
    assert 1 <= np.abs(noisy).max() <= 3 and abs(noisy.mean()) < 0.2
    faded = R.degrade(page, "faded", 5, 0, 0.2, 0, 0)
    assert (faded >= np.maximum(page, 1)).all() and (R.degrade(np.full_like(page, 255), "faded", 5, 0, 0.2, 0, 0) == 255).all()
    flat = np.full((21, 21, 3), 100, np.uint8)
    lit = R.degrade(flat, "faded", 90, 0, 0, 0.1, 0).astype(int)
    assert lit[0, 0, 0] < 100 < lit[-1, 0, 0] and abs(lit.mean() - 100) < 1
    soft = R.degrade(page, "soft", 5, 0, 0, 0, 1)
    assert soft.std() < page.std() and (R.degrade(flat, "soft", 5, 0, 0, 0, 2) == 100).all()


def test_difference_hash_of_a_ramp():
    falling = np.repeat(np.linspace(255, 0, 90).astype(np.uint8)[None, :, None], 80, 0).repeat(3, 2)
    assert R.difference_hash(falling) == -1
    assert R.difference_hash(falling[:, ::-1]) == 0


def test_letterbox_pads_and_orders_channels():
    rgb = np.zeros((4, 8, 3), dtype=np.uint8)
    rgb[..., 0] = 9
    out = R.letterbox(rgb, 16, "bgr")
    assert out.shape == (3, 16, 16) and (out[2, :8] == 9).all() and (out[:, 8:] == 114).all()
    assert R.detector_scaled(out, "unit").max() == pytest.approx(114 / 255)


def test_square_tensor_order():
    grid = np.arange(16 * 16 * 3, dtype=np.int64).reshape(16, 16, 3) % 251
    t = R.tiles(grid.astype(np.uint8))
    assert t.shape == (64, 3, 2, 2)
    assert t[9, 1, 0, 1] == pytest.approx((grid[2, 3, 1] / 255 - 0.456) / 0.224, abs=1e-6)


def test_centre_crop_of_constant():
    rgb = np.full((300, 400, 3), 77, dtype=np.uint8)
    assert R.centre_crop(rgb).shape == (224, 224, 3) and (R.centre_crop(rgb) == 77).all()


def test_clipped_area_of_rotated_squares():
    square = np.array([[[0, 0], [2, 0], [2, 2], [0, 2]]], dtype=float)
    diamond = np.array([[[1, -0.5], [2.5, 1], [1, 2.5], [-0.5, 1]]], dtype=float)
    assert G._clip_areas(square, diamond)[0] == pytest.approx(4 - 4 * 0.125)
    assert G._clip_areas(square, square + 5)[0] == 0
    assert G._clip_areas(square, square + [1, 1])[0] == pytest.approx(1)


def test_placement_and_softmax(spark):
    start = "rnbqkbnrpppppppp................................PPPPPPPPRNBQKBNR"
    df = spark.createDataFrame([(list(start), "white-bottom"), (list(start)[::-1], "black-bottom"), (list(start), "unknown"),
                                ([None] + list(start)[1:], "white-bottom")], "l array<string>, o string")
    fen = "rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR"
    assert [r[0] for r in df.select(L.placement(F.col("l"), F.col("o"))).collect()] == [fen, fen, None, None]
    p = spark.range(1).select(L.softmax(F.array(*[F.lit(float(i)) for i in range(3)])).alias("p")).first()["p"]
    assert p == pytest.approx([math.exp(i) / sum(math.exp(k) for k in range(3)) for i in range(3)])


def test_homography_of_a_degenerate_board_is_null(spark):
    rows = [([(0.0, 0.0), (10.0, 0.0), (10.0, 10.0), (0.0, 10.0)],), ([(0.0, 0.0), (5.0, 0.0), (9.0, 0.0), (2.0, 0.0)],)]
    df = spark.createDataFrame(rows, "q array<struct<x:double,y:double>>")
    got = [r[0] for r in df.select(G.homography(F.col("q"), 10.0)).collect()]
    assert got[0] == pytest.approx([1, 0, 0, 0, 1, 0, 0, 0, 1]) and got[1] is None


def test_unusable_board_has_no_grid(spark):
    pages = spark.createDataFrame([(1, bytes(12 * 12 * 3), 12, 12)], "page long, raster binary, width int, height int")
    boards = spark.createDataFrame([(1, 0, [(0.0, 0.0), (12.0, 0.0), (12.0, 12.0), (0.0, 12.0)]), (1, 1, [(0.0, 0.0), (0.0, 9.0), (9.0, 9.0), (9.0, 0.0)])],
                                   "page long, number long, corners array<struct<x:double,y:double>>")
    got = {r["number"]: r["grid"] for r in I.rectified(pages, boards, 16).collect()}
    assert len(got[0]) == 16 * 16 * 3 and got[1] is None


def test_review_rules():
    def s(content, reviewer, human=True, revision=0):
        return SimpleNamespace(content=content, reviewer=reviewer, human=human, revision=revision)

    a, o = judge(dict(EMPTY), s("x", "ann", human=False))
    assert o == "correction" and not a["accepted"] and a["revision"] == 1
    assert judge(a, s("x", "ann", human=False))[1] == "idempotent"
    assert judge(a, s("x", "ann", human=True, revision=1))[1] == "own-confirmation"
    b, o = judge(a, s("x", "bob", revision=1))
    assert o == "confirmation" and b["accepted"] and b["revision"] == 1
    assert judge(b, s("y", "bot", human=False, revision=1))[1] == "nonhuman-overwrite"
    assert judge(b, s("y", "cy", revision=0))[1] == "stale"
    c, o = judge(b, s("y", "cy", revision=1))
    assert o == "correction" and c["accepted"] and c["reviewers"] == ["cy"]


def test_attempt_identity(spark):
    df = spark.createDataFrame([("L1", "a", 1.0, None, None), (None, "a", 2.5, None, None), (None, None, 2.5, None, None),
                                (None, "a", None, "run", 3), (None, "a", None, None, None)],
                               "ledger_id string, segment string, started_at double, source_run_id string, source_attempt_index int")
    got = [r[0] for r in df.select(B.attempt_identity(F.lit(7))).collect()]
    assert got == ["L1", "legacy:2.500000000:a", "legacy:2.500000000:unknown", "run:3", "current:7"]


def test_snapshot_is_immutable_and_hashed(spark, tmp_path):
    rows = spark.createDataFrame([(1, "train", "a"), (2, "dev", "b")], "id long, split string, sha string")
    path = E.write_snapshot(rows, str(tmp_path / "out"), {"grid": "768"})
    with pytest.raises(Exception):
        E.write_snapshot(rows.orderBy(F.desc("id")), str(tmp_path / "out"), {"grid": "768"})
    E.write_manifest(spark, path, str(tmp_path / "manifest"))
    held = spark.read.json(str(tmp_path / "manifest"))
    found = M.files(spark, path, "*.parquet").select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    assert U.agreement(held, found, ["name"], ["sha256"]).count() == 0 and held.count() == 2
    assert spark.read.parquet(path).count() == 2


def test_fingerprint_ignores_order_and_sees_changes(spark):
    a = spark.createDataFrame([(1, "x"), (2, "y")], "id long, v string")
    b = spark.createDataFrame([(2, "y"), (1, "x")], "id long, v string")
    c = spark.createDataFrame([(1, "y"), (2, "x")], "id long, v string")
    digests = [E.fingerprint(d, "id", "v").first()["digest"] for d in (a, b, c)]
    assert digests[0] == digests[1] != digests[2]


def test_manifest_and_state_scans(spark, tmp_path):
    (tmp_path / "m").mkdir()
    (tmp_path / "m" / "a.json").write_text('{"id": "a", "split": "train", "pages": [1]}')
    (tmp_path / "m" / "b.json").write_text('{"id": ')
    rows = M.source_manifests(spark, str(tmp_path / "m")).cache()
    assert rows.where("id = 'a'").count() == 1 and M.corrupt(rows).count() == 1
    for run in ("r1", "r2"):
        (tmp_path / "runs" / run).mkdir(parents=True)
        (tmp_path / "runs" / run / "state.json").write_text(
            '{"run_id": "%s", "attempts": [{"ledger_id": "x", "segment": "s", "elapsed_seconds": 5.0}, {"segment": "s", "started_at": 1.5, "elapsed_seconds": 2.0}]}' % run)
    states = M.run_states(spark, str(tmp_path / "runs"))
    keyed = states.withColumn("key", B.attempt_identity(F.col("ordinal")))
    once = B.unique_attempts(keyed, "key", ["file", "ordinal"])
    assert {r["segment"]: (r["attempts"], r["seconds"]) for r in B.ledger_totals(once).collect()} == {"s": (2, 7.0), "all": (2, 7.0)}


def test_ingest_is_idempotent(spark, tmp_path):
    folder = tmp_path / "album"
    folder.mkdir()
    (folder / "one.pdf").write_bytes(b"1")
    (folder / "copy.pdf").write_bytes(b"1")
    (folder / "two.pdf").write_bytes(b"2")
    got = M.document_sources(M.files(spark, str(folder)))
    assert got.count() == 2 and {r["document_group"] for r in got.collect()} == {"album"}
    assert U.insert_absent(got, got, ["id"], ["sha256"]).count() == 0


def test_failing_model_is_a_row(spark):
    class Broken:
        def locate(self, page):
            raise ValueError("no")

    registry = P.Registry()
    registry.register("localization", "broken", Broken, "0")
    registry.register("labels", "none", Broken, "1")
    with pytest.raises(ValueError):
        registry.register("labels", "none", Broken, "2")
    pages = spark.createDataFrame([(1,)], "id long")
    row = P.score_pages(pages, registry, "broken", "none", "r", L.LABELS).first()
    assert row["status"] == "error" and row["warnings"] == ["ValueError: no"]


def test_prior_runs_and_empty_ids(spark):
    df = spark.createDataFrame([("", "a", None, "", "before", 2, 0), (None, "a", None, "from", "before", None, 1), (None, None, None, None, None, 5, 2), ("", None, 0.5, None, None, None, 3)],
                               "ledger_id string, segment string, started_at double, source_run_id string, prior_run_id string, source_attempt_index int, ordinal int")
    got = [r[0] for r in df.select(B.attempt_identity(F.col("ordinal"), F.col("prior_run_id"))).collect()]
    assert got == ["before:2", "from:1", "current:2", "legacy:0.500000000:unknown"]
    assert [r.identity for r in B.retained(df, ["ordinal"]).collect()] == ["legacy:0.500000000:unknown"]
    assert [r[0] for r in df.select(B.has_no_identity()).collect()] == [True, True, True, False]
