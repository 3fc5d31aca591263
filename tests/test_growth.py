"""What grows with the tables: plans without bands in broadcasts, batches, files and triggers of bounded size."""

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from folioproof.functions import raster as K
from folioproof.llm import jaccard as J
from folioproof.operators import components as G, coverage as C, images as I, recipes as R, stripes as S
from folioproof.plans import pages, streams, windowed
from folioproof.plans.registry import Tables
from folioproof.plans.session import shared_path
from folioproof.sources import digests as D
from folioproof.streaming.ordered import batch_fold, ordered_fold


def test_bands_are_never_broadcast(spark):
    def paint(parts):
        for pdf in parts:
            yield pd.DataFrame({"page": pdf["id"], "raster": [bytes([i]) * 300 for i in pdf["id"]], "width": 10, "height": 10})

    pages = spark.range(6).mapInPandas(paint, "page long, raster binary, width int, height int")
    areas = spark.range(6).select(F.col("id").alias("page"), *[F.lit(v).alias(n) for n, v in (("x", 2), ("y", 3), ("area_width", 4), ("area_height", 5))])
    cut = S.crops(S.striped(pages, 4), areas, 4)
    assert "Broadcast" not in cut._jdf.queryExecution().executedPlan().toString()
    assert {r.page: bytes(r.raster) for r in cut.collect()} == {i: bytes([i]) * 60 for i in range(6)}


def test_pages_are_drawn_a_few_at_a_time():
    frame = pd.DataFrame({"page": np.arange(2 * windowed.DRAWN + 3)})
    cut = list(windowed.pieces(iter([frame, frame[:0], frame[:2]]), windowed.DRAWN))
    assert [len(c) for c in cut] == [windowed.DRAWN, windowed.DRAWN, 3, 2]
    assert pd.concat(cut)["page"].tolist() == [*frame["page"], 0, 1]
    assert windowed.DRAWN * windowed.WIDE * windowed.HIGH * 3 <= 8 << 20


def test_files_are_written_and_listed_in_tasks(spark, tmp_path):
    rows = spark.createDataFrame([(i, f"text {i}\n") for i in range(300)] + [(7, "again\n"), (-3, ""), (None, "x")], "id long, content string").repartition(1)
    folder = str(tmp_path / "files")
    D.write_files(rows, folder)
    found = {r.path.rpartition("/id=")[2]: (r.length, r.sha256) for r in D.file_digests(spark, folder, parts=2).collect()}
    want = {str(i): f"text {i}\n" for i in range(300)} | {"-3": "", "None": "x"}
    got = found.pop("7")
    assert got[1] in {hashlib.sha256(x.encode()).hexdigest() for x in ("text 7\nagain\n", "again\ntext 7\n")}
    del want["7"]
    assert found == {k: (len(v), hashlib.sha256(v.encode()).hexdigest()) for k, v in want.items()}
    sets = D.DigestReader({"path": folder, "parts": "2"}).partitions()
    # One writing task has FOLDERS folders, which two readers list themselves.
    assert [len(s.paths) for s in sets] == [0, 0] and [len(s.folders) for s in sets] == [D.FOLDERS // 2] * 2
    assert [len(s.paths) for s in D.DigestReader({"path": folder, "parts": "50"}).partitions()].count(0) == 0


def test_triggers_of_several_files_hold_the_order(spark, monkeypatch):
    monkeypatch.setattr(streams, "FILE_ROWS", 10)
    rows = spark.range(150).select((F.col("id") % 3).alias("sample"), F.lit(0).cast("long").alias("revision"), F.lit("c").alias("content"), F.lit("w").alias("reviewer"),
                                   F.lit(True).alias("human"), F.timestamp_seconds(F.lit(1_700_000_000) + F.col("id") * 9000).alias("at"), "id")
    closing = rows.limit(1).withColumn("sample", F.lit(-1).cast("long")).withColumn("at", F.timestamp_seconds(F.lit(1_800_000_000)))
    source = streams.arriving(rows, "log", closing)
    out = streams.drained(ordered_fold(source, streams.DELAY), "out").where("sample >= 0").collect()
    assert sorted(map(str, out)) == sorted(map(str, batch_fold(rows).collect()))
    assert not any(r.outcome == "late" for r in out)
    # Four files a trigger, also for the last one, which has one row.
    files = []
    monkeypatch.setattr(streams, "shared_path", lambda spark, name: files.append(shared_path(spark, name)) or files[-1])
    streams.arriving(rows, "log", closing)
    assert len(spark.read.parquet(files[0]).inputFiles()) == 6 * (150 // (streams.FILES * 10) + 1)


def test_boards_are_made_once_for_all_counters(spark):
    made = R.recipes(spark.range(200).withColumnRenamed("id", "index"), "v1")
    counters = C.recipe_counters(made)
    assert counters._jdf.queryExecution().optimizedPlan().toString().count("explode(boards") == 1
    n = {(r.counter, r.key): r.n for r in counters.collect()}
    boards = made.select(F.explode("boards").alias("b")).collect()
    assert sum(v for (c, _), v in n.items() if c == "classes") == 64 * len(boards)
    assert sum(v for (c, _), v in n.items() if c == "sets") == len(boards) == sum(v for (c, _), v in n.items() if c == "joint_conditions")
    assert n["classes", "K"] == sum(b.b.labels.count("K") for b in boards)


def test_small_vectors_count_with_what_python_holds(spark, monkeypatch):
    monkeypatch.setattr(I, "BATCH_BYTES", 40 * I.ROW_BYTES)
    grids = spark.range(4, numPartitions=1).select(F.col("id").alias("page"), F.lit(0).cast("long").alias("number"), F.lit(bytes(64 * 64 * 3)).alias("grid"))
    tiles = I.inner_tiles(grids, 64, 1, 3)
    assert tiles.count() == 256


def test_letterbox_is_a_blend_of_rows_and_columns():
    rgb = np.random.default_rng(3).integers(0, 256, (5, 7, 3), dtype=np.uint8)
    xs = ys = (np.arange(40) + 0.5) / (40 / 7) - 0.5
    out = K.letterbox(rgb, 40, "bgr")
    want = K.grid_bilinear(rgb, xs, ys[:28]).astype(np.float32).transpose(2, 0, 1)[::-1]
    assert out.flags.c_contiguous and (out[:, :28] == want).all() and (out[:, 28:] == K.PAD).all()


def _exchanges(monkeypatch, module) -> list[int]:
    """Gets the shuffles and broadcasts of each plan that ``module`` keeps from now on."""
    counts, keep = [], module.keep
    monkeypatch.setattr(module, "keep", lambda df: counts.append(df._jdf.queryExecution().executedPlan().toString().count("Exchange ")) or keep(df))
    return counts


def test_a_round_of_components_has_few_exchanges(spark, monkeypatch):
    counts = _exchanges(monkeypatch, G)
    links = spark.range(1, 40).select(F.col("id").alias("u"), (F.col("id") - F.col("id") % 2 - 1).alias("v")).where("v >= 0")
    pairs = links.unionByName(spark.createDataFrame([(100, 101), (101, 100), (102, 101), (5, 5), (None, 7)], "u long, v long"))
    found = {r.u: r.v for r in G.linked_components(pairs).collect()}
    assert found == {u: 1 for u in range(2, 40)} | {101: 100, 102: 100}
    assert len(counts) > 2 and max(counts) <= 7


def test_near_duplicates_meet_in_a_plan_of_few_exchanges(spark, monkeypatch):
    counts = _exchanges(monkeypatch, J)
    rows = [(i, " ".join(f"w{(i // 3) * 50 + j if j != i % 3 else 'x'}" for j in range(40))) for i in range(60)]
    out = J.linked(spark.createDataFrame(rows, "doc_id long, text string"))
    assert max(counts) <= 34
    assert {r.doc_id: r.component_id for r in out.collect()} == {i: i - i % 3 for i in range(60)}


def test_components_of_documents_are_worked_out_once(spark, monkeypatch):
    names, put = [], J.put
    monkeypatch.setattr(J, "put", lambda df, name: names.append(name) or put(df, name))
    rows = [(1, "a b c d e f"), (2, "a b c d e f"), (3, "other words"), (3, "other text"), (None, "a b c d e f"), (4, None)]
    left = J.one_of_each(spark.createDataFrame(rows, "doc_id long, text string"))
    assert sorted((r.doc_id or 0) for r in left.collect()) == [0, 1, 3, 4]
    assert names.count("found") == 1


def test_tensors_of_one_file_are_made_by_all_tasks(spark, tmp_path):
    rows = spark.range(40).select(F.col("id").alias("vec_id"), F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: (i / 64).cast("float")).alias("embedding"), F.lit(0).alias("label"))
    rows.coalesce(1).write.parquet(str(tmp_path / "embeddings.parquet"))
    out = pages.letterboxed_pages(Tables(spark, str(tmp_path)))
    made = out.withColumn("task", F.spark_partition_id()).collect()
    assert sorted(r.page for r in made) == list(range(40)) and {r["values"] for r in made} == {3 * 416 * 416}
    assert len({r.task for r in made}) == 4
