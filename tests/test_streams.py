"""Reordered review streams and bucketed upserts."""

import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from folioproof.plans import streams
from folioproof.plans.session import shared_path
from folioproof.streaming.ordered import batch_fold, ordered_fold
from folioproof.streaming.upserts import BucketTable

START = dt.datetime(2024, 1, 1)
LOG = "sample long, revision long, content string, reviewer string, human boolean, at timestamp, id long"


def log(spark, rows):
    return spark.createDataFrame([(s, r, c, w, h, START + dt.timedelta(minutes=m), i) for s, r, c, w, h, m, i in rows], LOG)


def in_triggers(spark, parts):
    folder = shared_path(spark, "log")
    for part in parts:
        log(spark, part).coalesce(1).write.mode("append").parquet(folder)
    return spark.readStream.schema(LOG).option("maxFilesPerTrigger", 1).parquet(folder)


def test_order_of_events_holds_over_triggers(spark):
    rng = random.Random(3)
    rows = [(rng.randrange(4), rng.randrange(3), f"c{rng.randrange(2)}", f"w{rng.randrange(3)}", rng.random() < 0.6, m, m) for m in range(240)]
    near = sorted(rows, key=lambda r: r[5] + rng.randrange(30))
    parts = [near[i:i + 60] for i in range(0, 240, 60)]
    closing = [(9, 0, "", "", True, 10_000, 10_000)]
    out = streams.drained(ordered_fold(in_triggers(spark, [*parts, closing]), "45 minutes"), "folded").where("sample < 9")
    want = batch_fold(log(spark, rows)).collect()
    assert sorted(map(str, out.collect())) == sorted(map(str, want))
    assert {r.outcome for r in want} >= {"correction", "confirmation", "idempotent", "stale", "nonhuman-overwrite"}


def test_rows_behind_the_watermark_are_reported(spark):
    parts = [[(1, 0, "a", "w", True, 0, 1)], [(1, 1, "b", "w", True, 100, 2)], [(1, 2, "c", "w", True, 300, 3)], [(1, 1, "x", "w", True, 50, 4)], [(2, 0, "", "", True, 900, 5)]]
    out = {r.id: r for r in streams.drained(ordered_fold(in_triggers(spark, parts), "10 minutes"), "late").collect()}
    assert out[4].outcome == "late" and [out[i].outcome for i in (1, 2, 3)] == ["correction"] * 3
    assert out[3].revision == 3 and 5 not in out


def version_table(spark, **how):
    return BucketTable(spark, shared_path(spark, "kept"), spark.createDataFrame([], "k long, name string, at long").schema, ["k"], "at", **how)


def rows(spark, *values):
    return spark.createDataFrame(list(values), "k long, name string, at long")


def kept(table):
    return sorted(tuple(r) for r in table.read().collect())


def test_replayed_batches_change_nothing(spark):
    table = version_table(spark, buckets=8)
    assert kept(table) == []
    table.apply(rows(spark, (1, "a", 1), (2, "b", 5), (2, "older", 4)), 0)
    table.apply(rows(spark, (1, "c", 2), (2, "late", 3), (3, "d", 1)), 1)
    want = [(1, "c", 2), (2, "b", 5), (3, "d", 1)]
    assert kept(table) == want
    # A tie goes to the newer batch, so a replay of an old one must not be applied again.
    table.apply(rows(spark, (1, "tie", 2)), 2)
    table.apply(rows(spark, (1, "c", 2)), 1)
    assert kept(table) == [(1, "tie", 2), *want[1:]]
    table.apply(rows(spark).limit(0), 3)
    assert kept(table) == [(1, "tie", 2), *want[1:]]


def test_a_batch_writes_the_buckets_it_touches(spark):
    table = version_table(spark, buckets=8)
    table.apply(rows(spark, *[(i, "a", 1) for i in range(100)]), 0)
    table.apply(rows(spark, (7, "b", 2)), 1)
    assert table._committed().where("batch = 1").count() == 1 and table.stale().count() == 1
    files = [r.f for r in table._current([r for r in table._latest() if r["batch"] == 1]).select(F.input_file_name().alias("f")).distinct().collect()]
    assert files and all("batch=1" in f for f in files)
    assert len(kept(table)) == 100 and (7, "b", 2) in kept(table)


def test_a_batch_that_failed_before_its_commit_is_unseen_and_can_be_sent_again(spark, monkeypatch):
    table = version_table(spark, buckets=4)
    table.apply(rows(spark, (1, "a", 1)), 0)
    made = spark.createDataFrame

    def broken(data, schema=None, **how):
        if schema == "batch long, bucket int" and data:
            raise RuntimeError("lost")
        return made(data, schema, **how)

    monkeypatch.setattr(spark, "createDataFrame", broken)
    with pytest.raises(RuntimeError):
        table.apply(made([(1, "half", 2), (5, "half", 2)], "k long, name string, at long"), 1)
    monkeypatch.undo()
    assert kept(table) == [(1, "a", 1)]
    table.apply(rows(spark, (1, "whole", 2)), 1)
    assert kept(table) == [(1, "whole", 2)]


def test_stream_of_upserts(spark):
    rng = random.Random(5)
    source = spark.createDataFrame([(i, START + dt.timedelta(hours=i), rng.randrange(20), i) for i in range(200)], "id long, at timestamp, k long, version long")
    got = sorted((r.k, r.id) for r in streams.kept_latest(source, ["k"], "version", "t").collect())
    want = sorted((r.k, r.id) for r in source.groupBy("k").agg(F.max("id").alias("id")).collect())
    assert got == want
