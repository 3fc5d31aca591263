"""Components kept under change equal a full run."""

import random

import pytest

from folioproof.operators import components as C


def frame(spark, rows):
    return spark.createDataFrame(rows, "item long, key string")


def labels(df):
    return {r.item: r.component for r in df.collect()}


@pytest.mark.parametrize("hot_rows", [None, 3])
def test_added_and_removed_items(spark, hot_rows):
    rng = random.Random(11)
    rows = [(i, f"k{rng.randrange(120)}") for i in range(160) for _ in range(rng.randrange(1, 3))]
    old, new = rows[:150], rows[150:] + [(rows[3][0], "k0"), (rows[90][0], "k0"), (900, "fresh"), (901, "fresh"), (-5, "k1"), (902, "lonely")]
    held = C.components(frame(spark, old))
    got = C.grown(held, frame(spark, old), frame(spark, new), hot_rows)
    want = labels(C.components(frame(spark, old + new)))
    rows_out = got.collect()
    assert len(rows_out) == len(want) and labels(got) == want
    gone = {i for i, _ in old if i % 9 == 0}
    left = C.shrunk(got, frame(spark, old + new), frame(spark, [(i, "") for i in gone]), hot_rows)
    assert labels(left) == labels(C.components(frame(spark, [r for r in old + new if r[0] not in gone])))


def test_nothing_added_or_removed(spark):
    rows = frame(spark, [(1, "a"), (2, "a"), (3, "b")])
    held = C.components(rows)
    none = rows.limit(0)
    assert labels(C.grown(held, rows, none)) == labels(C.shrunk(held, rows, none)) == {1: 1, 2: 1, 3: 3}
    assert labels(C.grown(held.limit(0), none, rows)) == {1: 1, 2: 1, 3: 3}
