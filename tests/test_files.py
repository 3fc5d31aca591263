"""File digests of any size, integrity rows, and snapshots compared from their roots."""

import hashlib
import os

import pytest
from pyspark.sql import functions as F

from folioproof.operators import integrity as I, merkle as M
from folioproof.plans.session import shared_path
from folioproof.sources import digests as D, json_edge


def test_files_of_any_size(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(D, "CHUNK", 1000)
    held = {"a/big.bin": os.urandom(100_003), "a/small.bin": b"x", "empty.bin": b"", "b/c/d.txt": "ünï".encode(), "_SUCCESS": b"", ".a.crc": b"1"}
    for name, content in held.items():
        (tmp_path / name).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / name).write_bytes(content)
    found = {os.path.relpath(r.path, tmp_path): (r.length, r.sha256) for r in D.file_digests(spark, str(tmp_path), parts=3).collect()}
    assert found == {n: (len(c), hashlib.sha256(c).hexdigest()) for n, c in held.items() if n[0] not in "_."}
    assert D.file_digests(spark, "file://" + str(tmp_path), "*.txt").count() == 1
    assert D.file_digests(spark, str(tmp_path / "none")).collect() == []


def test_sets_hold_about_equal_bytes():
    sizes = [(1_000_000, "big")] + [(100_000, f"f{i}") for i in range(40)]
    sets = D.balanced(sizes, 5)
    assert sorted(n for s in sets for n in s) == sorted(n for _, n in sizes)
    weight = dict((n, s) for s, n in sizes)
    totals = [sum(weight[n] for n in s) for s in sets]
    assert max(totals) - min(totals) <= 100_000 and D.balanced([], 3) == []


def test_integrity_states(spark):
    expected = spark.createDataFrame([(1, "a"), (2, "b"), (3, "c"), (4, None), (5, "e")], "id long, sha256 string")
    found = spark.createDataFrame([(1, "a"), (1, "a"), (2, "x"), (4, "d"), (5, "e"), (5, "f")], "id long, sha256 string")
    got = {r.id: r.state for r in I.file_integrity(expected, found, "c").collect()}
    assert got == {2: "changed", 3: "missing", 4: "changed", 5: "changed"}


def snapshot(spark, rows):
    path = shared_path(spark, "snapshot")
    M.write(spark.createDataFrame(rows, "id long, name string"), "id", path, digits=3)
    return path


def test_equal_content_has_one_root(spark):
    rows = [(i, f"n{i}") for i in range(500)]
    one, two = snapshot(spark, rows), snapshot(spark, rows[::-1])
    assert M.root(spark, one).collect() == M.root(spark, two).collect()
    assert M.differing(spark, one, two, 3).count() == 0 and M.changes(spark, one, two, "id", 3).collect() == []


def test_changes_open_few_folders(spark):
    rows = [(i, f"n{i}") for i in range(2000)]
    old = snapshot(spark, rows)
    new = snapshot(spark, [(i, "z" if i == 7 else n) for i, n in rows if i != 9] + [(-1, None)])
    got = {r.id: r.state for r in M.changes(spark, old, new, "id", 3).collect()}
    assert got == {7: "changed", 9: "missing", -1: "extra"}
    assert len(M.folders(M.differing(spark, old, new, 3))) <= 3
    place = lambda i: hashlib.sha256(str(i).encode()).hexdigest()
    assert sorted(r.prefix for r in M.differing(spark, old, new, 3).collect()) == sorted({place(i)[:3] for i in (7, 9, -1)})


def test_stored_snapshots_are_refused_twice(spark):
    path = shared_path(spark, "snapshot")
    rows = spark.range(5).withColumn("name", F.lit("x"))
    M.write(rows, "id", path, digits=2)
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        M.write(rows, "id", path, digits=2)


def test_json_edge(spark):
    paths = {"id": ("$.id", "bigint"), "x": ("$.a.x", "double")}
    lines = {'{"id":1,"a":{"x":1.5}}': [], '{"id":"z","a":{"x":2}}': ["type:id"], '{"id":2}': ["missing:x"], '{"id":3,"a":{"x":"Infinity"}}': ["non-finite:x"],
             '{"id":4,"a":{"x":null}}': ["missing:x"], '{"id":5': ["malformed"], "[1]": ["malformed"], "7": ["malformed"], "": ["malformed"], "null": ["malformed"],
             '{"id":6,"pad":"' + "x" * 100 + '"}': ["oversize"]}
    df = spark.createDataFrame([(x,) for x in lines] + [(None,)], "value string")
    got = {}
    for r in json_edge.violations(df, "value", paths, 60).collect():
        got.setdefault(r.line, []).append(r.code)
    digest = lambda s: hashlib.sha256(s.encode()).hexdigest()
    want = {digest(x): c for x, c in lines.items() if c}
    want[digest("")] = ["malformed", "malformed"]
    assert got == want
    row = df.where("value LIKE '%1.5%'").select(*json_edge.typed(F.col("value"), paths)).first()
    assert (row.id, row.x) == (1, 1.5)
