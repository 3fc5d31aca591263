"""Plans that replace a sequential rule, against the rule itself."""

import hashlib
import random

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from folioproof.operators import components as C, detect as D, matching as M, pairs as P, reviews as R, splits as S
from folioproof.plans.ordered import medians, numbered, running
from folioproof.plans.skew import lookup


def test_running_over_a_hot_key_in_chunks(spark):
    random.seed(1)
    rows = [("hot" if i % 3 else f"k{i % 7}", random.randint(0, 40), i, i % 5) for i in range(600)]
    df = spark.createDataFrame(rows, "k string, t int, id long, v long")
    got = running(df, ["k"], [F.col("t"), F.col("id")], number="n", sums={"s": F.col("v")},
                  previous={"before": F.col("v")}, parts=9).toPandas()
    want = pd.DataFrame(rows, columns=["k", "t", "id", "v"]).sort_values(["k", "t", "id"])
    want["n"] = want.groupby("k").cumcount() + 1
    want["s"] = want.groupby("k")["v"].cumsum()
    want["before"] = want.groupby("k")["v"].shift(1)
    merged = got.merge(want, on="id", suffixes=("", "_w"))
    assert len(merged) == 600
    assert (merged["n"] == merged["n_w"]).all() and (merged["s"] == merged["s_w"]).all()
    assert (merged["before"].fillna(-1) == merged["before_w"].fillna(-1)).all()


def test_numbered_and_medians(spark):
    df = spark.range(1000).select((F.col("id") * 7919 % 1009).alias("x"), (F.col("id") % 2).alias("g"))
    got = numbered(df, [F.col("x")], "n", parts=7).toPandas().sort_values("x")
    assert list(got["n"]) == list(range(1, 1001))
    want = df.toPandas().groupby("g")["x"].median()
    assert {r["g"]: r["m"] for r in medians(df, ["g"], "x", "m").collect()} == want.to_dict()


def test_lookup_keeps_every_row_of_hot_keys(spark):
    left = spark.range(100).select(F.when(F.col("id") < 60, 0).otherwise(F.col("id")).alias("k"), "id")
    table = left.groupBy("k").agg(F.min("id").alias("m"), F.count(F.lit(1)).alias("n"))
    assert lookup(left, table, "k", "n", hot_rows=5).count() == 100


@pytest.mark.parametrize("blocks", [5, 6, 7, 8])
@pytest.mark.parametrize("hot", [1, 5000])
def test_near_codes_equal_brute_force(spark, blocks, hot):
    random.seed(blocks)
    base = [random.getrandbits(64) for _ in range(25)]
    codes = set(base)
    for b in base:
        for _ in range(4):
            c = b
            for bit in random.sample(range(64), random.randint(1, 6)):
                c ^= 1 << bit
            codes.add(c)
    signed = sorted(c - (1 << 64) if c >> 63 else c for c in codes)
    df = spark.createDataFrame([(c,) for c in signed], "code long")
    got = sorted((r["left"], r["right"], r["distance"]) for r in P.near_code_pairs(df, "code", blocks=blocks, hot_bucket=hot).collect())
    mask = (1 << 64) - 1
    want = sorted((a, b, bin((a ^ b) & mask).count("1")) for i, a in enumerate(signed) for b in signed[i + 1:]
                  if bin((a ^ b) & mask).count("1") <= 4)
    assert got == want and want


def test_exact_links_span_the_groups(spark):
    df = spark.createDataFrame([(i, "a" if i % 3 == 0 else f"s{i}") for i in range(30)], "id long, sha string")
    for hot in (2, 1000):
        links = P.exact_links(df, "id", "sha", hot_rows=hot).collect()
        assert sorted((r["a"], r["b"]) for r in links) == [(0, i) for i in range(3, 30, 3)]


PAGES = "id long, source string, split string, key long"


@pytest.mark.parametrize("threshold", [0.0, 0.0005, 0.3, 0.5])
def test_big_and_small_pages_agree_at_any_threshold(spark, threshold):
    rng = random.Random(5)
    rows = []
    for page in range(2):
        for rank in range(25):
            x, y, w = rng.uniform(0, 60), rng.uniform(0, 60), rng.choice([0.0, 0.01, 1.0, 7.0, 40.0])
            rows.append((page, rank, x, y, x + w, y + w * rng.uniform(0.5, 1), round(rng.random(), 2)))
        rows.append((page, 25, 0.0, 0.0, 4096.0, 4096.0, 0.0))
    boxes = spark.createDataFrame(rows, "page long, rank long, x0 double, y0 double, x1 double, y1 double, score double")
    few, all_ = (sorted((r["page"], r["rank"]) for r in D.suppress(boxes, threshold, big_page=n).collect()) for n in (5, 1000))
    assert few == all_ and len(all_) < len(rows)


def test_slanted_boards_match_on_big_pages_too(spark):
    def taper(t):
        return [{"x": 0.0, "y": 0.0}, {"x": 8000.0 * t, "y": 8000.0 * t}, {"x": 8000.0 * t - 16, "y": 8000.0 * t + 16}, {"x": -200.0, "y": 200.0}]

    kind = "page long, number long, corners array<struct<x: double, y: double>>, labels array<string>"
    proposed = spark.createDataFrame([(1, 0, taper(1.0), ["."])], kind)
    final = spark.createDataFrame([(1, 0, taper(0.32), ["."])], kind)
    for big in (1, 1000):
        assert R.polygon_matches(proposed, final, 0.2, big_page=big).count() == 1


def test_split_links_keep_what_an_excluded_head_would_hide(spark):
    samples = spark.createDataFrame([(1, "x", 7), (2, "y", 7), (3, "z", 7), (4, "z", 7), (5, "y", 8)], "id long, source string, key long")
    sources = spark.createDataFrame([("x", "train"), ("y", "train"), ("z", "dev")], "id string, split string")
    gone = spark.createDataFrame([("x", "toxic")], "source string, reason string")
    said = spark.createDataFrame([(2, 4, "duplicate"), (1, 2, "duplicate"), (2, 3, "distinct"), (2, 5, "duplicate")], "a long, b long, decision string")
    pages = P.active_pages(samples, sources, gone, "key")
    for hot in (1, 1000):
        links = P.split_links(pages, "key", said, hot_rows=hot)
        assert sorted((r["a"], r["b"], r["decision"] or "") for r in links.collect()) == [(2, 3, ""), (2, 4, "duplicate"), (3, 4, "")]
    assert sorted((r["a"], r["b"], r["code"]) for r in P.blockers(links).collect()) == [
        (2, 3, "unresolved-duplicate"), (2, 4, "cross-split-duplicate")]
    assert tuple(P.pair_status(pages, "key", said).first()) == (1, 1)
    asked = spark.createDataFrame([(4, 2, "duplicate"), (3, 2, "duplicate"), (1, 3, "duplicate"), (3, 2, "distinct"), (3, 4, "duplicate"), (5, 2, "duplicate")],
                                  "a long, b long, decision string")
    got = {(r["a"], r["b"], r["asked"]): r["outcome"] for r in P.decide(pages, "key", said, asked).collect()}
    assert got == {(2, 4, "duplicate"): "already-resolved", (2, 3, "duplicate"): "recorded", (1, 3, "duplicate"): "unknown-or-inactive",
                   (2, 3, "distinct"): "exact-not-distinct", (3, 4, "duplicate"): "same-split", (2, 5, "duplicate"): "unknown-or-inactive"}


def test_split_links_of_nothing_and_of_null_keys(spark):
    said = spark.createDataFrame([], "a long, b long, decision string")
    empty = spark.createDataFrame([], PAGES)
    nulls = spark.createDataFrame([(1, "s", "train", None), (2, "s", "dev", None)], PAGES)
    for pages in (empty, nulls):
        assert P.split_links(pages, "key", said).collect() == []
        assert tuple(P.pair_status(pages, "key", said).first()) == (0, 0)


def test_near_links_keep_a_head_in_every_split(spark):
    splits = {0: "train", 1: "train", 2: "dev", 3: "regression", 4: "dev"}
    rows = [(i, "s", splits[i], 0) for i in range(5)] + [(5, "s", "train", 3), (6, "s", "dev", 3), (7, "s", "dev", 1 << 40)]
    rows.append((8, "s", "regression", (1 << 12) - 1))
    got = {(r["a"], r["b"]) for r in P.near_split_links(spark.createDataFrame(rows, PAGES), "key").collect()}
    near = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and bin(a[3] ^ b[3]).count("1") <= 4}
    assert got <= near
    place = {r[0]: (r[3], r[2]) for r in rows}
    assert {frozenset((place[a], place[b])) for a, b in got} == {frozenset((place[a], place[b])) for a, b in near}


def test_board_decisions_of_changed_pages_are_dropped(spark):
    old = spark.createDataFrame([(1, 0), (2, 0), (3, 0)], "id long, revision long")
    new = spark.createDataFrame([(1, 0), (2, 0), (3, 1), (4, 0)], "id long, revision long")
    changed = P.changed_pages(new, old, "revision")
    assert sorted(r["id"] for r in changed.collect()) == [3, 4]
    pairs = [(1, 2, "board-exact"), (1, 3, "board-exact"), (2, 3, "exact")]
    decided = spark.createDataFrame([(*p, "duplicate") for p in pairs], "a long, b long, reason string, decision string")
    found = P.carry_decisions(spark.createDataFrame(pairs, "a long, b long, reason string"), decided, changed).collect()
    assert {(r["a"], r["b"]): r["decision"] for r in found} == {(1, 2): "duplicate", (1, 3): None, (2, 3): "duplicate"}


def _union_find(pairs):
    parent = {}

    def find(x):
        parent.setdefault(x, x)
        while parent[x] != x:
            x = parent[x]
        return x

    for item, key in pairs:
        a, b = find(("i", item)), find(("k", key))
        parent[a] = b
    groups = {}
    for item, _ in pairs:
        groups.setdefault(find(("i", item)), set()).add(item)
    return {i: min(g) for g in groups.values() for i in g}


@pytest.mark.parametrize("hot", [2, None])
def test_components_of_chains_and_stars(spark, hot):
    random.seed(3)
    pairs = [(i, f"c{i}") for i in range(40)] + [(i + 1, f"c{i}") for i in range(40)]
    pairs += [(100 + i, "star") for i in range(30)] + [(200 + random.randint(0, 50), f"r{random.randint(0, 40)}") for _ in range(60)]
    df = spark.createDataFrame(pairs, "item long, key string")
    assert {r["item"]: r["component"] for r in C.components(df, hot_rows=hot).collect()} == _union_find(pairs)


def test_frozen_split_equals_the_sequential_rule(spark):
    random.seed(5)
    for ratios in ({"train": 0.6, "development": 0.2, "calibration": 0.2}, {"a": 0.5, "b": 0.31, "c": 0.19}):
        sizes = [(i, random.choice([1, 1, 1, 2, 2, 3, 7, 20])) for i in range(300)]
        total = sum(s for _, s in sizes)
        names, counts, want = list(ratios), dict.fromkeys(ratios, 0), {}
        for c, s in sorted(sizes, key=lambda x: (-x[1], hashlib.sha256(f"7:{x[0]}".encode()).hexdigest())):
            pick = min(names, key=lambda n: (counts[n] / (total * ratios[n]), names.index(n)))
            want[c] = pick
            counts[pick] += s
        df = spark.createDataFrame(sizes, "component long, size long")
        assert {r["component"]: r["split"] for r in S.freeze(df, 7, ratios).collect()} == want


def _iou(a, b):
    w, h = min(a[2], b[2]) - max(a[0], b[0]), min(a[3], b[3]) - max(a[1], b[1])
    s = max(w, 0) * max(h, 0)
    return s / max(1e-9, (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - s)


def _boxes(spark, pages=6, n=9, seed=0):
    random.seed(seed)
    pred, truth = [], []
    for page in range(pages):
        for i in range(n):
            x, y, w, h = random.uniform(0, 60), random.uniform(0, 60), random.uniform(20, 60), random.uniform(20, 60)
            truth.append((page, i, x, y, x + w, y + h))
            dx, dy = random.uniform(-8, 8), random.uniform(-8, 8)
            pred.append((page, i, x + dx, y + dy, x + w + dx, y + h + dy, round(random.random(), 1)))
    return (pred, truth, spark.createDataFrame(pred, "page long, rank long, x0 double, y0 double, x1 double, y1 double, score double"),
            spark.createDataFrame(truth, "page long, number long, x0 double, y0 double, x1 double, y1 double"))


@pytest.mark.parametrize("big", [0, 1000])
def test_matching_equals_the_sequential_rule(spark, big):
    pred, truth, p, t = _boxes(spark)
    want = {}
    for k, limit in enumerate(D.IOU_GRID):
        for page in {r[0] for r in pred}:
            used = set()
            for r in sorted((r for r in pred if r[0] == page), key=lambda r: (-r[6], r[1])):
                free = [(_iou(r[2:6], b[2:6]), -b[1]) for b in truth if b[0] == page and b[1] not in used and _iou(r[2:6], b[2:6]) >= limit]
                if free:
                    used.add(-max(free)[1])
                    want[page, r[1], k] = -max(free)[1]
    rows = D.match(p, t, big_page=big).collect()
    got = {(r["page"], r["rank"], k): v for r in rows for k, v in enumerate(r["truths"]) if v is not None}
    assert len(rows) == len(pred) and got == want


@pytest.mark.parametrize("big", [0, 1000])
@pytest.mark.parametrize("threshold", [0.2, 0.5])
@pytest.mark.parametrize("at_most", [None, 3])
def test_suppression_equals_the_sequential_rule(spark, big, threshold, at_most):
    pred, _, p, _ = _boxes(spark, seed=2)
    want = set()
    for page in {r[0] for r in pred}:
        kept = []
        for r in sorted((r for r in pred if r[0] == page), key=lambda r: (-r[6], r[1])):
            if all(_iou(r[2:6], q[2:6]) <= threshold for q in kept):
                kept.append(r)
            if at_most and len(kept) >= at_most:
                break
        want |= {(page, r[1]) for r in kept}
    got = {(r["page"], r["rank"]) for r in D.suppress(p, threshold, big_page=big, at_most=at_most).collect()}
    assert got == want


def test_average_precision_and_operating_point(spark):
    pred, truth, p, t = _boxes(spark, pages=8, seed=4)
    rows = D.match(p, t).collect()
    order = sorted(rows, key=lambda r: (-r["score"], r["page"], r["rank"]))
    for line in D.precision_recall(D.match(p, t), t).collect():
        k = min(range(10), key=lambda i: abs(D.IOU_GRID[i] - line["iou"]))
        tp, curve = 0, []
        for n, r in enumerate(order, 1):
            tp += r["truths"][k] is not None
            curve.append((tp / n, tp / len(truth)))
        ap = sum(max((a for a, b in curve if b >= i / 100), default=0) / 101 for i in range(101))
        assert line["ap"] == pytest.approx(ap, abs=1e-9) and line["recall"] == pytest.approx(curve[-1][1])
    pages = spark.createDataFrame([(i, "boards") for i in range(8)] + [(8, "partial"), (9, "negative")], "page long, kind string")
    extra = spark.createDataFrame([(8, 0, 0.0, 0.0, 30.0, 30.0, 0.55)], p.schema)
    best = D.operating_point(pages, t, D.match(p.unionByName(extra), t)).first()
    ok = [s for s in {r["score"] for r in rows} if s > 0.55]
    recall = {s: sum(r["truths"][0] is not None for r in rows if r["score"] >= s) / len(truth) for s in ok}
    top = max(recall.values())
    assert best["recall"] == pytest.approx(top) and best["threshold"] == max(s for s in ok if recall[s] == top)


def test_rounds_of_claims(spark):
    random.seed(9)
    edges = [(0, i, j, round(random.random(), 2)) for i in range(8) for j in range(8) if random.random() < 0.6]
    df = spark.createDataFrame(edges, "g long, p long, t long, w double")
    want, up, ut = set(), set(), set()
    for _, i, j, w in sorted(edges, key=lambda e: (e[3], e[1], e[2]), reverse=True):
        if i not in up and j not in ut:
            up.add(i)
            ut.add(j)
            want.add((i, j))
    got = M.claim_in_rounds(df, ["g"], F.struct("w", "p", "t"))
    assert {(r["p"], r["t"]) for r in got.collect()} == want


def test_cells_never_lose_a_pair():
    rng = np.random.default_rng(0)
    for _ in range(20000):
        a = rng.uniform(0, 50, 2)
        w = rng.uniform(1, 40)
        b = [a[0] + rng.uniform(-w, w), 0.0]
        v = w * rng.uniform(0.5, 2)
        shared = min(a[0] + w, b[0] + v) - max(a[0], b[0])
        if shared >= 0.5 * max(w, v):
            la, lb = np.floor(np.log2(w)), np.floor(np.log2(v))
            assert abs(la - lb) <= 1
            unit = 2.0 ** (lb + 1)
            assert abs(np.floor((a[0] + w / 2) / unit) - np.floor((b[0] + v / 2) / unit)) <= 1


@pytest.mark.parametrize("big", [0, 4096])
def test_polygon_matches_do_not_depend_on_the_plan(spark, big):
    from folioproof.operators.reviews import polygon_matches
    _, _, p, t = _boxes(spark, seed=11)

    def boards(df, n):
        corner = [("x0", "y0"), ("x1", "y0"), ("x1", "y1"), ("x0", "y1")]
        return df.select("page", F.col(n).alias("number"), F.array(*[F.struct(F.col(a).alias("x"), F.col(b).alias("y")) for a, b in corner]).alias("corners"),
                         F.array(F.lit(".")).alias("labels"))

    pred, truth, _, _ = _boxes(spark, seed=11)
    want = set()
    for page in {r[0] for r in pred}:
        pairs = sorted(((_iou(a[2:6], b[2:6]), a[1], b[1]) for a in pred if a[0] == page for b in truth if b[0] == page), reverse=True)
        up, ut = set(), set()
        for v, i, j in pairs:
            if v >= 0.5 and i not in up and j not in ut:
                up.add(i)
                ut.add(j)
                want.add((page, i, j))
    got = polygon_matches(boards(p, "rank"), boards(t, "number"), big_page=big)
    assert {(r["page"], r["p"], r["t"]) for r in got.collect()} == want
