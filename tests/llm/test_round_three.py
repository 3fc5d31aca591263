"""Periodic runs, SimHash and hard negatives against brute force, with odd rows."""

import hashlib
import random
import zlib

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st

from folioproof.llm import negatives, periods, simhash
from folioproof.llm.queries import QUERIES, SQL
from folioproof.plans.registry import Tables
from tests.oracle import compare, duck

SCHEMA = "doc_id long, text string, n_chars long, k string, t string, print string"
ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "two words"), (None, "no id here at all"), (906, "Ünïcode 漢字 \x00 end"),
       (907, "long " * 30000), (908, "tie tie tie"), (908, "tie tie tie"), (908, "tie tie tie tie tie tie"), (909, "Tie tie Tie tie Tie tie"),
       (910, "no break no break no break no break no break no break")]


def table(spark, texts):
    return spark.createDataFrame([(i, t, None if t is None else len(t), "z", "z", None) for i, t in texts], SCHEMA)


def brute_runs(words, least=6, times=4):
    n, out = len(words), []
    for q in range(1, n // times + 1):
        same = [words[i] == words[i + q] for i in range(n - q)]
        i = 0
        while i < n - q:
            j = i
            while j < n - q and same[j]:
                j += 1
            length = j - i + q
            if j > i and length >= max(least, times * q):
                part = words[i:i + length]
                if not any(all(part[x] == part[x + p] for x in range(length - p)) for p in range(1, q)):
                    out.append((i, length, q))
            i = j + 1 if j == i else j
    return sorted(out, key=lambda r: (r[0], r[2]))


@settings(max_examples=300, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 2), min_size=1, max_size=9), st.integers(1, 8)), max_size=8), st.sampled_from([(6, 4), (6, 3), (20, 3), (3, 5)]))
def test_runs_of_any_words(parts, how):
    words = [x for part, times in parts for x in part * times]
    assert periods.text_runs(np.array(words, np.int64), *how) == brute_runs(words, *how)


def test_lag_classes_cover_every_lag():
    for least, times in ((6, 4), (100, 3), (1, 3), (6, 5)):
        at = 1
        for low, high, k in periods.lag_classes(5000, least, times):
            assert low == at and k >= 2 * high and all(k <= periods.overlap(q, least, times) for q in range(low, high + 1))
            at = high + 1
        assert at > 5000


def periodic(rng):
    def unit(n):
        return [f"u{rng.randrange(3)}" for _ in range(n)]

    # A period in which short grams recur sooner than the period.
    block = unit(40)
    texts = [(1, block * 2 + ["x"] + block * 2 + ["x"]), (2, (block + block + ["y"]) * 5), (3, unit(200) + unit(33) * 6 + unit(17) * 9 + unit(60))]
    for i in range(4, 40):
        texts.append((i, sum((unit(rng.randrange(1, 30)) * rng.randrange(1, 7) for _ in range(4)), [])))
    return [(i, " ".join(w)) for i, w in texts]


def test_detect(spark):
    texts = periodic(random.Random(2)) + ODD
    docs = table(spark, texts)
    rows = periods.detect(docs).collect()
    assert len(rows) == len(texts)
    want = {}
    for i, t in texts:
        words = (t or "").encode().split()
        runs = [(0, len(words), 1)] if i == 907 else brute_runs(words)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        want.setdefault(i, []).append((len(words), runs, b" ".join(w for x, w in enumerate(words) if x not in gone).decode()))
    for i in want:
        assert sorted((r.n_words, [tuple(x) for x in r.runs], r.collapsed) for r in rows if r.doc_id == i) == sorted(want[i])
    assert periods.detect(docs.limit(0)).collect() == []
    with pytest.raises(ValueError):
        periods.detect(docs, times=2)


def test_periodic_query(spark):
    rng = random.Random(4)
    texts = periodic(rng) + [(i, t) for i, t in ODD if i != 907]
    texts += [(i, " ".join(f"w{rng.randrange(9)}" for _ in range(rng.randrange(1, 90)))) for i in range(1000, 1200)]
    tables = type("", (), {"documents": table(spark, texts)})()
    got = QUERIES["op12_periodic_runs"](tables).collect()
    want = []
    for i, t in texts:
        words = (t or "").encode().split()
        if i is not None and words:
            h = zlib.crc32(str(i).encode())
            g, n = h // 10, len(words)
            if h % 10 == 0:
                a = g % n
                p = 1 + (n - a) // (3 + g % 8)
                words = [words[x] if x < a else words[a + (x - a) % p] for x in range(n)]
        runs = brute_runs(words)
        gone = {x for s, n, q in runs for x in range(s + q, s + n)}
        best = min(((-n, s, q) for s, n, q in runs), default=None)
        want.append((i, len(runs), *((best[1], -best[0], best[2], 1000 * -best[0] // best[2]) if best else (None,) * 4),
                     hashlib.sha256("".join(f"{s},{n},{q}\n" for s, n, q in runs).encode()).hexdigest(),
                     hashlib.sha256(b" ".join(w for x, w in enumerate(words) if x not in gone)).hexdigest()))
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert sum(r.n_runs > 0 for r in got) > 40


def brute_print(text):
    words = text.encode().lower().split()
    grams = [b" ".join(words[i:i + 3]) for i in range(len(words) - 2)] if len(words) >= 3 else ([b" ".join(words)] if words else [])
    h = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def brute_parts(prints, radius=3):
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(prints)):
        for j in range(i):
            if (prints[i] ^ prints[j]).bit_count() <= radius:
                a, b = sorted((top(i), top(j)))
                parent[b] = a
    return [top(i) for i in range(len(prints))]


def test_simhash(spark):
    rng = random.Random(6)
    texts = list(ODD)
    for c in range(25):
        base = [f"w{rng.randrange(500)}" for _ in range(rng.randrange(3, 400))]
        for k in range(6):
            copy = list(base)
            for _ in range(rng.randrange(3)):
                copy[rng.randrange(len(copy))] = "E"
            texts.append((c * 10 + k, " ".join(copy)))
    docs = table(spark, texts)
    got = simhash.linked(docs).collect()
    prints = [brute_print(t or "") for _, t in texts]
    parts = brute_parts(prints)
    least = {}
    for (i, _), p in zip(texts, parts):
        least[p] = i if least.get(p) is None else min(least[p], i) if i is not None else least[p]
    want = [(i, f"{f:016x}", least[p]) for (i, _), f, p in zip(texts, prints, parts)]
    assert sorted(map(str, want)) == sorted(str(tuple(r)) for r in got)
    assert len({p for p in parts}) < len(texts) - 40
    assert simhash.linked(docs.limit(0)).collect() == []


def prints_with_crowds(rng, n):
    """Chance prints, chains of neighbours, a crowd around one print, and a crowd that shares a half."""
    out = [rng.getrandbits(64) for _ in range(n)]
    for _ in range(n // 4):
        x = rng.choice(out)
        for _ in range(rng.randrange(1, 4)):
            x ^= 1 << rng.randrange(64)
        out.append(x)
    center, half = rng.getrandbits(64), rng.getrandbits(32)
    for _ in range(n // 2):
        x = center
        for _ in range(rng.randrange(4)):
            x ^= 1 << rng.randrange(64)
        out += [x, half << 32 | rng.getrandbits(32)]
    return sorted(set(out))


def groups_of(prints, links):
    index = {p: i for i, p in enumerate(prints)}
    parent = list(range(len(prints)))

    def top(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for a, b in links:
        assert (a ^ b).bit_count() <= 3
        a, b = sorted((top(index[a]), top(index[b])))
        parent[b] = a
    return [top(i) for i in range(len(prints))]


def test_trees_of_every_depth(spark, monkeypatch):
    """Upper trees of many leaves, and shards that split down to a few prints, give the components of all pairs."""
    monkeypatch.setattr(simhash, "SHARD", 64)
    prints = prints_with_crowds(random.Random(8), 800)
    want = brute_parts(prints)
    points = spark.createDataFrame([(p - (1 << 64) if p >> 63 else p,) for p in prints], "print long")
    links = [(r.u % (1 << 64), r.v % (1 << 64)) for r in simhash.near_links(points).collect()]
    assert groups_of(prints, links) == want
    assert len(links) < 3 * len(prints)
    array = np.array(prints, np.uint64)
    for cells in (64, 4096):
        monkeypatch.setattr(simhash, "CELLS", cells)
        found = [simhash.joined(array, array[:0], half, 3) for half in simhash.HALVES]
        assert groups_of(prints, [(prints[a], prints[b]) for part in found for a, b in part.tolist()]) == want


def test_trees_prune_and_deal_once():
    array = np.random.default_rng(1).integers(0, 1 << 63, 20000, dtype=np.uint64)
    tree, leaves = simhash.grow(array[:4000], simhash.LOW, 3, 32)
    row, leaf, own = simhash.dealt(tree, array)
    assert leaves > 16 and sorted(row[own].tolist()) == list(range(len(array)))
    assert len(row) < len(array) * leaves / 4


VECTORS = "vec_id long, embedding array<float>, label int, id string, v string, digest string"


def brute_negatives(rows):
    held = {}
    for i, vec, label in rows:
        if i is None or vec is None or label is None or any(x is None or not np.isfinite(x) for x in vec):
            continue
        label = (label + 1) % 10 if i % 7 == 0 else label
        held[i, label, tuple(int(np.floor(256 * np.float64(np.float32(x)))) for x in vec)] = True
    out = []
    for i, label, v in held:
        if i % 50:
            continue
        score = [(sum(x * y for x, y in zip(v, w)), j, other) for j, other, w in held if j != i and len(w) == len(v)]
        for p, pid in sorted(((s, j) for s, j, other in score if other == label), key=lambda x: (-x[0], x[1]))[:5]:
            fit = sorted(((s, j) for s, j, other in score if other != label and 50 * p <= 100 * s <= 95 * p), key=lambda x: (-x[0], x[1]))[:3]
            out += [(i, pid, r + 1, j, p, s) for r, (s, j) in enumerate(fit)]
    return sorted(out)


@pytest.mark.parametrize("size", [1, 5, 64, 100])
def test_negatives(spark, size):
    rng = np.random.default_rng(size)
    centers = rng.standard_normal((6, size))
    rows = []
    for i in range(600):
        v = centers[rng.integers(6)] + rng.standard_normal(size) * rng.choice([0.05, 0.5, 2])
        rows.append((i, (v / 3).tolist(), int(rng.integers(10) if rng.random() < 0.6 else 3)))
    rows += [(601, None, 1), (602, [None] * size, 1), (603, [float("nan")] * size, 2), (604, [float("inf")] * size, 2), (605, [0.5] * size, None),
             (None, [0.5] * size, 3), (650, [0.0] * size, 3), (651, [0.25] * (size + 1), 3), (652, [], 3), (700, [], 3), (701, [], 4), rows[50], rows[51], rows[51]]
    # A label of two rows, one of one row.
    rows += [(850, rows[5][1], 20), (851, rows[6][1], 20), (900, rows[7][1], 21)]
    # Ties: many ids with one vector.
    rows += [(i, rows[3][1], i % 3) for i in range(750, 800)]
    table = spark.createDataFrame([(*r, "z", "z", None) for r in rows], VECTORS)
    got = sorted(tuple(r) for r in negatives.mine(table).collect())
    assert got == brute_negatives(rows) and got
    assert negatives.mine(table.limit(0)).collect() == []


def test_too_long_vectors_take_no_part(spark):
    rows = [(0, [1e30, 1.0], 1), (1, [1.0, 1.0], 1), (50, [1.0, 1.0], 1), (2, [0.9, 0.8], 2)]
    got = negatives.mine(spark.createDataFrame([(*r, "", "", "") for r in rows], VECTORS)).collect()
    assert {r.anchor_id for r in got} == {50} and all(r.positive_id == 1 for r in got)


def test_intervals_hold_the_product_and_rule_out():
    rng = np.random.default_rng(3)
    rows = np.floor(256 * rng.standard_normal((2000, 64)) / 8).astype(np.int64)
    words, scale = negatives.encode(rows)
    low, high = negatives.Anchors(rows[:20]).interval(np.arange(20), words, scale)
    exact = rows[:20] @ rows.T
    assert (low <= exact).all() and (exact <= high).all()
    third = np.sort(exact, axis=1)[:, -4][:, None]
    assert (high < third).mean() > 0.4


def test_negatives_table(spark):
    folder = "/root/testdata/sf0.01"
    df = QUERIES["op13_hard_negatives"](Tables(spark, folder))
    found = duck(folder).execute(SQL["op13_hard_negatives"])
    assert compare(df.columns, df.collect(), [d[0] for d in found.description], found.fetchall()) is None
