"""Near duplicates: kept index against a rebuild, counts and decisions against all pairs."""

import random

from folioproof.operators import near_gate as N
from folioproof.operators.near_index import NearIndex
from folioproof.operators.pairs import near_code_pairs
from folioproof.plans.session import shared_path


def signed(x):
    return x - (1 << 64) if x >> 63 else x


def brute(codes, k=4):
    codes = sorted(set(codes))
    return {(a, b, ((a ^ b) & ((1 << 64) - 1)).bit_count()) for i, a in enumerate(codes) for b in codes[i + 1:] if ((a ^ b) & ((1 << 64) - 1)).bit_count() <= k}


def crowd(rng, n):
    out = [rng.getrandbits(64) for _ in range(n)]
    center = rng.getrandbits(64)
    for x in out[: n // 2]:
        y, z = x, center
        for _ in range(rng.randrange(6)):
            y ^= 1 << rng.randrange(64)
            z ^= 1 << rng.randrange(16)
        out += [y, z]
    return [signed(x) for x in out]


def pages(spark, rows):
    return spark.createDataFrame(rows, "page long, revision long, code long")


def test_generations_equal_a_rebuild(spark):
    rng = random.Random(1)
    codes = crowd(rng, 200)
    held = dict(enumerate(codes))
    index = NearIndex(spark, shared_path(spark, "near"), 400, parts=8)
    index.update(pages(spark, [(i, 0, c) for i, c in held.items()]), 1)
    for gen in (2, 3):
        changes = []
        for i in rng.sample(sorted(held), 20):
            held[i] = rng.choice([None, rng.choice(codes) ^ 1, signed(rng.getrandbits(64))])
            changes.append((i, gen, held[i]))
        # An older revision that comes late changes nothing; its code is known from then on.
        late = (changes[0][0], 0, rng.choice(codes) ^ 2)
        index.update(pages(spark, [*changes, late]), gen)
        index.update(pages(spark, [(0, 99, None)]), gen)  # sent again: skipped
        held = {i: c for i, c in held.items() if c is not None}
        got = {(r.left, r.right, r.distance): (r.pages_left, r.pages_right) for r in index.pairs().collect()}
        assert set(got) == brute(held.values())
        for (a, b, _), (x, y) in got.items():
            values = list(held.values())
            assert (x, y) == (values.count(a), values.count(b))
    assert index.generations() == [1, 2, 3]


def test_a_change_reads_few_folders(spark):
    rng = random.Random(2)
    index = NearIndex(spark, shared_path(spark, "near"), 300, parts=32)
    index.update(pages(spark, [(i, 0, signed(rng.getrandbits(64))) for i in range(300)]), 1)
    one = pages(spark, [(5, 1, 12345)])
    keys = index.cut.keyed(one.select("code"))
    assert index._read("keys").count() == 300 * keys.count()
    assert index.held(keys).count() < 0.35 * index._read("keys").count()


def test_crowded_buckets_meet_whole(spark):
    codes = crowd(random.Random(3), 150)
    found = near_code_pairs(spark.createDataFrame([(c,) for c in set(codes)], "code long"), "code", hot_bucket=5)
    rows = [(r.left, r.right, r.distance) for r in found.collect()]
    assert len(rows) == len(set(rows)) and set(rows) == brute(codes)


def gate_rows(spark, held, rulings):
    docs = spark.createDataFrame(held, "id long, source string, split string, codes array<long>")
    ruled = spark.createDataFrame(rulings, "a long, b long, decision string")
    return docs, ruled, N.gate(docs, ruled)


def test_five_holders_in_three_splits(spark):
    held = [(i, "s", s, [7]) for i, s in enumerate(["train", "train", "dev", "dev", "test"])] + [(9, "s", "train", [7 ^ 3]), (10, "s", None, [7]), (11, "s", "dev", [None])]
    rulings = [(0, 2, "distinct"), (3, 0, "duplicate"), (0, 3, "distinct"), (9, 4, "distinct"), (0, 77, "duplicate"), (1, 1, "duplicate")]
    docs, ruled, gated = gate_rows(spark, held, rulings)
    got = {(r.left, r.right, r.split_left, r.split_right): (r.pairs, r.duplicates, r.distincts, r.unresolved) for r in gated.collect()}
    assert got[7, 7, "dev", "train"] == (4, 1, 1, 2)  # only the decided pairs are off
    assert got[7, 7, "train", "train"] == (1, 0, 0, 1)
    assert got[4, 7, "train", "test"] == (1, 0, 1, 0)
    assert got[7, 7, "test", "train"] == (2, 0, 0, 2)
    assert sum(v[0] for v in got.values()) == 6 * 5 // 2
    assert {r.id for r in N.near_dropped(docs, ruled).collect()} == {3}
    codes = {(r.left, r.split_left, r.split_right): r.code for r in N.near_blockers(gated).collect()}
    assert codes[7, "dev", "train"] == "unresolved-duplicate" and (4, "train", "test") not in codes


def test_boards_of_one_page_are_no_pair(spark):
    held = [(1, "s", "train", [5, 5, 4]), (2, "s", "dev", [5]), (3, "s", "dev", [0xFFFFF << 20])]
    docs, ruled, gated = gate_rows(spark, held, [(1, 2, "duplicate")])
    got = {(r.left, r.right): (r.pairs, r.duplicates, r.unresolved) for r in gated.collect()}
    assert got == {(5, 5): (2, 2, 0), (4, 5): (1, 1, 0)}
    assert [r.code for r in N.near_blockers(gated).collect()] == ["cross-split-duplicate"] * 2
    said = {(r.a, r.b): r.outcome for r in N.near_decide(docs, ruled, spark.createDataFrame(
        [(2, 1, "distinct"), (1, 3, "distinct"), (2, 3, "no")], "a long, b long, decision string")).collect()}
    assert said == {(1, 2): "already-resolved", (1, 3): "unknown-or-inactive", (2, 3): "invalid-decision"}


def test_empty(spark):
    docs, ruled, gated = gate_rows(spark, [], [])
    assert gated.collect() == [] and N.status(gated).first()[0] == 0


def test_open_pages_against_all_pairs(spark):
    import itertools
    import random

    from folioproof.operators import open_pairs as O
    rng = random.Random(5)
    base = [rng.getrandbits(62) for _ in range(6)]
    pages = [(i, "s", rng.choice(["train", "dev", "regression", None]), [rng.choice(base) ^ sum(1 << b for b in rng.sample(range(62), rng.choice([0, 0, 2, 3])))
                                                                          for _ in range(rng.choice([0, 1, 1, 2]))]) for i in range(60)]
    rulings = [(*rng.sample(range(60), 2), rng.choice(["duplicate", "distinct"])) for _ in range(150)]
    settled = {frozenset(r[:2]) for r in rulings}
    want = {}
    for x, y in itertools.combinations(pages, 2):
        if None not in (x[2], y[2]) and x[2] != y[2] and frozenset((x[0], y[0])) not in settled:
            n = sum(bin(c ^ d).count("1") <= 4 for c in x[3] for d in y[3])
            for i in (x[0], y[0]):
                want[i] = want.get(i, 0) + n
    df = spark.createDataFrame(pages, "id long, source string, split string, codes array<long>")
    said = spark.createDataFrame(rulings, "a long, b long, decision string")
    assert {r.id: r.open_pairs for r in O.open_near_pages(df, said, 4).collect()} == {k: v for k, v in want.items() if v}
    assert O.open_near_pages(df.limit(0), said, 4).collect() == []
