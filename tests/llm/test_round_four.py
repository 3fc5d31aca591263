"""Edited passages beside fragments of earlier texts."""

import random

import corpus_pipeline
from folioproof.llm import passages

from .test_operators import ODD, fresh, table


def diluted(rng, a):
    return [w for i in range(0, len(a), 10) for w in a[i:i + 10] + fresh(rng, 10)]


#: Earlier texts that hold an 80-word passage in parts or with other words between.
EARLIER = {
    "halves": lambda rng, a: [a[:40], a[40:]],
    "five times": lambda rng, a: [a[:40], a[40:]] * 5,
    "small": lambda rng, a: [a[i:i + 15] for i in range(0, 80, 15)],
    "overlapping": lambda rng, a: [a[i:i + 40] for i in range(0, 60, 20)],
    "diluted": lambda rng, a: [diluted(rng, a)],
    "swapped": lambda rng, a: [a[40:] + fresh(rng, 3) + a[:40]],
}


def planted(rng, times):
    """(texts, {id of an edited copy: kind}); the copy has one edit in ten words, at words 60 to 139 of its text."""
    texts, copies = [], {}
    for kind, parts in EARLIER.items():
        for _ in range(times):
            a = fresh(rng, 80)
            for part in [*parts(rng, a), a, [f"e{rng.randrange(10 ** 9)}" if j % 10 == 9 else w for j, w in enumerate(a)]]:
                texts.append((10000 + len(texts), " ".join(fresh(rng, 60) + part + fresh(rng, 60))))
            copies[texts[-1][0]] = kind
    return texts, copies


def test_op1_finds_edited_passages_beside_fragments(spark):
    texts, copies = planted(random.Random(41), 20)
    got = {r.doc_id: r for r in passages.repeats(table(spark, texts + ODD)).collect()}
    assert len(got) == len({i for i, _ in texts + ODD})
    share = {}
    for i, kind in copies.items():
        share.setdefault(kind, []).append(any(x["first"] <= 70 and x["last"] >= 130 for x in got[i].spans))
    share = {k: sum(v) / len(v) for k, v in share.items()}
    assert min(share.values()) >= 0.9, share
    assert all(r.n_repeated == 0 for i, r in got.items() if i not in copies)


def test_a_seed_meets_the_first_texts_that_have_it(spark):
    rows = [(s, k, at) for s in range(3) for k in range(s, 30, s + 1) for at in range(k % 3 + 1)]
    found = spark.createDataFrame(rows, "seed long, k long, at int")
    for heads in (1, 3):
        want = sorted((k, at, o, 0) for s, k, at in rows for o in sorted({o for t, o, _ in rows if t == s})[:heads] if o < k)
        for size in ("2000", "4"):
            before = spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")
            spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", size)
            try:
                assert sorted(map(tuple, passages.matches(found, heads).collect())) == want
            finally:
                spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", before)


def test_the_pipeline_cuts_edited_passages_beside_fragments(spark):
    texts, copies = planted(random.Random(42), 5)
    before = {i: t.split() for i, t in texts}
    left = {r.doc_id: r.text.split() for r in corpus_pipeline.cut_repeats(spark, table(spark, texts), "").collect()}
    assert left.keys() == before.keys() and all(left[i] == before[i] for i in before if i not in copies)
    assert sum(len(left[i]) <= 140 for i in copies) >= 0.9 * len(copies)
