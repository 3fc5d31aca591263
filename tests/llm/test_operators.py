"""Each operator against brute force on small tables with odd rows, and on the given tables."""

import base64
import hashlib
import io
import random
import re
import zipfile
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioproof.llm import decontaminate, jaccard, joints, licenses, passages, quality, spots, toxicity, url_rules, warc_zip
from folioproof.llm.labelled import Sample
from folioproof.llm.queries import QUERIES, URL_RULES
from folioproof.plans.registry import Tables

SF = "/root/testdata/sf0.01"
SCHEMA = "doc_id long, text string, n_chars long, score string, other string, items string"


def words(rng, n, size=4000):
    return [f"w{int(rng.paretovariate(0.6)) % size}x" for _ in range(n)]


def table(spark, texts):
    rows = [(i, t, None if t is None else len(t), "z", None, "z") for i, t in texts]
    return spark.createDataFrame(rows, SCHEMA)


ODD = [(900, None), (901, ""), (902, " \t\n"), (903, "one"), (904, "one"), (905, "two words"), (None, "no id here at all"), (906, "Ünïcode 漢字 \x00 end"),
       (907, "long " * 30000), (908, "tie tie tie"), (908, "tie tie tie")]


def near_copies(rng):
    """Chains of edited copies, exact copies and a passage that many share."""
    texts, passage = [], words(rng, 60)
    for c in range(12):
        base = words(rng, rng.randrange(40, 400))
        for k in range(6):
            copy = list(base)
            for _ in range(rng.randrange(0, 1 + len(base) // 60)):
                copy[rng.randrange(len(copy))] = f"e{rng.randrange(10 ** 6)}"
            texts.append((c * 20 + k, " ".join(copy)))
        texts.append((c * 20 + 7, " ".join(words(rng, 120) + passage + words(rng, 120))))
    return texts


def brute_components(texts, n, percent):
    sets = {}
    for i, t in texts:
        w = re.findall(rb"[^\x20\x09-\x0D]+", (t or "").encode().lower())
        sets[i] = {tuple(w[j:j + n]) for j in range(len(w) - n + 1)} if len(w) >= n else ({tuple(w)} if w else set())
    ids = [i for i in sets if i is not None]
    parent = {i: i for i in ids}

    def root(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for x in ids:
        for y in ids:
            if x < y and sets[x] and sets[y] and 100 * len(sets[x] & sets[y]) >= percent * len(sets[x] | sets[y]):
                a, b = sorted((root(x), root(y)))
                parent[b] = a
    return {i: (len(sets[i]), root(i)) for i in ids}


@pytest.mark.parametrize("n,percent", [(4, 85), (5, 80)])
def test_jaccard(spark, n, percent):
    texts = near_copies(random.Random(n)) + ODD
    docs = table(spark, texts)
    got = jaccard.linked(docs, n, percent).collect()
    want = brute_components(texts, n, percent)
    assert len(got) == len(texts)
    assert all((r.n_shingles, r.component_id) == want[r.doc_id] for r in got if r.doc_id is not None)
    left = [r.doc_id for r in jaccard.one_of_each(docs, n, percent).collect()]
    assert sorted(i for i in left if i is not None) == sorted({c for i, (_, c) in want.items()}) and left.count(None) == 1
    assert jaccard.linked(docs.limit(0), n, percent).collect() == []


def test_bitmap_and_prefix_bounds():
    for n in range(1, 3000, 7):
        assert 1 <= jaccard.prefix_length(n) <= n


def test_passages(spark):
    # Words that do not repeat by chance, so bounds are exact.
    words = lambda rng, n: [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]
    rng = random.Random(5)
    shared, fuzzy = words(rng, 80), words(rng, 120)
    edited = list(fuzzy)
    for at in (30, 31, 70, 95):
        edited[at] = "changed"
    del edited[50]
    a = words(rng, 150) + shared + words(rng, 90)
    b = words(rng, 40) + shared + words(rng, 200) + fuzzy + words(rng, 30)
    c = words(rng, 70) + edited + words(rng, 60) + shared
    d = words(rng, 500)
    e = words(rng, 30) + shared[:30] + words(rng, 30)
    texts = [(1, " ".join(a)), (2, " ".join(b)), (3, " ".join(c)), (4, " ".join(d)), (5, " ".join(e))] + ODD
    docs = table(spark, texts)
    got = {r.doc_id: r for r in passages.repeats(docs).collect()}
    assert [tuple(x) for x in got[2].spans] == [(40, 120)] and got[2].sources == [1]
    (p, q), (s, t) = [tuple(x) for x in got[3].spans]
    assert abs(p - 70) <= 2 and abs(q - 189) <= 2 and (s, t) == (249, 329)
    assert all(got[i].n_repeated == 0 for i in (1, 4, 5, 900, 901, 903, 907, 908))
    left = {r.doc_id: r for r in passages.remove(docs).collect()}
    assert left[2].text.split() == b[:40] + b[120:] and left[2].n_chars == len(left[2].text)
    assert left[1].text == " ".join(a) and left[4].text == " ".join(d) and left[2].other is None and left[2].items == "z"
    assert passages.remove(docs).count() == len(texts) and passages.repeats(docs.limit(0)).collect() == []


def fresh(rng, n):
    """Words that do not repeat by chance."""
    return [f"u{rng.randrange(10 ** 9)}" for _ in range(n)]


def test_passages_beside_fragments(spark):
    # Each window of 50 words against brute force: the smallest ids hold parts too short to be passages.
    rng = random.Random(11)
    texts, i = {}, 0
    for c in range(20):
        x, y = fresh(rng, 45), fresh(rng, 45)
        for t in (x, y, x + y, x + y):
            texts[i] = fresh(rng, rng.randrange(60)) + t + fresh(rng, rng.randrange(60))
            i += 1
        # The first text holds every part of its passage before the passage.
        p = fresh(rng, 60)
        texts[i] = p[30:] + fresh(rng, 9) + p[:31] + fresh(rng, 9) + p + fresh(rng, 9)
        texts[i + 1] = fresh(rng, 20) + p + fresh(rng, 20)
        i += 2
    first, want = {}, {i: set() for i in texts}
    for i, t in texts.items():
        for a in range(len(t) - 49):
            if first.setdefault(tuple(t[a:a + 50]), i) != i:
                want[i] |= set(range(a, a + 50))
    got = {r.doc_id: {p for x in r.spans for p in range(x["first"], x["last"])} for r in passages.repeats(table(spark, [(i, " ".join(t)) for i, t in texts.items()])).collect()}
    assert sum(map(bool, want.values())) == 40 and got == want


def test_fuzzy_passages(spark):
    # Share of planted passages found, by length and one edit in so many words, and that their ends are found.
    rng = random.Random(12)
    planted, texts = {}, []
    for size in (55, 60, 120, 400):
        for every in (6, 8, 10, 20):
            for _ in range(25):
                a = fresh(rng, size)
                b = [f"e{rng.randrange(10 ** 9)}" if j % every == every - 1 else w for j, w in enumerate(a)]
                i = len(texts)
                texts += [(i, " ".join(fresh(rng, 200) + a + fresh(rng, 200))), (i + 1, " ".join(fresh(rng, 100) + b + fresh(rng, 300)))]
                planted[i + 1] = size, every
    # A long passage whose words agree in runs too short for a seed far from its only dense part.
    a = fresh(rng, 700)
    b = a[:100] + [w if j % 16 < 15 else f"e{j}" for j, w in enumerate(a[100:])]
    texts += [(9000, " ".join(a)), (9001, " ".join(b))]
    found = {r.doc_id: r for r in passages.repeats(table(spark, texts)).collect()}
    share = {}
    for i, key in planted.items():
        spans = [(x["first"], x["last"]) for x in found[i].spans]
        share.setdefault(key, []).append(len(spans) == 1 and abs(spans[0][0] - 100) <= key[1] and abs(spans[0][1] - 100 - key[0]) <= key[1])
    share = {k: sum(v) / len(v) for k, v in share.items()}
    print(share)
    assert all(v >= (0.8 if every == 6 and size < 100 else 0.9) for (size, every), v in share.items()), share
    assert found[9001].n_repeated >= 690 and all(found[i].n_repeated == 0 for i in range(0, len(planted) * 2, 2))


def test_fuzzy_passages_beside_fragments(spark):
    # Earlier texts hold both halves of a passage, too short to be passages; the edited copy is still found.
    rng = random.Random(13)
    planted, texts = {}, []
    for size, every in ((70, 14), (90, 15), (90, 10), (90, 7), (120, 10)):
        for _ in range(40):
            a = fresh(rng, size)
            b = [f"e{rng.randrange(10 ** 9)}" if j % every == every - 1 else w for j, w in enumerate(a)]
            i = len(texts)
            half = min(size // 2, 45)
            for part in (a[:half], a[half:half + 45], a[90:], a, b):
                texts.append((10000 + len(texts), " ".join(fresh(rng, 100) + part + fresh(rng, 100))))
            planted[10000 + i + 4] = size, every
    docs = table(spark, texts + ODD)
    found = passages.passages(docs)
    more = joints.beside_fragments(docs, found).collect()
    share = {}
    for i, key in planted.items():
        share.setdefault(key, []).append(any(r.doc_id == i and r["first"] <= 100 + key[1] and r["last"] >= 100 + key[0] - key[1] for r in more))
    share = {k: sum(v) / len(v) for k, v in share.items()}
    print(share)
    assert min(share.values()) >= 0.9 and {r.doc_id for r in more} <= set(planted), share
    assert joints.beside_fragments(docs.limit(0), found.limit(0)).collect() == []


def test_passages_with_clashing_columns(spark):
    rng = random.Random(14)
    p = " ".join(fresh(rng, 80))
    rows = [(i, f"head{i} {p} tail{i}", "kept", i) for i in range(3)]
    got = passages.remove(spark.createDataFrame(rows, "doc_id long, text string, _id0 string, _spans0 int"), chars="none").collect()
    assert {(r.doc_id, r["_id0"], r["_spans0"]) for r in got} == {(i, "kept", i) for i in range(3)}
    assert [r.text == f"head{r.doc_id} {p} tail{r.doc_id}" for r in sorted(got)] == [True, False, False]


def test_chains_are_best():
    rng = random.Random(2)
    for _ in range(60):
        n = rng.randrange(1, 14)
        x, y = np.array([rng.randrange(40) for _ in range(n)]), np.array([rng.randrange(40) for _ in range(n)])
        points = sorted(set(zip(x.tolist(), y.tolist())))
        best = [0.0] * len(points)
        for j, (u, v) in enumerate(points):
            best[j] = 8 + max([0.0] + [best[i] - 0.05 * (u - a + v - b) for i, (a, b) in enumerate(points[:j]) if a < u and b < v])
        top = max(best)
        x, y = (np.array(c) for c in zip(*points))
        x0, x1, y0, y1 = passages.chains(x, y, jump=100)[0]
        ends = [p for p, s in zip(points, best) if abs(s - top) < 1e-9]
        assert (x1, y1) in ends


def test_decontaminate(spark):
    rng = random.Random(8)
    item = words(rng, 25)
    texts = [(1, " ".join(words(rng, 50) + item[3:20] + words(rng, 20))), (2, " ".join(words(rng, 80))), (3, "Short Item!"), (4, "x short-ITEM x")] + ODD
    docs = table(spark, texts)
    bench = spark.createDataFrame([(7, " ".join(item)), (12, "short item"), (13, None), (14, "..."), (None, "tie tie tie"), (7, "two words")], "item_id long, text string")
    for limit in (10 ** 6, 5):
        got = {r.doc_id: r for r in decontaminate.mark(docs, bench, limit=limit).collect()}
        assert (got[1].n_hit, got[1].items) == (17, ["7"]) and got[2].n_hit == 0 and (got[4].n_words, got[4].n_hit) == (4, 2)
        assert got[905].items == ["7"] and got[908].n_hit == 3 and got[908].n_items == 0 and got[900].n_words == 0
        assert got[2].items_sha256 == hashlib.sha256(b"").hexdigest()
    left = {r.doc_id: r.text for r in decontaminate.remove(docs, bench).collect()}
    assert 3 not in left and left[4] == "x x" and left[2] == texts[1][1] and left[900] is None and len(left[1].split()) == 70
    odd = docs.withColumn("_hits", F.lit(1)).withColumn("_print", F.lit("p"))
    parts = decontaminate.remove(odd, bench, limit=5)
    assert parts.columns == odd.columns and sorted(map(str, parts.drop("_hits", "_print").collect())) == sorted(map(str, decontaminate.remove(docs, bench).collect()))
    whole, split = (sorted(map(str, decontaminate.mark(docs, bench, limit=n).collect())) for n in (10 ** 6, 3))
    assert whole == split
    assert decontaminate.mark(docs.limit(0), bench, limit=5).collect() == []
    assert decontaminate.mark(docs.limit(0), bench).collect() == [] and decontaminate.mark(docs, bench.limit(0)).where("n_hit > 0").collect() == []


def test_url_rules(spark):
    trie = url_rules.Trie(URL_RULES)
    for url, rule in [("http://A.com/x", "com/"), ("https://www.example.com/en/a?b", "www.example.com/en/"), ("http://b.example.com/en/", "example.com/en/"),
                      ("http://example.com/enx", "com/"), ("http://x.net/es", None), ("x://y.net/fr/#", "net/fr/"), ("http://com", None), ("nothing", None), (None, None),
                      ("://example.com:80/en/", None), ("http://notexample.com/en/", "com/"), ("http://com?/", None)]:
        host, path = url_rules.split_url(url)
        assert (trie.find(host, path) or (None,))[0] == rule, url
    assert url_rules.Trie([("allow", "a.b/p"), ("block", "a.b/p")]).find("x.a.b", "/pq") == ("a.b/p", "block")
    pages = spark.createDataFrame([(None, None, "z"), (1, "http://q.net/es/1", "z"), (1, "http://q.net/es/1", "z")], "page_id long, url string, verdict string")
    assert [r.verdict for r in url_rules.judge(pages, URL_RULES).collect()] == ["allow", "block", "block"]


def test_warc(spark, tmp_path):
    pages = spark.createDataFrame([(5, "http://a/ b", "<p>é"), (3, None, "<p>é"), (9, "x", None), (2, "y", ""), (None, "n", "<p>é"), (7, "l", "z" * 300000), (5, "http://a/ b", "<p>é")],
                                  "page_id long, url string, html string")
    packages = warc_zip.write(pages, str(tmp_path / "w"))
    for size in (warc_zip.RANGE_BYTES, 1):
        got = sorted((str(r.page_id), r.payload_bytes, r.payload_digest, r.record_type, r.refers_to, None if r.payload is None else bytes(r.payload))
                     for r in warc_zip.read(spark, packages, size).collect())
        sha = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()
        e, z = "<p>é".encode(), b"z" * 300000
        assert got == sorted([("5", 5, sha(e), "revisit", 3, None)] * 2 + [("3", 5, sha(e), "response", None, e), ("None", 5, sha(e), "response", None, e),
                             ("9", 0, sha(b""), "revisit", 2, None), ("2", 0, sha(b""), "response", None, b""), ("7", 300000, sha(z), "response", None, z)], key=str) or \
            sorted(got, key=str) == sorted([("5", 5, sha(e), "revisit", 3, None)] * 2 + [("3", 5, sha(e), "response", None, e), ("None", 5, sha(e), "response", None, e),
                             ("9", 0, sha(b""), "revisit", 2, None), ("2", 0, sha(b""), "response", None, b""), ("7", 300000, sha(z), "response", None, z)], key=str)
    assert warc_zip.read(spark, warc_zip.write(pages.limit(0), str(tmp_path / "e"))).collect() == []


class _File(io.BytesIO):
    def size(self):
        return len(self.getvalue())


def test_zip_directories(monkeypatch):
    for limit in (None, 10):
        if limit:
            monkeypatch.setattr(zipfile, "ZIP64_LIMIT", limit)
            monkeypatch.setattr(zipfile, "ZIP_FILECOUNT_LIMIT", 1)
        out = _File()
        with zipfile.ZipFile(out, "w") as z:
            z.writestr("a/é.txt", b"first member")
            z.writestr("packed", b"x" * 500, zipfile.ZIP_DEFLATED)
            z.writestr("b", b"second")
            z.comment = b"a comment"
        found = warc_zip.members(out)
        assert set(found) == {"a/é.txt", "b"}
        assert [warc_zip._range(out, *found[k]) for k in ("a/é.txt", "b")] == [b"first member", b"second"]
    with pytest.raises(ValueError):
        warc_zip.members(_File(b"no package"))


def test_warc_table(spark):
    pages = {r.page_id: (r.html or "").encode() for r in spark.read.parquet(f"{SF}/pages.parquet").collect()}
    first = {}
    for i in sorted(pages):
        first.setdefault(pages[i], i)
    got = {r.page_id: r for r in QUERIES["op2_warc"](Tables(spark, SF)).collect()}
    assert set(got) == set(pages)
    for i, payload in pages.items():
        head = first[payload]
        assert (got[i].payload_bytes, got[i].record_type, got[i].refers_to) == (len(payload), "response" if head == i else "revisit", None if head == i else head)


@pytest.mark.parametrize("name,label,parts,out,least", [("op3_quality", "quality", 5, 0, 0.93), ("op10_toxicity", "toxic", 4, 2, 0.92)])
def test_held_out(spark, name, label, parts, out, least):
    rows = QUERIES[name](Tables(spark, SF)).collect()
    truth = {r.doc_id: r[label] for r in spark.read.parquet(f"{SF}/labels.parquet").collect()}
    assert len(rows) == spark.read.parquet(f"{SF}/documents.parquet").count()
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % parts == out) and r.predicted == (r.score >= 0.3) and 0 <= r.score <= 1 for r in rows)
    held = [r for r in rows if r.held_out and r.doc_id in truth]
    assert sum(r.predicted == truth[r.doc_id] for r in held) / len(held) >= least


def test_classifiers_on_odd_rows(spark):
    docs = table(spark, ODD)
    given = Sample(["bad idiot here. fine words"] * 9 + ["fine words only. good"] * 30, [1] * 9 + [0] * 30, {0: 30, 1: 9})
    model = toxicity.fit(given)
    probe = table(spark, [(1, "Nice words. You idiot! Bye."), (2, "fine words"), *ODD])
    got = {r.doc_id: r for r in toxicity.score(probe, model).collect()}
    assert got[1].predicted == 1 and [x.words for x in got[1].offending] == ["you idiot"] and got[2].predicted == 0 and got[900].score == 0
    assert 1 not in {r.doc_id for r in toxicity.keep_clean(probe, model).collect()} and toxicity.keep_clean(docs, model).count() == len(ODD)
    assert toxicity.score(docs, toxicity.fit(Sample([], [], {0: 0, 1: 0}))).where("score > 0.01").count() == 0
    model = quality.fit(Sample(["clean prose of a kind " * 40] * 9 + ["### $$$ %%% " * 60] * 9, [1] * 9 + [0] * 9, {0: 9, 1: 9}))
    got = {r.doc_id: r.score for r in quality.score(probe, model).collect()}
    assert got[900] == got[901] and all(0 <= s <= 1 for s in got.values())
    assert quality.score(docs, quality.fit(Sample([], [], {0: 0, 1: 0}))).count() == len(ODD)


def test_patience():
    assert licenses.longest_rising([(0, 3), (1, 1), (2, 2), (3, 0), (4, 5)]) == [(1, 1), (2, 2), (4, 5)]
    a, b = "a x b c d y e".split(), "a b c z d e".split()
    assert [a[i] for i, _ in licenses.align(a, b)] == ["a", "b", "c", "d", "e"]
    assert licenses.align([], b) == [] and licenses.align(a, []) == []
    rng = random.Random(5)
    for _ in range(200):
        at = sorted(rng.sample(range(30), rng.randrange(1, 12)))
        need = rng.randrange(1, 6)
        runs = [(2 * (q - p + 1) - (at[q] - at[p] + 1), q - p + 1) for p in range(len(at)) for q in range(p + need - 1, len(at))]
        got = licenses.stretch(at, need - 0.5)
        assert (got and got[0]) == (max(runs)[0] if runs else None)


def test_licenses(spark):
    mit = licenses.TEMPLATES["mit"].replace("free of charge", "without any fee")
    docs = table(spark, [(1, f"Some prose here.\n{licenses.TEMPLATES['gpl-3.0-notice']}\nMore."), (2, "head\n" + mit.replace(" to any", "\nto any")), (3, "the license of the software is here"), *ODD])
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[1].license, got[1].coverage) == ("gpl-3.0-notice", 1.0) and got[2].license == "mit" and got[2].coverage < 1 and got[3].license is None
    assert got[900].notices == [] and len(got) == len({i for i, _ in ODD}) + 3
    given = spark.read.parquet(f"{SF}/documents.parquet").collect()
    want = {r.doc_id for r in given if any(t in r.text for n, t in licenses.TEMPLATES.items() if n.endswith("notice"))}
    assert want == {r.doc_id for r in QUERIES["op7_licenses"](Tables(spark, SF)).collect() if r.license}


def test_wrapped_licenses(spark):
    rng = random.Random(4)
    prose = lambda n: " ".join(fresh(rng, n))
    texts, want = [], []
    for i, name in enumerate(["mit", "apache-2.0", "gpl-3.0", "bsd"]):
        w = licenses.TEMPLATES[name].split()
        wrapped = "\n * ".join(" ".join(w[j:j + 7]) for j in range(0, len(w), 7))
        altered = wrapped.replace(w[0], "Altered", 1)
        edited = wrapped.replace(w[9], "edited words", 1)
        one = " ".join(w)
        for k, copies in enumerate([[wrapped, wrapped], [altered, edited], [one, wrapped], [edited, edited, altered], [wrapped]]):
            for gap in (0, 3, 400):  # words between copies
                # Stray first and last words of the notice far away.
                body = f"\n{prose(gap)}\n".join(copies)
                texts.append((len(texts), f"{w[0]} {prose(300)}\n{body}\n{prose(300)} {w[-1]}"))
                want.append((name, len(copies)))
    # A notice interrupted by many words, but fewer than it has itself.
    w = licenses.TEMPLATES["mit"].split()
    texts.append((len(texts), " ".join(fresh(rng, 301) + w[:15] + fresh(rng, 20) + w[15:] + fresh(rng, 300))))
    want.append(("mit", 1))
    got = {r.doc_id: r for r in licenses.scan(table(spark, texts)).collect()}
    for i, (name, copies) in enumerate(want):
        found = [x for x in got[i].notices if x["license"] == name]
        assert got[i].license in (name, f"{name}-notice") and len(found) == copies, (i, name, found)
        assert all(x["coverage"] >= 0.9 for x in found) and found[0]["first"] >= 301


def spot_set(text):
    w = [x for x in re.split(r"[\W_]+", text.lower()) if x]
    out = set()
    for i, x in enumerate(w):
        if x in spots.ANCHORS:
            content = [y for y in w[i + 1:i + 1 + spots.REACH] if y not in spots.ANCHORS][:spots.CHAIN]
            if len(content) == spots.CHAIN:
                out.add((x, *content))
    return out or ({tuple(w)} if w else set())


def like(a, b):
    return 1.0 if not a and not b else len(a & b) / len(a | b)


def test_spots_table(spark):
    rows = sorted(((r.doc_id, r.text) for r in spark.read.parquet(f"{SF}/documents.parquet").collect()), reverse=True)
    got = {r.doc_id: r for r in QUERIES["op8_spot_signatures"](Tables(spark, SF)).collect()}
    assert len(got) == len(rows)
    for i, (k, text) in enumerate(rows):
        after = rows[(i + 1) % len(rows)][1]
        half = len(text) // 2
        edited = text[:len(text) - half] + after[:half]
        r = got[k]
        assert (r.n_chars, r.edited_sha256) == (len(text), hashlib.sha256(edited.encode()).hexdigest())
        assert abs(r.near_edited - like(spot_set(text), spot_set(edited))) < 1e-9 and abs(r.near_next - like(spot_set(text), spot_set(after))) < 1e-9
    by_text = {}
    for k, text in rows:
        assert by_text.setdefault(text, got[k].fingerprint) == got[k].fingerprint


def test_spots_odd(spark):
    docs = table(spark, ODD)
    got = spots.fingerprints(docs).collect()
    assert len(got) == len(ODD) and all(0 <= r.near_next <= 1 and 0 <= r.near_edited <= 1 for r in got)
    one = spots.fingerprints(docs.where("doc_id = 905")).collect()
    assert one[0].near_next == 1.0 and spots.fingerprints(docs.limit(0)).collect() == []
