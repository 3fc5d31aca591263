import random
import zlib
from collections import defaultdict

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from folioproof.llm import packing
from folioproof.llm.queries import vocabulary
from folioproof.llm.tokens import WordIds

ODD = ["", " ", "It's we'll THEY'RE o'Dell's 12 3,4.5", "<|ENDOFTEXT|> <|endoftext|> x<|endoftext|> <|endoftext|> a<|startoftext|>b <|endoftext|", "café café ÉTÉ ΣΑΣ İx",
       "a b c\u0085d\x1ce\x00f\x7f", "你好, 世界! \U0001f600x̣́", "x" * 300, "th,*** (ouer)... «dir» -- naïve-coöp", "'s 's's don't'll é's"]


def test_words_equal_whole_texts():
    whole, ids = Tokenizer.from_file(vocabulary()), WordIds(vocabulary())
    rng = random.Random(3)
    texts = ODD + ["".join(rng.choice("aBé ß.'\n\t7́ <|>%") for _ in range(rng.randrange(60))) for _ in range(800)]
    got, bounds = ids(pa.array([*texts, None]), 2)
    for i, t in enumerate(texts):
        assert got[bounds[i]:bounds[i + 1]].tolist() == [*whole.encode(t, add_special_tokens=False).ids, 2], repr(t)
    assert got[bounds[-2]:].tolist() == [2] and ids(pa.array([], pa.string()), 2)[1].tolist() == [0]


@pytest.mark.parametrize("n", [1, 2, 63, 64, 65, 100, 1365, 2047, 2048, 2049, 4095, 4096, 4097, 12000])
def test_cut(n):
    got = packing.cut(n)
    assert sum(got) == n and max(got) <= 4096 and min(got) > 0


def check(rows, expected, capacity=4096):
    """Every id of every row's text lies in one piece, sequences have no gaps; returns padding and used tokens."""
    docs, bins = defaultdict(list), defaultdict(list)
    for r in rows:
        docs[r.doc_id or -1, r.doc_tokens].append((r.start, r.length, r.ids_crc32))
        bins[r.sequence_id].append((r.offset, r.length))
    got = sorted((k, sorted(v)) for k, v in docs.items())
    want = defaultdict(list)
    for doc, ids in expected:
        doc = doc or -1
        pieces = sorted(docs[doc, len(ids)])
        want[doc, len(ids)] += [(a, n, zlib.crc32(np.array(ids[a:a + n], "<u4").tobytes())) for a, n in dict.fromkeys((p[0], p[1]) for p in pieces)]
    assert got == sorted((k, sorted(v)) for k, v in want.items())
    padding = used = 0
    for parts in bins.values():
        at = 0
        for offset, length in sorted(parts):
            assert offset == at
            at += length
        assert at <= capacity
        used += at
        padding += 0 if at & (at - 1) == 0 else capacity - at
    assert used == sum(len(ids) for _, ids in expected)
    return padding, used


def test_whole_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    whole = Tokenizer.from_file(vocabulary())
    expected = [(r.doc_id, whole.encode(r.text, add_special_tokens=False).ids + [2]) for r in docs.collect()]
    padding, used = check(packing.pack(docs, vocabulary()).collect(), expected)
    assert padding < 0.01 * used


def test_odd_rows(spark):
    rows = [(i, t, "z") for i, t in enumerate(ODD)] + [(None, "null id", "z"), (77, None, None), (5, "word " * 9000, "z")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, klass string")
    whole = Tokenizer.from_file(vocabulary())
    expected = [(i, whole.encode(t or "", add_special_tokens=False).ids + [2]) for i, t, _ in rows]
    check(packing.pack(docs, vocabulary()).collect(), expected)
    assert packing.pack(docs.limit(0), vocabulary()).collect() == []
