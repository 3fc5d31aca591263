"""Benchmark passages in documents: broadcast hash set of n-word windows, verified, then removed.

A benchmark within the limit of one broadcast is scanned in one pass.  A larger one is dealt to
parts by the hash of its windows; each part is broadcast, scanned and given up before the next
one, and what it hit is written by text, so neither the driver nor a task holds more than a part.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, functions as F

from . import words as W
from .shared import put

N = 10
#: Windows on the driver and in a worker at one time (about 100 bytes each).  A larger benchmark
#: is scanned in several passes of about so many windows, so nothing is left out.
MAX_WINDOWS = 500_000
_BITS = 20


def windows(benchmark: DataFrame, n: int = N, key: str = "item_id", text: str = "text") -> DataFrame:
    """(item, size, hash, words): each window of ``n`` words; a shorter item that has words is one window."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.ALNUM)
                items, counts = part.column("k").to_pylist(), w.counts()
                rows = []
                for size in sorted({min(n, int(c)) for c in counts if c}):
                    at, hashes = w.windows(size)
                    fit = np.minimum(counts[w.doc[at]], n) == size
                    rows += [(items[w.doc[i]], size, int(h), w.text(i, i + size))
                             for i, h in zip(at[fit].tolist(), hashes[fit].astype(np.int64).tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array([r[j] for r in rows], t) for j, t in enumerate((pa.string(), pa.int32(), pa.int64(), pa.binary()))],
                    names=["item", "size", "hash", "words"])

    return benchmark.select(F.col(key).cast("string").alias("k"), F.col(text).alias("t")).mapInArrow(
        run, "item string, size int, hash long, words binary")


class Index:
    """Windows by hash, with the items that hold them; a bit table turns most lookups away."""

    def __init__(self, rows: list) -> None:
        found: dict = defaultdict(lambda: defaultdict(set))
        self.sizes: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for r in rows:
            found[r["size"], r["hash"]][bytes(r["words"])].add(r["item"])
        self.found = {k: dict(v) for k, v in found.items()}
        for size in {k[0] for k in self.found}:
            hashes = np.sort(np.array([k[1] for k in self.found if k[0] == size], np.int64).astype(np.uint64))
            bits = np.zeros(1 << _BITS, bool)
            bits[hashes >> W.U(64 - _BITS)] = True
            self.sizes[size] = (hashes, bits)

    def scan(self, w: W.Words) -> tuple[np.ndarray, dict[int, set]]:
        """(hit per word, items per text) of a block."""
        hit, items = np.zeros(len(w.hashes) + 1, np.int64), defaultdict(set)
        for size, (hashes, bits) in self.sizes.items():
            at, h = w.windows(size)
            likely = np.flatnonzero(bits[h >> W.U(64 - _BITS)])
            at, h = at[likely], h[likely]
            sure = np.isin(h, hashes)
            for i, x in zip(at[sure].tolist(), h[sure].astype(np.int64).tolist()):
                holders = self.found[size, x].get(w.text(i, i + size))
                if holders:
                    hit[i] += 1
                    hit[i + size] -= 1
                    items[int(w.doc[i])] |= holders
        return np.cumsum(hit)[:-1] > 0, items


class _OnePass:
    """Hits of a block by one broadcast index."""

    def __init__(self, index: Broadcast) -> None:
        self.index = index

    def __call__(self, part: pa.RecordBatch, w: W.Words) -> tuple[np.ndarray, dict[int, set]]:
        return self.index.value.scan(w)


class _Told:
    """Hits of a block that came beside its texts, in the list column ``name``."""

    def __init__(self, name: str) -> None:
        self.name = name

    def __call__(self, part: pa.RecordBatch, w: W.Words) -> tuple[np.ndarray, dict[int, set]]:
        hit, items = np.zeros(len(w.hashes), bool), {}
        for i, told in enumerate(part.column(self.name).to_pylist()):
            for one in told or ():
                for a, b in zip(one["starts"], one["ends"]):
                    hit[w.bounds[i] + a:w.bounds[i] + b] = True
                items.setdefault(i, set()).update(one["items"])
        return hit, items


def _pass(docs: DataFrame, text: str, index: Broadcast) -> DataFrame:
    """(print, starts, ends, items) of the texts that hold windows of this part, each text once."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.ALNUM)
                hit, items = index.value.scan(w)
                rows = []
                for i in sorted(items):
                    spans = W.runs(np.flatnonzero(hit[w.bounds[i]:w.bounds[i + 1]]))
                    rows.append((part.column("p")[i].as_py(), [x for x, _ in spans], [y for _, y in spans],
                                 sorted(items[i], key=lambda x: (x is not None, x))))
                kinds = (pa.string(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.string()))
                yield pa.RecordBatch.from_arrays([pa.array([r[j] for r in rows], k) for j, k in enumerate(kinds)],
                                                 names=["print", "starts", "ends", "items"])

    found = docs.select(F.sha2(F.col(text), 256).alias("p"), F.col(text).alias("t")).mapInArrow(
        run, "print string, starts array<int>, ends array<int>, items array<string>")
    # Equal texts have equal rows: one of each, which combines before the shuffle.
    return found.groupBy("print").agg(F.first("starts").alias("starts"), F.first("ends").alias("ends"), F.first("items").alias("items"))


def _located(docs: DataFrame, text: str, benchmark: DataFrame, n: int, key: str, item_text: str, limit: int,
             items: bool) -> tuple[DataFrame, Callable]:
    """``docs`` to be scanned, perhaps with a column of hits, and what finds the hits of a block of them."""
    found = windows(benchmark, n, key, item_text)
    found = (found if items else found.withColumn("item", F.lit("any"))).distinct()
    context = benchmark.sparkSession.sparkContext
    # One row more than the limit tells whether a single broadcast will do.
    first = found.limit(limit + 1).collect()
    if len(first) <= limit:
        return docs, _OnePass(context.broadcast(Index(first)))
    del first
    found = put(found, "windows")
    passes = -(-found.count() // limit)
    told = None
    for p in range(passes):
        index = context.broadcast(Index(found.where(F.pmod(F.xxhash64("hash"), F.lit(passes)) == p).collect()))
        hits = put(_pass(docs, text, index), "hits")
        index.destroy()
        told = hits if told is None else told.unionByName(hits)
    name, tag = "_hits", "_print"
    while name in docs.columns or tag in docs.columns:
        name, tag = name + "_", tag + "_"
    whole = told.groupBy(F.col("print").alias(tag)).agg(F.collect_list(F.struct("starts", "ends", "items")).alias(name))
    return docs.withColumn(tag, F.sha2(F.col(text), 256)).join(whole, tag, "left").drop(tag), _Told(name)


def mark(docs: DataFrame, benchmark: DataFrame, n: int = N, doc: str = "doc_id", key: str = "item_id", text: str = "text",
         limit: int = MAX_WINDOWS) -> DataFrame:
    """(doc, n_words, n_hit, items, n_items, items_sha256, contaminated) of every document row.

    A word inside any occurrence of a benchmark window is hit.  Null and empty texts have no
    words and no hits; items without words have no windows; an item without id is not
    listed, but its windows hit.  Repeated rows are answered each, other columns are not read.
    """
    rows, finder = _located(docs.select(F.col(doc).alias("k"), F.col(text).alias("t")), "t", benchmark, n, key, text, limit, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.ALNUM)
                hit, items = finder(part, w)
                named = [sorted(x for x in items.get(i, ()) if x is not None) for i in range(len(part))]
                total = np.r_[0, np.cumsum(hit)][w.bounds]
                hits = np.diff(total)
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(w.counts(), pa.int64()), pa.array(hits, pa.int64()), pa.array(named, pa.list_(pa.string())),
                     pa.array([len(x) for x in named], pa.int64()),
                     pa.array([hashlib.sha256(",".join(x).encode()).hexdigest() for x in named], pa.string()),
                     pa.array(hits > 0, pa.bool_())],
                    names=[doc, "n_words", "n_hit", "items", "n_items", "items_sha256", "contaminated"])

    kind = docs.schema[doc].dataType.simpleString()
    return rows.mapInArrow(
        run, f"{doc} {kind}, n_words long, n_hit long, items array<string>, n_items long, items_sha256 string, contaminated boolean")


def remove(docs: DataFrame, benchmark: DataFrame, n: int = N, most: float = 0.5, key: str = "item_id", text: str = "text",
           chars: str = "n_chars", limit: int = MAX_WINDOWS) -> DataFrame:
    """``docs`` without their hit words; a document with more than ``most`` of its words hit goes as a whole.

    Documents without hits come back unchanged, with all their columns; ``chars``, where it
    exists, follows the new text.  The same cases as in :func:`mark` hold.
    """
    rows, finder = _located(docs, text, benchmark, n, key, text, limit, False)
    columns = docs.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, text):
                w = W.words(part.column(text), W.ALNUM)
                hit, _ = finder(part, w)
                yield rewritten(part.select(columns), w, hit, text, chars, most)

    return rows.mapInArrow(run, docs.schema)


def rewritten(part: pa.RecordBatch, w: W.Words, gone: np.ndarray, text: str, chars: str, most: float) -> pa.RecordBatch:
    """The block without its ``gone`` words, and without the rows that lost more than ``most`` of theirs."""
    if not gone.any():
        return part
    lost = np.diff(np.r_[0, np.cumsum(gone)][w.bounds])
    texts, stay = part.column(text).to_pylist(), np.ones(len(part), bool)
    for i in np.flatnonzero(lost).tolist():
        a, b = w.bounds[i], w.bounds[i + 1]
        stay[i] = lost[i] <= most * (b - a)
        if stay[i]:
            texts[i] = W.without(w, i, W.runs(np.flatnonzero(gone[a:b]) + a))
    columns = {f.name: part.column(j) for j, f in enumerate(part.schema)}
    columns[text] = pa.array(texts, part.schema.field(text).type)
    if chars in columns and pa.types.is_integer(part.schema.field(chars).type):
        sizes = part.column(chars).to_pylist()
        for i in np.flatnonzero(lost).tolist():
            sizes[i] = len(texts[i] or "")
        columns[chars] = pa.array(sizes, part.schema.field(chars).type)
    return pa.RecordBatch.from_arrays(list(columns.values()), schema=part.schema).filter(pa.array(stay))
