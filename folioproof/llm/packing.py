"""Harmonic packing of token sequences: reciprocal-capacity classes with a fixed count per bin."""

from __future__ import annotations

import zlib
from collections import defaultdict
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, Window, functions as F

from . import words as W
from .shared import put
from .tokens import word_ids

CAPACITY = 4096
#: Rests up to this length stay whole; they are their own class.
WHOLE = 64

_PIECES = ("doc {kind}, start long, length long, ids_crc32 long, doc_tokens long, klass int, part int, place long")


def cut(tokens: int, capacity: int = CAPACITY, whole: int = WHOLE) -> list[int]:
    """Lengths of the pieces of a document, in order.

    Each piece is the largest reciprocal capacity // k that fits what is left, so that k
    pieces of that length fill a bin; a rest of at most ``whole`` tokens stays in one piece,
    and capacity // rest such pieces share a bin.
    """
    out = [capacity] * (tokens // capacity)
    left = tokens % capacity
    while left:
        length = left if left <= whole else capacity // -(-capacity // left)
        out.append(length)
        left -= length
    return out


def pieces(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY,
           doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Cut documents, with the place of each piece in its class among those of one task.

    Written to the shared folder, so that places do not change when a task runs again.
    """
    context = docs.sparkSession.sparkContext
    path = context.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, task, filled = word_ids(path.value), TaskContext.get().partitionId(), defaultdict(int)
        for batch in batches:
            for part in W.blocks(batch, "t"):
                found, bounds = ids(part.column("t"), end)
                raw, bounds = memoryview(found.astype("<u4").tobytes()), bounds.tolist()
                row, start, length, crc, total, place = [], [], [], [], [], []
                for i in range(len(part)):
                    own = raw[4 * bounds[i]:4 * bounds[i + 1]]
                    at, n = 0, len(own) // 4
                    for size in cut(n, capacity):
                        row.append(i)
                        start.append(at)
                        length.append(size)
                        crc.append(zlib.crc32(own[4 * at:4 * (at + size)]))
                        total.append(n)
                        place.append(filled[size])
                        filled[size] += 1
                        at += size
                yield pa.RecordBatch.from_arrays(
                    [part.column("k").take(pa.array(row, pa.int64())), pa.array(start, pa.int64()), pa.array(length, pa.int64()),
                     pa.array(crc, pa.int64()), pa.array(total, pa.int64()), pa.array(length, pa.int32()),
                     pa.array([task] * len(row), pa.int32()), pa.array(place, pa.int64())],
                    names=["doc", "start", "length", "ids_crc32", "doc_tokens", "klass", "part", "place"])

    kind = docs.schema[doc].dataType.simpleString()
    return put(docs.select(F.col(doc).alias("k"), F.col(text).alias("t")).mapInArrow(run, _PIECES.format(kind=kind)), "pieces")


def pack(docs: DataFrame, vocabulary: str, end: int = 2, capacity: int = CAPACITY,
         doc: str = "doc_id", text: str = "text") -> DataFrame:
    """Every token of every document in exactly one piece, every piece in one sequence.

    Returns (doc, start, length, ids_crc32, doc_tokens, sequence_id, offset).  Class ``l``
    fills each bin with capacity // l pieces of length l.  A piece's rank in its class is
    its place in its task plus the counts of the tasks before, so tasks fill bins
    independently and nothing but (task, class) counts is gathered.  The pieces that do not
    fill a last bin, fewer than capacity // l for each of the fixed classes whatever the
    corpus, are packed together, longest first.

    Null and empty texts are one end token.  Repeated rows are packed each; documents
    without rows give an empty result; columns other than ``doc`` and ``text`` are not read.
    """
    found = pieces(docs, vocabulary, end, capacity, doc, text)
    counts = found.groupBy("klass", "part").agg(F.count(F.lit(1)).alias("n"))
    before = Window.partitionBy("klass").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    base = counts.select("klass", "part", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("base"))
    # One row for each of the fixed classes; bins of a class follow those of longer classes.
    totals = {r["klass"]: r["n"] for r in counts.groupBy("klass").agg(F.sum("n").alias("n")).collect()}
    first, bins = {}, 0
    for klass in sorted(totals, reverse=True):
        first[klass] = bins
        bins += totals[klass] // (capacity // klass)
    ranked = found.join(base, ["klass", "part"]).withColumn("rank", F.col("base") + F.col("place"))
    count = F.expr(f"{capacity} div klass")
    slot = F.expr(f"rank div ({capacity} div klass)")
    own = ["doc", "start", "length", "ids_crc32", "doc_tokens"]
    if not totals:
        return found.select(F.col("doc").alias(doc), *own[1:], F.lit(0).cast("long").alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    firsts = F.create_map(*[F.lit(x) for k, v in first.items() for x in (k, v)])[F.col("klass")]
    full_bins = F.create_map(*[F.lit(x) for k, n in totals.items() for x in (k, n // (capacity // k))])[F.col("klass")]
    full = ranked.where(slot < full_bins).select(
        *own, (firsts + slot).cast("long").alias("sequence_id"), (F.col("rank") % count * F.col("length")).alias("offset"))
    rest = ranked.where(slot >= full_bins).select(*own, "rank")
    last = rest.groupBy(F.lit(0).alias("_all")).applyInArrow(
        lambda table: _together(table, capacity), rest.select(*own).schema.add("bin", "long").add("offset", "long"))
    last = last.select(*own, (F.lit(bins) + F.col("bin")).cast("long").alias("sequence_id"), "offset")
    return full.unionByName(last).withColumnRenamed("doc", doc)


def _together(table: pa.Table, capacity: int) -> pa.Table:
    """Best fit, longest first, of a bounded number of pieces; an open bin per room length."""
    table = table.sort_by([("length", "descending"), ("rank", "ascending")])
    rooms: dict[int, list[int]] = defaultdict(list)
    bins, offsets, used = [], [], 0
    for length in table.column("length").to_pylist():
        room = next((r for r in range(length, capacity) if rooms.get(r)), None)
        if room is None:
            number, room, used = used, capacity, used + 1
        else:
            number = rooms[room].pop()
        bins.append(number)
        offsets.append(capacity - room)
        if room > length:
            rooms[room - length].append(number)
    own = table.select(["doc", "start", "length", "ids_crc32", "doc_tokens"])
    return own.append_column("bin", pa.array(bins, pa.int64())).append_column("offset", pa.array(offsets, pa.int64()))
