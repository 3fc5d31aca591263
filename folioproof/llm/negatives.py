"""Hard negatives by rotated one-bit codes and deterministic intervals.

Each vector v is turned by a few fixed random rotations and keeps the signs as bits.  The
signs, turned back and summed, are its code vector x; with the stored alignment a, v = a x + e
and e is orthogonal to x, its length known.  For an anchor q the product with the code vector comes
from population counts of the bits with bit planes of the turned anchor; the rest is

    |<q, e>|  <=  |e| * |q's part orthogonal to x|          (Cauchy-Schwarz)

so each pair has an interval that surely holds its product.  Only pairs whose interval can
still be among the wanted are scored, with integers; results are exact whatever the codes.

Anchors and rows are dealt to blocks, and each pair of blocks is a task that holds one block
of anchors, of bounded size, and streams the rows.  First each anchor finds its positives, then,
in a second pass, the best rows of other labels below a share of each positive's score.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import shuffle_partitions
from .shared import put

TURNS, PLANES, SEED = 4, 6, 7
#: Anchors held by a task, and rows that it reads.
ANCHORS, ROWS = 32_768, 1 << 20
#: Anchors and rows whose intervals are found at once.
_TILE_ANCHORS, _TILE_ROWS = 32, 4096
#: Squared lengths up to this keep all scores, and a hundred times them, within a long.
LARGEST = float(1 << 56)
U = np.uint64
_turns: dict[tuple[int, int], np.ndarray] = {}


def rotations(size: int, turns: int = TURNS) -> np.ndarray:
    """Fixed random rotations (turns, size, size), the same in every task."""
    if (size, turns) not in _turns:
        draw = np.random.default_rng([SEED, size]).standard_normal((turns, size, size))
        _turns[size, turns] = np.array([np.linalg.qr(x)[0] for x in draw]) if size else draw
    return _turns[size, turns]


def encode(vectors: np.ndarray, turns: int = TURNS) -> tuple[np.ndarray, np.ndarray]:
    """(code words per row, rows (alignment, length of the code vector, length of the rest)) of integer vectors."""
    n, size = vectors.shape
    turned = np.einsum("tij,nj->nti", rotations(size, turns), vectors.astype(np.float64))
    signs = turned >= 0
    width = -(-size // 64) * 64
    padded = np.zeros((n, turns, width), bool)
    padded[:, :, :size] = signs
    words = np.packbits(padded, axis=2, bitorder="little").reshape(n, -1).view(np.uint64) if width else np.zeros((n, 0), np.uint64)
    code = np.einsum("tij,nti->nj", rotations(size, turns), np.where(signs, 1.0, -1.0))
    squared, product = (code * code).sum(1), (code * vectors).sum(1)
    align = np.divide(product, squared, out=np.zeros(n), where=squared > 0)
    rest = np.sqrt((((vectors - align[:, None] * code)) ** 2).sum(1))
    return words, np.column_stack([align, np.sqrt(squared), rest])


class Anchors:
    """A block of anchors of one dimension, ready to be held against rows."""

    def __init__(self, vectors: np.ndarray, turns: int = TURNS, planes: int = PLANES) -> None:
        n, size = vectors.shape
        self.vectors, self.length = vectors, np.sqrt((vectors.astype(np.float64) ** 2).sum(1))
        turned = np.einsum("tij,nj->nti", rotations(size, turns), vectors.astype(np.float64))
        low = turned.min(axis=(1, 2), initial=np.inf) if size else np.zeros(n)
        step = np.maximum((turned.max(axis=(1, 2), initial=-np.inf) if size else np.zeros(n)) - low, 1e-9) / ((1 << planes) - 1)
        level = np.rint((turned - low[:, None, None]) / step[:, None, None]).astype(np.int64)
        self.off = np.abs(turned - (low[:, None, None] + step[:, None, None] * level)).sum(axis=(1, 2))
        self.low, self.step = low, step
        # <q, x> is the sum of q's turned parts, plus where the sign is set, minus elsewhere.
        self.total = low * turns * size + step * level.sum(axis=(1, 2))
        width = -(-size // 64) * 64
        bits = np.zeros((n, planes, turns, width), bool)
        bits[..., :size] = (level[:, None] >> np.arange(planes)[None, :, None, None]) & 1
        self.planes = np.packbits(bits, axis=3, bitorder="little").reshape(n, planes, -1).view(np.uint64) if width else np.zeros((n, planes, 0), np.uint64)

    def interval(self, some: np.ndarray, words: np.ndarray, scale: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Bounds (anchor, row) of the products of ``some`` anchors with coded rows."""
        shape = len(some), len(words)
        weighted, ones = np.zeros(shape, np.int32), np.zeros(len(words), np.int32)
        for j in range(words.shape[1]):
            word = words[:, j]
            ones += np.bitwise_count(word)
            for p in range(self.planes.shape[1]):
                weighted += np.bitwise_count(word[None, :] & self.planes[some, p, j][:, None]).astype(np.int32) << p
        low, step, total, off, length = (x[some][:, None] for x in (self.low, self.step, self.total, self.off, self.length))
        product = 2 * (low * ones[None, :] + step * weighted) - total
        align, code, rest = scale.T[:, None, :]
        # The part of q along x is at least this long, so the orthogonal one is at most what is left.
        along = np.maximum(np.abs(product) - off, 0) / np.maximum(code, 1e-300)
        slack = rest * np.sqrt(np.maximum(length ** 2 - along ** 2, 0)) + np.abs(align) * off
        slack += 1e-9 * (1 + length * (np.abs(align) * code + rest))
        return align * product - slack, align * product + slack


def integers(rows: DataFrame, vec: str, embedding: str, label: str, moved: int | None) -> DataFrame:
    """(id, label, v, digest) of the rows that take part; v holds floor(256 * component).

    Left out are rows with a null id, label or vector, with a null or non-finite component,
    and with a vector so long that a long cannot hold its scores (see LARGEST).
    """
    value = F.col(embedding)
    whole = F.forall(value, lambda x: F.coalesce(~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")), F.lit(False)))
    scaled = F.transform(value, lambda x: F.floor(F.lit(256.0) * x.cast("double")))
    size = F.aggregate(value, F.lit(0.0), lambda s, x: s + (F.abs(F.lit(256.0) * x.cast("double")) + 1) * (F.abs(F.lit(256.0) * x.cast("double")) + 1))
    own = F.col(label).cast("int")
    if moved:
        own = F.when(F.col(vec) % moved == 0, (own + 1) % 10).otherwise(own)
    return rows.where(F.col(vec).isNotNull() & F.col(label).isNotNull() & value.isNotNull()).where(whole).where(size <= LARGEST).select(
        F.col(vec).cast("long").alias("id"), own.alias("label"), scaled.alias("v")).withColumn("digest", F.xxhash64("label", "v"))


def coded(rows: DataFrame, turns: int = TURNS) -> DataFrame:
    """``rows`` of :func:`integers` with (size, code, scale): dimension, code words, and alignment, code length and rest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for size, some in _by_size(batch):
                words, scale = encode(some["v"], turns)
                yield pa.RecordBatch.from_arrays(
                    [pa.array(some["id"]), pa.array(some["label"]), pa.array(some["digest"]), pa.array(np.full(len(words), size, np.int32)),
                     _lists(some["v"]), _lists(words.view(np.int64)), _lists(scale)],
                    names=["id", "label", "digest", "size", "v", "code", "scale"])

    return rows.mapInArrow(run, "id long, label int, digest long, size int, v array<long>, code array<long>, scale array<double>")


def _lists(rows: np.ndarray) -> pa.Array:
    offsets = np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(rows.reshape(-1)))


def _table(column: pa.Array) -> np.ndarray:
    """Lists of one length as a table."""
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1)


def _by_size(batch: pa.RecordBatch) -> Iterator[tuple[int, dict]]:
    """The rows of a batch for each dimension; only vectors of one dimension have a product."""
    if not len(batch):
        return
    sizes = batch.column("v").value_lengths().to_numpy()
    for size in np.unique(sizes).tolist():
        some = batch if (sizes == size).all() else batch.take(pa.array(np.flatnonzero(sizes == size)))
        yield size, {name: _table(c) if name in ("v", "code", "scale") else c.to_pylist() if pa.types.is_list(c.type) else c.to_numpy(zero_copy_only=False)
                     for name, c in zip(some.schema.names, some.columns)}


class Best:
    """The first ``most`` rows by (score, smaller id, digest) of one question; equal rows count once."""

    def __init__(self, most: int) -> None:
        self.most, self.rows, self.floor = most, np.empty((0, 3), np.int64), None

    def put(self, score: np.ndarray, ids: np.ndarray, digest: np.ndarray) -> None:
        rows = np.concatenate([self.rows, np.column_stack([score, ids, digest])])
        order = np.lexsort((rows[:, 2], rows[:, 1], -rows[:, 0]))
        rows = rows[order]
        fresh = np.r_[True, (rows[1:] != rows[:-1]).any(axis=1)] if len(rows) else np.zeros(0, bool)
        self.rows = rows[fresh][:self.most]
        if len(self.rows) == self.most:
            self.floor = int(self.rows[-1, 0])


def _cells(index: DataFrame, anchors: DataFrame, extra: list[str]) -> DataFrame:
    """One row of both kinds for each task: ``cell``, whether it is an anchor, and the coded row.

    Blocks come from hashes of ids, so neither a label nor a source makes a block large.
    """
    n, m = index.count(), anchors.count()
    row_blocks = max(-(-n // ROWS), shuffle_partitions(index))
    anchor_blocks = max(1, -(-m // ANCHORS))

    def dealt(blocks: int, salt: int) -> Column:
        return F.pmod(F.xxhash64("id", "digest", F.lit(salt)), F.lit(blocks)).cast("int")

    columns = ["id", "label", "digest", "size", "v", "code", "scale"]
    held = anchors.withColumn("_a", dealt(anchor_blocks, 1)).withColumn("_r", F.explode(F.sequence(F.lit(0), F.lit(row_blocks - 1))))
    rows = index.select(*columns, *[F.lit(None).cast(anchors.schema[c].dataType).alias(c) for c in extra])
    rows = rows.withColumn("_r", dealt(row_blocks, 2)).withColumn("_a", F.explode(F.sequence(F.lit(0), F.lit(anchor_blocks - 1))))
    both = [d.select((F.col("_a") * row_blocks + F.col("_r")).alias("cell"), F.lit(kind).alias("kind"), *columns, *extra)
            for d, kind in ((held.select(*columns, *extra, "_a", "_r"), 0), (rows, 1))]
    return (both[0].unionByName(both[1]).repartition(min(row_blocks * anchor_blocks, 4 * shuffle_partitions(index)), "cell")
            .sortWithinPartitions("cell", "kind"))


def _streamed(cells: DataFrame, work, schema: str) -> DataFrame:
    """``work(anchors by dimension)`` for each cell: a pair of functions that take a block of rows, and give the result."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, held, asked = None, [], None
        for batch in batches:
            if not len(batch):
                continue
            cell, kind = batch.column("cell").to_numpy(), batch.column("kind").to_numpy()
            edges = np.r_[0, np.flatnonzero((cell[1:] != cell[:-1]) | (kind[1:] != kind[:-1])) + 1, len(cell)]
            for a, b in zip(edges[:-1].tolist(), edges[1:].tolist()):
                part = batch.slice(a, b - a)
                if cell[a] != now:
                    if asked is not None:
                        yield from asked.result()
                    now, held, asked = cell[a], [], None
                if kind[a] == 0:
                    held.append(part)
                    continue
                if asked is None and held:
                    asked = work(pa.Table.from_batches(held).combine_chunks().to_batches()[0])
                if asked is not None:
                    for size, rows in _by_size(part):
                        asked.rows(size, rows)
        if asked is not None:
            yield from asked.result()

    return cells.mapInArrow(run, schema)


class _Search:
    """The questions of a block of anchors, answered row block by row block."""

    def __init__(self, anchors: pa.RecordBatch, most: int, same: bool) -> None:
        self.most, self.same = most, same
        self.blocks = {}
        for size, held in _by_size(anchors):
            held["index"] = Anchors(held["v"])
            held["questions"] = [[(None, None, Best(most))] for _ in held["id"]] if same else [
                [(low, high, Best(most)) for low, high in zip(*bounds)] for bounds in zip(held["low"], held["high"])]
            self.blocks[size] = held

    def rows(self, size: int, rows: dict) -> None:
        held = self.blocks.get(size)
        if held is None:
            return
        codes = rows["code"].view(np.uint64)
        every = np.arange(len(rows["id"])), np.arange(len(held["id"]))
        # Positives share the label, so labels meet one by one; negatives may have any other.
        groups = [(np.flatnonzero(rows["label"] == x), np.flatnonzero(held["label"] == x)) for x in np.unique(rows["label"])] if self.same else [every]
        for at, mine in groups:
            for b in range(0, len(at), _TILE_ROWS):
                tile = {k: v[at[b:b + _TILE_ROWS]] for k, v in (rows | {"code": codes}).items() if isinstance(v, np.ndarray)}
                tile["first"] = np.zeros(len(tile["id"]), bool)
                tile["first"][np.unique(tile["id"], return_index=True)[1]] = True
                for a in range(0, len(mine), _TILE_ANCHORS):
                    self._tile(held, mine[a:a + _TILE_ANCHORS], tile)

    def _tile(self, held: dict, some: np.ndarray, rows: dict) -> None:
        low, high = held["index"].interval(some, rows["code"], rows["scale"])
        for i, who in enumerate(some.tolist()):
            other = rows["id"] != held["id"][who]
            if not self.same:
                other &= rows["label"] != held["label"][who]
            maybe = np.zeros(len(other), bool)
            for least, limit, best in held["questions"][who]:
                may, sure = other, other & rows["first"]
                if limit is not None:
                    may = other & (low[i] <= limit) & (high[i] >= least)
                    sure = sure & (high[i] <= limit) & (low[i] >= least)
                # So many rows surely reach the floor; rows of one id can be equal, so an id counts once.
                reached = low[i][sure]
                floor = -np.inf if best.floor is None else best.floor
                if len(reached) >= self.most:
                    floor = max(floor, np.partition(reached, -self.most)[-self.most])
                maybe |= may & (high[i] >= floor)
            chosen = np.flatnonzero(maybe)
            if not len(chosen):
                continue
            score = rows["v"][chosen] @ held["v"][who]
            for least, limit, best in held["questions"][who]:
                fit = np.ones(len(chosen), bool) if limit is None else (score >= least) & (score <= limit)
                if best.floor is not None:
                    fit &= score >= best.floor
                if fit.any():
                    best.put(score[fit], rows["id"][chosen][fit], rows["digest"][chosen][fit])

    def result(self) -> Iterator[pa.RecordBatch]:
        for held in self.blocks.values():
            for who, questions in enumerate(held["questions"]):
                for number, (_, _, best) in enumerate(questions):
                    if len(best.rows):
                        n = len(best.rows)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(np.full(n, held["id"][who])), pa.array(np.full(n, held["digest"][who])), pa.array(np.full(n, number, np.int32)),
                             *(pa.array(best.rows[:, j].copy()) for j in (0, 1, 2))],
                            names=["anchor", "anchor_digest", "question", "score", "other", "other_digest"])


_FOUND = "anchor long, anchor_digest long, question int, score long, other long, other_digest long"


def _first(found: DataFrame, most: int, name: str) -> DataFrame:
    """The first ``most`` answers of each question over all blocks, numbered by ``name``; equal rows came to one block and were one there."""
    order = Window.partitionBy("anchor", "anchor_digest", "question").orderBy(F.desc("score"), "other", "other_digest")
    return found.withColumn(name, F.row_number().over(order)).where(F.col(name) <= most)


def positives(index: DataFrame, anchors: DataFrame, most: int) -> DataFrame:
    """(anchor, anchor_digest, score, other, other_digest, place): the first rows of the anchor's label."""
    cells = _cells(index, anchors, [])
    return _first(_streamed(cells, lambda held: _Search(held, most, True), _FOUND), most, "place").drop("question")


def _floor_100(x: Column) -> Column:
    """A hundredth, rounded down, in integers."""
    return F.call_function("div", x - F.pmod(x, F.lit(100)), F.lit(100))


def mine(rows: DataFrame, vec: str = "vec_id", embedding: str = "embedding", label: str = "label", moved: int | None = 7,
         every: int = 50, n_positives: int = 5, n_negatives: int = 3, low: int = 50, high: int = 95) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score) of every anchor and positive.

    Anchors are rows whose id ``every`` divides; positives their first ``n_positives`` rows of the
    same label by integer product, ties by smaller id; negatives the first ``n_negatives`` rows of
    other labels with ``low * positive <= 100 * product <= high * positive``.  Rows whose id
    ``moved`` divides first get the next label.  For rows left out see :func:`integers`.
    Rows that agree in id, label and components count once; other rows of one id stand for
    themselves, ordered by a hash of their content, but none is its own anchor's partner.  Vectors of
    another dimension have no product and are no partners; other columns are not read.
    """
    index = put(coded(integers(rows, vec, embedding, label, moved)), "coded")
    # Equal anchors ask once.
    anchors = index.where(F.col("id") % every == 0).dropDuplicates(["id", "digest"])
    best = put(positives(index, anchors, n_positives), "positives")
    asked = best.groupBy(F.col("anchor").alias("id"), F.col("anchor_digest").alias("digest")).agg(
        F.array_sort(F.collect_list(F.struct("place", "score"))).alias("_q"))

    bounds = anchors.join(asked, ["id", "digest"]).withColumns({
        "low": F.transform("_q", lambda q: -_floor_100(-q["score"] * low)),
        "high": F.transform("_q", lambda q: _floor_100(q["score"] * high))}).drop("_q")
    cells = _cells(index, bounds, ["low", "high"])
    found = _first(_streamed(cells, lambda held: _Search(held, n_negatives, False), _FOUND), n_negatives, "rank")
    key = ["anchor", "anchor_digest", "place"]
    chosen = best.select(*key, F.col("other").alias("positive_id"), F.col("score").alias("positive_score"))
    return found.withColumn("place", F.col("question") + 1).join(chosen, key).select(
        F.col("anchor").alias("anchor_id"), "positive_id", F.col("rank").cast("int").alias("rank"), F.col("other").alias("negative_id"),
        "positive_score", F.col("score").alias("negative_score"))
