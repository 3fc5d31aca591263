"""SimHash near duplicates by vantage-point trees over Hamming distances.

Two fingerprints that differ in ``radius`` bits at most differ in half of that, rounded down,
in one of their halves.  So there is a tree for each half, whose nodes part the fingerprints
by their distance from a vantage point, in that half or in all bits.  By the triangle
inequality a fingerprint's partners are on the inner side only if its own distance less the
radius is within the node's, on the outer side only if its distance and the radius are
beyond it; a fingerprint near the boundary looks on both sides.

The upper tree is grown from a bounded sample, and deals every fingerprint to its own leaf
(a shard) and to the later leaves it must look into.  Each shard goes on parting its own in
the same way until few are left, which are compared bit by bit.  A shard sends the links
that join its fingerprints into components, not all pairs: the other pairs follow from them.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from ..operators.components import linked_components
from ..plans.session import keep
from . import words as W
from .shared import meet, put

N, RADIUS, SEED = 3, 3, 42
#: Fingerprints that the upper trees are grown from, those of the smallest hashes; fewest of them in a leaf.
SAMPLE, IN_LEAF = 65_536, 8
#: Fingerprints of a shard, as far as the sample can tell.
SHARD = 8192
#: Pairs that are compared at once, and up to which a part is not split further.
CELLS = 1 << 19
#: A split that leaves more than this share of the work is not made.
WORTH = 0.85

U = np.uint64
LOW = U(0xFFFFFFFF)
HALVES = (LOW, ~LOW)
ALL = ~U(0)
_SHINGLES = 1 << 16


def fingerprint(text: bytes, n: int = N) -> int:
    """Bit b is set if it is in more than half of the XXH64 of the ``n``-word shingles, repeats included."""
    words = text.lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    size = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(size + 1) - 1
    starts = ends - size
    n = min(n, len(words))
    starts, ends = starts[:len(words) - n + 1], ends[n - 1:]
    hashed, count = xxhash.xxh64_digest, np.zeros(64, np.int64)
    for at in range(0, len(starts), _SHINGLES):
        raw = b"".join([hashed(joined[a:b], SEED) for a, b in zip(starts[at:at + _SHINGLES].tolist(), ends[at:at + _SHINGLES].tolist())])
        count += np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, 8), axis=1).sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * count > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, n: int = N, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, print) of each row, the 64 bits as a signed long; a text without words has zero."""
    source = docs.select(F.col(doc).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "t"):
                data, offsets = W.flat(part.column("t"))
                found = np.array([fingerprint(data[a:b].tobytes(), n) for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist())], np.uint64)
                yield pa.RecordBatch.from_arrays([part.column("k"), pa.array(found.view(np.int64))], names=[doc, "print"])

    return source.mapInArrow(run, f"`{doc}` {kind}, print long")


@dataclass(frozen=True)
class Node:
    """A vantage point: what is within ``edge`` of it in the bits of ``mask`` is inside."""

    point: int
    mask: int
    radius: int
    edge: int
    inner: "Node | int"
    outer: "Node | int"

    def distance(self, prints: np.ndarray) -> np.ndarray:
        return np.bitwise_count((prints ^ U(self.point)) & U(self.mask)).astype(np.int16)


def vantage(prints: np.ndarray, half: int, radius: int) -> Node | None:
    """The split of ``prints`` that leaves the least work, of a few points, both metrics and all edges; None if none is worth it."""
    some = prints[:: max(1, len(prints) // 2048)]
    best, found = WORTH, None
    for point in {int(p) for p in some[:: max(1, len(some) // 4)]}:
        for mask, r in ((half, radius // 2), (ALL, radius)):
            d = np.bitwise_count((some ^ U(point)) & mask)
            upto = np.cumsum(np.bincount(d, minlength=65)) / len(some)
            edge = np.arange(64)
            inside, beyond = upto[:64], 1 - upto[:64]
            looks_in, looks_out = upto[np.minimum(edge + r, 64)], 1 - np.where(edge >= r, upto[np.maximum(edge - r, 0)], 0)
            work = np.where((inside > 0) & (beyond > 0), inside * looks_in + beyond * looks_out, 2)
            at = int(np.argmin(work))
            if work[at] < best:
                best, found = float(work[at]), Node(point, int(mask), r, at, 0, 0)
    return found


def grow(sample: np.ndarray, half: int, radius: int, leaves: int) -> tuple["Node | int", int]:
    """(tree, number of leaves): parts of at least IN_LEAF of the sample, about as many as ``leaves``; leaves are numbered in order."""
    most = max(2 * IN_LEAF, -(-len(sample) // max(leaves, 1)))
    count = 0

    def build(prints: np.ndarray) -> "Node | int":
        nonlocal count
        node = vantage(prints, half, radius) if len(prints) > most else None
        if node is None:
            count += 1
            return count - 1
        near = node.distance(prints) <= node.edge
        inner = build(prints[near])
        return Node(node.point, node.mask, node.radius, node.edge, inner, build(prints[~near]))

    return build(sample), count


def dealt(tree: "Node | int", prints: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, leaf, whether it is the row's own): the own leaf of each print, and the later leaves with possible partners."""
    rows, leaves, own = [], [], []
    home = np.zeros(len(prints), np.int64)
    stack = [(tree, np.arange(len(prints)), np.ones(len(prints), bool))]
    while stack:
        node, at, mine = stack.pop()
        if not len(at):
            continue
        if isinstance(node, int):
            home[at[mine]] = node
            rows.append(at)
            leaves.append(np.full(len(at), node))
            own.append(mine)
            continue
        d = node.distance(prints[at])
        inside = d <= node.edge
        looks_in, looks_out = d - node.radius <= node.edge, d + node.radius > node.edge
        stack.append((node.inner, at[looks_in], (mine & inside)[looks_in]))
        stack.append((node.outer, at[looks_out], (mine & ~inside)[looks_out]))
    rows, leaves, own = (np.concatenate(x) for x in (rows, leaves, own))
    # Both of a pair would look into the other's leaf: the one of the earlier leaf does.
    stays = leaves >= home[rows]
    return rows[stays], leaves[stays], own[stays]


def joined(own: np.ndarray, guests: np.ndarray, half: int, radius: int) -> np.ndarray:
    """Rows (a, b): links within ``radius`` of own prints with each other and with guests, as many as join what they join."""
    prints = np.concatenate([own, guests])
    label = np.arange(len(prints))
    out: list[tuple[int, int]] = []

    def link(a: np.ndarray, b: np.ndarray) -> None:
        nonlocal label
        fresh = label[a] != label[b]
        if not fresh.any():
            return
        root: dict[int, int] = {}

        def top(x: int) -> int:
            while x in root:
                x = root[x]
            return x

        for i, j in zip(a[fresh].tolist(), b[fresh].tolist()):
            p, q = top(int(label[i])), top(int(label[j]))
            if p != q:
                root[max(p, q)] = min(p, q)
                out.append((i, j))
        changed = np.arange(len(prints))
        for x in root:
            changed[x] = top(x)
        label = changed[label]

    stack = [(np.arange(len(own)), np.arange(len(own), len(prints)))]
    while stack:
        mine, looking = stack.pop()
        if not len(mine):
            continue
        node = vantage(prints[mine], half, radius) if len(mine) * (len(mine) + len(looking)) > CELLS else None
        if node is None:
            both = np.r_[mine, looking]
            step = max(1, CELLS // len(mine))
            for at in range(0, len(both), step):
                some = both[at:at + step]
                x, y = np.nonzero(np.bitwise_count(prints[some][:, None] ^ prints[mine][None, :]) <= radius)
                link(some[x], mine[y])
            continue
        d, e = node.distance(prints[mine]), node.distance(prints[looking])
        inside = d <= node.edge
        # Own ones of the inner side near the boundary look into the outer side; the other direction would find the same pairs.
        stack.append((mine[inside], looking[e - node.radius <= node.edge]))
        stack.append((mine[~inside], np.r_[mine[inside & (d + node.radius > node.edge)], looking[e + node.radius > node.edge]]))
    return np.array(out, np.int64).reshape(-1, 2)


def near_links(points: DataFrame, radius: int = RADIUS) -> DataFrame:
    """(u, v): links between the distinct prints of ``points`` that join all those which ``radius`` bits or fewer part."""
    total = points.count()
    sample = points.orderBy(F.xxhash64("print", F.lit(1)), "print").limit(SAMPLE).toArrow().column(0).to_numpy().view(np.uint64)
    leaves = min(-(-total // SHARD), max(1, len(sample) // IN_LEAF))
    # Sampled prints come in hash order, so any part of them is a fair one.
    trees = [grow(sample, half, radius, leaves)[0] for half in HALVES]

    def deal(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            prints = batch.column(0).to_numpy().view(np.uint64)
            for t, tree in enumerate(trees) if len(prints) else ():
                row, leaf, own = dealt(tree, prints)
                for a in range(0, len(row), 1 << 18):
                    some = slice(a, a + (1 << 18))
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(np.full(len(row[some]), t, np.int32)), pa.array(leaf[some].astype(np.int32)), pa.array(own[some]), pa.array(prints[row[some]].view(np.int64))],
                        names=["tree", "leaf", "own", "print"])

    def shard(key: tuple, rows: pa.Table) -> pa.Table:
        prints, own = rows.column("print").to_numpy().view(np.uint64), rows.column("own").to_numpy()
        mine, guests = prints[own], prints[~own]
        pairs = joined(mine, guests, HALVES[key[0].as_py()], radius)
        both = np.concatenate([mine, guests]).view(np.int64)
        return pa.table({"u": both[pairs[:, 0]], "v": both[pairs[:, 1]]})

    return (points.select("print").mapInArrow(deal, "tree int, leaf int, own boolean, print long")
            .groupBy("tree", "leaf").applyInArrow(shard, "u long, v long"))


def linked(docs: DataFrame, n: int = N, radius: int = RADIUS, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, fingerprint, component_id) of each row; the component's id is the smallest one reachable by links.

    Rows whose fingerprints differ in ``radius`` bits at most are linked.  Null, empty and
    wordless texts have fingerprint zero and are linked like any other; so are rows without
    an id, which never name a component (null where nothing else is reachable).  Equal rows
    and rows of one id are each judged by their own text.  Other columns are not read.
    """
    marked = put(fingerprints(docs, n, doc, text).withColumnRenamed(doc, "k"), "fingerprints")
    groups = keep(marked.groupBy("print").agg(F.min("k").alias("least"), F.count(F.lit(1)).alias("met")))
    found = linked_components(near_links(groups, radius)).select(F.col("u").alias("print"), F.col("v").alias("part"))
    # A component can hold most prints: only its smallest id meets them, hot ones by broadcast.
    parts = keep(groups.join(found, "print", "left").withColumn("part", F.coalesce("part", "print")))
    names = parts.groupBy("part").agg(F.min("least").alias("component_id"), F.count(F.lit(1)).alias("prints"))
    total = parts.count()
    of = meet(parts.select("print", "part", "met"), names, "part", "prints", total).select("print", "met", "component_id")
    return meet(marked, keep(of), "print", "met", marked.count()).select(
        F.col("k").alias(doc), F.lpad(F.lower(F.hex("print")), 16, "0").alias("fingerprint"), "component_id")
