"""N-gram Jaccard join by grouped prefixes.

A text's set is its distinct n-word shingles, as 64-bit hashes in one global order, rare
ones first: by how often their bucket was met where that stands out (repeated passages), then
by how often their words are (chance repeats), then by hash.  The order only has to be the
same for all texts; the better it fits the corpus, the fewer pairs are met in vain.  Texts
that link must share some shingles among the first of each (the prefix).  Texts with the same
prefix and size form a group.

Pairs are not listed inside a crowded prefix shingle.  Each of its groups first meets the
shingle's smallest one only; verified links join them into components; then whatever is not
in the component of that smallest one meets all others that are in another component.  A
parity bitmap of each set bounds the overlap from above and is part of that join's
condition.  So no link between components is lost and linked crowds stay linear.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..operators.components import linked_components
from ..plans.session import keep, shuffle_partitions
from . import words as W
from .shared import among, meet, put

N, PERCENT = 4, 85
#: Hash buckets of shingle counts: at most so many numbers come to the driver.
_COMMON_BITS = 20
#: A bucket is common in a task when it holds this many times the mean, and at least 64.
_COMMON_TIMES, _COMMON_LEAST = 8, 64
_BITS = [f"b{i}" for i in range(8)]


def _shingles(w: W.Words, n: int) -> list[tuple[np.ndarray, int, int]]:
    """(hashes, first word, words of each) for each text; fewer than ``n`` words make one shingle of them all."""
    out = []
    start, h = w.windows(n)
    bounds = np.searchsorted(start, w.bounds)
    for i, c in enumerate(w.counts().tolist()):
        a = int(w.bounds[i])
        if c >= n:
            out.append((h[bounds[i]:bounds[i + 1]], a, n))
        else:
            out.append((W.chain(w.hashes[a:a + c], c) if c else np.empty(0, np.uint64), a, c))
    return out


def token_sets(w: W.Words, n: int = N) -> list[np.ndarray]:
    """Sorted distinct shingle hashes of each text."""
    return [W.unique(h) for h, _, _ in _shingles(w, n)]


def _bucket(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> W.U(64 - _COMMON_BITS)).astype(np.int64)


class Order:
    """Corpus counts that rank shingles: rare ones first."""

    def __init__(self, shingles: np.ndarray, words: np.ndarray, total: int) -> None:
        self.shingles = shingles
        floor = max(1.0, total / (1 << _COMMON_BITS))
        # Quarters of a binary logarithm of a word's share; all words that do not stand out are alike.
        self.words = np.round(4 * np.log2(np.maximum(words, floor) / floor)).astype(np.int32)

    def sorted(self, w: W.Words, hashes: np.ndarray, first: int, size: int) -> np.ndarray:
        """Distinct shingles, rarest first."""
        rank = self.words[_bucket(w.hashes[first:first + len(hashes) + size - 1])]
        total = np.r_[0, np.cumsum(rank)]
        chance = total[size:] - total[:-size]
        distinct, at = np.unique(hashes, return_index=True)
        return distinct[np.lexsort((distinct, chance[at], self.shingles[_bucket(distinct)]))]


def _order(docs: DataFrame, n: int) -> Order:
    """How many texts hold the shingles, and how often texts have the words, of each bucket that stands out in some task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size = 1 << _COMMON_BITS
        held, said = np.zeros(size, np.int64), np.zeros(size, np.int64)
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.SPACED)
                held += np.bincount(_bucket(np.concatenate(token_sets(w, n))), minlength=size)
                said += np.bincount(_bucket(w.hashes), minlength=size)
        for kind, counts in enumerate((held, said)):
            at = np.flatnonzero(counts > max(_COMMON_LEAST, _COMMON_TIMES * counts.mean()))
            yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), kind, np.int32)), pa.array(at, pa.int32()), pa.array(counts[at])],
                                             names=["kind", "bucket", "met"])
        yield pa.RecordBatch.from_arrays([pa.array([2], pa.int32()), pa.array([0], pa.int32()), pa.array([int(said.sum())], pa.int64())],
                                         names=["kind", "bucket", "met"])

    rows = (docs.select("t").mapInArrow(run, "kind int, bucket int, met long").groupBy("kind", "bucket")
            .agg(F.sum("met").alias("met")).toArrow())
    kind, bucket, met = (c.to_numpy() for c in rows.columns)
    tables = np.zeros((2, 1 << _COMMON_BITS), np.int64)
    for k in (0, 1):
        tables[k, bucket[kind == k]] = met[kind == k]
    return Order(tables[0], tables[1], int(met[kind == 2].sum()))


def asked(n: int) -> int:
    """How many prefix shingles a text of ``n`` shingles must share with a partner."""
    return 1 + n // 100


def prefix_length(n: int, percent: int = PERCENT) -> int:
    """Two sets with the asked share have asked(smaller) members in common among the first so many of either."""
    return min(n, n - -(-percent * n // 100) + asked(n))


def sets(docs: DataFrame, n: int = N, percent: int = PERCENT) -> DataFrame:
    """(k, n, set, prefix, b0..b7) of each row (k, t); ``set`` names the set, b are parities of its hashes in 512 buckets."""
    order = docs.sparkSession.sparkContext.broadcast(_order(docs, n))
    kind = docs.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.SPACED)
                names, prefixes, sizes = [], [], []
                bits = np.zeros((len(part), 8), np.int64)
                for i, (h, first, size) in enumerate(_shingles(w, n)):
                    x = order.value.sorted(w, h, first, size) if len(h) else h
                    sizes.append(len(x))
                    two = np.array([W.mix(x).sum(), W.mix(x ^ W.U(0x5851F42D4C957F2D)).sum(), len(x)], np.uint64)
                    names.append(two.tobytes())
                    odd = np.bincount((x >> W.U(55)).astype(np.int64), minlength=512) & 1
                    bits[i] = np.packbits(odd.astype(np.uint8)).view(np.int64)
                    prefixes.append(x[:prefix_length(len(x), percent) if len(x) else 0].view(np.int64))
                ends = np.cumsum([0, *map(len, prefixes)])
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(sizes, pa.int64()), pa.array(names, pa.binary()),
                     pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.concatenate(prefixes))),
                     *[pa.array(bits[:, j]) for j in range(8)]],
                    names=["k", "n", "set", "prefix", *_BITS])

    return put(docs.mapInArrow(run, f"k {kind}, n long, set binary, prefix array<long>, " + ", ".join(f"{b} long" for b in _BITS)), "sets")


def _sizes_fit(a: Column, b: Column, percent: int) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * percent


def _bits_fit(left: str, right: str, percent: int) -> Column:
    """The sets may differ in so many members at most, and differ in at least as many as parities differ."""
    apart = sum((F.bit_count(F.col(f"{left}.{b}").bitwiseXOR(F.col(f"{right}.{b}"))) for b in _BITS[1:]),
                F.bit_count(F.col(f"{left}.b0").bitwiseXOR(F.col(f"{right}.b0"))))
    return apart * (100 + percent) <= (F.col(f"{left}.n") + F.col(f"{right}.n")) * (100 - percent)


def _shared(postings: DataFrame) -> DataFrame:
    """Postings (token, g, n) of tokens that more than one group has, with the token's head, the smallest group.

    One pass over rows sorted by token; memory is one row, however many rows a token has.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, held = None, None
        for batch in batches:
            if not len(batch):
                continue
            token, g, n = (batch.column(j).to_numpy() for j in range(3))
            new = np.r_[token[0] != last, token[1:] != token[:-1]]
            begin = np.maximum.accumulate(np.where(new, np.arange(len(new)), -1))
            head_g = np.where(begin >= 0, g[begin], held[0] if held else 0)
            head_n = np.where(begin >= 0, n[begin], held[1] if held else 0)
            keep_rows = np.flatnonzero(~new)
            yield pa.RecordBatch.from_arrays([pa.array(x[keep_rows]) for x in (token, g, n, head_g, head_n)],
                                             names=["token", "g", "n", "head", "head_n"])
            last, held = token[-1], (head_g[-1], head_n[-1])

    return (postings.repartition(shuffle_partitions(postings), "token").sortWithinPartitions("token", "g")
            .mapInArrow(run, "token long, g long, n long, head long, head_n long"))


def _verified(pairs: DataFrame, texts: DataFrame, n: int, percent: int) -> DataFrame:
    """The pairs (a, b) whose sets reach the share; ``a`` repeats, so partners stream past its set.

    A pair that is given twice is checked twice.
    """
    wanted = pairs.select("a", F.col("b").alias("u")).unionByName(pairs.select("a").distinct().select("a", F.col("a").alias("u")))
    rows = wanted.join(among(texts, "k", wanted, "u"), F.col("u") == F.col("k")).select("a", (F.col("u") == F.col("a")).alias("own"), "u", "t")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        head, mine = None, []
        for batch in batches:
            for part in W.blocks(batch, "t"):
                a, own, u = (part.column(j).to_pylist() for j in range(3))
                found = []
                for i, x in enumerate(token_sets(W.words(part.column("t"), W.SPACED), n)):
                    if a[i] != head:
                        head, mine = a[i], []
                    if own[i]:
                        mine.append(x)
                        continue
                    for y in mine:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if 100 * both >= percent * (len(x) + len(y) - both):
                            found.append((head, u[i]))
                            break
                yield pa.RecordBatch.from_arrays([pa.array([p[j] for p in found], pa.int64()) for j in (0, 1)], names=["a", "b"])

    return (rows.repartition(shuffle_partitions(pairs), "a").sortWithinPartitions("a", F.desc("own"))
            .mapInArrow(run, "a long, b long"))


def linked(docs: DataFrame, n: int = N, percent: int = PERCENT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, n_shingles, component_id) of every row.

    Two texts link when 100 * common >= ``percent`` * all of their shingles; the component is
    the smallest id reachable by links.  Null, empty and wordless texts have no shingles and
    link with nothing; so do rows without id, whose component is null.  Rows that share an id
    are one document with several texts.  Other columns are not read.
    """
    source = docs.select(F.col(doc).cast("long").alias("k"), F.col(text).alias("t"))
    rows = sets(source, n, percent)
    full = rows.where("n > 0 AND k IS NOT NULL")
    # Equal sets are one unit, named by its smallest id.
    units = full.groupBy("set").agg(F.min("k").alias("u"), F.count(F.lit(1)).alias("copies"),
                                    F.min_by(F.struct("n", "prefix", *_BITS), "k").alias("_s"))
    units = put(units.select("set", "u", "copies", "_s.*").withColumn("p", F.xxhash64("prefix")), "units")
    # Units with equal size and prefix are one group, named by its smallest unit.
    groups = units.groupBy("n", "p").agg(F.min("u").alias("g"), F.any_value("prefix").alias("prefix"))
    names = units.groupBy("n", "p").agg(F.min("u").alias("g"))
    members = put(units.select("n", "p", "u", *_BITS).join(names, ["n", "p"]).drop("p"), "members")
    shared = put(_shared(groups.select(F.explode("prefix").alias("token"), "g", "n")), "shared")

    # Each group against the head of its tokens, each unit against the head of its group.
    # (those that share at least half of what is asked; the others are left to the second meeting).
    heads = (shared.where(_sizes_fit(F.col("n"), F.col("head_n"), percent)).groupBy("g", "head")
             .agg(F.count(F.lit(1)).alias("met"), F.min(F.least("n", "head_n")).alias("n")).where("2 * met >= 1 + n div 100")
             .select("g", "head").join(members.select("g", "u", F.col("n").alias("u_n"), *_BITS), "g")
             .select(F.col("head").alias("a"), F.col("u").alias("b"), F.col("u_n").alias("n"), *_BITS))
    inside = members.where("u <> g").select(F.col("g").alias("a"), F.col("u").alias("b"), "n", *_BITS)
    pairs = _near(heads.unionByName(inside), members, percent)
    texts = source.where("k IS NOT NULL")
    links = keep(_verified(keep(pairs), texts, n, percent))
    labels = _labels(links)

    # What is outside its head's component against all that is in another component.
    named = members.join(labels, "u", "left").withColumn("c", F.coalesce("c", "u"))
    named = put(named, "named")
    head_c = named.where("u = g").select(F.col("g").alias("head"), F.col("c").alias("head_c"))
    # Members of one group share its whole prefix: they meet in a token of their own that counts for all.
    own = F.xxhash64(F.lit("group"), "g")
    crowd = named.where("u <> g").select("g").distinct()
    tokens = (shared.select("token", "g").unionByName(shared.select("token", F.col("head").alias("g")).distinct())
              .select("token", "g", F.lit(1).alias("counts")).unionByName(crowd.select(own.alias("token"), "g", F.lit(1 << 30).alias("counts"))))
    head_of = shared.select("token", "head").distinct().unionByName(crowd.select(own.alias("token"), F.col("g").alias("head")))
    # Written first, so that the meeting is a plan of few exchanges: the driver keeps plans and tasks of all stages that run at once.
    told = put(head_of.join(head_c, "head").select("token", "head_c"), "told")
    # A unit with fewer shared shingles than its smallest partner asks for has no partner left.
    able = put(tokens.groupBy("g").agg(F.sum("counts").alias("met")), "able")
    named = named.join(able, "g").where(f"met >= 1 + (n * {percent} div 100) div 100").drop("met")
    at = tokens.join(named, "g").join(told, "token")
    outside = at.where("c <> head_c")
    every = at.join(outside.select("token").distinct(), "token", "left_semi").alias("y")
    x = outside.alias("x")
    # Each pair once: from its smaller unit if both are outside.
    once = (F.col("y.c") == F.col("y.head_c")) | (F.col("x.u") < F.col("y.u"))
    more = x.join(every, (F.col("x.token") == F.col("y.token")) & (F.col("x.c") != F.col("y.c")) & once
                  & _sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _bits_fit("x", "y", percent))
    more = (more.groupBy(F.least("x.u", "y.u").alias("a"), F.greatest("x.u", "y.u").alias("b"))
            .agg(F.sum("x.counts").alias("met"), F.min(F.least("x.n", "y.n")).alias("n")).where("met >= 1 + n div 100").select("a", "b"))
    links = keep(_verified(keep(more), texts, n, percent).unionByName(links))
    final = units.join(_labels(links), "u", "left").select("set", "copies", F.coalesce("c", "u").alias("component_id"))
    total = full.count()
    joined = meet(full.select("k", "n", "set"), final, "set", "copies", total).select("k", "n", "component_id")
    rest = rows.where("n = 0 OR k IS NULL").select("k", "n", F.col("k").alias("component_id"))
    return joined.unionByName(rest).select(F.col("k").alias(doc), F.col("n").alias("n_shingles"), "component_id")


def _near(pairs: DataFrame, members: DataFrame, percent: int) -> DataFrame:
    """The pairs (a, b) of different ids whose bitmaps allow a link; ``pairs`` have size and bitmap of ``b``.

    A group meets the name of another as head once, so a pair repeats only where an id has several texts.
    """
    x, y = members.select("u", "n", *_BITS).alias("x"), pairs.alias("y")
    found = y.where("a <> b").join(x, F.col("y.a") == F.col("x.u"))
    return found.where(_sizes_fit(F.col("x.n"), F.col("y.n"), percent) & _bits_fit("x", "y", percent)).select("y.a", "y.b")


def _labels(links: DataFrame) -> DataFrame:
    """(u, c): the smallest unit of its component, for each unit with a link to a smaller one."""
    return linked_components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("v", "c")


def one_of_each(docs: DataFrame, n: int = N, percent: int = PERCENT, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """``docs`` with the smallest id of each component only; rows without id stay, repeated rows become one."""
    found = put(linked(docs, n, percent, doc, text), "found")
    gone = found.where(F.col("component_id") < F.col(doc)).select(doc).distinct()
    left = docs.join(gone, doc, "left_anti")
    again = put(found.where(F.col(doc).isNotNull()).groupBy(doc).agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select(doc), "again")
    if again.isEmpty():
        return left
    # Ids with several rows: the row with the smallest text stays.
    twice = left.join(again, doc, "left_semi")
    text_hash = F.coalesce(F.sha2(text, 256), F.lit(""))
    best = twice.groupBy(doc).agg(F.min_by(F.struct(*docs.columns), text_hash).alias("_row")).select("_row.*")
    return left.join(again, doc, "left_anti").unionByName(best)
