"""Exact and near duplicates, and the decisions about them.

A group of n equal rows is reported by links, not by its n(n-1)/2 pairs, so that it stays
linear when a third of the rows are copies.  Where splits matter, links are made between
active pages only, by way of one head per key and split.  Pair counts come from group sizes.
"""

from __future__ import annotations

import math
from itertools import combinations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import hamming
from ..plans.session import keep
from ..plans.skew import lookup
from .components import lineage_tokens

NEAR_BITS = 4  # fixed value: largest distance of a perceptual duplicate


def exact_links(items: DataFrame, item: str, key: str, reason: str = "exact",
                hot_rows: int | None = None) -> DataFrame:
    """(a, b, reason) with a the smallest id sharing ``key``."""
    groups = items.groupBy(key).agg(F.min(item).alias("a"), F.count(F.lit(1)).alias("_rows")).where("_rows > 1")
    return (lookup(items.select(key, F.col(item).alias("b")), groups, key, "_rows", hot_rows, items.count())
            .where("a <> b").select("a", "b", F.lit(reason).alias("reason")))


def exact_pair_counts(items: DataFrame, key: str, split: str) -> DataFrame:
    """Pairs of equal rows per reason of interest, from group sizes alone."""
    # Halving the even factor first keeps n(n-1)/2 within a long up to four billion copies.
    pairs = "if(n % 2 = 0, (n div 2) * (n - 1), n * ((n - 1) div 2))"
    sizes = items.groupBy(key, split).agg(F.count(F.lit(1)).alias("n"))
    per_key = sizes.groupBy(key).agg(F.sum("n").alias("n"), F.sum(F.expr(pairs)).alias("same"))
    return per_key.where("n > 1").agg(
        F.count(F.lit(1)).alias("groups"),
        F.coalesce(F.sum("same"), F.lit(0)).alias("same_split_pairs"),
        F.coalesce(F.sum(F.expr(f"{pairs} - same")), F.lit(0)).alias("cross_split_pairs"))


def _cuts(bits: int, blocks: int) -> list[tuple[int, int]]:
    """(shift, width) of ``blocks`` nearly equal bit ranges."""
    edges = [round(i * bits / blocks) for i in range(blocks + 1)]
    return [(lo, hi - lo) for lo, hi in zip(edges, edges[1:])]


def _block(code: Column, cut: tuple[int, int]) -> Column:
    shift, width = cut
    return F.shiftrightunsigned(code, shift).bitwiseAND(F.lit((1 << width) - 1))


def choose_blocks(codes: int, bits: int = 64, k: int = NEAR_BITS) -> int:
    """Fewest blocks whose keys (blocks - k of them together) hold only a few codes each."""
    for blocks in range(k + 1, k + 5):
        if codes / 2 ** (bits * (blocks - k) / blocks) <= 8:
            return blocks
    return k + 4


class Blocks:
    """Codes cut into blocks: codes within ``k`` bits agree on some choice of ``blocks - k`` blocks."""

    def __init__(self, blocks: int, k: int = NEAR_BITS, bits: int = 64) -> None:
        self.blocks, self.k, self.bits = blocks, k, bits
        self.cuts = _cuts(bits, blocks)
        self.choices = list(combinations(range(blocks), blocks - k))
        self.first = [-1] * (1 << blocks)  # match mask -> first choice it contains
        for mask in range(1 << blocks):
            for number, choice in enumerate(self.choices):
                if all(mask >> b & 1 for b in choice):
                    self.first[mask] = number
                    break
        # The bits not in a choice are cut into k+1 bands: within a bucket the k differing
        # bits all lie there, so at least one band agrees.
        rest = {n: [i for b in range(blocks) if b not in c for i in range(self.cuts[b][0], self.cuts[b][0] + self.cuts[b][1])]
                for n, c in enumerate(self.choices)}
        masks = {n: [sum(1 << i for i in r[lo:lo + w]) for lo, w in _cuts(len(r), k + 1)] for n, r in rest.items()}
        signed = [[m - (1 << 64) if m >= 1 << 63 else m for m in masks[n]] for n in range(len(self.choices))]
        self.bands = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in signed])

    def _key(self, choice: tuple[int, ...]) -> Column:
        out = F.lit(0).cast("long")
        for b in choice:
            out = F.shiftleft(out, self.cuts[b][1]).bitwiseOR(_block(F.col("code"), self.cuts[b]))
        return out

    def keyed(self, codes: DataFrame, code: str = "code") -> DataFrame:
        """(code, choice, value): one row for each choice of blocks."""
        return codes.select(F.col(code).alias("code")).select("code", F.explode(F.array(*[
            F.struct(F.lit(n).alias("choice"), self._key(c).alias("value")) for n, c in enumerate(self.choices)])).alias("_k")
        ).select("code", "_k.choice", "_k.value")

    def meet(self, left: DataFrame, right: DataFrame, hot_bucket: int = 5000) -> DataFrame:
        """(left, right, distance): codes of ``left`` within ``k`` bits of one of ``right``, both keyed.

        A pair comes out at the first choice it agrees on only, which replaces a distinct.
        Buckets of ``right`` with more than ``hot_bucket`` codes are cut again over the whole code
        with k+1 finer bands, so a popular key is split by content, not capped.
        """
        # At most (rows / hot_bucket) buckets are hot, which bounds their broadcast.
        hot = keep(right.groupBy("choice", "value").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot_bucket)
                   .select("choice", "value"))
        crowded = not hot.isEmpty()

        def banded(keyed: DataFrame) -> DataFrame:
            plain = keyed.select("code", "choice", "value", F.lit(-1).alias("band"), F.lit(0).cast("long").alias("part"))
            if not crowded:
                return plain
            split = (keyed.join(F.broadcast(hot), ["choice", "value"])
                     .withColumn("_m", F.element_at(self.bands, F.col("choice") + 1))
                     .select("code", "choice", "value", F.posexplode("_m").alias("band", "mask"))
                     .select("code", "choice", "value", "band", F.col("code").bitwiseAND(F.col("mask")).alias("part")))
            return plain.join(F.broadcast(hot), ["choice", "value"], "left_anti").select(*split.columns).unionByName(split)

        x = F.col("left").bitwiseXOR(F.col("right"))
        agree = F.lit(0)
        for b, cut in enumerate(self.cuts):
            agree = agree + F.when(_block(x, cut) == 0, F.lit(1 << b)).otherwise(F.lit(0))
        table = F.array(*[F.lit(v) for v in self.first])
        itself = left is right
        pairs = (banded(left).withColumnRenamed("code", "left").join(banded(right).withColumnRenamed("code", "right"), ["choice", "value", "band", "part"])
                 .where("left < right" if itself else "left <> right")
                 .where(hamming(F.col("left"), F.col("right")) <= self.k)
                 .where(F.element_at(table, (agree + 1).cast("int")) == F.col("choice")))
        # Of the finer bands, keep the first that agrees.
        mask_row = F.element_at(self.bands, F.col("choice") + 1)
        earlier = F.exists(F.slice(mask_row, 1, F.greatest(F.col("band"), F.lit(0))),
                           lambda m: x.bitwiseAND(m) == 0)
        return (pairs.where((F.col("band") < 0) | ~earlier)
                .select("left", "right", hamming(F.col("left"), F.col("right")).cast("int").alias("distance")))


def near_code_pairs(codes: DataFrame, code: str, k: int = NEAR_BITS, bits: int = 64,
                    blocks: int | None = None, hot_bucket: int = 5000) -> DataFrame:
    """(left, right, distance) of distinct codes within Hamming distance ``k``; exact."""
    cut = Blocks(blocks or choose_blocks(codes.count(), bits, k), k, bits)
    rows = cut.keyed(codes, code)
    return cut.meet(rows, rows, hot_bucket)


def near_links(items: DataFrame, item: str, code: str, k: int = NEAR_BITS, bits: int = 64,
               reason: str = "perceptual", blocks: int | None = None, hot_bucket: int = 5000,
               hot_rows: int | None = None) -> DataFrame:
    """(a, b, distance, reason): equal codes as links to their smallest id, near codes
    as links between those smallest ids."""
    groups = keep(items.groupBy(code).agg(F.min(item).alias("a"), F.count(F.lit(1)).alias("_rows")))
    total = groups.agg(F.coalesce(F.sum("_rows"), F.lit(0)).alias("n")).first()["n"]
    same = (lookup(items.select(code, F.col(item).alias("b")), groups.where("_rows > 1"), code, "_rows", hot_rows, total)
            .where("a <> b").select("a", "b", F.lit(0).alias("distance")))
    heads = groups.select(F.col(code).alias("code"), "a")
    near = near_code_pairs(heads, "code", k, bits, blocks, hot_bucket)
    far = (near.join(heads.select(F.col("code").alias("left"), F.col("a").alias("p")), "left")
           .join(heads.select(F.col("code").alias("right"), F.col("a").alias("q")), "right")
           .select(F.least("p", "q").alias("a"), F.greatest("p", "q").alias("b"), "distance"))
    return same.unionByName(far).withColumn("reason", F.lit(reason))


def page_links(samples: DataFrame, item: str = "id", sha: str = "sha", phash: str = "phash", **near: object) -> DataFrame:
    """Page duplicates: equal bytes are 'exact', codes within four bits 'perceptual'."""
    return settle(exact_links(samples, item, sha).select("a", "b", "reason", F.lit(0).cast("long").alias("at"))
                  .unionByName(near_links(samples, item, phash, **near)
                               .select("a", "b", "reason", F.lit(0).cast("long").alias("at"))))


def board_links(signatures: DataFrame, sample: str = "sample", sha: str = "sha", phash: str = "phash",
                **near: object) -> DataFrame:
    """Page pairs that share a board: signatures of current revisions, never within one page."""
    one = signatures.select(F.col(sample).alias("sample"), F.col(sha).alias("sha"),
                            F.col(phash).alias("phash")).distinct()
    exact = exact_links(one.select("sample", "sha").distinct(), "sample", "sha", "board-exact")
    close = near_links(one.select("sample", "phash").distinct(), "sample", "phash",
                       reason="board-perceptual", **near).where("a <> b")
    return exact.unionByName(close.select("a", "b", "reason"))


def settle(found: DataFrame) -> DataFrame:
    """One reason per pair (columns a, b, reason, at): a page-level 'exact' stands; else the
    latest board reason; else 'perceptual'.  Board ties at one time go to 'board-exact'."""
    rank = (F.when(F.col("reason") == "exact", 2).when(F.col("reason").startswith("board-"), 1).otherwise(0))
    tie = (F.col("reason") == "board-exact").cast("int")
    return found.groupBy("a", "b").agg(F.max_by("reason", F.struct(rank, F.col("at"), tie)).alias("reason"))


def active_pages(samples: DataFrame, sources: DataFrame, exclusions: DataFrame, *columns: str) -> DataFrame:
    """(id, source, split, columns): pages of sources that are not excluded."""
    return (samples.select("id", "source", *columns).join(exclusions.select("source"), "source", "left_anti")
            .join(sources.select(F.col("id").alias("source"), "split"), "source").select("id", "source", "split", *columns))


def beside(pairs: DataFrame, pages: DataFrame, *columns: str) -> DataFrame:
    """``pairs`` (a, b, ...) of which both sides are in ``pages``, with source, split and ``columns`` of each side."""
    # One id may be in very many pairs: a hot key on its side.
    pairs = keep(pairs)
    total = pairs.count()
    for side in ("a", "b"):
        found = pages.select(F.col("id").alias(side), *[F.col(c).alias(f"{c}_{side}") for c in ("source", "split", *columns)])
        counted = found.join(pairs.groupBy(side).agg(F.count(F.lit(1)).alias("_rows")), side)
        pairs = lookup(pairs, counted, side, "_rows", total=total).drop("_rows")
    return pairs


def known_pairs(pages: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Decided pairs (a, b, decision) of equal active pages; equal pages can't be 'distinct', such a decision is void."""
    asked = decisions.where("decision = 'duplicate' AND a <> b").select(
        F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), "decision").distinct()
    return beside(asked, pages, key).where(F.col(f"{key}_a") == F.col(f"{key}_b")).drop(f"{key}_a", f"{key}_b")


_SIDES = ["a", "b", "source_a", "split_a", "source_b", "split_b"]


def _across(heads: str) -> Column:
    """All pairs of an array of (split, id, source), the smaller id first: as many as pairs of splits."""
    return F.flatten(F.transform(heads, lambda x: F.transform(F.filter(heads, lambda y: y["id"] > x["id"]), lambda y: F.struct(
        x["id"].alias("a"), y["id"].alias("b"), x["source"].alias("source_a"), x["split"].alias("split_a"),
        y["source"].alias("source_b"), y["split"].alias("split_b")))))


def split_links(pages: DataFrame, key: str, decisions: DataFrame, reason: str = "exact", hot_rows: int | None = None) -> DataFrame:
    """(a, b, reason, decision, source_a, split_a, source_b, split_b): links between equal active pages.

    ``pages`` (id, source, split, ``key``) are active ones only, so an excluded page never
    stands for others.  Each split of a key has a head, its smallest id: members link to the
    head of their split and heads link across splits, so every pair of splits that shares a
    key has a link and links stay linear.  Decided pairs are added whether links or not.
    """
    pages = keep(pages.where(F.col(key).isNotNull()))
    per_split = pages.groupBy(key, "split").agg(F.min_by(F.struct("split", "id", "source"), "id").alias("h"), F.count(F.lit(1)).alias("n"))
    # At most one entry per split, so the list is bounded by the split domain.
    heads = keep(per_split.groupBy(key).agg(F.collect_list("h").alias("heads"), F.sum("n").alias("_rows")).where("_rows > 1"))
    own = F.filter("heads", lambda h: h["split"] == F.col("split"))[0]
    inside = (lookup(pages, heads, key, "_rows", hot_rows, pages.count()).withColumn("h", own).where("id <> h.id")
              .select(F.col("h.id").alias("a"), F.col("id").alias("b"), F.col("h.source").alias("source_a"), F.col("split").alias("split_a"),
                      F.col("source").alias("source_b"), F.col("split").alias("split_b")))
    across = heads.select(F.explode(_across("heads")).alias("p")).select("p.*")
    links = inside.select(*_SIDES).unionByName(across)
    known = keep(known_pairs(pages, key, decisions))
    decided = links.join(known.select("a", "b", "decision"), ["a", "b"], "left")
    others = known.join(links.select("a", "b"), ["a", "b"], "left_anti")
    return decided.unionByName(others).withColumn("reason", F.lit(reason))


def near_split_links(pages: DataFrame, code: str, k: int = NEAR_BITS, bits: int = 64, reason: str = "perceptual",
                     blocks: int | None = None, hot_bucket: int = 5000) -> DataFrame:
    """(a, b, distance, reason, source_a, split_a, source_b, split_b): links of active pages with equal or near codes.

    Near is not transitive, so a code keeps a head in every split: each pair of near codes
    links all heads of the one with all heads of the other, within and across splits.
    """
    nobody = pages.select(F.col("id").alias("a"), F.col("id").alias("b"), F.lit("duplicate").alias("decision")).limit(0)
    same = split_links(pages, code, nobody).select(*_SIDES).withColumn("distance", F.lit(0))
    heads = keep(pages.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("code"), "split").agg(
        F.min_by(F.struct("id", "source", "split"), "id").alias("h")))
    near = near_code_pairs(heads.select("code").distinct(), "code", k, bits, blocks, hot_bucket)
    both = (near.join(heads.select(F.col("code").alias("left"), F.col("h").alias("p")), "left")
            .join(heads.select(F.col("code").alias("right"), F.col("h").alias("q")), "right")
            .select(F.least("p", "q").alias("x"), F.greatest("p", "q").alias("y"), "distance"))
    far = both.select(F.col("x.id").alias("a"), F.col("y.id").alias("b"), F.col("x.source").alias("source_a"), F.col("x.split").alias("split_a"),
                      F.col("y.source").alias("source_b"), F.col("y.split").alias("split_b"), "distance")
    return same.unionByName(far).withColumn("reason", F.lit(reason))


def pair_status(pages: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """Unresolved pairs of equal active pages: candidates within a split, blockers across splits.

    All pairs are counted from group sizes, decided ones are taken off.
    """
    pages = keep(pages)
    same = F.col("split_a") == F.col("split_b")
    done = known_pairs(pages, key, decisions).agg(F.count_if(same).alias("_same"), F.count_if(~same).alias("_cross"))
    return exact_pair_counts(pages.where(F.col(key).isNotNull()), key, "split").crossJoin(F.broadcast(done)).select(
        (F.col("same_split_pairs") - F.col("_same")).cast("long").alias("same_split_candidates"),
        (F.col("cross_split_pairs") - F.col("_cross")).cast("long").alias("cross_split_blockers"))


def same_split_audit(sided: DataFrame, splits: list[str] | None = None) -> DataFrame:
    """Unresolved pairs inside one split; they are kept and reported."""
    rows = sided.where(F.col("decision").isNull() & (F.col("split_a") == F.col("split_b")))
    if splits:
        rows = rows.where(F.col("split_a").isin(splits))
    return rows.select("a", "b", "reason", F.col("split_a").alias("split"))


def blockers(sided: DataFrame) -> DataFrame:
    """Pairs across splits that stop an export: undecided or confirmed duplicates."""
    cross = sided.where(F.col("split_a") != F.col("split_b"))
    return cross.select("a", "b", "reason", "split_a", "split_b", F.when(
        F.col("decision").isNull(), "unresolved-duplicate").when(
        F.col("decision") == "duplicate", "cross-split-duplicate").alias("code")).where("code is not null")


def dropped_duplicates(sided: DataFrame) -> DataFrame:
    """The b side of every confirmed active pair."""
    return sided.where("decision = 'duplicate'").select(F.col("b").alias("id")).distinct()


def decide(pages: DataFrame, key: str, prior: DataFrame, decisions: DataFrame, reason: str = "exact") -> DataFrame:
    """Judge proposed decisions (a, b, decision) on pairs of equal active pages, links or not.

    ``outcome`` is 'recorded' or the code of the rule that was broken.
    """
    asked = keep(decisions.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("decision").alias("asked")))
    pages = keep(pages)
    equal = beside(asked.select("a", "b").where("a <> b").distinct(), pages, key).where(F.col(f"{key}_a") == F.col(f"{key}_b"))
    known = equal.select("a", "b", F.lit(reason).alias("reason"), "split_a", "split_b").join(
        known_pairs(pages, key, prior).select("a", "b", F.col("decision").alias("prior")), ["a", "b"], "left")
    joined = asked.join(known, ["a", "b"], "left")
    outcome = (F.when(~F.col("asked").isin("distinct", "duplicate"), "invalid-decision")
               .when(F.col("reason").isNull(), "unknown-or-inactive")
               .when(F.col("prior").isNotNull(), "already-resolved")
               .when(F.col("split_a") == F.col("split_b"), "same-split")
               .when(F.col("asked") == "distinct", "exact-not-distinct")
               .otherwise("recorded"))
    return joined.select("a", "b", "asked", "reason", outcome.alias("outcome"))


def changed_pages(new: DataFrame, old: DataFrame, *content: str) -> DataFrame:
    """(id) of pages whose ``content`` columns are not what they were, new pages included."""
    return new.select("id", *content).join(old.select("id", *content), ["id", *content], "left_anti").select("id").distinct()


def carry_decisions(new_pairs: DataFrame, old_pairs: DataFrame, changed: DataFrame) -> DataFrame:
    """Rebuilt pairs keep a decision where pair and reason are unchanged (G6).

    Board pairs are built from a page's boards, so those with a page in ``changed`` (id) start undecided.
    """
    kept = old_pairs.where("decision is not null").select("a", "b", "reason", "decision")
    board = kept.where(F.col("reason").startswith("board-"))
    for side in ("a", "b"):
        board = board.join(changed.select(F.col("id").alias(side)), side, "left_anti")
    kept = kept.where(~F.col("reason").startswith("board-")).unionByName(board)
    return new_pairs.join(kept, ["a", "b", "reason"], "left")


def cross_split_lineage(sources: DataFrame) -> DataFrame:
    """(source, split, kind, value): sources of a key whose members lie in several splits.

    ``sources`` has id, split, sha256 and lineage edges; keys are aggregated, members are
    never paired with each other.
    """
    edges = sources.select("id", "split", F.explode(F.concat(
        lineage_tokens(), F.array(F.struct(F.lit("sha256").alias("kind"), F.col("sha256").alias("value"))))).alias("e")
    ).select("id", "split", "e.kind", "e.value").distinct()
    keys = edges.groupBy("kind", "value").agg(
        F.count(F.lit(1)).alias("_rows"), F.collect_set("split").alias("splits")).where("size(splits) > 1")
    keys = keys.withColumn("key", F.concat_ws("\u001f", "kind", "value"))
    members = edges.withColumn("key", F.concat_ws("\u001f", "kind", "value")).select("id", "split", "key")
    return lookup(members, keys, "key", "_rows", total=members.count()).select(
        "id", "split", "kind", "value", F.array_join(F.array_sort("splits"), ",").alias("splits"))


def leaks(samples: DataFrame, sources: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Pages that leak across splits, by pair of splits and reason.

    'exact' counts pairs of equal pages, a lineage kind counts pairs of sources sharing a
    value; both from counts per (key, split), so no pair is built.
    """
    active = sources.join(exclusions.select(F.col("source").alias("id")), "id", "left_anti")
    pages = (samples.select("id", "source", "sha")
             .join(active.select(F.col("id").alias("source"), "split"), "source"))
    by_sha = pages.groupBy(F.lit("exact").alias("reason"), F.col("sha").alias("value"), "split").agg(
        F.count(F.lit(1)).alias("n"))
    by_token = (active.select("id", "split", F.explode(lineage_tokens()).alias("e"))
                .select("id", "split", F.col("e.kind").alias("reason"), "e.value").distinct()
                .groupBy("reason", "value", "split").agg(F.count(F.lit(1)).alias("n")))
    counts = by_sha.unionByName(by_token)
    # At most one entry per split and key, so this list is bounded by the split domain.
    spread = counts.groupBy("reason", "value").agg(
        F.array_sort(F.collect_list(F.struct("split", "n"))).alias("s")).where("size(s) > 1")
    both = spread.select("reason", F.explode(F.flatten(F.transform("s", lambda x: F.transform(
        F.filter(F.col("s"), lambda y: y["split"] > x["split"]), lambda y: F.struct(
            x["split"].alias("split_a"), y["split"].alias("split_b"), (x["n"] * y["n"]).alias("n")))))).alias("p"))
    return both.groupBy("p.split_a", "p.split_b", "reason").agg(F.sum("p.n").alias("pairs"))


def bits_per_key(blocks: int, k: int = NEAR_BITS, bits: int = 64) -> int:
    return math.floor(bits * (blocks - k) / blocks)
