"""Counting, deciding and blocking on near duplicates, which are not transitive.

A page holds one code, or one for each of its boards.  Pairs of pages are never listed: the
pages of a code are counted by split, and each pair of near codes stands for all pairs of
their holders.  A decision is about one pair of pages and clears that pair only, so decided
pairs are taken off the counts of their codes and splits.  With boards, what is counted are
pairs of boards of different pages, and a decision clears all board pairs of its two pages.

``pages`` are the active ones: (id, source, split, codes), codes an array<long>, no longer than a
page has boards.  Rows with a null split take no part; null codes are passed over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.scalar import hamming
from ..plans.session import keep
from .pairs import NEAR_BITS, beside, near_code_pairs

_GROUP = ["left", "right", "split_left", "split_right"]


def _items(pages: DataFrame) -> DataFrame:
    return pages.where("split IS NOT NULL").select("id", "split", F.explode("codes").alias("code")).where("code IS NOT NULL")


def _sided(x: Column, y: Column, split_x: Column, split_y: Column) -> list[Column]:
    """The smaller code first, with its split; of equal codes the smaller split first."""
    turned = (x > y) | ((x == y) & (split_x > split_y))
    return [F.least(x, y).alias("left"), F.greatest(x, y).alias("right"),
            F.when(turned, split_y).otherwise(split_x).alias("split_left"), F.when(turned, split_x).otherwise(split_y).alias("split_right")]


def code_relation(pages: DataFrame, k: int = NEAR_BITS, bits: int = 64, blocks: int | None = None) -> DataFrame:
    """(left, right, distance) of the codes that pages hold: near ones, and each with itself."""
    codes = keep(_items(pages).select("code").distinct())
    own = codes.select(F.col("code").alias("left"), F.col("code").alias("right"), F.lit(0).alias("distance"))
    return own.unionByName(near_code_pairs(codes, "code", k, bits, blocks))


def decided(pages: DataFrame, decisions: DataFrame, k: int = NEAR_BITS) -> DataFrame:
    """(a, b, decision, left, right, split_left, split_right): the near code pairs of decided pairs of active pages.

    A pair with several decisions counts as 'duplicate' if one says so; decisions on pages
    that are not near, or not there, are void.
    """
    asked = decisions.where("decision IN ('duplicate', 'distinct') AND a <> b").groupBy(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).agg(
        F.when(F.bool_or(F.col("decision") == "duplicate"), "duplicate").otherwise("distinct").alias("decision"))
    both = beside(asked, pages.where("split IS NOT NULL"), "codes")
    each = both.withColumn("x", F.explode("codes_a")).withColumn("y", F.explode("codes_b")).where(hamming(F.col("x"), F.col("y")) <= k)
    return each.select("a", "b", "decision", *_sided(F.col("x"), F.col("y"), F.col("split_a"), F.col("split_b")))


def gate(pages: DataFrame, decisions: DataFrame, k: int = NEAR_BITS, bits: int = 64, blocks: int | None = None, relation: DataFrame | None = None) -> DataFrame:
    """One row for each two near codes and splits of their holders, with the pairs between them.

    (left, right, distance, split_left, split_right, a, b, pairs, duplicates, distincts,
    unresolved): a and b are the smallest holders of either code in its split.  ``relation`` may
    come from a kept index; otherwise it is built.
    """
    items = keep(_items(pages))
    relation = keep(code_relation(pages, k, bits, blocks) if relation is None else relation)
    groups = keep(items.groupBy("code", "split").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("head")))

    def side(name: str) -> DataFrame:
        return groups.select(F.col("code").alias(name), F.col("split").alias(f"split_{name}"), F.col("n").alias(f"n_{name}"), F.col("head").alias(f"head_{name}"))

    met = relation.join(side("left"), "left").join(side("right"), "right").where("left < right OR split_left <= split_right")
    # Halving the even factor first keeps n(n-1)/2 within a long.
    inside = F.expr("if(n_left % 2 = 0, (n_left div 2) * (n_left - 1), n_left * ((n_left - 1) div 2))")
    alike = (F.col("left") == F.col("right")) & (F.col("split_left") == F.col("split_right"))
    met = met.withColumn("pairs", F.when(alike, inside).otherwise(F.col("n_left") * F.col("n_right")))
    # Board pairs of one page are no duplicates.
    boards = keep(items.groupBy("id", "split", "code").agg(F.count(F.lit(1)).alias("c")))
    several = boards.join(boards.groupBy("id").agg(F.sum("c").alias("_all")).where("_all > 1").select("id"), "id")
    x = several.select("id", "split", F.col("code").alias("left"), F.col("c").alias("c_left"))
    y = several.select("id", F.col("code").alias("right"), F.col("c").alias("c_right"))
    own = x.join(y, "id").where("left <= right").join(relation.select("left", "right"), ["left", "right"]).groupBy(
        "left", "right", F.col("split").alias("split_left"), F.col("split").alias("split_right")).agg(
        F.sum(F.expr("if(left = right, c_left * (c_left - 1) div 2, c_left * c_right)")).alias("within"))
    known = decided(pages, decisions, k).groupBy(*_GROUP).agg(
        F.count_if(F.col("decision") == "duplicate").alias("duplicates"), F.count_if(F.col("decision") == "distinct").alias("distincts"))
    rows = met.join(own, _GROUP, "left").join(known, _GROUP, "left")
    zero = F.lit(0).cast("long")
    pairs = F.col("pairs") - F.coalesce("within", zero)
    duplicates, distincts = F.coalesce("duplicates", zero), F.coalesce("distincts", zero)
    return rows.select(*_GROUP[:2], "distance", *_GROUP[2:], F.col("head_left").alias("a"), F.col("head_right").alias("b"), pairs.alias("pairs"),
                       duplicates.alias("duplicates"), distincts.alias("distincts"), (pairs - duplicates - distincts).alias("unresolved")).where("pairs > 0")


def status(gated: DataFrame) -> DataFrame:
    """Unresolved pairs within splits and across splits."""
    same = F.col("split_left") == F.col("split_right")
    return gated.agg(F.coalesce(F.sum(F.when(same, F.col("unresolved"))), F.lit(0)).alias("same_split_candidates"),
                     F.coalesce(F.sum(F.when(~same, F.col("unresolved"))), F.lit(0)).alias("cross_split_blockers"))


def near_blockers(gated: DataFrame) -> DataFrame:
    """Codes whose holders in different splits stop an export: undecided pairs, or confirmed duplicates."""
    cross = gated.where("split_left <> split_right AND (unresolved > 0 OR duplicates > 0)")
    return cross.select("left", "right", "split_left", "split_right", "a", "b", "unresolved", "duplicates",
                        F.when(F.col("unresolved") > 0, "unresolved-duplicate").otherwise("cross-split-duplicate").alias("code"))


def near_audit(gated: DataFrame) -> DataFrame:
    """Unresolved pairs inside one split; they are kept and reported."""
    return gated.where("split_left = split_right AND unresolved > 0").select("left", "right", F.col("split_left").alias("split"), "unresolved")


def near_dropped(pages: DataFrame, decisions: DataFrame, k: int = NEAR_BITS) -> DataFrame:
    """(id): the larger id of every confirmed pair that is near and active."""
    return decided(pages, decisions, k).where("decision = 'duplicate'").select(F.col("b").alias("id")).distinct()


def near_decide(pages: DataFrame, prior: DataFrame, proposals: DataFrame, k: int = NEAR_BITS) -> DataFrame:
    """(a, b, asked, outcome) of proposed decisions: 'recorded', or the rule that was broken.

    Near pages may well be 'distinct'; a pair within one split waits for nobody.
    """
    asked = keep(proposals.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b"), F.col("decision").alias("asked")))
    both = beside(asked.where("a <> b").select("a", "b").distinct(), pages.where("split IS NOT NULL"), "codes")
    near = both.where(F.exists("codes_a", lambda x: F.exists("codes_b", lambda y: hamming(x, y) <= k)))
    known = decided(pages, prior, k).select("a", "b", F.lit(True).alias("_decided")).distinct()
    joined = asked.join(near.select("a", "b", "split_a", "split_b"), ["a", "b"], "left").join(known, ["a", "b"], "left")
    outcome = (F.when(~F.col("asked").isin("distinct", "duplicate") | F.col("asked").isNull(), "invalid-decision")
               .when(F.col("split_a").isNull(), "unknown-or-inactive").when(F.col("_decided"), "already-resolved")
               .when(F.col("split_a") == F.col("split_b"), "same-split").otherwise("recorded"))
    return joined.select("a", "b", "asked", outcome.alias("outcome"))
