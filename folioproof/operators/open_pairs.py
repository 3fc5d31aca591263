"""Pages that take part in an open pair across splits: equal or near, both active, undecided.

Pairs are counted from the sizes of groups, never listed, so a code that a third of the pages
hold costs one row per split.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..plans.session import keep
from ..plans.skew import lookup
from .near_gate import _items, code_relation, decided
from .pairs import NEAR_BITS, known_pairs


def open_pages(items: DataFrame, relation: DataFrame, known: DataFrame) -> DataFrame:
    """(id, split, open_pairs) of pages with at least one open pair in another split.

    ``items`` (id, split, code) are active, a page may hold several codes; ``relation`` (left,
    right) has each two alike codes once, and each code with itself; ``known`` (a, b, split_a,
    split_b) has a row for each decided pair of codes of two pages.
    """
    items = keep(items.where("split IS NOT NULL AND code IS NOT NULL"))
    held = keep(items.groupBy("code", "split").agg(F.count(F.lit(1)).alias("n")))
    both = relation.select("left", "right").unionByName(
        relation.where("left <> right").select(F.col("right").alias("left"), F.col("left").alias("right")))
    seen = (both.join(held.select(F.col("code").alias("right"), "split", "n"), "right")
            .groupBy(F.col("left").alias("code"), "split").agg(F.sum("n").alias("n"))
            # One entry per split.
            .groupBy("code").agg(F.sum("n").alias("_all"), F.map_from_entries(F.collect_list(F.struct("split", "n"))).alias("_in"))
            .where("size(_in) > 1").join(held.groupBy("code").agg(F.sum("n").alias("_rows")), "code"))
    met = lookup(items, seen, "code", "_rows", total=items.count()).withColumn("_c", F.col("_all") - F.element_at("_in", F.col("split")))
    counts = met.groupBy("id", "split").agg(F.sum("_c").alias("_c"))
    cross = known.where("split_a <> split_b").select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("_d"))
    left = F.col("_c") - F.coalesce("_d", F.lit(0))
    return counts.join(cross, "id", "left").select("id", "split", left.cast("long").alias("open_pairs")).where("open_pairs > 0")


def open_equal_pages(pages: DataFrame, key: str, decisions: DataFrame) -> DataFrame:
    """:func:`open_pages` for equal pages (id, source, split, ``key``); only 'duplicate' can settle an equal pair."""
    items = keep(pages.select("id", "split", F.col(key).alias("code")))
    same = items.where("code IS NOT NULL").select(F.col("code").alias("left"), F.col("code").alias("right")).distinct()
    return open_pages(items, same, known_pairs(pages, key, decisions))


def open_near_pages(pages: DataFrame, decisions: DataFrame, k: int = NEAR_BITS, bits: int = 64,
                    blocks: int | None = None, relation: DataFrame | None = None) -> DataFrame:
    """:func:`open_pages` for near codes; ``pages`` (id, source, split, codes) as ``near_gate.gate`` takes them."""
    relation = keep(code_relation(pages, k, bits, blocks) if relation is None else relation)
    known = decided(pages, decisions, k).select("a", "b", F.col("split_left").alias("split_a"), F.col("split_right").alias("split_b"))
    return open_pages(_items(pages), relation, known)
