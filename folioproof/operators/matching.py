"""Greedy one-to-one matching as rounds of aggregations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.session import keep


def claim_in_rounds(pairs: DataFrame, group: list[str], strength: Column) -> DataFrame:
    """Greedy matching of pairs (p, t) in descending ``strength``, which must be a total order
    of the pairs of a group.

    A pair that is the strongest of both its sides is what the greedy scan would take, so
    all such pairs are taken at once, their sides leave, and the rest goes to the next
    round.  No group is gathered in one task.
    """
    live = keep(pairs.select(*group, "p", "t", strength.alias("s")))
    taken = None
    while not live.isEmpty():
        by_p = live.groupBy(*group, "p").agg(F.max_by("t", "s").alias("t"))
        by_t = live.groupBy(*group, "t").agg(F.max_by("p", "s").alias("p"))
        now = keep(by_p.join(by_t, [*group, "p", "t"]).select(*group, "p", "t"))
        taken = now if taken is None else taken.unionByName(now)
        live = keep(live.join(now.select(*group, "p"), [*group, "p"], "left_anti")
                    .join(now.select(*group, "t"), [*group, "t"], "left_anti"))
    return pairs.select(*group, "p", "t").limit(0) if taken is None else taken


def dictate_in_rounds(pairs: DataFrame, group: list[str], turn: Column, liking: Column) -> DataFrame:
    """Sides p take turns (smallest ``turn`` first) and each takes its free t of largest ``liking``.

    A p that comes first among all who could still take its favourite t can take it now;
    that is safe because nobody earlier could want it.  Gives the same result as one
    sequential pass.
    """
    live = keep(pairs.select(*group, "p", "t", turn.alias("turn"), liking.alias("liking")))
    taken = None
    while not live.isEmpty():
        wish = live.groupBy(*group, "p").agg(F.max_by("t", "liking").alias("t"))
        first = live.groupBy(*group, "t").agg(F.min_by("p", "turn").alias("p"))
        now = keep(wish.join(first, [*group, "p", "t"]).select(*group, "p", "t"))
        taken = now if taken is None else taken.unionByName(now)
        live = keep(live.join(now.select(*group, "p"), [*group, "p"], "left_anti")
                    .join(now.select(*group, "t"), [*group, "t"], "left_anti"))
    return pairs.select(*group, "p", "t").limit(0) if taken is None else taken


def suppress_in_rounds(nodes: DataFrame, edges: DataFrame, key: list[str]) -> DataFrame:
    """Greedy suppression: ``edges`` (key, hi, lo) say that hi, if kept, removes lo, and hi
    always comes before lo.  Returns the kept (key, id) of ``nodes``."""
    waiting = keep(nodes.select(*key, "id"))
    links = keep(edges.select(*key, "hi", "lo"))
    kept = None
    while not waiting.isEmpty():
        blocked = links.select(*key, F.col("lo").alias("id")).distinct()
        now = keep(waiting.join(blocked, [*key, "id"], "left_anti"))
        kept = now if kept is None else kept.unionByName(now)
        gone = links.join(now.withColumnRenamed("id", "hi"), [*key, "hi"], "left_semi").select(
            *key, F.col("lo").alias("id")).distinct()
        waiting = keep(waiting.join(now, [*key, "id"], "left_anti").join(gone, [*key, "id"], "left_anti"))
        links = keep(links.join(waiting.withColumnRenamed("id", "hi"), [*key, "hi"], "left_semi")
                     .join(waiting.withColumnRenamed("id", "lo"), [*key, "lo"], "left_semi"))
    return nodes.select(*key, "id").limit(0) if kept is None else kept
