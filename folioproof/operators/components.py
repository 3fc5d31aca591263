"""Connected components and what follows from them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Row, functions as F

from ..plans.session import keep
from ..plans.skew import lookup


def lineage_tokens() -> Column:
    """All lineage tokens of a source as array<struct<kind, value>>."""
    def of(kind: str) -> Column:
        return F.transform(F.coalesce(F.col("lineage")[kind], F.array().cast("array<string>")),
                           lambda v: F.struct(F.lit(kind).alias("kind"), v.alias("value")))

    return F.concat(*[of(k) for k in ("document", "edition", "artwork", "parent")])


def lineage_edges(sources: DataFrame) -> DataFrame:
    """(item, key): one row per lineage token of a source."""
    return sources.select(F.col("id").alias("item"), F.explode(lineage_tokens()).alias("e")).select(
        "item", F.concat_ws("=", "e.kind", "e.value").alias("key")).distinct()


def _to_smallest(edges: DataFrame, met: DataFrame, hot_rows: int | None, total: int) -> DataFrame:
    """(u, v, m) with the smallest v that ``met`` has for u beside each edge; hot u stay spread out."""
    best = met.groupBy("u").agg(F.min("v").alias("m"), F.count(F.lit(1)).alias("_rows"))
    return lookup(edges, best, "u", "_rows", hot_rows, total)


def _each(rows: DataFrame, *pairs: tuple[str, str]) -> DataFrame:
    """(u, v) of each pair of columns of a row; one pass, where a union would read the rows once a pair."""
    return rows.select(F.inline(F.array(*[F.struct(F.col(u).alias("u"), F.col(v).alias("v")) for u, v in pairs])))


def components(members: DataFrame, item: str = "item", key: str = "key",
               hot_rows: int | None = None) -> DataFrame:
    """(item, component): items sharing a key, transitively; the label is the smallest item.

    A key with n items becomes n-1 edges to its smallest item.  Then edges are rewired to
    ever smaller neighbours, alternately over larger and over smaller neighbours, until
    nothing changes: O(log n) rounds in practice, linear edges, and every step is an
    aggregation with map-side combine plus a skew-safe lookup.  Each round is
    checkpointed, so a lost executor costs one round at most.
    """
    pairs = keep(members.select(F.col(item).alias("u"), F.col(key).alias("k")))
    heads = pairs.groupBy("k").agg(F.min("u").alias("v"), F.count(F.lit(1)).alias("_rows"))
    total = pairs.count()
    found = linked_components(lookup(pairs, heads, "k", "_rows", hot_rows, total).select("u", "v"), hot_rows)
    return pairs.select("u").distinct().join(found, "u", "left").select(
        F.col("u").alias(item), F.coalesce("v", "u").alias("component"))


def _mark(edges: DataFrame) -> Row:
    return edges.agg(F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()


def linked_components(links: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(u, v): the smallest item ``v`` of the component of each item ``u`` that is not that itself.

    ``links`` are undirected pairs (u, v); pairs of an item with itself mean nothing.  Links that
    already point each item to its component's smallest one take a single round.
    """
    edges = keep(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct())
    mark = _mark(edges)
    # An edge is rewired, never multiplied: rows of a round stay below twice those of the first.
    total = 2 * mark["n"]
    while True:
        # Over larger neighbours: an edge read from its smaller end is one; over smaller: its end and what it met.
        upward = edges.select(F.col("v").alias("u"), F.col("u").alias("v"))
        large = _to_smallest(upward, _each(edges, ("u", "v"), ("v", "u")), hot_rows, total)
        downward = large.select(F.col("v").alias("u"), F.least("u", "m").alias("v"))
        small = _to_smallest(downward, downward, hot_rows, total)
        edges = keep(_each(small, ("v", "m"), ("u", "m")).where("u <> v").distinct())
        now = _mark(edges)
        if now == mark:
            return edges
        mark = now


def grown(labels: DataFrame, members: DataFrame, added: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(item, component) after ``added`` rows (item, key), given the labels and rows (item, key) before.

    Old components are nodes now: a new row ties the node of its item to the node that holds its
    key, or to the least new node with that key.  Only this graph, as large as the change, runs
    through rounds; then components that met get their common label.  Equal to a full run.
    """
    added = keep(added.select("item", "key").distinct())
    new_items = added.select("item").distinct()
    nodes = keep(new_items.join(labels, "item", "left").select("item", F.coalesce("component", "item").alias("node")))
    rows = keep(added.join(nodes, "item").select("node", "key").distinct())
    # A key lies in one component, so any old row of it tells which.
    wanted = rows.groupBy("key").agg(F.min("node").alias("least"), F.count(F.lit(1)).alias("_rows"))
    held = (members.select("item", "key").join(wanted.select("key"), "key", "left_semi").groupBy("key").agg(F.min("item").alias("item"))
            .join(labels, "item").select("key", F.col("component").alias("holder")))
    heads = wanted.join(held, "key", "left").select("key", "_rows", F.coalesce("holder", "least").alias("head"))
    ties = lookup(rows, heads, "key", "_rows", hot_rows, rows.count()).select(F.col("node").alias("u"), F.col("head").alias("v"))
    moved = keep(linked_components(ties, hot_rows))
    every = keep(labels.select("item", "component").unionByName(
        nodes.join(labels, "item", "left_anti").select("item", F.col("node").alias("component"))))
    named = _sizes(every).join(moved.select(F.col("u").alias("component"), F.col("v").alias("_new")), "component", "left")
    return lookup(every, named, "component", "_rows", hot_rows, every.count()).select("item", F.coalesce("_new", "component").alias("component"))


def _sizes(labels: DataFrame) -> DataFrame:
    """(component, _rows): a component can hold most items, so what is to be known of it goes through ``lookup``."""
    return labels.groupBy("component").agg(F.count(F.lit(1)).alias("_rows"))


def shrunk(labels: DataFrame, members: DataFrame, removed: DataFrame, hot_rows: int | None = None) -> DataFrame:
    """(item, component) after the items of ``removed`` are gone: only components that lose an item are worked out again."""
    gone = keep(removed.select("item").distinct())
    hit = keep(labels.join(gone, "item", "left_semi").select("component").distinct())
    told = _sizes(labels).join(hit.withColumn("_hit", F.lit(True)), "component", "left")
    rows = keep(lookup(labels, told, "component", "_rows", hot_rows))
    inside = rows.where("_hit").select("item").join(gone, "item", "left_anti")
    again = components(members.select("item", "key").join(inside, "item", "left_semi"), hot_rows=hot_rows)
    return rows.where("_hit IS NULL").select("item", "component").unionByName(again)


def exclusion_closure(sources: DataFrame, seeds: DataFrame) -> DataFrame:
    """Sources to exclude: every source in the lineage component of a seed (id, reason)."""
    found = components(lineage_edges(sources))
    hit = found.join(seeds.select(F.col("id").alias("item"), "reason"), "item").groupBy("component").agg(
        F.min("reason").alias("reason"))
    return found.join(hit, "component").select(F.col("item").alias("source"), "reason")


def components_per_split(sources: DataFrame, split: str = "split") -> DataFrame:
    """Declared independent components of each split: sources joined only inside it."""
    inside = lineage_edges(sources).join(
        sources.select(F.col("id").alias("item"), split), "item").select(
        F.concat_ws("\u001f", split, "item").alias("item"), F.concat_ws("\u001f", split, "key").alias("key"))
    found = components(inside)
    return found.groupBy(F.element_at(F.split("component", "\u001f"), 1).alias(split)).agg(
        F.count_distinct("component").alias("components"))
