"""Exact running values over a total order, without one task per key.

A window over a key sends all rows of the key to one task.  Here the rows are range
partitioned by (key, order) instead, so a key of any size is cut into chunks; values
are computed per chunk, and each chunk gets the totals of the chunks before it.  A
chunk boundary can fall inside at most one key, so the carried totals have at most
one row per chunk and are safe to broadcast.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame, Window, functions as F

from .session import keep, shuffle_partitions

_BITS = 33  # row bits of monotonically_increasing_id


def ordered(df: DataFrame, by: Sequence[Column], parts: int | None = None) -> DataFrame:
    """Sort globally and tag each row with ``_slot`` (chunk in the high bits).

    The result is checkpointed: range bounds come from a sample, so they must not be
    drawn twice.
    """
    parts = parts or shuffle_partitions(df)
    return keep(df.repartitionByRange(parts, *by).sortWithinPartitions(*by)
                .withColumn("_slot", F.monotonically_increasing_id()))


def numbered(df: DataFrame, by: Sequence[Column], name: str, parts: int | None = None) -> DataFrame:
    """Global 1-based row number: one range shuffle and a chunk table, no window."""
    rows = ordered(df, by, parts).withColumn("_chunk", F.shiftright("_slot", _BITS))
    before = Window.orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("_chunk").count().select(
        "_chunk", F.coalesce(F.sum("count").over(before), F.lit(0)).alias("_start"))
    inside = F.col("_slot").bitwiseAND(F.lit((1 << _BITS) - 1))
    return (rows.join(F.broadcast(starts), "_chunk")
            .withColumn(name, F.col("_start") + inside + 1)
            .drop("_chunk", "_slot", "_start"))


def scan(rows: DataFrame, key: Sequence[str], *, number: str | None = None,
         sums: Mapping[str, Column] | None = None, previous: Mapping[str, Column] | None = None) -> DataFrame:
    """Running values over rows that :func:`ordered` has tagged by (key, order)."""
    sums, previous = dict(sums or {}), dict(previous or {})
    columns = rows.columns
    rows = rows.select("*", F.shiftright("_slot", _BITS).alias("_chunk"),
                       *[c.alias(f"_s_{n}") for n, c in sums.items()],
                       F.struct(F.lit(0).alias("_"), *[c.alias(n) for n, c in previous.items()]).alias("_p"))
    totals = rows.groupBy("_chunk", *key).agg(
        F.count(F.lit(1)).alias("_n"), F.max_by("_p", "_slot").alias("_last"),
        *[F.sum(f"_s_{n}").alias(f"_t_{n}") for n in sums])
    before = Window.partitionBy(*key).orderBy("_chunk").rowsBetween(Window.unboundedPreceding, -1)
    carried = totals.select(
        F.col("_chunk").alias("_c"), *[F.col(k).alias(f"_k_{k}") for k in key],
        F.sum("_n").over(before).alias("_n0"), F.last("_last").over(before).alias("_p0"),
        *[F.sum(f"_t_{n}").over(before).alias(f"_t0_{n}") for n in sums]).where("_n0 is not null")
    same = F.col("_chunk") == F.col("_c")
    for k in key:
        same = same & F.col(k).eqNullSafe(F.col(f"_k_{k}"))
    out = rows.join(F.broadcast(carried), same, "left")
    here = Window.partitionBy("_chunk", *key).orderBy("_slot")
    upto = here.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    if number:
        out = out.withColumn(number, F.row_number().over(here) + F.coalesce("_n0", F.lit(0)))
    for n in sums:
        out = out.withColumn(n, F.coalesce(F.sum(f"_s_{n}").over(upto), F.lit(0))
                             + F.coalesce(f"_t0_{n}", F.lit(0)))
    if previous:
        out = out.withColumn("_q", F.when(F.row_number().over(here) == 1, F.col("_p0"))
                             .otherwise(F.lag("_p").over(here)))
        for n in previous:
            out = out.withColumn(n, F.col(f"_q.{n}"))
    return out.select(*columns, *([number] if number else []), *sums, *previous)


def running(df: DataFrame, key: Sequence[str], order: Sequence[Column], *,
            number: str | None = None, sums: Mapping[str, Column] | None = None,
            previous: Mapping[str, Column] | None = None, parts: int | None = None) -> DataFrame:
    """Add a row number, inclusive running sums and previous-row values per key."""
    rows = ordered(df, [*[F.col(k) for k in key], *order], parts)
    return scan(rows, key, number=number, sums=sums, previous=previous).drop("_slot")


def medians(df: DataFrame, key: Sequence[str], value: str, name: str) -> DataFrame:
    """Exact median per key by position, so no group is held in memory."""
    sizes = df.where(F.col(value).isNotNull()).groupBy(*key).agg(F.count(value).alias("_m"))
    ranked = running(df.where(F.col(value).isNotNull()).select(*key, value), key,
                     [F.col(value)], number="_r")
    # Both middle positions of a key are found from its size alone.
    middle = sizes.select(*key, F.explode(F.array_distinct(F.array(
        F.expr("(_m + 1) div 2"), F.expr("_m div 2 + 1")))).alias("_r"))
    return ranked.join(middle, [*key, "_r"], "left_semi").groupBy(*key).agg(F.avg(value).alias(name))
