"""Joins of a large table with a per-key lookup where single keys may be huge."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

# Keys holding more rows than this are joined by broadcast, so their rows never
# meet in one task.  At most rows/HOT_ROWS keys can be hot, which bounds the
# broadcast: 10^12 rows have at most 10^6 hot keys.
HOT_ROWS = 1_000_000


def lookup(left: DataFrame, table: DataFrame, on: str, rows: str,
           hot_rows: int | None = None, total: int | None = None) -> DataFrame:
    """Inner join of ``left`` with ``table`` (one row per ``on``).

    ``rows`` is the column of ``table`` that tells how many rows of ``left`` carry
    the key.  Rows of hot keys stay where they are and meet a broadcast of the hot
    entries; all others go through an ordinary shuffled join.  When ``total``, the rows
    of ``left``, is itself within the limit no key can be hot and the join is plain.
    """
    limit = HOT_ROWS if hot_rows is None else hot_rows
    if total is not None and total <= limit:
        return left.join(table, on)
    hot = table.where(F.col(rows) > limit)
    cold = table.where(F.col(rows) <= limit)
    few = F.broadcast(hot.select(on))
    return (left.join(F.broadcast(hot), on)
            .unionByName(left.join(few, on, "left_anti").join(cold, on)))
