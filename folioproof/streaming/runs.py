"""Liveness of workers and acceptance of late results as streams."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..operators.reviews import current_results


class Liveness(StatefulProcessor):
    """Last heartbeat per worker; a timer reports a worker that falls silent."""

    def __init__(self, quiet_ms: int) -> None:
        self._quiet = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._last = handle.getValueState("last", "ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        newest = max(int(pdf["at_ms"].max()) for pdf in rows)
        # A worker has one timer at most, and its time follows from the state: every call less is a round trip less.
        held = self._last.get()
        if held is not None:
            newest = max(newest, int(held[0]))
            self._handle.deleteTimer(int(held[0]) + self._quiet)
        self._last.update((newest,))
        self._handle.registerTimer(newest + self._quiet)
        yield pd.DataFrame({"worker": [key[0]], "last_ms": [newest], "stale": [False]})

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        yield pd.DataFrame({"worker": [key[0]], "last_ms": [int(self._last.get()[0])], "stale": [True]})

    def close(self) -> None:
        pass


def liveness(heartbeats: DataFrame, seconds: int = 100, delay: str = "1 minute") -> DataFrame:
    """(worker, last_ms, stale) on every change; ``heartbeats`` has worker and at.

    Event-time timers: the watermark, not the wall clock, decides that a worker is silent,
    so a replay gives the same answer.
    """
    t = heartbeats.schema["worker"].dataType.simpleString()
    rows = heartbeats.withWatermark("at", delay).withColumn("at_ms", F.unix_millis("at"))
    return rows.groupBy("worker").transformWithStateInPandas(
        Liveness(seconds * 1000), f"worker {t}, last_ms long, stale boolean", outputMode="Append", timeMode="EventTime")


def judged_results(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Stream-static join: each arriving result is 'current' or 'stale' against the pages now."""
    return current_results(results, samples)
