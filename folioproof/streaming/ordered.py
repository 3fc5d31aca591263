"""Review outcomes in event order, however the log arrives."""

from __future__ import annotations

from collections import namedtuple
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

from ..plans.session import shuffle_partitions
from .reviews import EMPTY, judge

_ROW = ["at_us", "id", "revision", "content", "reviewer", "human"]
_WAITING = [("at_us", pa.int64()), ("id", pa.int64()), ("revision", pa.int64()), ("content", pa.string()), ("reviewer", pa.string()), ("human", pa.bool_())]
_PAGE = [("revision", pa.int64()), ("content", pa.string()), ("accepted", pa.bool_()), ("reviewers", pa.list_(pa.string())), ("human_reviewers", pa.list_(pa.string()))]
_Waiting = namedtuple("_Waiting", _ROW)
_OUT = ["sample", "id", "outcome", "revision", "content", "accepted"]
#: Groups of pages that are kept together, unless a caller says how many.
BUCKETS = 1024


def _packed(table: pa.Table) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, table.schema) as writer:
        writer.write_table(table)
    return sink.getvalue().to_pybytes()


def _unpacked(held: bytes) -> pa.Table:
    return pa.ipc.open_stream(held).read_all()


class OrderedFold(StatefulProcessor):
    """The states of a bucket of pages, and their submissions that the watermark has not passed yet.

    Arriving rows only wait.  A timer at the earliest waiting time wakes the bucket when the
    watermark has passed it; then everything up to the watermark is judged by page, at and id, and
    a timer is set for what is left.  No earlier row can come any more, so the order is that
    of event time over all triggers.  A row at or before the watermark on arrival missed its
    turn: it is reported as 'late' and changes nothing.

    A call of the state or a timer costs far more than a row, so a bucket's rows of a trigger are
    one value, and so are its pages.
    """

    def __init__(self, sample: pa.DataType) -> None:
        self._waits, self._pages_as = (pa.schema([("sample", sample), *fields]) for fields in (_WAITING, _PAGE))

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._handle = handle
        self._pages = handle.getValueState("pages", "pages binary")
        self._waiting = handle.getListState("waiting", "held binary")
        self._woken = handle.getValueState("woken", "at_ms long")

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        passed = 1000 * timerValues.getCurrentWatermarkInMs()
        fresh, states = [], None
        for frame in rows:
            late = frame["at_us"] <= passed
            if late.any():
                states = self._states() if states is None else states
                missed = self._table(frame[late])
                found = [(s, i, states.get(s, EMPTY)) for s, i in zip(missed["sample"].to_pylist(), missed["id"].to_pylist())]
                yield _frame([(s, i, "late", x["revision"], x["content"], x["accepted"]) for s, i, x in found])
                frame = frame[~late]
            if len(frame):
                fresh.append(self._table(frame))
        if fresh:
            table = pa.concat_tables(fresh)
            self._waiting.appendValue((_packed(table),))
            self._wake(pc.min(table["at_us"]).as_py())

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        now = timerValues.getCurrentWatermarkInMs()
        # Of several timers that are due at once the first has done it all.
        if not self._woken.exists() or self._woken.get()[0] > now:
            return
        held = pa.concat_tables([_unpacked(bytes(r[0])) for r in self._waiting.get()])
        due = pc.fill_null(pc.less_equal(held["at_us"], pa.scalar(1000 * now, pa.int64())), False)
        rest, due = held.filter(pc.invert(due)), held.filter(due)
        states, out = self._states(), []
        due = due.sort_by([(c, "ascending") for c in ("sample", "at_us", "id")])
        for part in due.to_batches(max_chunksize=10_000):
            columns = [c.to_pylist() for c in part.columns]
            for s, row in zip(columns[0], map(_Waiting, *columns[1:])):
                state, outcome = judge(states.get(s, EMPTY), row)
                states[s] = state
                out.append((s, row.id, outcome, state["revision"], state["content"], state["accepted"]))
            yield _frame(out)
            out = []
        values = [[*states], *([x[name] for x in states.values()] for name, _ in _PAGE)]
        self._pages.update((_packed(pa.table([pa.array(v, f.type) for v, f in zip(values, self._pages_as)], schema=self._pages_as)),))
        self._woken.clear()
        if len(rest):
            self._waiting.put([(_packed(rest),)])
            self._wake(pc.min(rest["at_us"]).as_py())
        else:
            self._waiting.clear()

    def _table(self, frame: pd.DataFrame) -> pa.Table:
        return pa.Table.from_pandas(frame, self._waits, preserve_index=False)

    def _states(self) -> dict:
        """The state of each page by its sample."""
        if not self._pages.exists():
            return {}
        columns = [c.to_pylist() for c in _unpacked(bytes(self._pages.get()[0])).columns]
        return {s: dict(zip(EMPTY, row)) for s, *row in zip(*columns)}

    def _wake(self, at_us: int | None) -> None:
        if at_us is None:
            return
        at_ms = -(-at_us // 1000)
        if not self._woken.exists() or at_ms < self._woken.get()[0]:
            self._handle.registerTimer(at_ms)
            self._woken.update((at_ms,))

    def close(self) -> None:
        pass


def _frame(rows: list[tuple]) -> pd.DataFrame:
    # Whole numbers beside nulls stay whole.
    return pd.DataFrame(rows, columns=_OUT, dtype=object)


def ordered_fold(submissions: DataFrame, delay: str = "1 hour", buckets: int = BUCKETS) -> DataFrame:
    """Outcome of every submission (sample, revision, content, reviewer, human, at, id) in the order of (at, id) per page.

    ``delay`` is how far behind the newest row a row may arrive.  State is a small entry per page
    and the rows of the last ``delay``.  Pages are dealt to ``buckets``, whose number must not change
    while a stream goes on; one bucket's pages and rows are in memory at a time, and what waits in
    a bucket is written again when some of it is due.  The last rows of a log come out once the
    watermark passes them: send a row ``delay`` later.
    """
    kind = submissions.schema["sample"].dataType
    t = kind.simpleString()
    # Rows without a page are a page of their own bucket.
    bucket = F.when(F.col("sample").isNotNull(), F.pmod(F.xxhash64("sample"), F.lit(buckets))).otherwise(F.lit(buckets))
    # The watermark column itself goes no further: Spark would drop late rows unseen.
    rows = submissions.withWatermark("at", delay).select(
        "sample", (F.unix_micros("at") + F.lit(0)).alias("at_us"), *_ROW[1:], bucket.alias("bucket"))
    return rows.groupBy("bucket").transformWithStateInPandas(
        OrderedFold(to_arrow_type(kind)), f"sample {t}, id long, outcome string, revision long, content string, accepted boolean", outputMode="Append", timeMode="EventTime")


def batch_fold(submissions: DataFrame) -> DataFrame:
    """The same outcomes over a table: rows sorted by page, time and id stream past one page's state.

    An outcome depends on all before it, so a page is read by one task, in constant memory.
    """
    t = submissions.schema["sample"].dataType.simpleString()
    rows = submissions.select("sample", F.unix_micros("at").alias("at_us"), *_ROW[1:])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, state, begun = None, dict(EMPTY), False
        for batch in batches:
            frame, out = batch.to_pandas(), []
            for row in frame.itertuples(index=False):
                if not begun or row.sample != now:
                    now, state, begun = row.sample, dict(EMPTY), True
                state, outcome = judge(state, row)
                out.append((row.sample, row.id, outcome, state["revision"], state["content"], state["accepted"]))
            yield pa.RecordBatch.from_arrays([batch.column("sample"), *(pa.array([o[i] for o in out], kind) for i, kind in (
                (1, pa.int64()), (2, pa.string()), (3, pa.int64()), (4, pa.string()), (5, pa.bool_())))], names=_OUT)

    return (rows.repartition(shuffle_partitions(rows), "sample").sortWithinPartitions("sample", "at_us", "id")
            .mapInArrow(run, f"sample {t}, id long, outcome string, revision long, content string, accepted boolean"))
