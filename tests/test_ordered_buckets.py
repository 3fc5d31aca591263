"""Ordered review streams whose pages are kept by buckets."""

import random
from types import SimpleNamespace

import pandas as pd
import pyarrow as pa

from folioproof.plans import streams
from folioproof.streaming.ordered import OrderedFold, batch_fold, ordered_fold
from folioproof.streaming.reviews import EMPTY, judge

from .test_streams import in_triggers, log


class Held:
    """A value or list state, and a store of timers, that count their calls."""

    def __init__(self):
        self.values, self.timers, self.calls = {}, set(), 0

    def getValueState(self, name, schema):
        return self._state(name)

    getListState = getValueState

    def registerTimer(self, at):
        self.calls += 1
        self.timers.add(at)

    def _state(self, name):
        def counted(fn):
            def call(*args):
                self.calls += 1
                return fn(*args)
            return call

        held, put = self.values, lambda v: self.values.__setitem__(name, v)
        return SimpleNamespace(**{n: counted(f) for n, f in {
            "exists": lambda: name in held, "get": lambda: held[name], "update": put, "put": put, "clear": lambda: held.pop(name, None),
            "appendValue": lambda v: held.setdefault(name, []).append(v)}.items()})


def test_calls_of_the_state_follow_triggers_not_pages():
    rng = random.Random(6)
    rows = [(rng.randrange(400), 1000 * m, m, rng.randrange(2), rng.choice(["a", "b", None]), f"w{rng.randrange(3)}", rng.random() < 0.6) for m in range(4000)]
    names = ["sample", "at_us", "id", "revision", "content", "reviewer", "human"]
    handle, fold, got = Held(), OrderedFold(pa.int64()), {}
    fold.init(handle)

    def keep(frames):
        for frame in frames:
            got.update({r.id: (r.sample, r.outcome, r.revision, r.content, bool(r.accepted)) for r in frame.itertuples(index=False)})

    for step in range(4):
        part = rows[step * 1000:][:1000]
        rng.shuffle(part)
        # Rows come in several frames of a trigger; the watermark is behind the last trigger's first half.
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: step * 1000 - 500)
        keep(fold.handleInputRows((0,), iter([pd.DataFrame(part[i:i + 300], columns=names) for i in range(0, 1000, 300)]), now))
        for at in sorted(t for t in handle.timers if t <= now.getCurrentWatermarkInMs()):
            handle.timers.discard(at)
            keep(fold.handleExpiredTimer((0,), now, None))
    now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 3500)
    keep(fold.handleInputRows((0,), iter([pd.DataFrame([rows[7]], columns=names)]), now))
    assert got.pop(7)[1] == "late"
    while due := [t for t in handle.timers if t <= 10_000]:
        now = SimpleNamespace(getCurrentWatermarkInMs=lambda: 10_000)
        handle.timers.discard(due[0])
        keep(fold.handleExpiredTimer((0,), now, None))
    states, want = {}, {}
    for s, _, i, revision, content, reviewer, human in rows:
        states[s], outcome = judge(states.get(s, EMPTY), SimpleNamespace(revision=revision, content=content, reviewer=reviewer, human=human))
        want[i] = s, outcome, states[s]["revision"], states[s]["content"], states[s]["accepted"]
    want.pop(7)
    assert got == want and len(states) > 300
    assert handle.calls < 80


def test_buckets_of_several_pages_give_the_same_outcomes(spark):
    rng = random.Random(7)
    # Ids of pages that a float does not hold.
    rows = [(2 ** 60 + rng.randrange(12), rng.randrange(3), rng.choice(["a", "b", None]), f"w{rng.randrange(3)}", rng.random() < 0.6, m, m) for m in range(200)]
    # Rows without a page are one page.
    lone = [(None, 0, "a", "w", True, 300, 300), (None, 1, "b", "w", True, 301, 301)]
    near = sorted(rows + lone, key=lambda r: r[5] + rng.randrange(30))
    parts = [near[i:i + 50] for i in range(0, 250, 50)]
    closing = [(99, 0, "", "", True, 10_000, 10_000)]
    out = streams.drained(ordered_fold(in_triggers(spark, [*parts, closing]), "2 hours", buckets=3), "folded").where("sample > 99 OR sample IS NULL").collect()
    assert [(r.outcome, r.revision) for r in sorted(out, key=lambda r: r.id) if r["sample"] is None] == [("correction", 1), ("correction", 2)]
    assert sorted(str(r) for r in out if r["sample"] is not None) == sorted(map(str, batch_fold(log(spark, rows)).collect()))
