"""The review log as a stream."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

STATE = "revision long, content string, accepted boolean, reviewers array<string>, human_reviewers array<string>"
OUT = ("sample {t}, id long, outcome string, revision long, content string, accepted boolean")


def judge(state: dict, submission: object) -> tuple[dict, str]:
    """One submission against one page: the new state and the outcome.

    A retry of the reviewer's last accepted answer is a no-op; a submission for an older
    revision is stale; a non-human never overwrites an accepted human answer; nobody
    confirms their own answer; one human review accepts.
    """
    who, human, content = submission.reviewer, bool(submission.human), submission.content
    again = content == state["content"] and who in (state["human_reviewers"] if human else
                                                    [r for r in state["reviewers"] if r not in state["human_reviewers"]])
    if again and submission.revision in (state["revision"], state["revision"] - 1):
        return {**state, "accepted": state["accepted"] or human}, "idempotent"
    if submission.revision != state["revision"]:
        return state, "stale"
    changed = content != state["content"]
    if changed and state["accepted"] and not human:
        return state, "nonhuman-overwrite"
    if not changed and who in state["reviewers"]:
        return state, "own-confirmation"
    known = [] if changed else state["reviewers"]
    humans = [] if changed else state["human_reviewers"]
    return {"revision": state["revision"] + int(changed), "content": content,
            "accepted": human or bool(humans), "reviewers": [*known, who],
            "human_reviewers": [*humans, who] if human else humans}, "correction" if changed else "confirmation"


EMPTY = {"revision": 0, "content": None, "accepted": False, "reviewers": [], "human_reviewers": []}


class ReviewFold(StatefulProcessor):
    """One state row per page: revision, content, acceptance, reviewers of the revision."""

    def init(self, handle: StatefulProcessorHandle) -> None:
        self._page = handle.getValueState("page", STATE)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        held = self._page.get() if self._page.exists() else None
        state = dict(EMPTY) if held is None else {
            "revision": held[0], "content": held[1], "accepted": held[2], "reviewers": list(held[3] or []),
            "human_reviewers": list(held[4] or [])}
        # The rows of one page in one trigger; the source's rate limit bounds them.
        out = []
        for row in pd.concat(list(rows)).sort_values(["at", "id"]).itertuples(index=False):
            state, outcome = judge(state, row)
            out.append((key[0], row.id, outcome, state["revision"], state["content"], state["accepted"]))
        yield pd.DataFrame(out, columns=["sample", "id", "outcome", "revision", "content", "accepted"])
        self._page.update((state["revision"], state["content"], state["accepted"], state["reviewers"],
                           state["human_reviewers"]))

    def close(self) -> None:
        pass


def fold(submissions: DataFrame) -> DataFrame:
    """Outcome of every submission (sample, revision, content, reviewer, human, at, id).

    State is one small row per page in the RocksDB store.  Within a trigger a page's rows are
    put in order of (at, id); set the source's rate limit (``maxFilesPerTrigger`` and the
    like), which bounds what one busy page can bring to one task.
    """
    t = submissions.schema["sample"].dataType.simpleString()
    return submissions.groupBy("sample").transformWithStateInPandas(
        ReviewFold(), OUT.format(t=t), outputMode="Append", timeMode="None")


def without_retries(submissions: DataFrame, delay: str = "1 hour", at: str = "at") -> DataFrame:
    """Drop resent submissions within the watermark; state is bounded by the delay."""
    return submissions.withWatermark(at, delay).dropDuplicatesWithinWatermark(
        ["sample", "revision", "content", "reviewer", "human"])
