"""Periodic runs of words: seeds of guaranteed overlap, extended along diagonals.

A run of period q and ``times`` periods is a stretch of words that equals itself q words
later, over at least ``(times - 1) * q`` words.  So lags are taken in classes, and each class is
sought with the k-grams that the shortest run of any of its lags must still hold twice.  A
class ends where k would fall below twice its lag: then a k-gram of a run cannot recur
sooner than one period on (both lags would be periods of the k-gram, hence their greatest
common divisor one of the run), so each occurrence is paired with the next one of the same
text only, and the pairs of a class are no more than the words.  A pair is extended along its
lag in both directions, unless the table of what each lag has covered already holds it.

k-grams are named by doubling, so equal names are equal words; no hash decides a result.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: Fewest words of a run, and fewest periods (three at least, see above).
LEAST, TIMES = 6, 4


def overlap(q: int, least: int = LEAST, times: int = TIMES) -> int:
    """Words over which the shortest run of period ``q`` equals itself ``q`` words later."""
    return max(least - q, (times - 1) * q)


def lag_classes(longest: int, least: int = LEAST, times: int = TIMES) -> Iterator[tuple[int, int, int]]:
    """(first lag, last lag, k) up to ``longest``: k is at least twice the last lag and at most the overlap of each."""
    q = 1
    while q <= longest:
        last, k = q, overlap(q, least, times)
        while min(k, overlap(last + 1, least, times)) >= 2 * (last + 1):
            last += 1
            k = min(k, overlap(last, least, times))
        yield q, last, k
        q = last + 1


class Grams:
    """Names of the k-grams of one text: equal names, equal words."""

    def __init__(self, ids: np.ndarray) -> None:
        self.doubled = [ids.astype(np.int64)]

    def keys(self, k: int) -> np.ndarray:
        """A number for each k-gram, not dense."""
        j = k.bit_length() - 1
        while len(self.doubled) <= j:
            last = self.doubled[-1]
            half = 1 << (len(self.doubled) - 1)
            self.doubled.append(np.unique(self._pair(last[:-half], last[half:]), return_inverse=True)[1])
        names = self.doubled[j]
        return self._pair(names[:len(names) - (k - (1 << j))], names[k - (1 << j):])

    @staticmethod
    def _pair(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return a * (int(b.max(initial=0)) + 1) + b


def _agree(a: np.ndarray, b: np.ndarray) -> int:
    """How many first elements are equal."""
    n, at, step = min(len(a), len(b)), 0, 64
    while at < n:
        differ = np.flatnonzero(a[at:at + step][:n - at] != b[at:at + step][:n - at])
        if len(differ):
            return at + int(differ[0])
        at, step = at + step, 2 * step
    return n


def _longest_lag(ids: np.ndarray, least: int, times: int) -> int:
    """No run has a longer period.

    In the shortest run of period q, each k-gram recurs q words later or earlier if k is at most the
    run's words less 2q - 1; so with the least such k all k-grams of any run occur twice in the text.
    """
    k = min(max(least, times * q) - 2 * q + 1 for q in range(1, least + 1))
    if len(ids) < max(least, k + 1):
        return 0
    h = W.chain(W.mix(ids.astype(np.uint64) + W.U(1)), k)
    order = np.argsort(h)
    twin = h[order[1:]] == h[order[:-1]]
    twice = np.zeros(len(h), bool)
    twice[order[1:][twin]] = twice[order[:-1][twin]] = True
    most = max((b - a for a, b in W.runs(np.flatnonzero(twice))), default=0)
    words = most + k - 1
    return words // times if most and words >= least else 0


def text_runs(ids: np.ndarray, least: int = LEAST, times: int = TIMES) -> list[tuple[int, int, int]]:
    """(start, length, period) of every run of a text, given a number for each of its words, by start and period."""
    longest = _longest_lag(ids, least, times)
    out, grams = [], Grams(ids)
    for low, high, k in lag_classes(longest, least, times):
        if k >= len(ids):
            break
        key = grams.keys(k)
        order = np.argsort(key, kind="stable")
        again = key[order[1:]] == key[order[:-1]]
        at = order[:-1][again]
        lag = order[1:][again] - at
        fit = (lag >= low) & (lag <= high)
        at, lag = at[fit], lag[fit]
        order = np.lexsort((at, lag))
        at, lag = at[order], lag[order]
        # A pair whose left neighbour is one of the same lag lies inside that one's extension.
        first = np.ones(len(at), bool)
        first[1:] = (at[1:] != at[:-1] + 1) | (lag[1:] != lag[:-1])
        covered: dict[int, int] = {}
        for i, q in zip(at[first].tolist(), lag[first].tolist()):
            done = covered.get(q, 0)
            if i < done:
                continue
            start = i - _agree(ids[done:i][::-1], ids[done + q:i + q][::-1])
            end = i + k + _agree(ids[i + k:], ids[i + k + q:])
            covered[q] = end
            length = end - start + q
            if length >= max(least, times * q):
                out.append((start, length, q))
    return sorted(out, key=lambda r: (r[0], r[2]))


def detect(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: int = LEAST, times: int = TIMES) -> DataFrame:
    """(doc, n_words, runs, collapsed) of each row: all runs by start and period, and the text without their repeats.

    A run is a stretch of at least ``least`` words and ``times`` periods with smallest period q
    that no neighbouring word extends.  ``collapsed`` holds, with one blank between, the words
    that no run contains after its first q words.  Words are what stands between ASCII white
    space, in their own case.  Null and empty texts have no words, no runs and an empty
    ``collapsed``; equal rows are judged one by one; a null id is kept; other columns are not
    read.  One text is worked on at a time, in memory of some hundred bytes a word.
    """
    if times < 3:
        raise ValueError("runs of fewer than three periods are not sought")
    source = docs.select(F.col(doc).alias("k"), F.col(text).alias("t"))
    kind = source.schema["k"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        runs_type = pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())]))
        for batch in batches:
            for part in W.blocks(batch, "t"):
                data, offsets = W.flat(part.column("t"))
                count, found, left = [], [], []
                for a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist()):
                    words = data[a:b].tobytes().split()
                    known: dict[bytes, int] = {}
                    runs = text_runs(np.array([known.setdefault(w, len(known)) for w in words], np.int64), least, times)
                    if runs:
                        stays = np.ones(len(words), bool)
                        for start, length, q in runs:
                            stays[start + q:start + length] = False
                        kept = [words[i] for i in np.flatnonzero(stays).tolist()]
                    else:
                        kept = words
                    count.append(len(words))
                    found.append([{"start": s, "length": n, "period": q} for s, n, q in runs])
                    left.append(b" ".join(kept).decode("utf-8", "replace"))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(count, pa.int64()), pa.array(found, runs_type), pa.array(left, pa.string())],
                    names=[doc, "n_words", "runs", "collapsed"])

    return source.mapInArrow(run, f"`{doc}` {kind}, n_words long, runs array<struct<start: long, length: long, period: long>>, collapsed string")
