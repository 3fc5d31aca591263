"""License notices by patience alignment with templates.

Where enough template words stand close together, the text from there is aligned with the template:
words that both have once are anchors, the longest rising run of them stays, gaps are aligned again.
A notice is the best stretch of matched words; its coverage is their share of the template.
"""

from __future__ import annotations

from bisect import bisect_left
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from . import words as W

#: License notices.
TEMPLATES = {
    "mit-notice": "Released under the MIT License.",
    "mit": "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
           "documentation files (the \"Software\"), to deal in the Software without restriction",
    "apache-2.0-notice": "Licensed under the Apache License, Version 2.0.",
    "apache-2.0": "Licensed under the Apache License, Version 2.0 (the \"License\"); you may not use this file except in "
                  "compliance with the License. You may obtain a copy of the License at",
    "gpl-3.0-notice": "This work is licensed under the GNU General Public License, version 3.",
    "gpl-3.0": "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
               "Public License as published by the Free Software Foundation, either version 3 of the License",
    "bsd": "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
           "the following conditions are met",
    "cc-by-nc-4.0-notice": "Licensed under CC BY-NC 4.0.",
    "cc-by-4.0-notice": "Licensed under CC BY 4.0.",
}
COVERAGE = 0.8


def align(text: list, template: list) -> list[tuple[int, int]]:
    """Matched positions (text, template), rising in both.

    Anchors are words that both have exactly once; the longest rising run of them stays, and
    the gaps between them are aligned the same way.  Ends that agree are matched first.
    """
    out, stack = [], [(0, len(text), 0, len(template))]
    while stack:
        a, b, c, d = stack.pop()
        while a < b and c < d and text[a] == template[c]:
            out.append((a, c))
            a, c = a + 1, c + 1
        while a < b and c < d and text[b - 1] == template[d - 1]:
            b, d = b - 1, d - 1
            out.append((b, d))
        if a >= b or c >= d:
            continue
        left, right = Counter(text[a:b]), Counter(template[c:d])
        place = {w: i for i, w in enumerate(template[c:d], c) if right[w] == 1}
        anchors = [(i, place[w]) for i, w in enumerate(text[a:b], a) if left[w] == 1 and w in place]
        rising = longest_rising(anchors)
        if not rising:
            continue
        out += rising
        ends = [(a - 1, c - 1), *rising, (b, d)]
        stack += [(i + 1, k, j + 1, m) for (i, j), (k, m) in zip(ends, ends[1:])]
    return sorted(out)


def longest_rising(pairs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """The longest run of pairs, given by first number, that rises in the second: patience piles."""
    tops, at, back = [], [], []
    for i, (_, y) in enumerate(pairs):
        pile = bisect_left(tops, y)
        back.append(at[pile - 1] if pile else -1)
        if pile == len(tops):
            tops.append(y)
            at.append(i)
        else:
            tops[pile], at[pile] = y, i
    out, i = [], at[-1] if at else -1
    while i >= 0:
        out.append(pairs[i])
        i = back[i]
    return out[::-1]


class Templates:
    def __init__(self, templates: dict[str, str], coverage: float) -> None:
        self.coverage = coverage
        w = W.words(pa.array(list(templates.values()), pa.string()), W.ALNUM)
        self.names = list(templates)
        self.words = [w.hashes[a:b].tolist() for a, b in zip(w.bounds[:-1], w.bounds[1:])]
        self.known = np.unique(w.hashes)
        self.sets = [Counter(x) for x in self.words]

    def scan(self, text: list[int], held: np.ndarray) -> list[dict]:
        """Notices in one text, wherever its lines break: for each template all copies that do not overlap."""
        out = []
        have = Counter(t for t, h in zip(text, held.tolist()) if h)
        for name, template, need in zip(self.names, self.words, self.sets):
            least = self.coverage * len(template)
            # No alignment can match more than the words both have.
            if sum(min(n, have[t]) for t, n in need.items()) < least:
                continue
            end = 0
            for s in dense(text, need, least, 2 * len(template)):
                if s < end:
                    continue
                found = notice(text, template, s, least)
                # Words of an earlier sentence may have moved the end of what was aligned.
                found = found and max(found, notice(text, template, found[1], least) or found)
                if found:
                    # Copies in a row are found one by one.
                    _, first, last, n = found
                    out.append({"license": name, "coverage": n / len(template), "first": first, "last": last})
                    end = last
        return out


def dense(text: list, need: Counter, least: float, size: int) -> Iterator[int]:
    """Places of template words from which ``size`` words hold at least ``least`` words of the template."""
    have: Counter = Counter()
    both = right = 0
    for s, word in enumerate(text):
        while right < min(len(text), s + size):
            new = text[right]
            if new in need:
                both += have[new] < need[new]
                have[new] += 1
            right += 1
        if word in need:
            if both >= least:
                yield s
            have[word] -= 1
            both -= have[word] < need[word]


#: Words of text that are aligned with a template, as multiples of its own: words scattered over more are no notice.
_SIZES = (1, 1.25, 1.5, 2)


def notice(text: list, template: list, start: int, least: float) -> tuple[float, int, int, int] | None:
    """(score, first, last, matched words) of the best notice in the words from ``start``, the shortest of equals.

    Several lengths are aligned: in a longer one the next copy can take the anchors away,
    in a shorter one a notice with added words has no room.
    """
    best = None
    for size in _SIZES:
        matched = align(text[start:start + int(size * len(template))], template)
        found = stretch([start + i for i, _ in matched], least)
        if found and (best is None or found[0] > best[0]):
            best = found
    return best


def stretch(at: list[int], least: float) -> tuple[float, int, int, int] | None:
    """(score, first, last, n) of the best run of at least ``least`` matched words at rising places: a matched word weighs two passed ones."""
    need, best, begin = max(int(-(-least // 1)), 1), None, None
    for q in range(need - 1, len(at)):
        # A run from p to q scores 2 (q - p + 1) - (at[q] - at[p] + 1), so the best p has the greatest at[p] - 2 p.
        p = q - need + 1
        if begin is None or at[p] - 2 * p >= at[begin] - 2 * begin:
            begin = p
        n = q - begin + 1
        score = 2 * n - (at[q] - at[begin] + 1)
        if best is None or score > best[0]:
            best = score, at[begin], at[q] + 1, n
    return best


_FOUND = pa.list_(pa.struct([("license", pa.string()), ("coverage", pa.float64()), ("first", pa.int32()), ("last", pa.int32())]))


def scan(docs: DataFrame, templates: dict[str, str] = TEMPLATES, coverage: float = COVERAGE, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, license, coverage, notices) of every row: the best covered notice, the longest of equals, and all of them.

    Words are runs of letters and digits, A-Z as a-z; ``first`` and ``last`` bound a notice
    in words.  Null, empty and clean texts have no notices and a null license.  Repeated rows are scanned each.
    """
    sent = docs.sparkSession.sparkContext.broadcast(Templates(templates, coverage))
    size = {n: len(t) for n, t in templates.items()}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        index = sent.value
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.ALNUM)
                held = np.isin(w.hashes, index.known)
                count = np.diff(np.r_[0, np.cumsum(held)][w.bounds])
                found: list[list] = [[] for _ in range(len(part))]
                for i in np.flatnonzero(count >= index.coverage * min(map(len, index.words))).tolist():
                    a, b = int(w.bounds[i]), int(w.bounds[i + 1])
                    found[i] = index.scan(w.hashes[a:b].tolist(), held[a:b])
                best = [max(f, key=lambda x: (x["coverage"], size[x["license"]]), default=None) for f in found]
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array([x and x["license"] for x in best], pa.string()),
                     pa.array([x["coverage"] if x else 0.0 for x in best], pa.float64()), pa.array(found, _FOUND)],
                    names=[doc, "license", "coverage", "notices"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"{doc} {kind}, license string, coverage double, notices array<struct<license: string, coverage: double, first: int, last: int>>")
