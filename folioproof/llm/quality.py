"""Quality by compression: sizes under a dictionary of good and one of bad text, calibrated."""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .labelled import Sample, learn

#: Bytes of a dictionary, and of the pieces that texts are compressed in.  Pieces keep the
#: dictionary's effect alike along a text; all pieces of a text are summed.
DICTIONARY, PIECE, LEVEL = 112 << 10, 1024, 3
#: Bytes added to a text's length before dividing by it, so that short texts stay near 0.
EASE = 200


@dataclass
class Model:
    good: bytes
    bad: bytes
    slope: float
    level: float

    def scorer(self) -> Scorer:
        return Scorer(self.good, self.bad, self.slope, self.level)


class Scorer:
    def __init__(self, good: bytes, bad: bytes, slope: float = 1.0, level: float = 0.0) -> None:
        self.slope, self.level = slope, level
        self.sizes = [self._compressor(good), self._compressor(bad)]

    @staticmethod
    def _compressor(raw: bytes):
        kind = zstandard.DICT_TYPE_AUTO if raw[:4] == b"\x37\xa4\x30\xec" else zstandard.DICT_TYPE_RAWCONTENT
        given = zstandard.ZstdCompressionDict(raw, dict_type=kind)
        given.precompute_compress(level=LEVEL)
        return zstandard.ZstdCompressor(dict_data=given, write_content_size=False, write_checksum=False, write_dict_id=False).compress

    def difference(self, text: bytes) -> float:
        """(size under bad - size under good) / (length + EASE): above 0 for good text, 0 without text."""
        good, bad = self.sizes
        a = b = 0
        for at in range(0, len(text), PIECE):
            piece = text[at:at + PIECE]
            a += len(good(piece))
            b += len(bad(piece))
        return (b - a) / (len(text) + EASE)

    def score(self, text: bytes) -> float:
        return 1 / (1 + math.exp(-max(-500.0, min(500.0, self.slope * self.difference(text) + self.level))))


def dictionary(texts: list[bytes], size: int = DICTIONARY) -> bytes:
    """A trained dictionary; too little text for training serves as it is."""
    pieces = [t[at:at + PIECE] for t in texts for at in range(0, len(t), PIECE)]
    try:
        return zstandard.train_dictionary(size, pieces, level=LEVEL).as_bytes()
    except zstandard.ZstdError:
        return b"".join(pieces)[:size]


def fit(given: Sample) -> Model:
    """Dictionaries from two thirds of the sample, slope and level of the score from the rest.

    With one class only there is nothing to tell apart, and the score is that class's share.
    """
    texts, labels, weights = [t.encode() for t in given.texts], np.array(given.labels), np.array(given.weights())
    turn = np.empty(len(texts), np.int64)
    for k in (0, 1):
        turn[labels == k] = np.arange(int((labels == k).sum())) % 3
    parts = [dictionary([t for t, y, r in zip(texts, labels, turn) if y == k and r < 2]) for k in (1, 0)]
    if not all(parts):
        share = given.total[1] / max(1, sum(given.total.values()))
        return Model(parts[0], parts[1], 0.0, math.log(max(share, 1e-3) / max(1 - share, 1e-3)))
    scorer = Scorer(*parts)
    rest = np.flatnonzero(turn == 2)
    x = np.array([scorer.difference(texts[i]) for i in rest])
    slope, level = logistic(x, labels[rest], weights[rest])
    return Model(parts[0], parts[1], slope, level)


def logistic(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> tuple[float, float]:
    """Slope and level of a weighted logistic curve, by Newton steps with a weak prior on the slope."""
    beta, design = np.zeros(2), np.stack([x, np.ones(len(x))], 1)
    prior = np.array([1e-4, 1e-6])
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ beta, -30, 30)))
        g = design.T @ (w * (p - y)) + prior * beta
        h = (design * (w * p * (1 - p))[:, None]).T @ design + np.diag(prior)
        step = np.linalg.solve(h + 1e-9 * np.eye(2), g)
        beta -= step * min(1.0, 20 / max(1e-12, np.abs(step).max()))
    return float(beta[0]), float(beta[1])


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "quality", doc: str = "doc_id", text: str = "text") -> Model:
    return learn(docs, labels, label, use, fit, doc, text)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score, predicted, difference) for every row, over whole texts.

    Null and empty texts have difference 0 and its score.  Repeated rows are scored each;
    other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scorer = sent.value.scorer()
        for batch in batches:
            for part in W.blocks(batch, "t"):
                data, offsets = W.flat(part.column("t"))
                raw, cuts = data.tobytes(), offsets.tolist()
                d = np.array([scorer.difference(raw[a:b]) for a, b in zip(cuts, cuts[1:])])
                s = 1 / (1 + np.exp(-np.clip(scorer.slope * d + scorer.level, -500, 500)))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(s), pa.array(s >= threshold).cast(pa.int32()), pa.array(d)],
                    names=[doc, "score", "predicted", "difference"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"{doc} {kind}, score double, predicted int, difference double")
