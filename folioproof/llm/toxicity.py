"""Toxicity from document labels: sentence scores combined by noisy-or, trained as multiple-instance learning."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, functions as F

from . import words as W
from .labelled import Sample, learn

FEATURES = 1 << 18
#: Beginnings of a word, in characters, that are features beside the word itself.
BEGINNINGS = range(3, 9)
#: A feature needs this many toxic sample documents, and so many times the share of toxic
#: documents that it has of the others.
SUPPORT, LIFT = 3, 2.0
REMEMBERED = 150_000
_BREAK = np.zeros(256, bool)
_BREAK[[ord(c) for c in ".!?\n"]] = True


def features(word: bytes) -> np.ndarray:
    text = word.decode("utf-8", "replace")
    keys = [b"=" + word] + [b"^" + text[:n].encode() for n in BEGINNINGS if n <= len(text)]
    return np.array([xxhash.xxh3_64_intdigest(k) % FEATURES for k in keys], np.int32)


def sentences(w: W.Words) -> np.ndarray:
    """First word of each sentence: texts end sentences, and so do . ! ? and line ends."""
    breaks = np.flatnonzero(_BREAK[w.data])
    number = np.searchsorted(breaks, w.starts)
    return np.flatnonzero(np.r_[True, (w.doc[1:] != w.doc[:-1]) | (number[1:] != number[:-1])]) if len(w.starts) else np.empty(0, np.int64)


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.logaddexp(0, z)


@dataclass
class Model:
    weights: np.ndarray
    bias: float

    def word(self, word: bytes) -> float:
        return float(self.weights[features(word)].sum())

    def score(self, w: W.Words, memory: dict) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(score of each text, first word and probability of each sentence); no words: no sentence, score 0."""
        first = sentences(w)
        if not len(first):
            return np.zeros(len(w.bounds) - 1), first, np.empty(0)
        values, inverse = w.distinct(memory)
        z = np.add.reduceat(np.array(values)[inverse], first) + self.bias
        keep = np.zeros(len(w.bounds) - 1)
        np.add.at(keep, w.doc[first], _softplus(z))
        return -np.expm1(-keep), first, 1 / (1 + np.exp(-z))


def fit(given: Sample, rounds: int = 300, rate: float = 0.05, ridge: float = 5e-5) -> Model:
    """Weights that make the noisy-or of sentence probabilities agree with document labels.

    Only words and beginnings with SUPPORT and LIFT get a weight.  Full gradients with Adam
    steps; the sample is bounded, so is the work.  Without toxic rows every score is near 0.
    """
    w = W.words(pa.array(given.texts, pa.string()), W.ALNUM)
    label, weight = np.array(given.labels), np.array(given.weights())
    first = sentences(w)
    model = Model(np.zeros(FEATURES), -7.0)
    if not len(first) or not label.any():
        return model
    memory: dict[bytes, int] = {}
    listed: list[np.ndarray] = []

    class Number(dict):
        def __missing__(self, word: bytes) -> int:
            listed.append(features(word))
            self[word] = len(self)
            return self[word]

    memory = Number()
    numbers, inverse = w.distinct(memory)
    kind = np.array(numbers)[inverse]
    size = np.array([len(x) for x in listed])
    table, owner = np.concatenate(listed), np.repeat(np.arange(len(listed)), size)
    # Documents of either label for each feature.
    toxic = label == 1
    pairs = W.unique(w.doc.astype(np.int64) * len(listed) + kind)
    begin = np.cumsum(size) - size
    bad, fine = np.zeros(FEATURES, np.int64), np.zeros(FEATURES, np.int64)
    edges = np.searchsorted(pairs, np.arange(0, len(label) + 100, 100) * len(listed))
    for a, b in zip(edges[:-1], edges[1:]):  # a hundred documents at a time
        owners, held = pairs[a:b] // len(listed), pairs[a:b] % len(listed)
        n = size[held]
        flat = table[np.arange(int(n.sum())) + np.repeat(begin[held] - (np.cumsum(n) - n), n)].astype(np.int64)
        seen = W.unique(np.repeat(owners, n) * FEATURES + flat)
        ill = toxic[seen // FEATURES]
        bad += np.bincount(seen[ill] % FEATURES, minlength=FEATURES)
        fine += np.bincount(seen[~ill] % FEATURES, minlength=FEATURES)
    known = (bad >= SUPPORT) & (bad / toxic.sum() >= LIFT * (fine + 0.5) / (len(label) - toxic.sum() + 1))
    used = known[table]
    table, owner = table[used], owner[used]
    useful = np.zeros(len(listed), bool)
    useful[owner] = True
    sentence = np.repeat(np.arange(len(first)), np.diff(np.r_[first, len(w.starts)]))
    tokens = useful[kind]
    sentence, kind, doc = sentence[tokens], kind[tokens], w.doc[first]
    theta, bias = np.zeros(FEATURES), model.bias
    m, v, mb, vb = np.zeros(FEATURES), np.zeros(FEATURES), 0.0, 0.0
    docs = len(label)
    for step in range(1, rounds + 1):
        word = np.bincount(owner, theta[table], len(listed))
        z = np.clip(np.bincount(sentence, word[kind], len(first)) + bias, -30, 30)
        total = np.bincount(doc, _softplus(z), docs)
        pull = np.where(label == 1, -1 / np.expm1(np.clip(total, 1e-9, 50)), 1.0) * weight / docs
        dz = pull[doc] / (1 + np.exp(-z))
        dword = np.bincount(kind, dz[sentence], len(listed))
        g = np.bincount(table, dword[owner], FEATURES) + ridge * theta
        gb = dz.sum()
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * gb, 0.99 * vb + 0.01 * gb * gb
        fix = np.sqrt(1 - 0.99 ** step) / (1 - 0.9 ** step)
        theta -= rate * fix * m / (np.sqrt(v) + 1e-8)
        bias -= rate * fix * mb / (np.sqrt(vb) + 1e-8)
    theta[~known] = 0
    return Model(theta, float(bias))


def train(docs: DataFrame, labels: DataFrame, use: Column, label: str = "toxic", doc: str = "doc_id", text: str = "text") -> Model:
    return learn(docs, labels, label, use, fit, doc, text)


def score(docs: DataFrame, model: Model, threshold: float = 0.3, doc: str = "doc_id", text: str = "text") -> DataFrame:
    """(doc, score, predicted, n_sentences, offending) for every row, over whole texts.

    ``score`` is the noisy-or of the sentence probabilities; ``offending`` lists the
    sentences (number, score, words) with probability ``threshold`` or more.  Null, empty and wordless texts score 0.
    Repeated rows are scored each; other columns are not read.
    """
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = sent.value
        memory = W.Recent(model.word, REMEMBERED)
        for batch in batches:
            for part in W.blocks(batch, "t"):
                w = W.words(part.column("t"), W.ALNUM)
                scores, first, p = model.score(w, memory)
                last = np.r_[first[1:], len(w.starts)]
                opening = np.searchsorted(first, w.bounds[:-1])
                found: list[list] = [[] for _ in range(len(part))]
                for j in np.flatnonzero(p >= threshold).tolist():
                    i = int(w.doc[first[j]])
                    found[i].append({"sentence": j - int(opening[i]), "score": float(p[j]),
                                     "words": w.text(int(first[j]), int(last[j])).decode("utf-8", "replace")})
                count = np.bincount(w.doc[first], minlength=len(part))
                yield pa.RecordBatch.from_arrays(
                    [part.column("k"), pa.array(scores, pa.float64()), pa.array(scores >= threshold).cast(pa.int32()),
                     pa.array(count, pa.int64()), pa.array(found, _OFFENDING)],
                    names=[doc, "score", "predicted", "n_sentences", "offending"])

    kind = docs.schema[doc].dataType.simpleString()
    return docs.select(F.col(doc).alias("k"), F.col(text).alias("t")).mapInArrow(
        run, f"{doc} {kind}, score double, predicted int, n_sentences long, "
             "offending array<struct<sentence: long, score: double, words: string>>")


_OFFENDING = pa.list_(pa.struct([("sentence", pa.int64()), ("score", pa.float64()), ("words", pa.string())]))


def keep_clean(docs: DataFrame, model: Model, threshold: float = 0.3, text: str = "text") -> DataFrame:
    """The rows of ``docs`` that score below ``threshold``, unchanged."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memory = W.Recent(sent.value.word, REMEMBERED)
        for batch in batches:
            for part in W.blocks(batch, text):
                scores = sent.value.score(W.words(part.column(text), W.ALNUM), memory)[0]
                yield part.filter(pa.array(scores < threshold))

    return docs.mapInArrow(run, docs.schema)
