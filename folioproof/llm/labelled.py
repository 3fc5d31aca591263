"""A bounded sample of labelled documents for fitting classifiers."""

from __future__ import annotations

import pickle
from collections.abc import Callable
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

#: Most documents of each class, and most characters of a document, that a fit reads: with
#: one byte a character 2 x 2,000 x 32,768 bytes, 131 MB, meet in the fitting task at the very most.
PER_CLASS, MOST_CHARS = 2_000, 32_768


@dataclass
class Sample:
    """Texts with labels, and how many labelled rows of each class there are in all."""

    texts: list[str]
    labels: list[int]
    total: dict[int, int]

    def weights(self) -> list[float]:
        """Row weights that restore the classes' shares of all labelled rows."""
        here = {k: max(1, self.labels.count(k)) for k in (0, 1)}
        every = max(1, sum(self.total.values()))
        return [self.total[k] / here[k] / every * len(self.labels) for k in self.labels]


def fold(doc: str, parts: int) -> Column:
    """crc32 of the id as text, modulo ``parts``."""
    return F.crc32(F.col(doc).cast("string").cast("binary")) % parts


def learn(docs: DataFrame, labels: DataFrame, label: str, use: Column, fit: Callable[[Sample], object], doc: str = "doc_id",
          text: str = "text", per_class: int = PER_CLASS, most_chars: int = MOST_CHARS) -> object:
    """``fit`` over labelled texts for which ``use`` holds, those with the smallest id hashes of each class.

    The sample is bounded, so one task fits it; only the model comes to the driver.  Null
    labels, ids without a text and texts over ``most_chars`` are passed over; an id with
    several labels has the largest, an id with several texts the smallest.
    """
    given = (labels.where(F.col(label).isin(0, 1) & F.col(doc).isNotNull()).where(use)
             .groupBy(doc).agg(F.max(label).cast("int").alias("_label")))
    total = {0: 0, 1: 0} | {r["_label"]: r["n"] for r in given.groupBy("_label").agg(F.count(F.lit(1)).alias("n")).collect()}
    picked = None
    for k in (0, 1):
        part = given.where(F.col("_label") == k).orderBy(F.xxhash64(doc), doc).limit(per_class)
        picked = part if picked is None else picked.unionByName(part)
    rows = (docs.select(doc, F.col(text).alias("_text")).where(F.length("_text") <= most_chars)
            .join(F.broadcast(picked), doc).groupBy(doc).agg(F.min("_text").alias("_text"), F.max("_label").alias("_label")))

    def run(table: pa.Table) -> pa.Table:
        table = table.sort_by(doc)
        given = Sample(table.column("_text").to_pylist(), table.column("_label").to_pylist(), total)
        return pa.table({"model": pa.array([pickle.dumps(fit(given))], pa.binary())})

    found = rows.groupBy(F.lit(0).alias("_all")).applyInArrow(run, "model binary").collect()
    return pickle.loads(found[0][0]) if found else fit(Sample([], [], total))
