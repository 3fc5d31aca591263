"""The corpus pipeline: toxicity, near duplicates, repeated passages, benchmark passages, packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from folioproof.llm import decontaminate, jaccard, packing, passages, toxicity
from folioproof.llm.labelled import fold
from folioproof.llm.queries import vocabulary
from folioproof.llm.shared import put, ready


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    ready(spark)
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score below 0.3 stay; the model learns from labelled documents as op10 does."""
    model = toxicity.train(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), fold("doc_id", 4) != 2)
    return toxicity.keep_clean(docs, model)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Five-word shingles, Jaccard of 0.8 or more: the smallest id of each component stays."""
    ready(spark)
    return jaccard.one_of_each(docs, n=5, percent=80)


def cut_repeats(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Passages of 50 words or more stay in the smallest id that has them."""
    ready(spark)
    return passages.remove(docs)


def cut_benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Words in benchmark windows go; a document more than half of which is such words goes as a whole."""
    return decontaminate.remove(docs, _table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    ready(spark)
    return packing.pack(docs, vocabulary())


STAGES = [("toxicity", drop_toxic), ("near duplicates", drop_near_copies), ("repeated passages", cut_repeats),
          ("benchmark passages", cut_benchmark), ("packing", pack)]

#: Model training and tokenizing are not expressible in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = put(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
