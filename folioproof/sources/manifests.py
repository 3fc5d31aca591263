"""Scans of manifests, registries, documents, batch records and run states.

Schemas are stated, never inferred; a record that does not fit is kept in
``_corrupt_record`` and reported by :func:`corrupt`.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.upsert import agreement

RIGHTS = ("struct<reviewer:string,evidence_url:string,license:string,exclusions:string,review_date:string,"
          "evidence_sha256:string,acquisition:string,training:string,evaluation:string,redistribution:string,"
          "model_publication:string>")
LINEAGE = "struct<document:array<string>,edition:array<string>,artwork:array<string>,parent:array<string>>"
SOURCE = (f"id string, sha256 string, split string, format string, max_bytes long, pages array<int>, revision string,"
          f" attribution string, edition string, selection_reason string, pretrained_overlap string, private boolean,"
          f" real boolean, lineage_reviewed boolean, lineage {LINEAGE}, conditions array<string>, url string,"
          f" rights {RIGHTS}")
RECORD = ("struct<id:string,kind:string,url:string,revision:string,sha256:string,bytes:long,max_bytes:long,"
          "attribution:string,license:string,evidence_ids:array<string>,pages:array<int>,split:string,"
          "lineage:array<string>,conditions:array<string>>")
ATTEMPT = ("struct<ledger_id:string,segment:string,started_at:double,elapsed_seconds:double,source_run_id:string,prior_run_id:string,"
           "source_attempt_index:int,inherited:boolean,state:string>")
MAX_MANIFEST = 2 * 1024 * 1024


def _json(spark: SparkSession, path: str, ddl: str) -> DataFrame:
    return (spark.read.schema(ddl + ", _corrupt_record string").option("multiLine", True)
            .option("mode", "PERMISSIVE").json(path))


def corrupt(df: DataFrame) -> DataFrame:
    return df.where("_corrupt_record is not null").select("_corrupt_record")


def source_manifests(spark: SparkSession, path: str) -> DataFrame:
    """Source manifests below ``path``, one JSON file each, oversize files marked."""
    df = _json(spark, path, SOURCE)
    return df.withColumn("file", F.col("_metadata.file_path")).withColumn(
        "oversize", F.col("_metadata.file_size") > MAX_MANIFEST)


def files(spark: SparkSession, path: str, pattern: str | None = None) -> DataFrame:
    """(path, length, sha256) of every file; contents are hashed where they are read."""
    reader = spark.read.format("binaryFile").option("recursiveFileLookup", True)
    if pattern:
        reader = reader.option("pathGlobFilter", pattern)
    return reader.load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))


def bytes_on_disk(spark: SparkSession, path: str) -> DataFrame:
    # Only the length is read: the content column is pruned.
    return (spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
            .agg(F.coalesce(F.sum("length"), F.lit(0)).alias("bytes")))


def provenance(spark: SparkSession, path: str) -> DataFrame:
    """One row per record of a provenance registry."""
    doc = _json(spark, path, f"schema string, `public` boolean, review_date string, scope string, records array<{RECORD}>")
    return doc.select("review_date", F.explode("records").alias("r")).select("review_date", "r.*")


def with_evidence(records: DataFrame) -> DataFrame:
    """(id, evidence, evidence_kind): each record with the records it rests on; a missing one has no kind."""
    links = records.select("id", F.explode("evidence_ids").alias("evidence")).distinct()
    held = records.select(F.col("id").alias("evidence"), F.col("kind").alias("evidence_kind"),
                          F.col("sha256").alias("evidence_sha256")).dropDuplicates(["evidence"])
    return links.join(held, "evidence", "left").select("id", "evidence", "evidence_kind", "evidence_sha256")


def admit(records: DataFrame, originals: DataFrame) -> DataFrame:
    """Admit records whose file is at hand: (id, outcome) by hash, size and evidence.

    ``originals`` has sha256 and length of the files; a record is admitted when its bytes are
    there, its length fits and all its evidence is on file too.
    """
    have = originals.groupBy("sha256").agg(F.max("length").alias("length"))
    evidence = (with_evidence(records)
                .join(have.select(F.col("sha256").alias("evidence_sha256"), F.lit(True).alias("_on_file")),
                      "evidence_sha256", "left")
                .groupBy("id").agg(F.bool_and((F.col("evidence_kind") == "license-evidence")
                                              & F.coalesce("_on_file", F.lit(False))).alias("_proved")))
    joined = records.join(have, "sha256", "left").join(evidence, "id", "left")
    outcome = (F.when(F.col("length").isNull(), "missing-original").when(F.col("length") != F.col("bytes"), "length-changed")
               .when((F.col("kind") != "license-evidence") & ~F.coalesce("_proved", F.lit(False)), "missing-evidence")
               .otherwise("admitted"))
    return joined.select("id", outcome.alias("outcome"))


def document_sources(found: DataFrame) -> DataFrame:
    """Identity of documents from their bytes; the folder is one lineage group.

    ``found`` is :func:`files` output.  Ingesting the same bytes again gives the same row,
    so :func:`folioproof.operators.upsert.insert_absent` makes it a no-op.
    """
    folder = F.regexp_extract("path", r"([^/]+)/[^/]+$", 1)
    return (found.groupBy("sha256").agg(F.min("path").alias("path"), F.max("length").alias("bytes"))
            .select(F.concat(F.lit("local-"), F.substring("sha256", 1, 20)).alias("id"), "sha256", "bytes",
                    folder.alias("document_group"), "path"))


def changed_inputs(found: DataFrame, expected: DataFrame) -> DataFrame:
    """Files whose hash is not the expected one (expected: name, sha256)."""
    named = found.select(F.element_at(F.split("path", "/"), -1).alias("name"), "sha256")
    return agreement(expected.select("name", "sha256"), named, ["name"], ["sha256"])


def batch_records(spark: SparkSession, path: str, record: str) -> DataFrame:
    """Records of all batch files, one row each; ``record`` is the struct type of an entry."""
    return (spark.read.schema(record).option("multiLine", True).option("pathGlobFilter", "batch-*.json")
            .json(path).withColumn("file", F.col("_metadata.file_name")))


def run_states(spark: SparkSession, path: str) -> DataFrame:
    """Attempts of every ``<run>/state.json`` below ``path`` with run, file and ordinal."""
    df = (spark.read.schema(f"run_id string, state string, attempts array<{ATTEMPT}>").option("multiLine", True)
          .option("recursiveFileLookup", True).option("pathGlobFilter", "state.json").json(path)
          .withColumn("file", F.col("_metadata.file_path")))
    return df.select("file", F.regexp_extract("file", r"([^/]+)/state\.json$", 1).alias("retained_run"),
                     F.posexplode("attempts").alias("ordinal", "a")).select("file", "retained_run", "ordinal", "a.*")
