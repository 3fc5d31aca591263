"""Files and snapshots: integrity, identity and differences."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.scalar import canonical
from ..operators import integrity as I, merkle as M
from ..operators.near_gate import near_blockers
from ..sources import json_edge, manifests
from ..sources.digests import file_digests, write_files
from .curation import validation
from .near import near_gated
from .registry import SQL, Tables, query, view, with_views
from .session import shared_path

view("paper", """SELECT doc_id AS id, source, text || chr(10) AS original, lang || ':' || source || chr(10) AS rights FROM documents WHERE text IS NOT NULL""")
view("shelf", """SELECT id, CASE WHEN id % 11 = 3 THEN 'x' || original ELSE original END AS original FROM {paper} WHERE id % 13 <> 5""")
view("faults", """SELECT id, 'source-integrity' AS code, CASE WHEN id % 13 = 5 THEN 'missing' ELSE 'changed' END AS state FROM {paper} WHERE id % 13 = 5 OR id % 11 = 3
  UNION ALL SELECT id, 'rights-integrity', CASE WHEN id % 23 = 7 THEN 'missing' ELSE 'changed' END FROM {paper} WHERE id % 23 = 7 OR id % 19 = 4
  UNION ALL SELECT id, 'source-record-integrity', 'changed' FROM {paper} WHERE id % 17 = 2""")


def papers(t: Tables) -> DataFrame:
    return t.documents.where("text IS NOT NULL").select(
        F.col("doc_id").alias("id"), "source", F.concat("text", F.lit("\n")).alias("original"), F.concat("lang", F.lit(":"), "source", F.lit("\n")).alias("rights"))


def shelved(rows: DataFrame, name: str) -> DataFrame:
    """(id, path, length, sha256) of files, one a row of (id, text), written and read again as files."""
    folder = shared_path(rows.sparkSession, name)
    # A line without text is an empty line.
    write_files(rows.select("id", F.coalesce("text", F.lit("\n")).alias("content")), folder)
    return file_digests(rows.sparkSession, folder).select(F.regexp_extract("path", "/id=(-?[0-9]+)$", 1).try_cast("long").alias("id"), "path", "length", "sha256")


def originals(t: Tables) -> DataFrame:
    """Originals of which some are gone and some were written over."""
    kept = papers(t).where("id % 13 <> 5")
    return shelved(kept.select("id", F.when(F.col("id") % 11 == 3, F.concat(F.lit("x"), "original")).otherwise(F.col("original")).alias("text")), "originals")


def faults(t: Tables) -> DataFrame:
    p = papers(t)
    evidence = shelved(p.where("id % 23 <> 7").select("id", F.when(F.col("id") % 19 == 4, F.concat(F.lit("x"), "rights")).otherwise(F.col("rights")).alias("text")), "rights")
    records = p.select("id", "source", F.sha2("original", 256).alias("sha256"))
    stored = canonical("id", "source", "sha256")
    records = records.withColumn("stored", F.sha2(F.when(F.col("id") % 17 == 2, F.concat(stored, F.lit(" "))).otherwise(stored), 256))
    return (I.file_integrity(p.select("id", F.sha2("original", 256).alias("sha256")), originals(t), "source-integrity")
            .unionByName(I.file_integrity(p.select("id", F.sha2("rights", 256).alias("sha256")), evidence, "rights-integrity"))
            .unionByName(I.record_integrity(records, "stored", "id", "source", "sha256")))


@query("SELECT * FROM faults", "faults")
def integrity(t: Tables) -> DataFrame:
    """Originals, rights evidence and records that are not what was registered."""
    return faults(t)


@query(f"""SELECT code, CAST(sum(rows) AS BIGINT) AS rows FROM (SELECT code, rows FROM ({SQL['validation']})
  UNION ALL SELECT code, count(*) FROM ({SQL['near_blockers']}) GROUP BY 1
  UNION ALL SELECT code, count(*) FROM ({with_views('SELECT * FROM faults', 'faults')}) GROUP BY 1) GROUP BY code""")
def full_validation(t: Tables) -> DataFrame:
    """Everything that blocks an export: rules and lineage, equal and near duplicates, files and records."""
    found = validation(t).unionByName(near_blockers(near_gated(t)).groupBy("code").agg(F.count(F.lit(1)).alias("rows"))).unionByName(
        faults(t).groupBy("code").agg(F.count(F.lit(1)).alias("rows")))
    return found.groupBy("code").agg(F.sum("rows").alias("rows"))


@query("SELECT 'local-' || substr(sha256(original), 1, 20) AS id, sha256(original) AS sha256, CAST(any_value(strlen(original)) AS BIGINT) AS bytes FROM shelf GROUP BY sha256(original)", "shelf")
def document_identities(t: Tables) -> DataFrame:
    """Documents by their bytes: equal files are one."""
    return manifests.document_sources(originals(t)).select("id", "sha256", "bytes")


@query("""SELECT id, CASE WHEN id % 13 = 5 THEN 'missing' ELSE 'different' END AS reason FROM paper WHERE id % 13 = 5 OR id % 11 = 3""", "paper")
def changed_files(t: Tables) -> DataFrame:
    """Files that disagree with the digests a run was started from."""
    named = originals(t).select(F.col("id").cast("string").alias("path"), "sha256")
    expected = papers(t).select(F.col("id").cast("string").alias("name"), F.sha2("original", 256).alias("sha256"))
    return manifests.changed_inputs(named, expected).select(F.col("name").cast("long").alias("id"), "reason")


# --- snapshots --------------------------------------------------------------

view("first", "SELECT doc_id AS id, lang, sha256(coalesce(text, '')) AS sha FROM documents")
view("later", """SELECT id, CASE WHEN id % 50 = 1 THEN lang || '!' ELSE lang END AS lang, sha FROM {first} WHERE id % 70 <> 2
  UNION ALL SELECT -id - 1, lang, sha FROM {first} WHERE id % 90 = 3""")


def first(t: Tables) -> DataFrame:
    return t.documents.select(F.col("doc_id").alias("id"), "lang", F.sha2(F.coalesce("text", F.lit("")), 256).alias("sha"))


def later(t: Tables) -> DataFrame:
    rows = first(t)
    return rows.where("id % 70 <> 2").withColumn("lang", F.when(F.col("id") % 50 == 1, F.concat("lang", F.lit("!"))).otherwise(F.col("lang"))).unionByName(
        rows.where("id % 90 = 3").withColumn("id", -F.col("id") - 1))


_leaf = """SELECT substr(sha256(CAST(id AS VARCHAR)), 1, 4) AS prefix, sha256(string_agg(sha256('{"id":' || id || ',"lang":"' || lang || '","sha":"' || sha || '"}'), ''
  ORDER BY sha256(CAST(id AS VARCHAR)))) AS digest, count(*) AS rows FROM later GROUP BY 1"""
for _size in (3, 2, 1, 0):
    _leaf = f"SELECT substr(prefix, 1, {_size}) AS prefix, sha256(string_agg(digest, '' ORDER BY prefix)) AS digest, CAST(sum(rows) AS BIGINT) AS rows FROM ({_leaf}) GROUP BY 1"


@query(f"SELECT rows, digest FROM ({_leaf})", "later")
def snapshot_root(t: Tables) -> DataFrame:
    """The name of a snapshot: the root over its rows."""
    path = shared_path(t.spark, "snapshot")
    M.write(later(t), "id", path)
    return M.root(t.spark, path)


@query("""SELECT coalesce(a.id, b.id) AS id, CASE WHEN b.id IS NULL THEN 'missing' WHEN a.id IS NULL THEN 'extra' ELSE 'changed' END AS state
  FROM first a FULL JOIN later b ON a.id = b.id WHERE a.id IS NULL OR b.id IS NULL OR a.lang <> b.lang OR a.sha <> b.sha""", "first", "later")
def snapshot_changes(t: Tables) -> DataFrame:
    """Rows that differ between two snapshots, found from their roots down."""
    old, new = shared_path(t.spark, "snapshot"), shared_path(t.spark, "snapshot")
    M.write(first(t), "id", old)
    M.write(later(t), "id", new)
    return M.changes(t.spark, old, new, "id")


# --- JSON records -----------------------------------------------------------

#: What a record must hold, and its most bytes.
RECORD = {"id": ("$.id", "bigint"), "lang": ("$.lang", "string"), "chars": ("$.meta.chars", "bigint"), "score": ("$.meta.score", "double")}
LONGEST = 2000
_RECORD = """'{"id":' || CAST(doc_id AS STRING) || CASE WHEN doc_id % 17 = 4 THEN '' ELSE ',"lang":"' || lang || '"' END || ',"meta":{"chars":' || CASE WHEN doc_id % 11 = 2 THEN '"many"' ELSE CAST(n_chars AS STRING) END
  || ',"score":' || CASE WHEN doc_id % 13 = 3 THEN '"NaN"' WHEN doc_id % 13 = 4 THEN 'null' ELSE CAST(n_chars % 97 AS STRING) || '.5' END || '},"pad":"' || repeat('x', CAST(n_chars % 3000 AS INT)) || '"'
  || CASE WHEN doc_id % 7 = 1 THEN '' ELSE '}' END"""


@query(f"""WITH r AS (SELECT {_RECORD} AS t FROM documents WHERE n_chars IS NOT NULL AND lang IS NOT NULL),
  k AS (SELECT sha256(t) AS line, strlen(t) AS n, json_valid(t) AS ok, CASE WHEN json_valid(t) THEN t END AS t FROM r)
  SELECT line, 'oversize' AS code FROM k WHERE n > {LONGEST}
  UNION ALL SELECT line, 'malformed' FROM k WHERE n <= {LONGEST} AND NOT ok
  UNION ALL SELECT line, 'missing:lang' FROM k WHERE n <= {LONGEST} AND ok AND json_extract_string(t, '$.lang') IS NULL
  UNION ALL SELECT line, 'type:chars' FROM k WHERE n <= {LONGEST} AND ok AND json_type(t, '$.meta.chars') NOT IN ('UBIGINT', 'BIGINT')
  UNION ALL SELECT line, 'missing:score' FROM k WHERE n <= {LONGEST} AND ok AND json_extract_string(t, '$.meta.score') IS NULL
  UNION ALL SELECT line, 'non-finite:score' FROM k WHERE n <= {LONGEST} AND ok AND NOT isfinite(TRY_CAST(json_extract_string(t, '$.meta.score') AS DOUBLE))""")
def json_violations(t: Tables) -> DataFrame:
    """Records written as JSON lines and read again, some of them broken."""
    folder = shared_path(t.spark, "records")
    t.documents.where("n_chars IS NOT NULL AND lang IS NOT NULL").select(F.expr(_RECORD).alias("value")).write.text(folder)
    return json_edge.violations(t.spark.read.text(folder), "value", RECORD, LONGEST)
