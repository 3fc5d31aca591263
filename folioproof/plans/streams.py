"""Stream queries over logs that arrive out of order and in many triggers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, Window, functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..streaming.ordered import batch_fold, ordered_fold
from ..streaming.runs import liveness
from ..streaming.upserts import BucketTable, keep_latest
from .registry import Tables, query, view
from .session import shared_path, shuffle_partitions

#: Triggers that a log arrives in, how far rows stray from their order, and the delay that the stream allows.
FILES, STRAY, DELAY = 5, 3 * 86400, "4 days"
#: Rows of a file, so that a trigger brings as many files as its rows keep tasks busy.
FILE_ROWS = 100_000
#: Rows of the whole log in a bucket of pages, which a task holds at a time.
BUCKET_ROWS = 50_000


def arriving(rows: DataFrame, name: str, closing: DataFrame | None = None) -> DataFrame:
    """``rows`` as a stream of FILES triggers, in which rows stray up to STRAY seconds from the order of ``at``.

    Every trigger brings the same number of files, about FILE_ROWS rows each.  The last one holds
    ``closing``, which moves the watermark past all others.
    """
    spark = rows.sparkSession
    folder = shared_path(spark, name)
    # The log is worked out once; triggers are cut from what was stored.
    stored = shared_path(spark, name + "-log")
    rows.write.parquet(stored)
    rows = spark.read.schema(rows.schema).parquet(stored)
    strayed = F.unix_seconds("at") + F.pmod(F.xxhash64("id"), F.lit(STRAY))
    span = rows.agg(F.min(F.unix_seconds("at")).alias("a"), F.max(F.unix_seconds("at")).alias("b"), F.count(F.lit(1)).alias("n")).first()
    first, step = span["a"] or 0, ((span["b"] or 0) - (span["a"] or 0) + STRAY) // FILES + 1
    files = span["n"] // (FILES * FILE_ROWS) + 1

    def arrive(part: DataFrame, done: int) -> None:
        (part.coalesce(1) if files == 1 else part.repartition(files)).write.mode("append").parquet(folder)
        # Spark leaves out files without rows, but a trigger takes as many files as it is told.
        for _ in range((done + 1) * files - len(spark.read.schema(rows.schema).parquet(folder).inputFiles())):
            part.limit(0).coalesce(1).write.mode("append").parquet(folder)

    # One write a trigger: files arrive in the order of writing.
    for k in range(FILES):
        arrive(rows.where((strayed >= first + k * step) & (strayed < first + (k + 1) * step)), k)
    if closing is not None:
        arrive(closing, FILES)
    return spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", files).parquet(folder)


def finish(writer: DataStreamWriter) -> None:
    """Run a stream over what has arrived, with state in RocksDB."""
    spark = writer._spark
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        writer.trigger(availableNow=True).start().awaitTermination()
    finally:
        spark.conf.set(provider, before)


def drained(df: DataFrame, name: str) -> DataFrame:
    target, state = shared_path(df.sparkSession, name), shared_path(df.sparkSession, name + "-state")
    finish(df.writeStream.format("parquet").option("path", target).option("checkpointLocation", state))
    return df.sparkSession.read.schema(df.schema).parquet(target)


view("sent", """SELECT user_id AS sample, event_id AS id, ts, 'c' || (event_id % 3) AS content, CAST(event_id % 5 AS VARCHAR) AS reviewer,
  event_id % 4 <> 0 AS human, event_id % 11 = 0 AS odd FROM events""")
view("lead", """SELECT *, NOT odd AND (human OR coalesce(ts < min(ts) FILTER (WHERE human AND NOT odd) OVER (PARTITION BY sample), true)) AS counts FROM {sent}""")
view("asked", """SELECT *, CAST(coalesce(sum(CASE WHEN counts AND content IS DISTINCT FROM before THEN 1 ELSE 0 END) OVER (
    PARTITION BY sample ORDER BY ts, id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) - CASE WHEN odd THEN 1 ELSE 0 END AS BIGINT) AS claim,
  row_number() OVER (PARTITION BY sample ORDER BY ts, id) AS rn
  FROM (SELECT *, lag(content) OVER (PARTITION BY sample, counts ORDER BY ts, id) AS before FROM {lead})""")

FOLD = """RECURSIVE
 fold(sample, rn, id, outcome, revision, content, accepted, reviewers, humans) AS (
  SELECT DISTINCT sample, 0::BIGINT, NULL::BIGINT, '', 0::BIGINT, NULL::VARCHAR, false, []::VARCHAR[], []::VARCHAR[] FROM asked
  UNION ALL
  SELECT n.sample, n.rn, n.id, n.outcome,
    CASE WHEN n.outcome = 'correction' THEN n.revision + 1 ELSE n.revision END,
    CASE WHEN n.outcome = 'correction' THEN n.said ELSE n.content END,
    CASE n.outcome WHEN 'correction' THEN n.human WHEN 'confirmation' THEN n.human OR len(n.humans) > 0 WHEN 'idempotent' THEN n.accepted OR n.human ELSE n.accepted END,
    CASE n.outcome WHEN 'correction' THEN [n.reviewer] WHEN 'confirmation' THEN list_append(n.reviewers, n.reviewer) ELSE n.reviewers END,
    CASE WHEN n.outcome = 'correction' AND n.human THEN [n.reviewer] WHEN n.outcome = 'correction' THEN [] WHEN n.outcome = 'confirmation' AND n.human THEN list_append(n.humans, n.reviewer) ELSE n.humans END
  FROM (SELECT a.sample, a.rn, a.id, a.content AS said, a.reviewer, a.human, f.revision, f.content, f.accepted, f.reviewers, f.humans,
      CASE WHEN a.content IS NOT DISTINCT FROM f.content AND a.claim IN (f.revision, f.revision - 1)
             AND CASE WHEN a.human THEN list_contains(f.humans, a.reviewer) ELSE list_contains(f.reviewers, a.reviewer) AND NOT list_contains(f.humans, a.reviewer) END THEN 'idempotent'
           WHEN a.claim <> f.revision THEN 'stale'
           WHEN a.content IS DISTINCT FROM f.content AND f.accepted AND NOT a.human THEN 'nonhuman-overwrite'
           WHEN a.content IS NOT DISTINCT FROM f.content AND list_contains(f.reviewers, a.reviewer) THEN 'own-confirmation'
           WHEN a.content IS DISTINCT FROM f.content THEN 'correction' ELSE 'confirmation' END AS outcome
    FROM fold f JOIN asked a ON a.sample = f.sample AND a.rn = f.rn + 1) n)
 SELECT sample, id, outcome, revision, content, accepted FROM fold WHERE rn > 0"""


def submissions(t: Tables) -> DataFrame:
    """Events as submissions of people and machines, most of them for the revision they would find, some for the one before."""
    e = F.col("event_id")
    rows = t.events.select(F.col("user_id").alias("sample"), e.alias("id"), F.col("ts").cast("timestamp").alias("at"), F.concat(F.lit("c"), (e % 3).cast("string")).alias("content"),
                           (e % 5).cast("string").alias("reviewer"), (e % 4 != 0).alias("human"), (e % 11 == 0).alias("odd"))
    page = Window.partitionBy("sample")
    first = F.min(F.when(F.col("human") & ~F.col("odd"), F.col("at"))).over(page)
    rows = rows.withColumn("counts", ~F.col("odd") & (F.col("human") | F.coalesce(F.col("at") < first, F.lit(True))))
    rows = rows.withColumn("before", F.lag("content").over(Window.partitionBy("sample", "counts").orderBy("at", "id")))
    changed = (F.col("counts") & ~F.col("content").eqNullSafe(F.col("before"))).cast("long")
    earlier = page.orderBy("at", "id").rowsBetween(Window.unboundedPreceding, -1)
    return rows.withColumn("revision", F.coalesce(F.sum(changed).over(earlier), F.lit(0)) - F.col("odd").cast("long")).select(
        "sample", "revision", "content", "reviewer", "human", "at", "id")


@query(FOLD, "asked")
def folded_reviews(t: Tables) -> DataFrame:
    """All outcomes of a review log, as one table."""
    return batch_fold(submissions(t))


@query(FOLD, "asked")
def stream_ordered_reviews(t: Tables) -> DataFrame:
    """The same outcomes from rows that arrive out of order over several triggers."""
    rows = submissions(t)
    closing = rows.agg(F.max("at").alias("last")).select(
        F.lit(-1).cast("long").alias("sample"), F.lit(0).cast("long").alias("revision"), F.lit("").alias("content"), F.lit("").alias("reviewer"), F.lit(True).alias("human"),
        F.expr("last + interval 30 days").alias("at"), F.lit(-1).cast("long").alias("id"))
    buckets = max(t.events.count() // BUCKET_ROWS, 2 * shuffle_partitions(rows))
    out = drained(ordered_fold(arriving(rows, "submissions", closing), DELAY, buckets), "ordered-reviews")
    return out.where("sample >= 0")


@query("""SELECT worker, last_ms FROM (SELECT user_id AS worker, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1)
  WHERE last_ms + 86400000 <= (SELECT epoch_us(max(ts)) // 1000 - 60000 FROM events)""")
def stream_silences(t: Tables) -> DataFrame:
    """Workers silent for a day at the end of the log, as their timers report them."""
    beats = arriving(t.events.select(F.col("event_id").alias("id"), F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("at")), "beats")
    out = drained(liveness(beats, 86400, "1 minute"), "silences")
    last = out.groupBy("worker").agg(F.max("last_ms").alias("last_ms"))
    return out.where("stale").select("worker", "last_ms").join(last, ["worker", "last_ms"])


def kept_latest(rows: DataFrame, key: list[str], version: str, name: str, after: Callable[[BucketTable], None] | None = None) -> DataFrame:
    """The table that a stream of ``rows`` keeps."""
    spark = rows.sparkSession
    table = BucketTable(spark, shared_path(spark, name), rows.schema, key, version)
    finish(keep_latest(arriving(rows, name + "-log"), table, shared_path(spark, name + "-state")))
    if after:
        after(table)
    return table.read()


@query("""SELECT user_id AS sample, event_type AS kind, epoch_us(max(ts)) AS at_us, arg_max(event_id, (ts, event_id)) AS id FROM events GROUP BY 1, 2""")
def stream_latest_results(t: Tables) -> DataFrame:
    """The latest result of each page and kind, kept by a stream whose rows come out of order, with its second batch sent again."""
    rows = t.events.select(F.col("user_id").alias("sample"), F.col("event_type").alias("kind"), F.col("event_id").alias("id"), F.col("ts").cast("timestamp").alias("at"),
                           F.struct(F.unix_micros(F.col("ts").cast("timestamp")).alias("at_us"), F.col("event_id").alias("id")).alias("version"))
    again = rows.where("id % 3 = 0")
    found = kept_latest(rows, ["sample", "kind"], "version", "results", lambda table: table.apply(again, 1))
    return found.select("sample", "kind", F.unix_micros("at").alias("at_us"), "id")
