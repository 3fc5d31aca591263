"""Document fingerprints from spot signatures, with DataFrame functions only.

A spot is an occurrence of a common word; its signature is that word with the CHAIN content
words that follow it.  A text's fingerprint is the set of its signatures.  The likeness of two
sets is Jaccard.  The query compares each text with two given ones and makes no search of all
pairs, so dealing sets to bands by their length (:func:`band`) and leaving out pairs by their
lengths (``least`` of :func:`likeness`) are for callers and unused in it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from ..plans.session import shuffle_partitions

#: Common words of English, German, French and Spanish that open spots.
ANCHORS = """a an and are as at be by for from has in is it of on or that the this to was with
das dem den der des die ein eine für ist mit nicht sich und von zu
au avec ce dans de des du elle en est et il la le les par pas pour que qui sur un une
al como con de del el en es la las los más no para por que se su un una y""".split()
#: Content words of a signature, and words after a common one among which they are sought.
CHAIN, REACH = 2, 8
MOST_BANDS = 1024


def _let(value: Column, then) -> Column:
    """``then(value)`` with the value worked out once."""
    return F.transform(F.array(value), then)[0]


def signatures(text: Column, anchors: list[str] = ANCHORS, chain: int = CHAIN, reach: int = REACH) -> Column:
    """Sorted distinct signature hashes; a text with words but no full spot has one of all its words, one without words none."""
    common = sorted(set(anchors))

    def spots(words: Column) -> Column:
        def one(i: Column) -> Column:
            content = F.filter(F.slice(words, i + 2, F.lit(reach)), lambda w: ~w.isin(common))
            return F.concat(F.array(F.get(words, i)), F.slice(content, 1, chain))

        at = F.filter(F.sequence(F.lit(0), F.size(words) - 1), lambda i: F.get(words, i).isin(common))
        found = F.filter(F.transform(at, one), lambda c: F.size(c) == chain + 1)
        hashes = _let(F.transform(found, lambda c: F.xxhash64(c)),
                      lambda h: F.when(F.size(h) > 0, F.array_sort(F.array_distinct(h))).otherwise(F.array(F.xxhash64(words))))
        return F.when(F.size(words) > 0, hashes).otherwise(F.array().cast("array<bigint>"))

    return _let(F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+"), lambda w: w != ""), spots)


def name(signature: Column) -> Column:
    """The fingerprint as text: the length of the set and a digest of it."""
    return F.concat(F.size(signature).cast("string"), F.lit("-"), F.sha2(F.array_join(signature.cast("array<string>"), ","), 256))


def band(signature: Column, least: float) -> Column:
    """Sets in bands more than one apart differ too much in length to have the least likeness."""
    return F.floor(F.log(F.greatest(F.size(signature), F.lit(1)).cast("double")) / F.log(F.lit(1 / least))).cast("int")


def likeness(a: Column, b: Column, least: float = 0.0) -> Column:
    """Jaccard of two sets, 1 for two empty ones; 0 without comparing where lengths already bound it below ``least``."""
    small, large = F.least(F.size(a), F.size(b)), F.greatest(F.size(a), F.size(b))
    both = F.size(F.array_intersect(a, b))
    return (F.when(large == 0, 1.0).when((small == 0) | (small < large * least), 0.0)
            .otherwise(_let(both, lambda i: i / (F.size(a) + F.size(b) - i))))


def _values(spark, rows: list[tuple], names: list[str]) -> DataFrame:
    """A few literal rows."""
    parts = [F.struct(*[F.lit(v).cast("long").alias(n) for v, n in zip(r, names)]) for r in rows]
    return spark.range(1).select(F.inline(F.array(*parts)))


def beside_next(rows: DataFrame, carried: list[str]) -> DataFrame:
    """Rows (k, h, ...) with ``next_<name>`` of the next row by descending k, the first again after the last.

    Ties go by h; rows without k come last.  Rows are dealt to ranges of k, bounded by
    quantiles (MOST_BANDS numbers at most), and each range also gets the first row of the next
    one, so one shuffle of the rows is enough and no task orders all of them.
    """
    spark = rows.sparkSession
    parts = min(MOST_BANDS, 4 * shuffle_partitions(rows))
    marks = rows.select(F.percentile_approx("k", [i / parts for i in range(1, parts)], 10_000)).first()[0] if parts > 1 else []
    marks = sorted(set(marks or []))
    inside = F.size(F.filter(F.array(*[F.lit(m) for m in marks]).cast("array<bigint>"), lambda m: m <= F.col("k"))).cast("long")
    rows = rows.withColumn("_range", F.when(F.col("k").isNull(), F.lit(-1).cast("long")).otherwise(inside if marks else F.lit(0).cast("long")))
    first = rows.groupBy("_range").agg(F.max(F.struct("k", (-F.col("h").cast("decimal(20,0)")).alias("m"), "h")).alias("f")).select("_range", "f.k", "f.h")
    firsts = sorted(first.collect(), key=lambda r: -r["_range"])
    if not firsts:
        return rows.select("*", *[F.col(c).alias(f"next_{c}") for c in carried]).drop("_range")
    ghosts = _values(spark, [(r["_range"], r["k"], r["h"], firsts[i - 1]["_range"]) for i, r in enumerate(firsts)], ["r", "gk", "gh", "into"])
    rows = rows.join(F.broadcast(ghosts), (F.col("_range") == F.col("r")) & F.col("k").eqNullSafe(F.col("gk")) & (F.col("h") == F.col("gh")), "left")
    own = F.struct(F.col("_range").alias("at"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("into").alias("at"), F.lit(1).alias("ghost"))
    rows = rows.withColumn("_place", F.explode(F.when(F.col("into").isNull(), F.array(own)).otherwise(F.array(own, ghost))))
    order = Window.partitionBy("_place.at").orderBy("_place.ghost", F.col("k").desc_nulls_last(), "h")
    rows = rows.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return rows.where("_place.ghost = 0").drop("_range", "_place", "r", "gk", "gh", "into")


def fingerprints(docs: DataFrame, doc: str = "doc_id", text: str = "text", least: float = 0.0) -> DataFrame:
    """(doc, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next) of every row.

    The edited text has its second half replaced by the beginning of the next document, by
    descending id.  Null texts are empty; repeated ids go by the hash of their text; rows
    without id come last; a single row is its own next.  Other columns are not read.
    """
    rows = docs.select(F.col(doc).cast("long").alias("k"), F.coalesce(F.col(text), F.lit("")).alias("t"))
    rows = beside_next(rows.withColumn("h", F.xxhash64("t")).withColumn("s", signatures(F.col("t"))), ["t", "s"])
    n = F.length("t")
    half = F.floor(n / 2).cast("int")
    edited = F.concat(F.substring(F.col("t"), F.lit(1), n - half), F.substring(F.col("next_t"), F.lit(1), half))
    rows = rows.select("k", "s", "next_s", n.cast("long").alias("n_chars"), edited.alias("e"))
    rows = rows.select("*", F.sha2("e", 256).alias("edited_sha256"), signatures(F.col("e")).alias("es"))
    return rows.select(F.col("k").alias(doc), "n_chars", "edited_sha256", name(F.col("s")).alias("fingerprint"),
                       name(F.col("es")).alias("edited_fingerprint"), likeness(F.col("s"), F.col("es"), least).alias("near_edited"),
                       likeness(F.col("s"), F.col("next_s"), least).alias("near_next"))
