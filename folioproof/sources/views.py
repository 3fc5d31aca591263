"""Projections of the driver tables onto the engine's relations.

The tables stand in for a curated corpus: documents are pages of twenty sources, events
are a review log, embeddings carry codes, class scores, boxes and small rasters, lineitem
is an attempt ledger.  Every view keeps all rows of its table.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from ..functions import geometry as G
from ..functions.labels import label_array
from ..functions.scalar import texts
from ..operators.recipes import EFFECTS

DIMS = 64


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def sources(documents: DataFrame) -> DataFrame:
    """One row per source with split and lineage; artwork groups cross the splits."""
    n = F.substring("id", 4, 10).cast("int")
    split = (F.when(F.col("n") % 10 < 6, "train").when(F.col("n") % 10 < 8, "dev")
             .when(F.col("n") % 10 == 8, "qualification").otherwise("regression"))
    named = documents.select(F.col("source").alias("id")).distinct().withColumn("n", n)

    def token(prefix: str, value: Column) -> Column:
        return F.array(F.concat(F.lit(prefix), value.cast("string")))

    return named.select(
        "id", "n", split.alias("split"), F.sha2(F.col("id"), 256).alias("sha256"),
        F.struct(F.array("id").alias("document"), token("ed", F.col("n")).alias("edition"),
                 token("art", F.floor(F.col("n") / 4)).alias("artwork"), token("par", F.col("n")).alias("parent")).alias("lineage"),
        F.array(F.concat(F.lit("c"), (F.col("n") % 3).cast("string")), F.lit("print")).alias("conditions"))


def exclusions(documents: DataFrame, labels: DataFrame, percent: int = 7) -> DataFrame:
    """Sources of which at least ``percent`` in a hundred documents are toxic."""
    rows = documents.select("doc_id", "source").join(labels.select("doc_id", "toxic"), "doc_id", "left")
    shares = rows.groupBy("source").agg(F.count_if(F.col("toxic") == 1).alias("bad"), F.count(F.lit(1)).alias("n"))
    return shares.where(f"bad * 100 >= n * {percent}").select("source", F.lit("toxic").alias("reason"))


def samples(documents: DataFrame, labels: DataFrame) -> DataFrame:
    kind = (F.when(F.col("lang") == "en", "boards").when(F.col("lang") == "fr", "negative")
            .when(F.col("lang") == "de", "partial").otherwise("unsupported"))
    quality = labels.select("doc_id", (F.col("quality") == 1).alias("accepted"))
    return documents.join(quality, "doc_id", "left").select(
        F.col("doc_id").alias("id"), "source", F.col("doc_id").alias("page"), F.sha2("text", 256).alias("sha"),
        kind.alias("kind"), F.col("n_chars").alias("width"), F.expr("n_chars div 2 + 1").alias("height"),
        (F.col("doc_id") % 3).cast("long").alias("revision"), F.col("lang").alias("content"),
        F.coalesce("accepted", F.lit(False)).alias("accepted"),
        F.when(F.col("lang") == "en", F.col("doc_id") % 3 + 1).otherwise(0).cast("long").alias("boards"))


def review_log(events: DataFrame) -> DataFrame:
    return events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("sample"), F.col("ts").alias("at"),
        F.col("event_type").alias("content"), (F.col("event_id") % 7).cast("string").alias("reviewer"),
        (F.col("event_type") != "error").alias("human"), F.col("value").alias("seconds"))


def dim(i: int) -> Column:
    return F.col("embedding")[i].cast("double")


def codes(embeddings: DataFrame) -> DataFrame:
    """60-bit sign codes, each with a copy whose low vec_id % 7 bits are flipped."""
    code = F.expr(" + ".join(f"if(embedding[{i}] > 0, {1 << i}L, 0L)" for i in range(60)))
    own = embeddings.select(F.col("vec_id").alias("id"), code.alias("phash"))
    flips = F.element_at(F.array(*[F.lit((1 << k) - 1).cast("long") for k in range(7)]), (F.col("id") % 7 + 1).cast("int"))
    return own.unionByName(own.select((F.col("id") + 1000000).alias("id"), F.col("phash").bitwiseXOR(flips).alias("phash")))


def squares(embeddings: DataFrame, first: int = 0) -> DataFrame:
    board = F.expr("vec_id div 8")
    return embeddings.select(
        board.alias("board"), (F.col("vec_id") % 8).cast("int").alias("pos"), F.col("label").alias("truth"),
        F.when(board % 2 == 0, "white-bottom").otherwise("black-bottom").alias("orientation"),
        F.array(*[dim(first + i) * 40 for i in range(13)]).alias("logits"))


def truth_boxes(embeddings: DataFrame) -> DataFrame:
    """All true boxes with page and number; pages 8 and 9 of ten have none."""
    b = boxes(embeddings)
    return b.where(~(F.col("page") % 10).isin(8, 9)).select("page", "number", "x0", "y0", "x1", "y1")


def boxes(embeddings: DataFrame) -> DataFrame:
    x0, y0 = 300 + 800 * dim(0), 300 + 800 * dim(1)
    return embeddings.select(
        F.col("vec_id"), F.expr("vec_id div 4").alias("page"), (F.col("vec_id") % 4).alias("number"), x0.alias("x0"),
        y0.alias("y0"), (x0 + 60 + 400 * F.abs(dim(2))).alias("x1"), (y0 + 60 + 400 * F.abs(dim(3))).alias("y1"))


def predicted_boxes(embeddings: DataFrame) -> DataFrame:
    b = boxes(embeddings.select("*")).join(
        embeddings.select("vec_id", (60 * dim(4)).alias("dx"), (60 * dim(5)).alias("dy"), F.abs(dim(6)).alias("score")), "vec_id")
    return b.select("page", F.col("number").alias("rank"), *[
        (F.col(c) + F.col("d" + c[0])).alias(c) for c in ("x0", "y0", "x1", "y1")], "score")


def detector_pages(embeddings: DataFrame) -> DataFrame:
    pages = embeddings.select(F.expr("vec_id div 4").alias("page")).distinct()
    effect = F.element_at(texts(EFFECTS), (F.col("page") % 4 + 1).cast("int"))
    return pages.select("page", F.when(F.col("page") % 10 == 8, "negative").when(F.col("page") % 10 == 9, "partial")
                        .otherwise("boards").alias("kind"), effect.alias("effect"),
                        F.concat(F.lit("layout-"), (F.col("page") % 3).cast("string")).alias("layout"))


def quad(skew: float = 20.0) -> Column:
    """Corners of a slightly irregular board around the box of a vector."""
    x0, y0 = 300 + 800 * dim(0), 300 + 800 * dim(1)
    x1, y1 = x0 + 60 + 400 * F.abs(dim(2)), y0 + 60 + 400 * F.abs(dim(3))
    return F.array(G.point(x0, y0), G.point(x1, y0 + skew * dim(8)), G.point(x1 + skew * dim(9), y1),
                   G.point(x0, y1 + skew * dim(10)))


def class_of_dim() -> Column:
    """64 classes from the dimensions."""
    return F.transform("embedding", lambda x: (F.floor(F.abs(x.cast("double")) * 60) % 13).cast("int"))


def label_names(classes: Column) -> Column:
    return F.transform(classes, lambda c: F.element_at(label_array(), c + 1))


def boards(embeddings: DataFrame) -> DataFrame:
    """One annotated board per vector."""
    side = F.when(F.col("label") % 3 == 0, "unknown").when(F.col("label") % 3 == 1, "white-bottom").otherwise("black-bottom")
    return embeddings.select(
        "vec_id", F.expr("vec_id div 4").alias("page"), (F.col("vec_id") % 4).alias("number"),
        quad().alias("corners"), label_names(class_of_dim()).alias("labels"), side.alias("orientation"))


def rasters(embeddings: DataFrame) -> DataFrame:
    """An 8 x 8 grey picture per vector as RGB bytes."""
    grey = F.transform("embedding", lambda x: F.floor((F.least(F.lit(1.0), F.greatest(F.lit(-1.0), x.cast("double"))) + 1) * 127.5).cast("int"))
    text = F.array_join(F.transform(grey, lambda g: F.repeat(F.lpad(F.hex(g), 2, "0"), 3)), "")
    return embeddings.select(F.col("vec_id").alias("page"), F.unhex(text).alias("raster"), F.lit(8).alias("width"),
                             F.lit(8).alias("height"), "label")


def attempts(lineitem: DataFrame) -> DataFrame:
    """Ledger rows; (order, line) repeats like a copied attempt."""
    return lineitem.select(
        F.col("l_orderkey").alias("run"), F.concat_ws("-", "l_orderkey", "l_linenumber").alias("ledger_id"),
        F.col("l_returnflag").alias("segment"), F.col("l_quantity").alias("elapsed_seconds"),
        (F.col("l_linestatus") == "F").alias("inherited"), "l_shipdate", "l_partkey", "l_suppkey", "l_extendedprice")


ATTEMPT_ORDER = ["l_shipdate", "l_partkey", "l_suppkey", "elapsed_seconds", "l_extendedprice"]


def items(documents: DataFrame) -> DataFrame:
    """(item, key): documents of equal text, and runs of five neighbours."""
    return (documents.select(F.col("doc_id").alias("item"), F.sha2("text", 256).alias("key"))
            .unionByName(documents.select(F.col("doc_id").alias("item"), F.concat(F.lit("b"), F.expr("doc_id div 5").cast("string")).alias("key"))))


def curves(events: DataFrame) -> DataFrame:
    """One row per day as a training curve."""
    day = F.datediff(F.to_date("ts"), F.lit("2024-01-01"))
    return events.groupBy((F.col("event_id") % 3).alias("run"), (day * 100).cast("long").alias("step")).agg(
        (F.count_if(F.col("event_type") == "purchase") / F.count(F.lit(1))).alias("recall"),
        F.round(F.avg("value"), 6).alias("nll"), F.count(F.lit(1)).alias("n"))
