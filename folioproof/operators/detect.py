"""Detection: suppression, matching, average precision, strata and the operating point."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from ..functions import geometry as G
from ..functions.labels import unit_interval
from ..plans.ordered import ordered, running, scan
from .matching import dictate_in_rounds, suppress_in_rounds

# The IoU grid of the metric and the admitted rate of false detections.
IOU_GRID = [0.5 + 0.05 * i for i in range(10)]
FALSE_PER_PAGE = 0.05
NO_BOARD_KINDS = ["negative", "partial", "unsupported"]
# Pages with more rows than this never go to one task.  A page within the limits of the
# formats has at most a few thousand rows; at most rows/BIG_PAGE pages can be larger,
# which bounds the broadcast of their keys.
BIG_PAGE = 4_000


def _split_by_size(rows: DataFrame, limit: int) -> tuple[DataFrame, DataFrame]:
    """Pages of ordinary size and the keys of oversized ones."""
    big = rows.groupBy("page").count().where(F.col("count") > limit).select("page")
    return rows.join(F.broadcast(big), "page", "left_anti"), big


def _ious(box: np.ndarray, others: np.ndarray) -> np.ndarray:
    w = np.minimum(box[2], others[:, 2]) - np.maximum(box[0], others[:, 0])
    h = np.minimum(box[3], others[:, 3]) - np.maximum(box[1], others[:, 1])
    shared = np.maximum(w, 0) * np.maximum(h, 0)
    area = (box[2] - box[0]) * (box[3] - box[1])
    areas = (others[:, 2] - others[:, 0]) * (others[:, 3] - others[:, 1])
    return shared / np.maximum(area + areas - shared, 1e-9)


def _survivors(rows: np.ndarray, threshold: float, at_most: int | None) -> list[int]:
    """Places kept by greedy suppression of (x0, y0, x1, y1, class) rows in order."""
    alive = np.ones(len(rows), dtype=bool)
    kept: list[int] = []
    for i in range(len(rows)):
        if not alive[i]:
            continue
        kept.append(i)
        if at_most is not None and len(kept) >= at_most:
            break
        alive[i + 1:] &= ~((_ious(rows[i], rows[i + 1:]) > threshold) & (rows[i + 1:, 4] == rows[i, 4]))
    return kept


def _claims(boxes: np.ndarray, others: np.ndarray, limits: np.ndarray) -> tuple[list, list, list]:
    """Greedy claims of ``boxes`` in order, per limit: place of the truth, IoU and error."""
    free = np.ones((len(limits), len(others)), dtype=bool)
    truths, ious, errors = [], [], []
    for box in boxes:
        t, u, e = [None] * len(limits), [None] * len(limits), [None] * len(limits)
        iou = _ious(box, others) if len(others) else np.zeros(0)
        for k in np.nonzero(limits <= iou.max())[0] if len(iou) else ():
            left = np.where(free[k] & (iou >= limits[k]), iou, -1.0)
            best = int(left.argmax())
            if left[best] >= 0:
                free[k, best] = False
                t[k], u[k], e[k] = best, float(iou[best]), float(np.abs(box[:4] - others[best, :4]).mean())
        truths.append(t)
        ious.append(u)
        errors.append(e)
    return truths, ious, errors


def _cells(low: str, high: str, name: str, spread: bool) -> Column:
    """(level, cell) keys along one axis under which boxes of IoU >= 0.5 meet.

    Such boxes differ in extent by at most a factor two and their centres by less than
    one extent, so with cells of twice the power of two below a box's extent they lie in
    the same or a neighbouring level and cell.
    """
    extent, centre = F.col(high) - F.col(low), (F.col(high) + F.col(low)) / 2
    level = F.floor(F.log2(F.greatest(extent, F.lit(1e-9))))

    def cell(k: Column) -> Column:
        return F.floor(centre / F.pow(F.lit(2.0), k + 1))

    if not spread:
        return F.array(F.struct(level.alias("l"), cell(level).alias("c"))).alias(name)
    return F.flatten(F.transform(F.sequence(level - 1, level + 1), lambda k: F.transform(
        F.sequence(cell(k) - 1, cell(k) + 1), lambda c: F.struct(k.alias("l"), c.alias("c"))))).alias(name)


def overlapping(left: DataFrame, right: DataFrame, least: float, keys: list[str]) -> DataFrame:
    """Pairs with IoU >= least (above 0) by a join on grid cells of both axes.

    Columns: ``keys``, id and edges of each side as ``l_*`` and ``r_*``, and ``iou``.
    """
    if least < 0.5:
        # The cells below are exact from 0.5 on; those of ``touching`` at any threshold.
        found = touching(left, right, keys, least * (1 - 1e-9))
        for df, p in ((left, "l_"), (right, "r_")):
            found = found.join(df.select(*keys, *[F.col(c).alias(p + c) for c in ("id", "x0", "y0", "x1", "y1")]), [*keys, p + "id"])
        return found.withColumn("iou", G.box_iou(G.box("l_"), G.box("r_"))).where(F.col("iou") >= least)

    def side(df: DataFrame, p: str, spread: bool) -> DataFrame:
        named = df.select(*keys, *[F.col(c).alias(p + c) for c in ("id", "x0", "y0", "x1", "y1")],
                          _cells("x0", "x1", "_x", spread), _cells("y0", "y1", "_y", spread))
        return named.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y"))

    joined = side(left, "l_", True).join(side(right, "r_", False), [*keys, "_x", "_y"])
    return (joined.withColumn("iou", G.box_iou(G.box("l_"), G.box("r_"))).where(F.col("iou") >= least)
            .drop("_x", "_y"))


def suppress(candidates: DataFrame, threshold: float, *, by_class: bool = False, at_most: int | None = None,
             given_order: bool = False, big_page: int = BIG_PAGE) -> DataFrame:
    """Greedy non-maximum suppression per page.

    ``candidates`` has page, rank (input order), x0..y1, score and, for ``by_class``,
    class_id.  Highest score first, input order on ties; with ``given_order`` the input
    order alone decides.  ``at_most`` keeps the first of the kept ones, the rule of the
    decoder.  Oversized pages are suppressed in rounds over overlapping pairs.
    """
    columns = candidates.columns
    small, big = _split_by_size(candidates, big_page)

    # A page becomes one row of arrays in suppression order, so a batch of pages is one call.
    turn = F.struct(F.col("rank").alias("a")) if given_order else F.struct((-F.col("score")).alias("a"), F.col("rank").alias("b"))
    listed = small.groupBy("page").agg(F.array_sort(F.collect_list(F.struct(
        turn.alias("turn"), F.struct(*columns).alias("row"), *[F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")],
        (F.col("class_id") if by_class else F.lit(0)).cast("double").alias("k")))).alias("c"))
    flat = F.flatten(F.transform("c", lambda z: F.array(z["x0"], z["y0"], z["x1"], z["y1"], z["k"])))

    @F.pandas_udf("array<int>")
    def survivors(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
        for pages in parts:
            yield pd.Series([_survivors(np.asarray(v, dtype=float).reshape(-1, 5), threshold, at_most) for v in pages], dtype=object)

    done = (listed.withColumn("_kept", survivors(flat)).select("c", F.explode("_kept").alias("_i"))
            .select(F.get("c", F.col("_i"))["row"].alias("r")).select("r.*"))
    rest = candidates.join(F.broadcast(big), "page")
    if big.isEmpty():
        return done
    keys = ["page", "class_id"] if by_class else ["page"]
    nodes = rest.withColumn("id", F.col("rank")).withColumn("turn", turn)
    if threshold < 0.5:
        pairs = touching(nodes, nodes, keys, threshold)
    else:
        pairs = overlapping(nodes, nodes, threshold, keys).where(F.col("iou") > threshold)
    turns = nodes.select(*keys, "id", "turn")
    edges = (pairs.where("l_id <> r_id")
             .join(turns.select(*keys, F.col("id").alias("l_id"), F.col("turn").alias("l_turn")), [*keys, "l_id"])
             .join(turns.select(*keys, F.col("id").alias("r_id"), F.col("turn").alias("r_turn")), [*keys, "r_id"])
             .select(*keys, F.when(F.col("l_turn") < F.col("r_turn"), F.col("l_id")).otherwise(F.col("r_id")).alias("hi"),
                     F.when(F.col("l_turn") < F.col("r_turn"), F.col("r_id")).otherwise(F.col("l_id")).alias("lo"))
             .distinct())
    kept = suppress_in_rounds(nodes, edges, keys).withColumnRenamed("id", "rank")
    out = rest.join(kept, [*keys, "rank"], "left_semi")
    if at_most is not None:
        order = [F.col("rank")] if given_order else [F.col("score").desc(), F.col("rank")]
        out = running(out, ["page"], order, number="_n").where(F.col("_n") <= at_most).drop("_n")
    return done.unionByName(out.select(*columns))


def touching(left: DataFrame, right: DataFrame, keys: list[str], threshold: float) -> DataFrame:
    """(keys, l_id, r_id) of boxes with IoU above ``threshold`` (0: that overlap at all).

    Both boxes of a pair cover a common grid cell at the level of the larger extent.  Extents
    differ by at most 1/threshold, and no level is above that of the largest box there is.
    Boxes without extent overlap nothing.
    """
    def level_of(low: str, high: str) -> Column:
        return F.floor(F.log2(F.col(high) - F.col(low)))

    left, right = (df.where("x1 > x0 AND y1 > y0") for df in (left, right))
    extents = left.select("x0", "y0", "x1", "y1").unionByName(right.select("x0", "y0", "x1", "y1"))
    highest = extents.agg(F.max(F.greatest(level_of("x0", "x1"), level_of("y0", "y1")))).scalar()

    def covered(low: str, high: str, name: str) -> Column:
        level = level_of(low, high)
        top = F.col("_top") if threshold <= 0 else F.least("_top", level + math.ceil(math.log2(1 / threshold)))
        return F.flatten(F.transform(F.sequence(level, top), lambda k: F.transform(
            F.sequence(F.floor(F.col(low) / F.pow(F.lit(2.0), k)), F.floor(F.col(high) / F.pow(F.lit(2.0), k))),
            lambda c: F.struct(k.alias("l"), c.alias("c"))))).alias(name)

    def side(df: DataFrame, p: str) -> DataFrame:
        named = df.withColumn("_top", highest).select(*keys, *[F.col(c).alias(p + c) for c in ("id", "x0", "y0", "x1", "y1")],
                                                      covered("x0", "x1", "_x"), covered("y0", "y1", "_y"))
        return named.withColumn("_x", F.explode("_x")).withColumn("_y", F.explode("_y"))

    return (side(left, "l_").join(side(right, "r_"), [*keys, "_x", "_y"])
            .withColumn("iou", G.box_iou(G.box("l_"), G.box("r_"))).where(F.col("iou") > threshold)
            .select(*keys, "l_id", "r_id").distinct())


def decode(raw: DataFrame, confidence: float, nms_iou: float) -> DataFrame:
    """Centre boxes with objectness and class score to suppressed edges per page.

    ``raw`` has page, rank, cx, cy, w, h, objectness, class_score."""
    scored = raw.select("page", "rank", (F.col("cx") - F.col("w") / 2).alias("x0"),
                        (F.col("cy") - F.col("h") / 2).alias("y0"), (F.col("cx") + F.col("w") / 2).alias("x1"),
                        (F.col("cy") + F.col("h") / 2).alias("y1"),
                        (F.col("objectness") * F.col("class_score")).alias("score"))
    return suppress(scored.where(F.col("score") >= confidence), nms_iou)


def match(predictions: DataFrame, truth: DataFrame, thresholds: list[float] | None = None,
          big_page: int = BIG_PAGE) -> DataFrame:
    """Greedy one-to-one matches in score order, at every threshold in one pass.

    ``predictions``: page, rank, x0..y1, score; ``truth``: page, number, x0..y1.  One row
    per prediction: page, rank, score, and arrays by threshold of the matched truth number
    (null when unmatched), IoU and mean coordinate error.  Ties in IoU go to the lower
    truth number, ties in score to the lower rank.
    """
    thresholds = thresholds or IOU_GRID
    edges = [F.col(c).cast("double").alias(c) for c in ("x0", "y0", "x1", "y1")]
    rows = (predictions.select("page", F.lit(1).alias("side"), F.col("rank").cast("long").alias("n"), *edges,
                               F.col("score").cast("double").alias("score"))
            .unionByName(truth.select("page", F.lit(0).alias("side"), F.col("number").cast("long").alias("n"), *edges,
                                      F.lit(None).cast("double").alias("score"))))
    limits = np.array(thresholds)
    small, big = _split_by_size(rows, big_page)

    def side(which: int, order: Column) -> Column:
        return F.array_sort(F.collect_list(F.when(F.col("side") == which, F.struct(
            order.alias("o"), "n", "x0", "y0", "x1", "y1")))).alias("pt"[1 - which])

    def numbers(c: str) -> Column:
        return F.flatten(F.transform(c, lambda z: F.array(z["x0"], z["y0"], z["x1"], z["y1"])))

    claim_type = "array<struct<truths:array<long>,ious:array<double>,errors:array<double>>>"

    @F.pandas_udf(claim_type)
    def claims(parts: Iterator[tuple[pd.Series, pd.Series, pd.Series]]) -> Iterator[pd.Series]:
        for p, t, names in parts:
            made = []
            for own, other, name in zip(p, t, names):
                found = _claims(np.asarray(own, dtype=float).reshape(-1, 4), np.asarray(other, dtype=float).reshape(-1, 4), limits)
                made.append([{"truths": [None if i is None else int(name[i]) for i in a], "ious": b, "errors": c}
                             for a, b, c in zip(*found)])
            yield pd.Series(made, dtype=object)

    # One row of arrays per page: a batch of pages is one call of the kernel.
    listed = small.groupBy("page").agg(side(1, -F.col("score")), side(0, F.lit(0.0)))
    claimed = listed.where(F.size("p") > 0).select("page", "p", claims(
        numbers("p"), numbers("t"), F.transform("t", lambda z: z["n"])).alias("m"))
    done = claimed.select("page", F.explode(F.arrays_zip("p", "m")).alias("z")).select(
        "page", F.col("z.p.n").alias("rank"), (-F.col("z.p.o")).alias("score"), "z.m.truths", "z.m.ious", "z.m.errors")
    if big.isEmpty():
        return done
    large = rows.join(F.broadcast(big), "page").withColumnRenamed("n", "id")
    pairs = overlapping(large.where("side = 1"), large.where("side = 0"), min(thresholds), ["page"])
    scores = large.where("side = 1").select("page", F.col("id").alias("l_id"), "score")
    steps = F.array(*[F.lit(float(x)) for x in thresholds])
    levels = pairs.join(scores, ["page", "l_id"]).select(
        "page", F.col("l_id").alias("p"), F.col("r_id").alias("t"), "iou", "score",
        ((F.abs(F.col("l_x0") - F.col("r_x0")) + F.abs(F.col("l_y0") - F.col("r_y0"))
          + F.abs(F.col("l_x1") - F.col("r_x1")) + F.abs(F.col("l_y1") - F.col("r_y1"))) / 4).alias("error"),
        F.posexplode(steps).alias("step", "least")).where("iou >= least")
    taken = dictate_in_rounds(levels, ["page", "step"], F.struct(-F.col("score"), F.col("p")),
                              F.struct(F.col("iou"), -F.col("t")))
    found = levels.join(taken, ["page", "step", "p", "t"]).groupBy("page", F.col("p").alias("l_id")).agg(
        F.map_from_entries(F.collect_list(F.struct("step", F.struct("t", "iou", "error")))).alias("m"))

    def by_step(field: str) -> Column:
        return F.array(*[F.col("m")[k][field] for k in range(len(thresholds))])

    wide = scores.join(found, ["page", "l_id"], "left").select(
        "page", F.col("l_id").alias("rank"), "score", by_step("t").alias("truths"),
        by_step("iou").alias("ious"), by_step("error").alias("errors"))
    return done.unionByName(wide)


def precision_recall(matches: DataFrame, truth: DataFrame, thresholds: list[float] | None = None) -> DataFrame:
    """Per threshold: AP over 101 recall levels, final recall and precision.

    Predictions are ranked by score over all pages, pages and ranks breaking ties, by an
    ordered scan.  Precision is then reduced to one maximum per recall level.
    """
    thresholds = thresholds or IOU_GRID
    n = len(thresholds)
    positives = truth.agg(F.count(F.lit(1))).scalar()
    rows = ordered(matches.select("page", "rank", "score", *[
        F.col("truths")[i].isNotNull().cast("long").alias(f"_g{i}") for i in range(n)]),
        [F.col("score").desc(), F.col("page"), F.col("rank")])
    curve = scan(rows, [], number="_rank", sums={f"_tp{i}": F.col(f"_g{i}") for i in range(n)})
    points = curve.select("_rank", F.posexplode(F.array(*[f"_tp{i}" for i in range(n)])).alias("step", "tp"))
    recall = F.col("tp") / F.greatest(F.lit(1), positives)
    guess = F.floor(recall * 100)
    level = (F.when((guess + 1) / 100 <= recall, guess + 1).when(guess / 100 > recall, guess - 1)
             .otherwise(guess).cast("int"))
    best = points.groupBy("step", F.least(F.lit(100), level).alias("level")).agg(
        F.max(F.col("tp") / F.col("_rank")).alias("p"))
    # At most 101 rows per threshold from here on.
    w = Window.partitionBy("step").orderBy("level")
    envelope = best.select(
        "step", "level", F.max("p").over(w.rowsBetween(Window.currentRow, Window.unboundedFollowing)).alias("p"),
        (F.col("level") - F.coalesce(F.lag("level").over(w), F.lit(-1))).alias("levels"))
    ap = envelope.groupBy("step").agg(unit_interval(F.sum(F.col("p") * F.col("levels")) / 101).alias("ap"))
    ends = matches.agg(F.count(F.lit(1)).alias("n"), *[
        F.count(F.col("truths")[i]).alias(f"_m{i}") for i in range(n)]).select(
        "n", F.posexplode(F.array(*[F.struct(F.lit(float(t)).alias("t"), F.col(f"_m{i}").alias("m"))
                                    for i, t in enumerate(thresholds)])).alias("step", "e"))
    return (ends.join(F.broadcast(ap), "step", "left").select(
        F.col("e.t").alias("iou"), F.coalesce("ap", F.lit(0.0)).alias("ap"),
        unit_interval(F.col("e.m") / F.greatest(F.lit(1), positives)).alias("recall"),
        unit_interval(F.col("e.m") / F.greatest(F.lit(1), F.col("n"))).alias("precision")))


def mean_average_precision(table: DataFrame) -> DataFrame:
    return table.agg(unit_interval(F.avg("ap")).alias("ap50_95"))


def no_board_pages(pages: DataFrame, truth: DataFrame, predictions: DataFrame) -> DataFrame:
    """Pages without a valid board and the detections on them, per kind."""
    empty = pages.join(truth.select("page").distinct(), "page", "left_anti").select("page", "kind")
    hits = predictions.groupBy("page").agg(F.count(F.lit(1)).alias("n"))
    return empty.join(hits, "page", "left").groupBy("kind").agg(
        F.count(F.lit(1)).alias("pages"), F.coalesce(F.sum("n"), F.lit(0)).alias("false_detections"))


def _page_totals(pages: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    m = matches.groupBy("page").agg(
        F.count(F.lit(1)).alias("detections"), F.count(F.col("truths")[0]).alias("matched"),
        F.coalesce(F.sum(F.col("ious")[0]), F.lit(0.0)).alias("iou_sum"),
        F.coalesce(F.sum(F.col("errors")[0] / G.DETECTOR_SIZE), F.lit(0.0)).alias("error_sum"))
    t = truth.groupBy("page").agg(F.count(F.lit(1)).alias("targets"))
    return pages.join(t, "page", "left").join(m, "page", "left").fillna(
        0, ["targets", "detections", "matched", "iou_sum", "error_sum"])


def strata(pages: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Targets, matches, false positives, IoU and box error by effect, layout, board count, size.

    The first threshold of ``matches`` is the reporting one.  Misses stay in denominators.
    """
    per_page = _page_totals(pages, truth, matches)
    page_rows = per_page.select(
        "targets", "matched", F.greatest(F.lit(0), F.col("detections") - F.col("matched")).alias("false_positives"),
        "iou_sum", "error_sum", F.col("matched").alias("error_matches"),
        F.explode(F.array(
            F.struct(F.lit("effect").alias("kind"), F.col("effect").alias("name")),
            F.struct(F.lit("layout").alias("kind"), F.col("layout").alias("name")),
            F.struct(F.lit("board_count").alias("kind"), F.col("targets").cast("string").alias("name")))).alias("s"))
    hit = matches.where(F.col("truths")[0].isNotNull()).select(
        "page", F.col("truths")[0].alias("number"), F.col("ious")[0].alias("iou"),
        (F.col("errors")[0] / G.DETECTOR_SIZE).alias("error"))
    size_rows = truth.join(hit, ["page", "number"], "left").select(
        F.lit(1).alias("targets"), F.col("iou").isNotNull().cast("long").alias("matched"),
        F.lit(0).alias("false_positives"), F.coalesce("iou", F.lit(0.0)).alias("iou_sum"),
        F.coalesce("error", F.lit(0.0)).alias("error_sum"), F.col("iou").isNotNull().cast("long").alias("error_matches"),
        F.struct(F.lit("size").alias("kind"), G.size_bucket(G.box()).alias("name")).alias("s"))
    sums = page_rows.unionByName(size_rows).groupBy("s.kind", "s.name").agg(*[
        F.sum(c).alias(c) for c in ("targets", "matched", "false_positives", "iou_sum", "error_sum", "error_matches")])
    one = F.lit(1)
    return sums.select(
        "kind", "name", "targets", "matched", "false_positives",
        (F.col("matched") / F.greatest(one, F.col("targets"))).alias("recall"),
        (F.col("iou_sum") / F.greatest(one, F.col("targets"))).alias("mean_iou"),
        (F.col("error_sum") / F.greatest(one, F.col("error_matches"))).alias("box_error"))


def overall(pages: DataFrame, truth: DataFrame, matches: DataFrame) -> DataFrame:
    """Totals of a detector evaluation in one row."""
    t = _page_totals(pages, truth, matches)
    return t.agg(F.count(F.lit(1)).alias("pages"), F.sum("targets").alias("targets"),
                 F.count_if(F.col("kind") == "negative").alias("negative_pages"),
                 F.sum(F.when(F.col("kind") == "negative", F.col("detections")).otherwise(0)).alias("false_on_negative"),
                 (F.sum("iou_sum") / F.greatest(F.lit(1), F.sum("targets"))).alias("mean_iou"),
                 (F.sum("error_sum") / F.greatest(F.lit(1), F.sum("matched"))).alias("box_error"))


def operating_point(pages: DataFrame, truth: DataFrame, matches: DataFrame, per_page: float = FALSE_PER_PAGE) -> DataFrame:
    """Score threshold of highest recall with few false detections on pages without a board.

    Matching visits detections in score order, so dropping low scores never changes an
    earlier match: one matching gives the counts of every threshold as running sums over
    the distinct scores.  The highest qualifying score wins ties.
    """
    boards = truth.select("page").distinct().withColumn("has", F.lit(True))
    tagged = matches.join(boards, "page", "left")
    per_score = tagged.groupBy("score").agg(
        F.count_if(F.col("truths")[0].isNotNull()).alias("m"), F.count_if(F.col("has").isNull()).alias("f"))
    rows = ordered(per_score, [F.col("score").desc()])
    curve = scan(rows, [], sums={"matched": F.col("m"), "false": F.col("f")})
    positives = F.greatest(F.lit(1), truth.agg(F.count(F.lit(1))).scalar())
    empty = F.greatest(F.lit(1), pages.join(boards, "page", "left_anti").agg(F.count(F.lit(1))).scalar())
    rates = curve.select(
        "score", (F.col("matched") / positives).alias("recall"), (F.col("false") / empty).alias("rate"))
    best = rates.where((F.col("rate") <= per_page) & (F.col("recall") > 0)).agg(
        F.max_by(F.struct("score", "recall", "rate"), F.struct("recall", "score")).alias("b"))
    return best.select(F.coalesce("b.score", F.lit(1.0)).alias("threshold"),
                       F.coalesce("b.recall", F.lit(0.0)).alias("recall"),
                       F.coalesce("b.rate", F.lit(0.0)).alias("false_per_page"))


def eligible(pages: DataFrame, split: str, kind: str = "kind") -> DataFrame:
    """Pages a detector may see: partial and unsupported ones only outside training."""
    kinds = ["boards", "negative"] if split == "train" else ["boards", *NO_BOARD_KINDS]
    return pages.where((F.col("split") == split) & F.col(kind).isin(kinds))

