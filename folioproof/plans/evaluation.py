"""Evaluation queries: classification, detection, paired models, ledgers."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import geometry as G
from ..functions import labels as L
from ..operators import classify as K, detect as D, ledger as B, paired as Q
from ..operators.reviews import assistance, polygon_matches
from ..sources import views as V
from .registry import Tables, query, view
from .session import keep

# --- classification ---------------------------------------------------------

_logits = "[" + ", ".join(f"40 * CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(13)) + "]"
view("sq", f"""SELECT vec_id, vec_id // 8 AS board, label AS truth, CASE WHEN (vec_id // 8) % 2 = 0 THEN 'white-bottom' ELSE 'black-bottom' END AS orientation,
  {_logits} AS logits FROM embeddings""")
view("soft", """SELECT *, list_transform(logits, lambda x: exp(x - list_max(logits))) AS e FROM {sq}""")
view("prd", """SELECT *, pred = truth AS correct FROM (SELECT *, list_max(e) / list_sum(e) AS confidence, list_position(e, list_max(e)) - 1 AS pred,
  ln(list_sum(e)) - (logits[truth + 1] - list_max(logits)) AS nll FROM {soft})""")
view("conf", "SELECT truth, pred, count(*) AS n FROM {prd} GROUP BY 1, 2")


def predicted(t: Tables) -> DataFrame:
    return K.predicted(V.squares(t.embeddings))


@query("SELECT vec_id, CAST(pred AS INT) AS pred, round(confidence, 6) AS confidence, round(nll, 6) AS nll, confidence < 0.7 AS uncertain FROM prd", "prd")
def square_predictions(t: Tables) -> DataFrame:
    rows = K.predicted(V.squares(t.embeddings).withColumn("vec_id", F.col("board") * 8 + F.col("pos")))
    return rows.select("vec_id", "pred", F.round("confidence", 6).alias("confidence"), F.round("nll", 6).alias("nll"),
                       L.uncertain(F.col("confidence")).alias("uncertain"))


@query("""SELECT CAST(x AS INT) AS truth, CAST(y AS INT) AS pred, coalesce(n, 0) AS n FROM range(13) a(x) CROSS JOIN range(13) b(y) LEFT JOIN conf ON truth = x AND pred = y""", "conf")
def confusion(t: Tables) -> DataFrame:
    return K.confusion(predicted(t), dense=True)


_scores = """SELECT c, tp, fp, fn, 2 * tp / greatest(1, 2 * tp + fp + fn) AS f1 FROM (SELECT c, coalesce(sum(n) FILTER (WHERE truth = c AND pred = c), 0) AS tp,
  coalesce(sum(n) FILTER (WHERE truth <> c AND pred = c), 0) AS fp, coalesce(sum(n) FILTER (WHERE truth = c AND pred <> c), 0) AS fn
  FROM range(1, 13) r(c) LEFT JOIN conf ON truth = c OR pred = c GROUP BY c)"""


@query(f"SELECT CAST(c AS INT) AS class, CAST(tp AS BIGINT) AS tp, CAST(fp AS BIGINT) AS fp, CAST(fn AS BIGINT) AS fn, round(f1, 6) AS f1 FROM ({_scores})", "conf")
def class_scores(t: Tables) -> DataFrame:
    return K.class_scores(K.confusion(predicted(t))).select("class", "tp", "fp", "fn", F.round("f1", 6).alias("f1"))


@query(f"SELECT round(avg(f1), 6) AS occupied_macro_f1 FROM ({_scores})", "conf")
def macro_f1(t: Tables) -> DataFrame:
    return K.macro_f1(K.confusion(predicted(t))).select(F.round("occupied_macro_f1", 6).alias("occupied_macro_f1"))


@query("""SELECT CAST(coalesce(sum(n) FILTER (WHERE (truth = 0) <> (pred = 0)), 0) AS BIGINT) AS empty_occupied_errors,
  CAST(coalesce(sum(n) FILTER (WHERE truth > 0 AND pred > 0 AND (truth <= 6) <> (pred <= 6)), 0) AS BIGINT) AS color_errors,
  CAST(coalesce(sum(n) FILTER (WHERE truth > 0 AND pred > 0 AND (truth - 1) % 6 <> (pred - 1) % 6), 0) AS BIGINT) AS piece_class_errors FROM conf""", "conf")
def error_blocks(t: Tables) -> DataFrame:
    return K.error_blocks(K.confusion(predicted(t)))


@query("""SELECT CAST(t AS DOUBLE) AS threshold, round(count(*) FILTER (WHERE confidence >= t) / count(*), 6) AS coverage,
  count(*) FILTER (WHERE confidence >= t AND NOT correct) AS wrong FROM prd, (SELECT unnest([0.5::DOUBLE, 0.7, 0.9, 0.95, 0.99]) AS t) GROUP BY t""", "prd")
def confidence_coverage(t: Tables) -> DataFrame:
    return K.confidence_coverage(predicted(t)).select("threshold", F.round("coverage", 6).alias("coverage"), "wrong")


@query("""SELECT orientation, CAST(t AS DOUBLE) AS threshold, round(count(*) FILTER (WHERE confidence >= t) / count(*), 6) AS coverage,
  count(*) FILTER (WHERE confidence >= t AND NOT correct) AS wrong FROM prd, (SELECT unnest([0.5::DOUBLE, 0.7, 0.9, 0.95, 0.99]) AS t) GROUP BY orientation, t""", "prd")
def coverage_by_orientation(t: Tables) -> DataFrame:
    return K.confidence_coverage(predicted(t), ["orientation"]).select("orientation", "threshold", F.round("coverage", 6).alias("coverage"), "wrong")


@query("""SELECT coalesce(orientation, 'all') AS orientation, count(*) AS boards, CAST(sum(n) AS BIGINT) AS squares, count(*) FILTER (WHERE exact) AS exact_boards,
  round(count(*) FILTER (WHERE exact) / count(*), 6) AS exact_board_accuracy, round(sum(ok) / sum(n), 6) AS square_accuracy, round(sum(nll) / sum(n), 6) AS nll,
  round(sum(cf) / sum(n), 6) AS mean_confidence, CAST(sum(sw) AS BIGINT) AS confident_wrong FROM (SELECT board, orientation, bool_and(correct) AS exact, count(*) AS n,
  count(*) FILTER (WHERE correct) AS ok, sum(nll) AS nll, sum(confidence) AS cf, count(*) FILTER (WHERE NOT correct AND confidence >= 0.99) AS sw FROM prd GROUP BY 1, 2)
  GROUP BY GROUPING SETS ((orientation), ())""", "prd")
def classifier_report(t: Tables) -> DataFrame:
    r = K.report_with_total(predicted(t), "orientation")
    return r.select("orientation", "boards", "squares", "exact_boards", *[F.round(c, 6).alias(c) for c in (
        "exact_board_accuracy", "square_accuracy", "nll", "mean_confidence")], "confident_wrong")


view("grid", """SELECT i, 0.25 + 0.025 * i::DOUBLE AS temperature, avg(ln(list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / (0.25 + 0.025 * i::DOUBLE)))))
  - (logits[truth + 1] - list_max(logits)) / (0.25 + 0.025 * i::DOUBLE)) AS nll FROM {sq}, range(151) r(i) GROUP BY i""")


@query("SELECT round(temperature, 4) AS temperature, round(nll, 6) AS nll FROM grid", "grid")
def temperature_curve(t: Tables) -> DataFrame:
    return K.temperature_curve(V.squares(t.embeddings)).select(F.round("temperature", 4).alias("temperature"), F.round("nll", 6).alias("nll"))


@query("""SELECT round(tt, 4) AS temperature, round(lim, 6) AS uncertainty_threshold, round(count(*) FILTER (WHERE c >= lim) / count(*), 6) AS accepted_coverage,
  count(*) FILTER (WHERE c >= lim AND p <> truth) AS accepted_wrong FROM (SELECT *, coalesce(least(1.0, max(CASE WHEN p <> truth THEN c END) OVER () + 1e-6), 0.0) AS lim FROM (
  SELECT truth, tt, 1 / list_sum(list_transform(logits, lambda x: exp((x - list_max(logits)) / tt))) AS c, list_position(logits, list_max(logits)) - 1 AS p
  FROM sq, (SELECT arg_min(temperature, nll) AS tt FROM grid))) GROUP BY tt, lim""", "sq", "grid")
def classifier_calibration(t: Tables) -> DataFrame:
    return K.calibrate(V.squares(t.embeddings)).select(
        F.round("temperature", 4).alias("temperature"), F.round("uncertainty_threshold", 6).alias("uncertainty_threshold"),
        F.round("accepted_coverage", 6).alias("accepted_coverage"), "accepted_wrong")


# --- detection --------------------------------------------------------------

_e = {i: f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(16)}
view("bx", f"""SELECT vec_id, vec_id // 4 AS page, vec_id % 4 AS number, 300 + 800 * {_e[0]} AS x0, 300 + 800 * {_e[1]} AS y0,
  300 + 800 * {_e[0]} + 60 + 400 * abs({_e[2]}) AS x1, 300 + 800 * {_e[1]} + 60 + 400 * abs({_e[3]}) AS y1,
  60 * {_e[4]} AS dx, 60 * {_e[5]} AS dy, abs({_e[6]}) AS score FROM embeddings""")
view("tr", "SELECT * FROM {bx} WHERE page % 10 NOT IN (8, 9)")
view("pd", "SELECT vec_id, page, number AS rank, x0 + dx AS x0, y0 + dy AS y0, x1 + dx AS x1, y1 + dy AS y1, score FROM {bx}")
view("pg", """SELECT page, CASE page % 10 WHEN 8 THEN 'negative' WHEN 9 THEN 'partial' ELSE 'boards' END AS kind,
  ['blank', 'paper', 'faded', 'soft'][CAST(page % 4 + 1 AS INT)] AS effect, 'layout-' || (page % 3) AS layout FROM (SELECT DISTINCT page FROM {bx})""")
_inter = "greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0))"
view("near", f"""SELECT p.page, p.rank, t.number, {_inter} / greatest(1e-9, (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_inter}) AS iou,
  (abs(p.x0 - t.x0) + abs(p.y0 - t.y0) + abs(p.x1 - t.x1) + abs(p.y1 - t.y1)) / 4 AS err FROM {{pd}} p JOIN {{tr}} t USING (page)""")
view("lim", "SELECT k, 0.5 + 0.05 * k::DOUBLE AS t FROM range(10) r(k)")
view("turn", """SELECT page, rank, score, row_number() OVER (PARTITION BY page ORDER BY score DESC, rank) AS rn FROM {pd}""")
view("cand", """SELECT u.page, u.rank, u.score, u.rn, l.k, coalesce(list(struct_pack(number := n.number, iou := n.iou, err := n.err) ORDER BY n.iou DESC, n.number)
  FILTER (WHERE n.iou >= l.t), []) AS c FROM {turn} u CROSS JOIN {lim} l LEFT JOIN {near} n ON n.page = u.page AND n.rank = u.rank GROUP BY 1, 2, 3, 4, 5""")
_greedy = """RECURSIVE go(page, k, rn, rank, score, number, iou, err, used) AS (
  SELECT page, k, 0::BIGINT, -1::BIGINT, NULL::DOUBLE, NULL::BIGINT, NULL::DOUBLE, NULL::DOUBLE, []::BIGINT[] FROM cand WHERE rn = 1
  UNION ALL SELECT page, k, rn, rank, score, m.number, m.iou, m.err, CASE WHEN m.number IS NULL THEN used ELSE list_append(used, m.number) END FROM (
    SELECT g.page, g.k, c.rn, c.rank, c.score, g.used, list_filter(c.c, lambda z: NOT list_contains(g.used, z.number))[1] AS m
    FROM go g JOIN cand c ON c.page = g.page AND c.k = g.k AND c.rn = g.rn + 1)),
  hit AS (SELECT page, k, rank, score, number, iou, err FROM go WHERE rn > 0)"""


def matched(t: Tables) -> DataFrame:
    return D.match(V.predicted_boxes(t.embeddings), V.truth_boxes(t.embeddings))


@query(_greedy + " SELECT page, rank, CAST(k AS INT) AS step, number, round(iou, 6) AS iou, round(err, 4) AS error FROM hit WHERE number IS NOT NULL", "cand")
def detection_matches(t: Tables) -> DataFrame:
    rows = matched(t).select("page", "rank", F.posexplode(F.arrays_zip("truths", "ious", "errors")).alias("step", "m"))
    return rows.where("m.truths is not null").select("page", "rank", "step", F.col("m.truths").alias("number"), F.round("m.ious", 6).alias("iou"), F.round("m.errors", 4).alias("error"))


_pr = _greedy + """, pos AS (SELECT count(*) AS p FROM tr), run AS (SELECT k, tp, rnk, tp / rnk AS prec, tp / greatest(1, p) AS rec FROM (
    SELECT k, sum(CASE WHEN number IS NULL THEN 0 ELSE 1 END) OVER w AS tp, row_number() OVER w AS rnk FROM hit
    WINDOW w AS (PARTITION BY k ORDER BY score DESC, page, rank)), pos),
  lev AS (SELECT l / 100 AS level FROM range(101) r(l)),
  best AS (SELECT k, level, coalesce(max(prec) FILTER (WHERE rec >= level), 0) AS p FROM run CROSS JOIN lev GROUP BY 1, 2),
  ap AS (SELECT k, least(1, greatest(0, sum(p) / 101)) AS ap FROM best GROUP BY k)"""


@query(_pr + """ SELECT round(0.5 + 0.05 * k::DOUBLE, 2) AS iou, round(ap, 6) AS ap, round(arg_max(rec, rnk), 6) AS recall, round(arg_max(prec, rnk), 6) AS precision
  FROM run JOIN ap USING (k) GROUP BY k, ap""", "cand", "tr")
def ap_by_iou(t: Tables) -> DataFrame:
    table = D.precision_recall(matched(t), V.truth_boxes(t.embeddings))
    return table.select(F.round("iou", 2).alias("iou"), *[F.round(c, 6).alias(c) for c in ("ap", "recall", "precision")])


@query(_pr + " SELECT round(avg(ap), 6) AS ap50_95 FROM ap", "cand", "tr")
def mean_ap(t: Tables) -> DataFrame:
    return D.mean_average_precision(D.precision_recall(matched(t), V.truth_boxes(t.embeddings))).select(F.round("ap50_95", 6).alias("ap50_95"))


_page_sums = _greedy + """, m AS (SELECT page, count(*) AS det, count(number) AS mt, coalesce(sum(iou), 0) AS si, coalesce(sum(err / 416), 0) AS se FROM hit WHERE k = 0 GROUP BY page),
  tg AS (SELECT page, count(*) AS n FROM tr GROUP BY page),
  s AS (SELECT g.*, coalesce(n, 0) AS n, coalesce(det, 0) AS det, coalesce(mt, 0) AS mt, coalesce(si, 0) AS si, coalesce(se, 0) AS se FROM pg g LEFT JOIN tg USING (page) LEFT JOIN m USING (page))"""


@query(_page_sums + """, z AS (SELECT 'effect' AS kind, effect AS name, n, mt, greatest(0, det - mt) AS fp, si, se, mt AS em FROM s
  UNION ALL SELECT 'layout', layout, n, mt, greatest(0, det - mt), si, se, mt FROM s UNION ALL SELECT 'board_count', CAST(n AS VARCHAR), n, mt, greatest(0, det - mt), si, se, mt FROM s
  UNION ALL SELECT 'size', CASE WHEN sqrt((t.x1 - t.x0) * (t.y1 - t.y0)) / 416 < 0.4 THEN 'small' WHEN sqrt((t.x1 - t.x0) * (t.y1 - t.y0)) / 416 < 0.7 THEN 'medium' ELSE 'large' END,
    1, CASE WHEN h.number IS NULL THEN 0 ELSE 1 END, 0, coalesce(h.iou, 0), coalesce(h.err / 416, 0), CASE WHEN h.number IS NULL THEN 0 ELSE 1 END
    FROM tr t LEFT JOIN (SELECT * FROM hit WHERE k = 0) h ON h.page = t.page AND h.number = t.number)
  SELECT kind, name, CAST(sum(n) AS BIGINT) AS targets, CAST(sum(mt) AS BIGINT) AS matched, CAST(sum(fp) AS BIGINT) AS false_positives, round(sum(mt) / greatest(1, sum(n)), 6) AS recall,
  round(sum(si) / greatest(1, sum(n)), 6) AS mean_iou, round(sum(se) / greatest(1, sum(em)), 6) AS box_error FROM z GROUP BY 1, 2""", "cand", "tr", "pg")
def detection_strata(t: Tables) -> DataFrame:
    s = D.strata(V.detector_pages(t.embeddings), V.truth_boxes(t.embeddings), matched(t))
    return s.select("kind", "name", "targets", "matched", "false_positives", *[F.round(c, 6).alias(c) for c in ("recall", "mean_iou", "box_error")])


@query(_page_sums + """ SELECT count(*) AS pages, CAST(sum(n) AS BIGINT) AS targets, count(*) FILTER (WHERE kind = 'negative') AS negative_pages,
  CAST(sum(CASE WHEN kind = 'negative' THEN det ELSE 0 END) AS BIGINT) AS false_on_negative, round(sum(si) / greatest(1, sum(n)), 6) AS mean_iou,
  round(sum(se) / greatest(1, sum(mt)), 6) AS box_error FROM s""", "cand", "tr", "pg")
def detection_overall(t: Tables) -> DataFrame:
    o = D.overall(V.detector_pages(t.embeddings), V.truth_boxes(t.embeddings), matched(t))
    return o.select("pages", "targets", "negative_pages", "false_on_negative", F.round("mean_iou", 6).alias("mean_iou"), F.round("box_error", 6).alias("box_error"))


@query("""SELECT kind, count(*) AS pages, CAST(sum((SELECT count(*) FROM pd WHERE pd.page = pg.page)) AS BIGINT) AS false_detections FROM pg
  WHERE page NOT IN (SELECT page FROM tr) GROUP BY kind""", "pg", "pd", "tr")
def false_by_kind(t: Tables) -> DataFrame:
    return D.no_board_pages(V.detector_pages(t.embeddings), V.truth_boxes(t.embeddings), V.predicted_boxes(t.embeddings))


@query(_greedy + """, tot AS (SELECT (SELECT greatest(1, count(*)) FROM tr) AS p, (SELECT greatest(1, count(*)) FROM pg WHERE page NOT IN (SELECT page FROM tr)) AS e),
  pick AS (SELECT DISTINCT score FROM pd),
  rate AS (SELECT c.score, count(*) FILTER (WHERE h.number IS NOT NULL) / any_value(p) AS recall, count(*) FILTER (WHERE h.page NOT IN (SELECT page FROM tr)) / any_value(e) AS fp
    FROM pick c JOIN hit h ON h.k = 0 AND h.score >= c.score, tot GROUP BY c.score)
  SELECT round(coalesce(arg_max(score, (recall, score)), 1.0), 6) AS threshold, round(coalesce(max(recall), 0), 6) AS recall, round(coalesce(arg_max(fp, (recall, score)), 0), 6) AS false_per_page
  FROM rate WHERE fp <= 0.05 AND recall > 0""", "cand", "tr", "pg", "pd")
def operating_point(t: Tables) -> DataFrame:
    o = D.operating_point(V.detector_pages(t.embeddings), V.truth_boxes(t.embeddings), keep(matched(t)))
    return o.select(*[F.round(c, 6).alias(c) for c in ("threshold", "recall", "false_per_page")])


view("hitpair", f"SELECT p.page, p.rank AS hi, t.rank AS lo FROM {{pd}} p JOIN {{pd}} t USING (page) WHERE p.rank <> t.rank AND {_inter} / greatest(1e-9, (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_inter}) > 0.3")


@query("""RECURSIVE ord AS (SELECT page, rank, row_number() OVER (PARTITION BY page ORDER BY score DESC, rank) AS rn FROM pd),
  foe AS (SELECT o.page, o.rank, o.rn, coalesce(list(h.hi) FILTER (WHERE h.hi IS NOT NULL), []) AS foes FROM ord o LEFT JOIN hitpair h ON h.page = o.page AND h.lo = o.rank GROUP BY 1, 2, 3),
  step(page, rn, kept) AS (SELECT DISTINCT page, 0::BIGINT, []::BIGINT[] FROM ord
    UNION ALL SELECT s.page, o.rn, CASE WHEN list_has_any(s.kept, o.foes) THEN s.kept ELSE list_append(s.kept, o.rank) END FROM step s JOIN foe o ON o.page = s.page AND o.rn = s.rn + 1)
  SELECT page, unnest(arg_max(kept, rn)) AS rank FROM step GROUP BY page""", "pd", "hitpair")
def suppressed_boxes(t: Tables) -> DataFrame:
    return D.suppress(V.predicted_boxes(t.embeddings), 0.3).select("page", "rank")


@query("""SELECT split, page, kind FROM (SELECT *, ['train', 'dev'][CAST(page % 2 + 1 AS INT)] AS split FROM pg) WHERE split = 'train' AND kind IN ('boards', 'negative')
  OR split = 'dev' AND kind IN ('boards', 'negative', 'partial', 'unsupported')""", "pg")
def detector_membership(t: Tables) -> DataFrame:
    pages = V.detector_pages(t.embeddings).withColumn("split", F.when(F.col("page") % 2 == 0, "train").otherwise("dev"))
    return D.eligible(pages, "train").unionByName(D.eligible(pages, "dev")).select("split", "page", "kind")


# --- paired models ----------------------------------------------------------

def references(t: Tables) -> DataFrame:
    """One reference per group of four vectors; every seventh entry shows no board."""
    return V.boards(t.embeddings).where("number = 0").select(
        F.col("page").alias("entry"), F.when(F.col("page") % 7 == 3, "negative").otherwise("board").alias("kind"), "corners", "labels")


def returned(t: Tables) -> DataFrame:
    """Boards of two models: the first returns all four of a page, the second the later two."""
    b = V.boards(t.embeddings).withColumn("squares", F.transform("labels", lambda x: F.struct(
        x.alias("label"), F.array(F.lit(0.995), F.lit(0.005)).alias("probabilities"), F.lit(False).alias("uncertain"))))
    first = b.select(F.col("page").alias("entry"), F.lit("first").alias("model"), F.col("number").alias("index"), "corners", "squares")
    second = b.where("number >= 2").select(F.col("page").alias("entry"), F.lit("second").alias("model"), (F.col("number") - 2).alias("index"), "corners", "squares")
    return first.unionByName(second)


def runs(t: Tables) -> DataFrame:
    page = F.col("page")
    rows = V.detector_pages(t.embeddings).select(page.alias("entry"), F.explode(F.array(F.lit("first"), F.lit("second"))).alias("model"))
    e = F.col("entry")
    return rows.select("entry", "model", F.when(e % 3 == 0, "manual-grid").otherwise("automatic").alias("mode"), (e % 5 == 0).alias("cold"),
                       (e * 7919 % 1009 + F.when(F.col("model") == "first", 0).otherwise(13)).cast("double").alias("total_ms"),
                       F.when(e % 4 == 0, F.array(F.lit("Refinement failed"))).otherwise(F.array().cast("array<string>")).alias("warnings"))


_q = f"[{_e[0]} * 800 + 300, {_e[1]} * 800 + 300, {_e[0]} * 800 + 300 + 60 + 400 * abs({_e[2]}), {_e[1]} * 800 + 300 + 20 * {_e[8]}, {_e[0]} * 800 + 300 + 60 + 400 * abs({_e[2]}) + 20 * {_e[9]}, {_e[1]} * 800 + 300 + 60 + 400 * abs({_e[3]}), {_e[0]} * 800 + 300, {_e[1]} * 800 + 300 + 60 + 400 * abs({_e[3]}) + 20 * {_e[10]}]"
_q = _q.replace(f"{_e[0]} * 800 + 300", f"300 + 800 * {_e[0]}").replace(f"{_e[1]} * 800 + 300", f"300 + 800 * {_e[1]}")
view("qd", f"""SELECT vec_id, vec_id // 4 AS page, vec_id % 4 AS number, label, {_q} AS q,
  [CAST(floor(abs(CAST(x AS DOUBLE)) * 60) AS INT) % 13 FOR x IN embedding] AS cls FROM embeddings""")
view("ref", "SELECT page AS entry, CASE WHEN page % 7 = 3 THEN 'negative' ELSE 'board' END AS kind, q AS rq, cls AS rc FROM {qd} WHERE number = 0")
view("ret", """SELECT page AS entry, 'first' AS model, number AS idx, q, cls FROM {qd} UNION ALL SELECT page, 'second', number - 2, q, cls FROM {qd} WHERE number >= 2""")
_side = " + ".join(f"sqrt((rq[{2 * ((i + 1) % 4) + 1}] - rq[{2 * i + 1}])**2 + (rq[{2 * ((i + 1) % 4) + 2}] - rq[{2 * i + 2}])**2)" for i in range(4))
_off = " + ".join(f"sqrt((rq[{2 * i + 1}] - q[{2 * i + 1}])**2 + (rq[{2 * i + 2}] - q[{2 * i + 2}])**2)" for i in range(4))
view("cmp", f"""SELECT entry, model, idx, kind, (({_off}) / 4) / greatest(1e-9, ({_side}) / 4 / 8) AS disp,
  len(list_filter(list_zip(rc, cls), lambda z: z[1] <> z[2])) AS wrong,
  len(list_filter(list_zip(rc, cls), lambda z: (z[1] = 0) <> (z[2] = 0))) AS oe,
  len(list_filter(list_zip(rc, cls), lambda z: z[1] > 0 AND z[2] > 0 AND (z[1] - 1) % 6 <> (z[2] - 1) % 6)) AS pc,
  len(list_filter(list_zip(rc, cls), lambda z: z[1] > 0 AND z[2] > 0 AND (z[1] <= 6) <> (z[2] <= 6))) AS co FROM {{ref}} JOIN {{ret}} USING (entry)""")
view("prow", """SELECT r.entry, m.model, CASE WHEN r.entry % 3 = 0 THEN 'manual-grid' ELSE 'automatic' END AS mode, r.entry % 5 = 0 AS cold,
  CAST(r.entry * 7919 % 1009 + CASE m.model WHEN 'first' THEN 0 ELSE 13 END AS DOUBLE) AS total_ms, kind = 'board' AS isb, coalesce(n, 0) AS n, b.disp, b.wrong, b.oe, b.pc, b.co
  FROM {ref} r CROSS JOIN (SELECT unnest(['first', 'second']) AS model) m LEFT JOIN (SELECT entry, model, count(*) AS n, arg_min(disp, (disp, idx)) AS disp, arg_min(wrong, (disp, idx)) AS wrong,
    arg_min(oe, (disp, idx)) AS oe, arg_min(pc, (disp, idx)) AS pc, arg_min(co, (disp, idx)) AS co FROM {cmp} GROUP BY 1, 2) b ON b.entry = r.entry AND b.model = m.model""")
view("pres", """SELECT entry, model, mode, cold, total_ms, CAST(isb AS BIGINT) AS expected_boards, n AS returned_boards, CAST(isb AND n = 0 AS BIGINT) AS missed_boards,
  CASE WHEN NOT isb THEN n ELSE greatest(0, n - 1) END AS false_boards, CAST((NOT isb OR n = 0) AND entry % 4 = 0 AS BIGINT) AS refinement_failures,
  CASE WHEN isb AND n > 0 THEN disp END AS displacement, CAST(CASE WHEN NOT isb THEN n = 0 WHEN n = 0 THEN false ELSE wrong = 0 AND disp <= 0.25 END AS BIGINT) AS exact_boards,
  CASE WHEN isb AND n > 0 THEN oe ELSE 0 END AS occupied_empty_errors, CASE WHEN isb AND n > 0 THEN pc ELSE 0 END AS piece_class_errors, CASE WHEN isb AND n > 0 THEN co ELSE 0 END AS color_errors,
  CASE WHEN isb AND n > 0 THEN wrong WHEN isb THEN 64 ELSE 0 END AS wrong_squares, CASE WHEN isb AND n > 0 THEN wrong ELSE 0 END AS confident_wrong_squares FROM {prow}""")


def compared(t: Tables) -> DataFrame:
    return Q.compare(references(t), runs(t), returned(t))


@query("SELECT * REPLACE (round(displacement, 6) AS displacement) FROM pres", "pres")
def paired_rows(t: Tables) -> DataFrame:
    return compared(t).withColumn("displacement", F.round("displacement", 6))


@query("SELECT model, count(*) AS inputs, count(*) FILTER (WHERE mode = 'automatic') AS automatic_inputs, count(*) FILTER (WHERE mode = 'manual-grid') AS manual_grid_inputs, "
       + ", ".join(f"CAST(sum({c}) AS BIGINT) AS {c}" for c in Q.COUNTS)
       + ", count(displacement) AS displacement_count, round(coalesce(sum(displacement), 0), 4) AS displacement_total FROM pres GROUP BY model", "pres")
def paired_totals(t: Tables) -> DataFrame:
    return Q.totals(compared(t)).withColumn("displacement_total", F.round("displacement_total", 4))


@query("""SELECT event_type AS engine, user_id % 2 = 0 AS cold, count(*) AS runs, min(value) AS min, max(value) AS max, round(median(value), 6) AS median FROM events GROUP BY 1, 2""")
def latency(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("event_type").alias("engine"), (F.col("user_id") % 2 == 0).alias("cold"), "value")
    return B.latency(rows, ["engine", "cold"], "value").withColumn("median", F.round("median", 6))


@query("""SELECT c.entry, c.model, c.idx AS index, CASE WHEN c.kind <> 'board' THEN 'false-return' WHEN c.idx = b.best THEN 'scored' ELSE 'additional' END AS role
  FROM cmp c JOIN (SELECT entry, model, arg_min(idx, (disp, idx)) AS best FROM cmp GROUP BY 1, 2) b USING (entry, model)""", "cmp")
def display_roles(t: Tables) -> DataFrame:
    return Q.display_roles(references(t), returned(t))


@query("""SELECT entry, model, CASE WHEN any_value(kind) = 'board' THEN arg_min(idx, (disp, idx)) ELSE min(idx) END AS index FROM cmp GROUP BY 1, 2""", "cmp")
def closest_board(t: Tables) -> DataFrame:
    return Q.closest(references(t), returned(t))


_stage_sql = """SELECT stage, place, count(*) AS items, max(diff) AS max_difference, 0 AS shape_errors, max(diff) <= lim AS passed FROM (
  SELECT ['rectified', 'tensor', 'logits'][CAST(label % 3 + 1 AS INT)] AS stage, CAST(label % 3 AS INT) AS place, [0.0, 1e-6, 1e-3][CAST(label % 3 + 1 AS INT)] AS lim,
    list_max(list_transform(embedding, lambda x: abs(CAST(x AS DOUBLE) - CAST(CAST(CAST(x AS DOUBLE) * 1000 AS BIGINT) AS DOUBLE) / 1000))) AS diff FROM embeddings) GROUP BY stage, place, lim"""


def stages(t: Tables) -> DataFrame:
    stage = F.element_at(F.array(F.lit("rectified"), F.lit("tensor"), F.lit("logits")), (F.col("label") % 3 + 1).cast("int"))
    left = t.embeddings.select(stage.alias("stage"), F.col("vec_id").alias("item"), F.transform("embedding", lambda x: x.cast("double")).alias("values"))
    right = left.withColumn("values", F.transform("values", lambda x: F.rint(x * 1000) / 1000))
    return Q.parity(left, right, {"rectified": 0.0, "tensor": 1e-6, "logits": 1e-3})


@query("SELECT stage, place, items, round(max_difference, 9) AS max_difference, CAST(shape_errors AS BIGINT) AS shape_errors, passed FROM (" + _stage_sql + ")")
def parity_stages(t: Tables) -> DataFrame:
    return stages(t).withColumn("max_difference", F.round("max_difference", 9))


@query("SELECT arg_min(stage, place) AS first_failing FROM (" + _stage_sql + ") WHERE NOT passed")
def first_failing_stage(t: Tables) -> DataFrame:
    return Q.first_failing(stages(t))


@query("""SELECT coalesce(o_orderkey, l_orderkey) AS index, CASE WHEN l_orderkey IS NULL THEN 'missing' WHEN o_orderkey IS NULL THEN 'unexpected' ELSE 'different' END AS reason
  FROM orders FULL JOIN (SELECT l_orderkey, min(l_linestatus) AS s, count(*) AS n FROM lineitem GROUP BY 1) l ON l_orderkey = o_orderkey
  WHERE l_orderkey IS NULL OR o_orderkey IS NULL OR s <> o_orderstatus OR n <> 4""")
def matching_files(t: Tables) -> DataFrame:
    files = t.lineitem.groupBy(F.col("l_orderkey").alias("index")).agg(F.min("l_linestatus").alias("sha256"), F.count(F.lit(1)).alias("bytes"))
    expected = t.orders.select(F.col("o_orderkey").alias("index"), F.col("o_orderstatus").alias("sha256"), F.lit(4).cast("long").alias("bytes"))
    return Q.matching_files(expected, files)


# --- assistance -------------------------------------------------------------

def _flat_boards(t: Tables, shift: bool) -> DataFrame:
    """Axis-parallel boards; the proposals are the shifted ones."""
    b = V.boxes(t.embeddings)
    if shift:
        b = V.predicted_boxes(t.embeddings).withColumnRenamed("rank", "number")
    labels = V.boards(t.embeddings).select("page", "number", "labels")
    quad = F.array(G.point(F.col("x0"), F.col("y0")), G.point(F.col("x1"), F.col("y0")), G.point(F.col("x1"), F.col("y1")), G.point(F.col("x0"), F.col("y1")))
    out = b.select("page", "number", quad.alias("corners")).join(labels, ["page", "number"])
    return out.withColumn("labels", F.reverse("labels")) if shift else out


_pairs = f"""RECURSIVE al AS (SELECT p.page, p.rank AS p, t.number AS t, {_inter} / ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_inter}) AS iou,
    sqrt(t.dx**2 + t.dy**2) AS d, p.rank = t.number AS own, ((t.x1 - t.x0) + (t.y1 - t.y0)) / 2 AS edge FROM pd p JOIN bx t USING (page)),
  sr AS (SELECT *, row_number() OVER (PARTITION BY page ORDER BY iou DESC, p DESC, t DESC) AS rn FROM al WHERE iou >= 0.5),
  go(page, rn, p, t, up, ut, hit) AS (SELECT DISTINCT page, 0::BIGINT, -1::BIGINT, -1::BIGINT, []::BIGINT[], []::BIGINT[], false FROM sr
    UNION ALL SELECT g.page, s.rn, s.p, s.t, CASE WHEN list_contains(g.up, s.p) OR list_contains(g.ut, s.t) THEN g.up ELSE list_append(g.up, s.p) END,
      CASE WHEN list_contains(g.up, s.p) OR list_contains(g.ut, s.t) THEN g.ut ELSE list_append(g.ut, s.t) END, NOT (list_contains(g.up, s.p) OR list_contains(g.ut, s.t))
    FROM go g JOIN sr s ON s.page = g.page AND s.rn = g.rn + 1)"""


@query(_pairs + " SELECT go.page, go.p, go.t, round(iou, 6) AS iou FROM go JOIN sr ON sr.page = go.page AND sr.p = go.p AND sr.t = go.t WHERE hit", "pd", "bx")
def proposal_matches(t: Tables) -> DataFrame:
    return polygon_matches(_flat_boards(t, True), _flat_boards(t, False)).select("page", "p", "t", F.round("iou", 6).alias("iou"))


_ends = " + ".join(f"sqrt((p.{x} - t.{x})**2 + (p.{y} - t.{y})**2)" for x in ("x0", "x1") for y in ("y0", "y1"))


@query(_pairs + f""", moved AS (SELECT go.page, ({_ends}) / 4 AS px, ({_ends}) / 4 / (((t.x1 - t.x0) + (t.y1 - t.y0)) / 2 / 8) AS sq,
    len(list_filter(list_zip(list_reverse(q.cls), r.cls), lambda z: z[1] <> z[2])) AS pieces
    FROM go JOIN pd p ON p.page = go.page AND p.rank = go.p JOIN bx t ON t.page = go.page AND t.number = go.t
    JOIN qd q ON q.page = go.page AND q.number = go.p JOIN qd r ON r.page = go.page AND r.number = go.t WHERE hit),
  mt AS (SELECT page, count(*) AS n, avg(px) AS px, avg(sq) AS sq, sum(pieces) AS pieces FROM moved GROUP BY page)
  SELECT page, count(*) AS proposal_boards, count(*) AS review_boards, coalesce(any_value(n), 0) AS matched, count(*) - coalesce(any_value(n), 0) AS false_boards,
  count(*) - coalesce(any_value(n), 0) AS missed_boards, CAST(page % 60 AS DOUBLE) AS active_seconds, round(any_value(px), 6) AS corner_pixels, round(any_value(sq), 6) AS corner_squares,
  CAST(coalesce(any_value(pieces), 0) AS BIGINT) AS piece_corrections FROM bx LEFT JOIN mt USING (page) GROUP BY page""", "pd", "bx", "qd")
def assistance_metrics(t: Tables) -> DataFrame:
    """How much a reviewer had to move and relabel on each page."""
    seconds = V.detector_pages(t.embeddings).select("page", (F.col("page") % 60).cast("double").alias("active_seconds"))
    return assistance(_flat_boards(t, True), _flat_boards(t, False), seconds).select(
        "page", "proposal_boards", "review_boards", "matched", "false_boards", "missed_boards", "active_seconds",
        F.round("corner_pixels", 6).alias("corner_pixels"), F.round("corner_squares", 6).alias("corner_squares"), "piece_corrections")


# --- ledgers and curves -----------------------------------------------------

view("att", """SELECT l_orderkey || '-' || l_linenumber AS lid, arg_min(l_returnflag, o) AS segment, arg_min(l_quantity, o) AS seconds, arg_min(l_linestatus = 'F', o) AS inherited, arg_min(l_orderkey, o) AS run
  FROM (SELECT *, (l_shipdate, l_partkey, l_suppkey, l_quantity, l_extendedprice) AS o FROM lineitem) GROUP BY 1""")


def unique(t: Tables) -> DataFrame:
    return B.unique_attempts(V.attempts(t.lineitem), "ledger_id", V.ATTEMPT_ORDER)


# Attempts as old and new run states tell them: some with a ledger id, some with a start, some copied from other runs.
view("told", """SELECT l_orderkey AS run, l_linenumber - 1 AS ordinal, CASE l_linenumber % 7 WHEN 1 THEN l_partkey || '/' || l_suppkey WHEN 2 THEN '' END AS ledger_id,
  CASE WHEN l_linenumber % 7 IN (1, 2, 3) THEN l_partkey * 0.5::DOUBLE END AS started_at, CASE WHEN l_returnflag <> 'N' THEN l_returnflag END AS segment,
  CASE l_linenumber % 7 WHEN 4 THEN 'run-' || l_suppkey WHEN 5 THEN '' END AS source_run_id, CASE WHEN l_linenumber % 7 IN (4, 5, 6) THEN 'prior-' || l_suppkey END AS prior_run_id,
  CASE WHEN l_linenumber % 2 = 0 THEN l_partkey END AS source_attempt_index, l_quantity AS elapsed_seconds, l_extendedprice AS price FROM lineitem""")
view("ident", """SELECT *, CASE WHEN length(ledger_id) > 0 THEN ledger_id WHEN started_at IS NOT NULL THEN printf('legacy:%.9f:%s', started_at, coalesce(segment, 'unknown'))
  WHEN coalesce(nullif(source_run_id, ''), prior_run_id) IS NOT NULL THEN coalesce(nullif(source_run_id, ''), prior_run_id) || ':' || coalesce(source_attempt_index, ordinal)
  ELSE 'current:' || ordinal END AS identity, NOT (length(coalesce(ledger_id, '')) > 0 OR started_at IS NOT NULL) AS lost FROM {told}""")


def told_attempts(t: Tables) -> DataFrame:
    m = F.col("l_linenumber") % 7
    return t.lineitem.select(
        F.col("l_orderkey").alias("run"), (F.col("l_linenumber") - 1).alias("ordinal"),
        F.when(m == 1, F.concat_ws("/", "l_partkey", "l_suppkey")).when(m == 2, "").alias("ledger_id"), F.when(m.isin(1, 2, 3), F.col("l_partkey") * 0.5).alias("started_at"),
        F.when(F.col("l_returnflag") != "N", F.col("l_returnflag")).alias("segment"), F.when(m == 4, F.concat(F.lit("run-"), "l_suppkey")).when(m == 5, "").alias("source_run_id"),
        F.when(m.isin(4, 5, 6), F.concat(F.lit("prior-"), "l_suppkey")).alias("prior_run_id"), F.when(F.col("l_linenumber") % 2 == 0, F.col("l_partkey")).alias("source_attempt_index"),
        F.col("l_quantity").alias("elapsed_seconds"), F.col("l_extendedprice").alias("price"))


@query("SELECT identity, lost, count(*) AS attempts, round(sum(elapsed_seconds), 4) AS seconds FROM ident GROUP BY 1, 2", "ident")
def attempt_identities(t: Tables) -> DataFrame:
    """Who is who among the attempts, and which have no identity beyond their own run."""
    named = told_attempts(t).withColumn("lost", B.has_no_identity()).withColumn("identity", B.attempt_identity(F.col("ordinal"), F.col("prior_run_id")))
    return named.groupBy("identity", "lost").agg(F.count(F.lit(1)).alias("attempts"), F.round(F.sum("elapsed_seconds"), 4).alias("seconds"))


@query("""SELECT coalesce(segment, 'all') AS segment, count(*) AS attempts, round(sum(seconds), 4) AS seconds FROM (
  SELECT identity, coalesce(arg_min(coalesce(segment, '-'), o), '-') AS segment, arg_min(elapsed_seconds, o) AS seconds FROM (
    SELECT *, (run, ordinal, elapsed_seconds, price) AS o FROM ident WHERE NOT lost) GROUP BY 1) GROUP BY GROUPING SETS ((segment), ())""", "ident")
def retained_totals(t: Tables) -> DataFrame:
    """Attempts of all runs counted once, whatever runs copied them."""
    once = B.retained(told_attempts(t), ["run", "ordinal", "elapsed_seconds", "price"]).fillna("-", ["segment"])
    return B.ledger_totals(once).withColumn("seconds", F.round("seconds", 4))


@query("""SELECT coalesce(segment, 'all') AS segment, count(*) AS attempts, round(sum(seconds), 4) AS seconds FROM att GROUP BY GROUPING SETS ((segment), ())""", "att")
def ledger_totals(t: Tables) -> DataFrame:
    return B.ledger_totals(unique(t)).withColumn("seconds", F.round("seconds", 4))


@query("""SELECT o_orderkey AS run, segment, round(o_totalprice, 2) AS capacity, round(coalesce(used, 0), 2) AS consumed, round(greatest(0, o_totalprice - coalesce(used, 0)), 2) AS remaining
  FROM orders CROSS JOIN (SELECT unnest(['A', 'N', 'R']) AS segment) s LEFT JOIN (SELECT run, segment AS sg, sum(seconds) AS used FROM att WHERE NOT inherited GROUP BY 1, 2) u
  ON u.run = o_orderkey AND u.sg = s.segment""", "att")
def budget_status(t: Tables) -> DataFrame:
    capacities = t.orders.select(F.col("o_orderkey").alias("run"), F.explode(F.array(F.lit("A"), F.lit("N"), F.lit("R"))).alias("segment"), F.col("o_totalprice").alias("capacity"))
    return B.budget_status(unique(t), capacities).select("run", "segment", *[F.round(c, 2).alias(c) for c in ("capacity", "consumed", "remaining")])


@query("""SELECT event_id, round(tv, 4) AS total_value, tn AS total_unit, coalesce(rn < first, true) AS admitted FROM (SELECT *, min(CASE WHEN tv > 60000 OR tn > 9000 THEN rn END) OVER () AS first FROM (
  SELECT event_id, sum(value) OVER w AS tv, count(*) OVER w AS tn, row_number() OVER w AS rn FROM events WINDOW w AS (ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING)))""")
def budget_admission(t: Tables) -> DataFrame:
    rows = t.events.select("event_id", "ts", "value", F.lit(1).cast("long").alias("unit"))
    out = B.admit_reservations(rows, ["ts", "event_id"], {"value": 60000, "unit": 9000})
    return out.select("event_id", F.round("total_value", 4).alias("total_value"), "total_unit", "admitted")


@query("""SELECT CAST((SELECT sum(l_partkey) FROM lineitem) + 1000 AS BIGINT) AS bytes, round((SELECT sum(l_quantity) FROM lineitem) + 60, 4) AS seconds, (SELECT count(*) FROM lineitem) + 2 AS attempts,
  (SELECT count(*) FROM events) + 3 AS decisions, round((SELECT sum(value) FROM events) + 9.5, 4) AS review_seconds""")
def accounting(t: Tables) -> DataFrame:
    ledger = t.lineitem.select(F.col("l_partkey").alias("bytes"), F.col("l_quantity").alias("seconds"))
    carried = t.spark.range(1).select(F.lit(1000).alias("bytes"), F.lit(60.0).alias("seconds"), F.lit(2).alias("attempts"), F.lit(3).alias("decisions"), F.lit(9.5).alias("review_seconds"))
    out = B.accounting(ledger, t.events.select(F.col("value").alias("seconds")), carried)
    return out.select("bytes", F.round("seconds", 4).alias("seconds"), "attempts", "decisions", F.round("review_seconds", 4).alias("review_seconds"))


view("cv", """SELECT event_id % 3 AS run, CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) * 100 AS BIGINT) AS step, count(*) FILTER (WHERE event_type = 'purchase') / count(*) AS recall,
  round(avg(value), 6) AS nll, count(*) AS n FROM events GROUP BY 1, 2""")


@query("""SELECT run, round(max(recall), 6) AS recall, arg_max(step, (recall, n, -nll, -step)) AS step FROM cv GROUP BY run""", "cv")
def best_curve_row(t: Tables) -> DataFrame:
    c = V.curves(t.events)
    return B.best_row(c, ["run"], [F.col("recall"), F.col("n"), -F.col("nll")]).select("run", F.round("recall", 6).alias("recall"), "step")


@query("""SELECT run, round(b, 6) AS before, round(w, 6) AS now, coalesce(b >= 0.10 AND w < 0.2, false) AS failed FROM (SELECT run, max(recall) FILTER (WHERE step = 1500) AS b,
  max(recall) FILTER (WHERE step = 2000) AS w FROM cv GROUP BY run)""", "cv")
def stage_gate(t: Tables) -> DataFrame:
    g = B.transition_gate(V.curves(t.events), below=0.2)
    return g.select("run", F.round("before", 6).alias("before"), F.round("now", 6).alias("now"), "failed")


@query("""SELECT user_id AS worker, epoch(TIMESTAMP '2024-01-31 00:00:00') - epoch(max(ts)) > 36000 AS stale FROM events GROUP BY 1""")
def stale_workers(t: Tables) -> DataFrame:
    from ..functions.scalar import stale
    last = t.events.groupBy(F.col("user_id").alias("worker")).agg(F.max("ts").alias("at"))
    return last.select("worker", stale(F.to_timestamp(F.lit("2024-01-31 00:00:00")), F.col("at"), 36000).alias("stale"))
