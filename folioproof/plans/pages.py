"""Queries on rules, geometry, recipes, images, scoring, snapshots and streams."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G, labels as L, rules as U, scalar as S
from ..operators import coverage as C, detect as D, export as E, images as I, recipes as R, scoring as P
from ..operators.classify import board_squares
from ..operators.components import components, exclusion_closure
from ..operators.pairs import active_pages, known_pairs
from ..operators.splits import component_sizes, freeze
from ..sources import views as V
from ..streaming.reviews import fold, without_retries
from ..streaming.runs import judged_results, liveness
from . import evaluation  # noqa: F401  (its views are used here)
from .curation import FREEZE, decisions, queue_pages
from .registry import Tables, query, view
from .session import keep, shared_path, shuffle_partitions

# --- rules ------------------------------------------------------------------

@query("""SELECT page_id, regexp_full_match(url, 'https://[^/?#@:]+(/[^?#]*)?') AS public_url, regexp_full_match(url, 'https://[^/?#@:]+(/[^#]*)?') AS plain_url FROM pages""")
def url_rules(t: Tables) -> DataFrame:
    return t.pages.select("page_id", S.public_https(F.col("url")).alias("public_url"), S.plain_https(F.col("url")).alias("plain_url"))


@query("""SELECT doc_id, regexp_full_match(lang || '-' || source, '[a-zA-Z0-9_-]{1,80}') AS token, regexp_full_match(text, '[a-zA-Z0-9_-]{1,80}') AS text_token,
  true AS hash, false AS text_hash FROM documents""")
def identifier_rules(t: Tables) -> DataFrame:
    return t.documents.select(
        "doc_id", S.is_token(F.concat_ws("-", "lang", "source")).alias("token"), S.is_token(F.col("text")).alias("text_token"),
        S.is_sha256(F.sha2("text", 256)).alias("hash"), S.is_sha256(F.col("text")).alias("text_hash"))


def manifests(t: Tables) -> DataFrame:
    n, some = F.col("n"), F.lit("x")
    return t.sources().select(
        "id", F.when(n % 6 == 1, "nope").otherwise(F.col("sha256")).alias("sha256"), "split", F.when(n % 5 == 0, "png").otherwise("pdf").alias("format"),
        F.when(n % 7 == 2, 0).otherwise(1000).cast("long").alias("max_bytes"), F.when(n % 4 == 3, F.array(F.lit(2), F.lit(2))).otherwise(F.array(F.lit(1))).alias("pages"),
        some.alias("revision"), F.when(n % 8 == 4, "").otherwise("x").alias("attribution"), some.alias("edition"), some.alias("selection_reason"), some.alias("pretrained_overlap"),
        (n % 9 == 5).alias("private"), (n % 10 != 6).alias("real"), F.when(n % 11 == 7, F.lit(None).cast("boolean")).otherwise(True).alias("lineage_reviewed"),
        "lineage", "conditions", F.when(n % 3 == 0, "https://a.example/x?y=1").when(n % 3 == 1, "https://u:p@a.example/x").otherwise("https://a.example:443/x").alias("url"),
        F.struct(some.alias("reviewer"), some.alias("evidence_url"), some.alias("license"), some.alias("exclusions"),
                 F.when(n % 4 == 1, "2024-13-01").otherwise("2024-01-31").alias("review_date"), F.col("sha256").alias("evidence_sha256"), F.lit("approved").alias("acquisition"),
                 F.when(n % 2 == 0, "approved").otherwise("denied").alias("training"), F.lit("approved").alias("evaluation"), F.lit("unknown").alias("redistribution"),
                 F.when(n % 5 == 4, "maybe").otherwise("denied").alias("model_publication")).alias("rights"))


@query("""SELECT id, unnest(list_filter([CASE WHEN n % 6 = 1 THEN 'sha256' END, CASE WHEN n % 7 = 2 THEN 'byte-ceiling' END, CASE WHEN n % 4 = 3 THEN 'pages' END,
  CASE WHEN n % 5 = 0 AND n % 4 = 3 THEN 'image-pages' END, CASE WHEN n % 8 = 4 THEN 'provenance' END, CASE WHEN n % 9 = 5 THEN 'private' END, CASE WHEN n % 10 = 6 THEN 'real' END,
  CASE WHEN n % 11 = 7 THEN 'lineage-review' END, CASE WHEN n % 4 = 1 THEN 'rights-date' END, CASE WHEN split = 'train' AND n % 2 = 1 THEN 'split-rights' END,
  CASE WHEN n % 5 = 4 THEN 'downstream-rights' END, CASE WHEN n % 3 = 1 THEN 'url' END], lambda x: x IS NOT NULL)) AS code FROM src""", "src")
def source_violations(t: Tables) -> DataFrame:
    return manifests(t).select("id", F.explode(U.source_rules()).alias("code"))


_x = [f"q[{2 * i + 1}]" for i in range(4)]
_y = [f"q[{2 * i + 2}]" for i in range(4)]
_turns = [f"(({_x[(i + 1) % 4]} - {_x[i]}) * ({_y[(i + 2) % 4]} - {_y[(i + 1) % 4]}) - ({_y[(i + 1) % 4]} - {_y[i]}) * ({_x[(i + 2) % 4]} - {_x[(i + 1) % 4]}))" for i in range(4)]
_sides = [f"sqrt(({_x[(i + 1) % 4]} - {_x[i]})**2 + ({_y[(i + 1) % 4]} - {_y[i]})**2)" for i in range(4)]
_area = "(" + " + ".join(f"({_x[i]} * {_y[(i + 1) % 4]} - {_x[(i + 1) % 4]} * {_y[i]})" for i in range(4)) + ") / 2"


@query(f"""SELECT vec_id, round({_area}, 4) AS area, round(({' + '.join(_sides)}) / 4, 6) AS mean_edge, round(({' + '.join(_sides)}) / 32, 6) AS square_width,
  least({', '.join(_turns)}) > 1 AS convex, {_y[0]} + {_y[1]} < {_y[2]} + {_y[3]} AND {_x[0]} + {_x[3]} < {_x[1]} + {_x[2]} AS ordered FROM qd""", "qd")
def quad_metrics(t: Tables) -> DataFrame:
    q = F.col("corners")
    return V.boards(t.embeddings).select(
        "vec_id", F.round(G.polygon_area(q), 4).alias("area"), F.round(G.mean_edge(q), 6).alias("mean_edge"), F.round(G.square_width(q), 6).alias("square_width"),
        G.convex_clockwise(q).alias("convex"), G.image_ordered(q).alias("ordered"))


def annotations(t: Tables) -> DataFrame:
    """One annotated page per four vectors; sizes and kinds vary so that rules break."""
    page = F.col("page")
    return V.boards(t.embeddings).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("number", "corners", "labels", "orientation"))).alias("b")).select(
        "page", F.transform("b", lambda x: F.struct(x["corners"].alias("corners"), x["labels"].alias("labels"), x["orientation"].alias("orientation"))).alias("boards"),
        F.when(page % 9 == 4, "negative").otherwise("boards").alias("kind"), (page % 8 != 5).alias("complete_page"),
        F.when(page % 3 == 0, 450).otherwise(4000).alias("width"), F.lit(4000).alias("height"))


@query(f"""SELECT DISTINCT page, code FROM (SELECT page, CASE WHEN page % 9 = 4 THEN 'kind-boards' END AS code FROM qd UNION ALL SELECT page, CASE WHEN page % 8 = 5 THEN 'complete' END FROM qd
  UNION ALL SELECT page, CASE WHEN greatest({', '.join(_x)}) > CASE WHEN page % 3 = 0 THEN 450 ELSE 4000 END OR least({', '.join(_x + _y)}) < 0 THEN 'corner-bounds' END FROM qd
  UNION ALL SELECT page, CASE WHEN NOT least({', '.join(_turns)}) > 1 THEN 'convex' END FROM qd) WHERE code IS NOT NULL""", "qd")
def annotation_violations(t: Tables) -> DataFrame:
    return annotations(t).select("page", F.explode(U.annotation_rules()).alias("code"))


def recognised(t: Tables) -> DataFrame:
    """Results of four boards; some probabilities do not add up, some evidence is missing."""
    v = F.col("vec_id")
    one_hot = F.array(*[F.array(*[F.lit(1.0 if i == k else 0.0) for i in range(13)]) for k in range(13)])
    short = F.array(*[F.lit(0.5) if i == 0 else F.lit(0.0) for i in range(13)])
    squares = F.transform(V.class_of_dim(), lambda c, i: F.struct(
        F.element_at(L.label_array(), c + 1).alias("label"),
        F.when(i % 5 == 0, F.lit(None).cast("array<double>")).when(v % 17 == 0, short).otherwise(F.element_at(one_hot, c + 1)).alias("probabilities"),
        ((i % 5 == 0) & (v % 11 != 0)).alias("uncertain")))
    b = t.embeddings.select(F.expr("vec_id div 4").alias("page"), F.struct((v % 4).alias("id"), V.quad().alias("corners"), squares.alias("squares")).alias("b"))
    return b.groupBy("page").agg(F.collect_list("b").alias("boards")).withColumn("status", F.lit("ok")).withColumn("width", F.lit(450)).withColumn("height", F.lit(4000))


@query(f"""SELECT DISTINCT page, code FROM (SELECT page, CASE WHEN vec_id % 17 = 0 THEN 'probabilities' END AS code FROM qd UNION ALL SELECT page, CASE WHEN vec_id % 11 = 0 THEN 'missing-evidence' END FROM qd
  UNION ALL SELECT page, CASE WHEN greatest({', '.join(_x)}) > 450 OR least({', '.join(_x + _y)}) < 0 THEN 'corner-bounds' END FROM qd
  UNION ALL SELECT page, CASE WHEN NOT least({', '.join(_turns)}) > 0 THEN 'convex' END FROM qd) WHERE code IS NOT NULL""", "qd")
def result_violations(t: Tables) -> DataFrame:
    return recognised(t).select("page", F.explode(U.result_rules()).alias("code"))


@query(f"""SELECT DISTINCT page, code FROM (SELECT page, CASE WHEN vec_id % 17 = 0 THEN 'probabilities' END AS code FROM qd UNION ALL SELECT page, CASE WHEN vec_id % 11 = 0 THEN 'missing-evidence' END FROM qd
  UNION ALL SELECT page, CASE WHEN page % 6 = 1 THEN 'providers' END FROM qd UNION ALL SELECT page, CASE WHEN page % 7 = 2 THEN 'timing' END FROM qd UNION ALL SELECT page, CASE WHEN page % 5 = 3 THEN 'status-boards' END FROM qd
  UNION ALL SELECT page, CASE WHEN greatest({', '.join(_x)}) > 450 OR least({', '.join(_x + _y)}) < 0 THEN 'corner-bounds' END FROM qd
  UNION ALL SELECT page, CASE WHEN NOT least({', '.join(_turns)}) > 1 THEN 'convex' END FROM qd) WHERE code IS NOT NULL""", "qd")
def proposal_violations(t: Tables) -> DataFrame:
    p = F.col("page")
    boards = F.transform("boards", lambda b: F.struct(
        b["id"].cast("string").alias("id"), b["corners"].alias("corners"), F.transform(b["squares"], lambda s: s["label"]).alias("labels"), F.lit("unknown").alias("orientation"),
        F.transform(b["squares"], lambda s: s["probabilities"]).alias("probabilities"), F.transform(b["squares"], lambda s: s["uncertain"]).alias("uncertain")))
    rows = recognised(t).withColumn("boards", boards).withColumn("status", F.when(p % 5 == 3, "unsupported").otherwise("ok")).withColumn(
        "providers", F.when(p % 6 == 1, F.array(F.lit("a"))).otherwise(F.array(F.lit("a"), F.lit("b")))).withColumn("total_ms", F.when(p % 7 == 2, 120001.0).otherwise(5.0))
    return rows.select("page", F.explode(U.proposal_rules()).alias("code"))


@query("""SELECT event_id AS id, unnest(list_filter([CASE WHEN event_type = 'view' THEN 'reviewer' END, CASE WHEN value > 100 THEN 'seconds' END,
  CASE WHEN event_id % 5 <> user_id % 5 THEN 'image' END, CASE WHEN event_id % 4 NOT IN (user_id % 4, user_id % 4 - 1) THEN 'revision' END], lambda x: x IS NOT NULL)) AS code FROM events""")
def review_violations(t: Tables) -> DataFrame:
    pages = queue_pages(t).select(F.col("id").alias("sample"), F.col("revision").alias("current_revision"), F.col("sha").alias("current_sha"))
    log = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("sample"), F.when(F.col("event_type") == "view", " ").otherwise("ann").alias("reviewer"), F.lit(True).alias("human"),
        F.when(F.col("value") > 100, 20000.0).otherwise(F.col("value")).alias("seconds"), F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("image_sha"),
        (F.col("event_id") % 4).alias("revision"))
    return log.join(pages, "sample", "left").select("id", F.explode(U.review_rules()).alias("code"))


@query("""SELECT event_id AS id, unnest(list_filter([CASE WHEN event_type NOT IN ('view', 'click') THEN 'reason' END, CASE WHEN event_id % 4 <> user_id % 4 OR event_id % 5 <> user_id % 5 THEN 'stale' END,
  CASE WHEN event_type = 'error' THEN 'run' END], lambda x: x IS NOT NULL)) AS code FROM events""")
def deferral_violations(t: Tables) -> DataFrame:
    pages = queue_pages(t).select(F.col("id").alias("sample"), F.col("revision").alias("current_revision"), F.col("sha").alias("current_sha"))
    kind = F.col("event_type")
    log = t.events.select(
        F.col("event_id").alias("id"), F.col("user_id").alias("sample"), F.when(kind == "view", "labels").when(kind == "click", "geometry").otherwise(kind).alias("reason"),
        F.col("value").alias("seconds"), F.when(kind == "error", "not-a-hash").alias("proposal_run"), F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("image_sha"),
        (F.col("event_id") % 4).alias("revision"))
    return log.join(pages, "sample", "left").select("id", F.explode(U.deferral_rules()).alias("code"))


@query("""SELECT session, code FROM (SELECT user_id AS session, 'repeated-entry' AS code FROM (SELECT user_id FROM events GROUP BY user_id, event_id % 23, event_type HAVING count(*) > 1) GROUP BY 1
  UNION ALL SELECT user_id, 'too-many-entries' FROM events GROUP BY 1 HAVING count(*) > 40 UNION ALL SELECT user_id, 'too-many-inputs' FROM events GROUP BY 1 HAVING count(DISTINCT event_id % 23) > 20
  UNION ALL SELECT user_id, 'result-image-changed' FROM events GROUP BY 1 HAVING count(*) FILTER (WHERE value > 300) > 0)""")
def session_violations(t: Tables) -> DataFrame:
    rows = t.events.select(F.col("user_id").alias("session"), (F.col("event_id") % 23).alias("index"), F.col("event_type").alias("mode"), F.lit(80).alias("width"), F.lit(80).alias("height"),
                           F.when(F.col("value") > 300, 81).otherwise(80).alias("result_width"), F.lit(80).alias("result_height"))
    return U.session_violations(rows)


# --- geometry ---------------------------------------------------------------

def _both(t: Tables) -> DataFrame:
    p = V.predicted_boxes(t.embeddings).select("page", F.col("rank").alias("number"), *[F.col(c).alias("p_" + c) for c in ("x0", "y0", "x1", "y1")])
    return V.boxes(t.embeddings).join(p, ["page", "number"])


_pi = "greatest(0, least(p.x1, t.x1) - greatest(p.x0, t.x0)) * greatest(0, least(p.y1, t.y1) - greatest(p.y0, t.y0))"
_pt = "FROM bx t JOIN pd p ON p.vec_id = t.vec_id"


@query(f"""SELECT t.vec_id, round({_pi} / greatest(1e-9, (p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_pi}), 6) AS iou,
  round({_pi} / least((p.x1 - p.x0) * (p.y1 - p.y0), (t.x1 - t.x0) * (t.y1 - t.y0)), 6) AS overlap {_pt}""", "bx", "pd")
def box_iou_pairs(t: Tables) -> DataFrame:
    return _both(t).select("vec_id", F.round(G.box_iou(G.box(), G.box("p_")), 6).alias("iou"), F.round(G.box_overlap(G.box(), G.box("p_")), 6).alias("overlap"))


@query(f"SELECT t.vec_id, round({_pi} / ((p.x1 - p.x0) * (p.y1 - p.y0) + (t.x1 - t.x0) * (t.y1 - t.y0) - {_pi}), 6) AS iou {_pt}", "bx", "pd")
def polygon_iou_pairs(t: Tables) -> DataFrame:
    def quad(p: str) -> Column:
        x0, y0, x1, y1 = (F.col(p + c) for c in ("x0", "y0", "x1", "y1"))
        return F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1))

    return _both(t).select("vec_id", F.round(G.polygon_iou(quad(""), quad("p_")), 6).alias("iou"))


@query("""SELECT CASE WHEN sqrt((x1 - x0) * (y1 - y0)) / 416 < 0.4 THEN 'small' WHEN sqrt((x1 - x0) * (y1 - y0)) / 416 < 0.7 THEN 'medium' ELSE 'large' END AS size, count(*) AS n FROM bx GROUP BY 1""", "bx")
def size_buckets(t: Tables) -> DataFrame:
    return V.boxes(t.embeddings).groupBy(G.size_bucket(G.box()).alias("size")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT vec_id, round(greatest(0, x0 - greatest(x1 - x0, y1 - y0) * 0.12), 4) AS x0, round(greatest(0, y0 - greatest(x1 - x0, y1 - y0) * 0.12), 4) AS y0,
  round(least(500, x1 + greatest(x1 - x0, y1 - y0) * 0.12), 4) AS x1, round(least(700, y1 + greatest(x1 - x0, y1 - y0) * 0.12), 4) AS y1 FROM bx""", "bx")
def expanded_boxes(t: Tables) -> DataFrame:
    wide = G.expanded(G.box(), F.lit(500.0), F.lit(700.0), 0.12)
    return V.boxes(t.embeddings).select("vec_id", *[F.round(c, 4).alias(k) for k, c in wide.items()])


@query("""SELECT vec_id, round((x0 + x1) / 2 / 1600, 6) AS cx, round((y0 + y1) / 2 / 1200, 6) AS cy, round((x1 - x0) / 1600 * 1600 * 0.26, 6) AS w, round((y1 - y0) / 1200 * 1200 * 0.26, 6) AS h FROM bx""", "bx")
def letterbox_targets(t: Tables) -> DataFrame:
    x0, y0, x1, y1 = G.box().values()
    quad = F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1))
    w, h = F.lit(1600.0), F.lit(1200.0)
    box = G.centre_box(quad, w, h)
    moved = G.letterbox_box(box, w, h)
    return V.boxes(t.embeddings).select("vec_id", F.round(box["cx"], 6).alias("cx"), F.round(box["cy"], 6).alias("cy"), F.round(moved["w"], 6).alias("w"), F.round(moved["h"], 6).alias("h"))


@query("""SELECT doc_id, violation, count(x) AS windows, CAST(sum(x) AS BIGINT) AS sum_x, CAST(sum(y) AS BIGINT) AS sum_y FROM (
  SELECT doc_id, 'too-many-windows' AS violation, NULL::BIGINT AS x, NULL::BIGINT AS y FROM (SELECT doc_id, n_chars AS w, n_chars // 2 + 1 AS h FROM documents)
  WHERE (ceil(greatest(0, w - 1024) / 896) + 1) * (ceil(greatest(0, h - 1024) / 896) + 1) > 64
  UNION ALL SELECT doc_id, NULL, least(i * 896, greatest(0, w - 1024)) AS x, least(j * 896, greatest(0, h - 1024)) AS y
  FROM (SELECT doc_id, n_chars AS w, n_chars // 2 + 1 AS h FROM documents), range(0, 64) a(i), range(0, 64) b(j)
  WHERE i <= ceil(greatest(0, w - 1024) / 896) AND j <= ceil(greatest(0, h - 1024) / 896)
  AND (ceil(greatest(0, w - 1024) / 896) + 1) * (ceil(greatest(0, h - 1024) / 896) + 1) <= 64) GROUP BY doc_id, violation""")
def window_plan(t: Tables) -> DataFrame:
    pages = t.documents.select("doc_id", F.col("n_chars").alias("width"), F.expr("n_chars div 2 + 1").alias("height"))
    return G.page_windows(pages).groupBy("doc_id", "violation").agg(
        F.count("x").alias("windows"), F.sum("x").cast("long").alias("sum_x"), F.sum("y").cast("long").alias("sum_y"))


@query("""SELECT vec_id, round((0.94 * x0 + 12) / (0.0001 * x0 + 0.00005 * y0 + 1), 6) AS x, round((0.94 * y0 + 9) / (0.0001 * x0 + 0.00005 * y0 + 1), 6) AS y,
  round(306 + (x0 + 0.024 * y0 - 306) * cos(radians(1.25)) - (y0 - 396) * sin(radians(1.25)), 6) AS sx, round(396 + (x0 + 0.024 * y0 - 306) * sin(radians(1.25)) + (y0 - 396) * cos(radians(1.25)), 6) AS sy FROM bx""", "bx")
def projected_points(t: Tables) -> DataFrame:
    matrix = [F.lit(v) for v in (0.94, 0.0, 12.0, 0.0, 0.94, 9.0, 0.0001, 0.00005, 1.0)]
    p = G.point(F.col("x0"), F.col("y0"))
    rows = V.boxes(t.embeddings).select("vec_id", G.project(matrix, p).alias("p"), G.shear_rotate(p, F.lit(612), F.lit(792), F.lit(0.024), F.lit(1.25)).alias("s"))
    return rows.select("vec_id", F.round("p.x", 6).alias("x"), F.round("p.y", 6).alias("y"), F.round("s.x", 6).alias("sx"), F.round("s.y", 6).alias("sy"))


@query("SELECT vec_id, " + ", ".join(f"round(q[{2 * i + k}], 4) AS {'_xy'[k]}{i}" for i in range(4) for k in (1, 2)) + " FROM qd", "qd")
def homography_corners(t: Tables) -> DataFrame:
    """The corners again, through the homography that was solved from them."""
    solved = V.boards(t.embeddings).select("vec_id", G.homography(F.col("corners"), 767.0).alias("h"))
    h = [F.col("h")[i] for i in range(9)]
    ends = [(0.0, 0.0), (767.0, 0.0), (767.0, 767.0), (0.0, 767.0)]
    moved = solved.select("vec_id", *[G.project(h, G.point(F.lit(x), F.lit(y))).alias(f"p{i}") for i, (x, y) in enumerate(ends)])
    return moved.select("vec_id", *[F.round(f"p{i}.{k}", 4).alias(f"{k}{i}") for i in range(4) for k in ("x", "y")])


_f = {i: f"CAST(embedding[{i + 1}] AS DOUBLE)" for i in range(8)}
_row = "vec_id * 7 % 3549"
_stride = f"CASE WHEN {_row} < 2704 THEN 8 WHEN {_row} < 3380 THEN 16 ELSE 32 END"
_at = f"CASE WHEN {_row} < 2704 THEN {_row} WHEN {_row} < 3380 THEN {_row} - 2704 ELSE {_row} - 3380 END"
_n = f"CASE WHEN {_row} < 2704 THEN 52 WHEN {_row} < 3380 THEN 26 ELSE 13 END"
view("raw", f"""SELECT vec_id, sc, cx - w / 2 AS l, cx + w / 2 AS r, cy - h / 2 AS t, cy + h / 2 AS b FROM (SELECT vec_id, ({_f[0]} + ({_at}) % ({_n})) * ({_stride}) AS cx, ({_f[1]} + ({_at}) // ({_n})) * ({_stride}) AS cy,
  exp({_f[2]}) * ({_stride}) AS w, exp({_f[3]}) * ({_stride}) AS h, abs({_f[4]}) * greatest(abs({_f[5]}), abs({_f[6]})) AS sc FROM embeddings)""")


@query("""SELECT vec_id, round(sc, 6) AS score, round(greatest(0, least(416, greatest(0, l))) / 0.26, 4) AS x0, round(greatest(0, least(312, greatest(0, t))) / 0.26, 4) AS y0,
  round(greatest(0, least(416, least(416, r))) / 0.26, 4) AS x1, round(greatest(0, least(312, least(416, b))) / 0.26, 4) AS y1 FROM raw WHERE least(416, r) > greatest(0, l) AND least(416, b) > greatest(0, t)
  AND (greatest(0, least(416, least(416, r))) - greatest(0, least(416, greatest(0, l)))) / 0.26 > 1 AND (greatest(0, least(312, least(416, b))) - greatest(0, least(312, greatest(0, t)))) / 0.26 > 1""", "raw")
def decoded_rows(t: Tables) -> DataFrame:
    raw = t.embeddings.select(
        "vec_id", (F.col("vec_id") * 7 % 3549).alias("row"), V.dim(0).alias("dx"), V.dim(1).alias("dy"), V.dim(2).alias("dw"), V.dim(3).alias("dh"), F.abs(V.dim(4)).alias("objectness"),
        F.array(F.abs(V.dim(5)), F.abs(V.dim(6))).alias("class_probabilities"), F.lit(1600).alias("width"), F.lit(1200).alias("height"))
    return G.to_source(G.decode_rows(raw)).select("vec_id", F.round("score", 6).alias("score"), *[F.round(c, 4).alias(c) for c in ("x0", "y0", "x1", "y1")])


@query("""SELECT vec_id, unnest(list_filter([CASE WHEN vec_id * 97 % 4000 > 3548 THEN 'row' END, CASE WHEN 6 * CAST(embedding[5] AS DOUBLE) NOT BETWEEN 0 AND 1 THEN 'objectness' END,
  CASE WHEN greatest(abs(CAST(embedding[6] AS DOUBLE)), abs(CAST(embedding[7] AS DOUBLE))) * 4 > 1 THEN 'class-probability' END], lambda x: x IS NOT NULL)) AS code FROM embeddings""")
def detector_row_violations(t: Tables) -> DataFrame:
    raw = t.embeddings.select(
        "vec_id", (F.col("vec_id") * 97 % 4000).alias("row"), V.dim(0).alias("dx"), V.dim(1).alias("dy"), V.dim(2).alias("dw"), V.dim(3).alias("dh"), (6 * V.dim(4)).alias("objectness"),
        F.array(F.abs(V.dim(5)) * 4, F.abs(V.dim(6)) * 4).alias("class_probabilities"))
    return G.raw_violations(raw).select("vec_id", "code")


# --- labels -----------------------------------------------------------------

_text = "array_to_string([['.', 'P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k'][c + 1] FOR c IN list_slice(o, {0}, {1})], '')"
_ranks = " || '/' || ".join(_text.format(8 * i + 1, 8 * i + 8) for i in range(8))
_runs = _ranks
for _k in range(8, 0, -1):
    _runs = f"replace({_runs}, '{'.' * _k}', '{_k}')"


@query(f"SELECT vec_id, CASE WHEN label % 3 > 0 THEN {_runs} END AS placement FROM (SELECT vec_id, label, CASE WHEN label % 3 = 2 THEN list_reverse(cls) ELSE cls END AS o FROM qd)", "qd")
def placements(t: Tables) -> DataFrame:
    return V.boards(t.embeddings).select("vec_id", L.placement(F.col("labels"), F.col("orientation")).alias("placement"))


@query("""SELECT vec_id, array_to_string([list_position(['empty', 'K', 'Q', 'R', 'B', 'N', 'P', 'k', 'q', 'r', 'b', 'n', 'p'], z) FOR z IN ['empty', 'P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k']], ',') AS taken,
  array_to_string([CAST(round(CAST(embedding[CAST((((7 - i // 8) * 8 + i % 8) * 13) % 64 + 1 AS INT)] AS DOUBLE) * 1000) AS INT) FOR i IN range(64)], ',') AS first_class FROM embeddings""")
def image_order(t: Tables) -> DataFrame:
    flat = t.embeddings.select("vec_id", F.transform(F.sequence(F.lit(0), F.lit(831)), lambda i: F.col("embedding")[i % 64].cast("double")).alias("p"))
    ordered = flat.select("vec_id", L.image_order(F.col("p")).alias("s"))
    order = L.image_order(F.transform(F.sequence(F.lit(0), F.lit(831)), lambda i: i + 1))
    return ordered.select("vec_id", F.array_join(order[56], ",").alias("taken"),
                          F.array_join(F.transform("s", lambda q: F.round(q[0] * 1000).cast("int")), ",").alias("first_class"))


@query("""SELECT vec_id, len(list_filter(z, lambda p: p[1] <> p[2])) AS wrong, len(list_filter(z, lambda p: (p[1] = 0) <> (p[2] = 0))) AS occupied,
  len(list_filter(z, lambda p: p[1] > 0 AND p[2] > 0 AND (p[1] <= 6) <> (p[2] <= 6))) AS color FROM (SELECT vec_id, list_zip(cls, list_reverse(cls)) AS z FROM qd)""", "qd")
def label_comparison(t: Tables) -> DataFrame:
    b = V.boards(t.embeddings).select("vec_id", F.zip_with("labels", L.reversed_labels(F.col("labels")), lambda a, b: F.struct(a.alias("a"), b.alias("b"))).alias("z"))

    def count(rule) -> Column:
        return F.size(F.filter("z", rule)).cast("long")

    return b.select("vec_id", count(lambda p: L.class_id(p["a"]) != L.class_id(p["b"])).alias("wrong"),
                    count(lambda p: L.occupied(p["a"]) != L.occupied(p["b"])).alias("occupied"),
                    count(lambda p: F.coalesce(L.is_white(p["a"]) != L.is_white(p["b"]), F.lit(False))).alias("color"))


@query("""SELECT page, vec_id % 4 AS number, g.i - 1 AS square, cls[g.i] AS truth FROM qd, generate_series(1, 64) g(i) WHERE page % 10 NOT IN (8, 9)""", "qd")
def classifier_membership(t: Tables) -> DataFrame:
    kinds = V.detector_pages(t.embeddings).select("page", F.col("kind"), F.lit("train").alias("split"))
    pages = V.boards(t.embeddings).groupBy("page").agg(F.array_sort(F.collect_list(F.struct("number", "orientation", "labels"))).alias("boards")).join(kinds, "page")
    return board_squares(pages, "train").select("page", F.col("number").cast("long").alias("number"), F.col("square").cast("long").alias("square"), "truth")


# --- recipes ----------------------------------------------------------------

SETS = R.DEFAULT_SETS


def made(t: Tables) -> DataFrame:
    """A recipe for every document."""
    indices = t.documents.select(F.col("doc_id").alias("index"))
    return R.recipes(indices, "v1", SETS, parts=shuffle_partitions(indices))


view("rcp", """SELECT doc_id AS i, CASE WHEN doc_id % 11 = 10 THEN 'negative' WHEN doc_id % 37 = 36 THEN 'partial' ELSE 'boards' END AS kind,
  CASE WHEN doc_id % 11 <> 10 AND doc_id % 4 >= 2 THEN 'multiple-boards' WHEN doc_id % 4 = 1 THEN 'large-board' ELSE 'small-board' END AS layout,
  ['blank', 'paper', 'faded', 'soft'][CAST(doc_id // 4 % 4 + 1 AS INT)] AS effect, CASE WHEN doc_id % 4 >= 2 THEN 2 ELSE 1 END AS nb,
  CASE WHEN doc_id % 20 = 0 THEN 'legal-opening' WHEN doc_id % 29 = 28 THEN 'empty' ELSE ['sparse', 'medium', 'dense'][CAST(doc_id % 3 + 1 AS INT)] END AS pk, doc_id % 5 = 4 AS persp FROM documents""")
view("rbd", """SELECT i, kind, effect, 0 AS b, ['set-a', 'set-b', 'set-c'][CAST(i // 3 % 3 + 1 AS INT)] AS st, pk, CASE WHEN i % 7 = 0 THEN 'black-bottom' ELSE 'white-bottom' END AS side,
    CASE WHEN pk = 'legal-opening' THEN 'opening-' || (i // 20 % 3) ELSE 'teaching-v1-' || i || '-board-0' END AS parent, CASE pk WHEN 'empty' THEN 0 WHEN 'sparse' THEN 8 WHEN 'medium' THEN 22 WHEN 'dense' THEN 42 ELSE 32 END AS occ FROM {rcp}
  UNION ALL SELECT i, kind, effect, 1, ['set-a', 'set-b', 'set-c'][CAST((i + i % 4 - 1) % 3 + 1 AS INT)], CASE i % 4 WHEN 2 THEN 'sparse' ELSE 'dense' END, CASE i % 4 WHEN 2 THEN 'white-bottom' ELSE 'black-bottom' END,
    'teaching-v1-' || i || '-board-1', CASE i % 4 WHEN 2 THEN 8 ELSE 42 END FROM {rcp} WHERE nb = 2""")


@query("""SELECT i AS index, kind, layout, effect, persp AS perspective, CASE WHEN kind = 'boards' THEN nb ELSE 0 END AS boards, CASE WHEN kind = 'partial' THEN nb ELSE 0 END AS unsupported,
  CASE WHEN i % 6 = 0 THEN 0.024 WHEN i % 6 = 3 THEN -0.018 ELSE 0 END AS shear, CASE WHEN i % 8 = 5 THEN 1.25 WHEN i % 8 = 7 THEN -1.25 ELSE 0 END AS turn FROM rcp""", "rcp")
def recipe_pages(t: Tables) -> DataFrame:
    c = F.col("condition")
    return made(t).select("index", "kind", "layout", c["degradation"]["variant"].alias("effect"), c["perspective"].isNotNull().alias("perspective"), F.size("boards").cast("long").alias("boards"),
                          F.size("unsupported_boards").cast("long").alias("unsupported"), c["affine"]["shear_x"].alias("shear"), c["affine"]["rotation_deg"].alias("turn"))


@query("""SELECT i AS index, 'board-' || b AS id, st AS set, pk AS position_kind, side AS orientation, parent, CAST(occ AS BIGINT) AS occupied FROM rbd WHERE kind = 'boards'""", "rbd")
def recipe_boards(t: Tables) -> DataFrame:
    rows = made(t).select("index", F.explode("boards").alias("b"))
    return rows.select("index", *[F.col(f"b.{k}").alias(k) for k in ("id", "set", "position_kind", "orientation", "parent")],
                       F.size(F.filter("b.labels", lambda x: x != ".")).cast("long").alias("occupied"))


_bits = "(" + " || ".join(f"sha256('v1:' || doc_id || ':0:{i}')" for i in range(4)) + ")"


@query(f"""SELECT doc_id AS index, array_to_string([CASE WHEN r <= k THEN ['P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k'][CAST((r - 1 + s) % 12 + 1 AS INT)] ELSE '.' END FOR r IN ranks], '') AS labels FROM (
  SELECT doc_id, CASE doc_id % 3 WHEN 0 THEN 8 WHEN 1 THEN 22 ELSE 42 END AS k, ('0x' || substr(md5('v1:' || doc_id || ':0:start'), 1, 8))::BIGINT % 12 AS s,
    [list_position(o, lpad(CAST(q AS VARCHAR), 2, '0')) FOR q IN range(64)] AS ranks FROM (SELECT doc_id, [substr(z, 5, 2) FOR z IN list_sort([substr({_bits}, CAST(4 * q + 1 AS INT), 4) || lpad(CAST(q AS VARCHAR), 2, '0') FOR q IN range(64)])] AS o FROM documents))""")
def random_positions(t: Tables) -> DataFrame:
    i = F.col("doc_id")
    occupied = F.when(i % 3 == 0, 8).when(i % 3 == 1, 22).otherwise(42)
    return t.documents.select(i.alias("index"), F.array_join(R.random_labels("v1", i, 0, occupied), "").alias("labels"))


@query("""SELECT 'page_kinds' AS counter, kind AS key, count(*) AS n FROM rcp GROUP BY 2 UNION ALL SELECT 'effects', effect, count(*) FROM rcp GROUP BY 2
  UNION ALL SELECT 'perspective', CASE WHEN persp THEN 'projective' ELSE 'affine-only' END, count(*) FROM rcp GROUP BY 2 UNION ALL SELECT 'sets', st, count(*) FROM rbd WHERE kind = 'boards' GROUP BY 2
  UNION ALL SELECT 'position_kinds', pk, count(*) FROM rbd WHERE kind = 'boards' GROUP BY 2""", "rcp", "rbd")
def recipe_coverage(t: Tables) -> DataFrame:
    return C.recipe_counters(made(t)).where(F.col("counter").isin("page_kinds", "effects", "perspective", "sets", "position_kinds"))


@query()
def recipe_square_coverage(t: Tables) -> DataFrame:
    return C.recipe_counters(made(t)).where(F.col("counter").isin("classes", "class_background", "set_class_background", "set_effect_class_background", "joint_conditions"))


@query("""SELECT CAST(sum(CASE WHEN kind = 'boards' THEN nb ELSE 0 END) AS BIGINT) AS training_boards, CAST(sum(CASE WHEN kind = 'partial' THEN nb ELSE 0 END) AS BIGINT) AS unsupported_boards FROM rcp""", "rcp")
def recipe_totals(t: Tables) -> DataFrame:
    return C.recipe_totals(made(t)).select("training_boards", "unsupported_boards")


@query("SELECT 'x' AS gate, 'y' AS cell WHERE false")
def recipe_gate(t: Tables) -> DataFrame:
    return C.recipe_gate(keep(C.recipe_counters(made(t))), SETS, R.EFFECTS)


@query("""SELECT DISTINCT i AS index, code FROM (SELECT i, CASE WHEN i % 8 = 1 THEN 'size' END AS code FROM rcp UNION ALL SELECT i, CASE WHEN i % 6 = 2 AND effect = 'blank' THEN 'blank-identity' END FROM rcp
  UNION ALL SELECT i, CASE WHEN kind <> 'negative' AND i % 8 = 1 THEN 'page-bounds' END FROM rcp) WHERE code IS NOT NULL""", "rcp")
def recipe_violations(t: Tables) -> DataFrame:
    """Recipes with some pages made too narrow and some blank effects made noisy."""
    i = F.col("index")
    broken = made(t).withColumn("width", F.when(i % 8 == 1, 100).otherwise(F.col("width"))).withColumn(
        "condition", F.col("condition").withField("degradation.paper_noise", F.when(i % 6 == 2, 0.5).otherwise(F.col("condition.degradation.paper_noise"))))
    return broken.select("index", F.explode(U.recipe_rules(SETS)).alias("code"))


@query("""SELECT doc_id, CAST(page AS BIGINT) AS page FROM (SELECT DISTINCT doc_id, 1 + round_even(i * (n_chars - 1) / greatest(1, least(10, n_chars) - 1), 0) AS page FROM documents, range(10) r(i) WHERE i < least(10, n_chars))""")
def uniform_pages(t: Tables) -> DataFrame:
    return R.uniform_pages(t.documents.select("doc_id", "n_chars", F.lit(10).cast("long").alias("wanted")), "n_chars", "wanted").select("doc_id", "page")


@query("""SELECT epoch, doc_id, position, position // 64 AS batch FROM (SELECT CAST(e AS INT) AS epoch, doc_id, row_number() OVER (PARTITION BY e ORDER BY md5('11:' || e || ':' || doc_id), doc_id) - 1 AS position FROM documents, range(2) r(e))""")
def epoch_order(t: Tables) -> DataFrame:
    return R.epoch_order(t.documents, "doc_id", 11, 2, 64).select("epoch", "doc_id", "position", "batch")


view("ritem", """SELECT i AS item, 'e' || (i // 4) AS key FROM {rcp} UNION SELECT i, parent FROM {rbd} WHERE kind = 'boards'""")
view("redge", "SELECT DISTINCT x.item AS u, y.item AS v FROM {ritem} x JOIN {ritem} y USING (key)")


@query(FREEZE.replace("JOIN edge e", "JOIN redge e").replace("FROM edge", "FROM redge") + " SELECT component, size, split FROM fill WHERE rn > 0", "rcp", "rbd", "ritem", "redge")
def recipe_split(t: Tables) -> DataFrame:
    """Recipes frozen into splits by shared positions and effect controls."""
    found = components(R.split_keys(made(t)))
    return freeze(component_sizes(found), 7)


# --- images -----------------------------------------------------------------

def _resized() -> str:
    """Eight grey values of a row as nine, by the triangle filter."""
    out = []
    for x in range(9):
        centre = (x + 0.5) * 8 / 9
        taps = {j: max(0.0, 1 - abs(j + 0.5 - centre)) for j in range(max(0, int(centre - 0.5)), min(8, int(centre + 1.5)))}
        total = sum(taps.values())
        out.append("floor(0.500000001 + " + " + ".join(f"g[8 * y + {j + 1}] * {w / total!r}::DOUBLE" for j, w in taps.items()) + ")")
    return "[" + ", ".join(out) + "]"


@query(f"""SELECT vec_id AS page, CAST(CASE WHEN h >= 9223372036854775808 THEN h - 18446744073709551616 ELSE h END AS BIGINT) AS phash FROM (
  SELECT vec_id, sum(CASE WHEN r[x] > r[x + 1] THEN 1::HUGEINT << CAST(8 * y + x - 1 AS INT) ELSE 0::HUGEINT END) AS h FROM (
    SELECT vec_id, y, {_resized()} AS r FROM (SELECT vec_id, [floor((greatest(-1, least(1, CAST(v AS DOUBLE))) + 1) * 127.5) FOR v IN embedding] AS g FROM embeddings), range(8) a(y)), range(1, 9) b(x) GROUP BY vec_id)""")
def page_hashes(t: Tables) -> DataFrame:
    p = V.rasters(t.embeddings)
    return p.select("page", I.difference_hash(F.col("raster"), F.col("width"), F.col("height")).alias("phash"))


def _whole(p: DataFrame) -> DataFrame:
    """One board per raster: the whole picture."""
    return p.select("page", F.lit(0).alias("number"), F.array(*[G.point(F.lit(x), F.lit(y)) for x, y in ((0, 0), (8, 0), (8, 8), (0, 8))]).alias("corners"))


@query("""SELECT vec_id AS page, CAST(0 AS BIGINT) AS number, CAST(g.i - 1 AS INT) AS square, round((floor((greatest(-1, least(1, CAST(embedding[g.i] AS DOUBLE))) + 1) * 127.5) / 255 - 0.485) / 0.229, 4) AS red
  FROM embeddings, generate_series(1, 64) g(i)""")
def rectified_squares(t: Tables) -> DataFrame:
    """An 8 x 8 picture rectified to 8 x 8 is itself, so each square is one normalised pixel."""
    p = V.rasters(t.embeddings)
    tensors = I.square_tensors(I.rectified(p, _whole(p), 8), 8)
    return tensors.select("page", "number", "square", F.round(F.col("tensor")[0].cast("double"), 4).alias("red"))


@query()
def degraded_errors(t: Tables) -> DataFrame:
    """Error of degraded pictures against the clean ones, per board."""
    p = V.rasters(t.embeddings).withColumn("degradation", R.degradation("v1", F.col("page")))
    clean = I.inner_tiles(I.rectified(p, _whole(p), 64), 64, 1, 3)
    spoiled = I.degraded(p)
    tiles = I.inner_tiles(I.rectified(spoiled, _whole(p), 64), 64, 1, 3)
    out = I.tile_errors(tiles, clean, 18.0)
    return out.select("page", "number", "tiles", F.round("mean_mae", 6).alias("mean_mae"), F.round("max_mae", 6).alias("max_mae"), "passed")


def _spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all tasks, whatever files hold them: a small row can become 2 MB of tensor."""
    return rows.repartition(shuffle_partitions(rows))


@query("""SELECT vec_id AS page, 52.0::DOUBLE AS scale, 3 * 416 * 416 AS values, round((floor((greatest(-1, least(1, CAST(embedding[1] AS DOUBLE))) + 1) * 127.5)) / 255, 4) AS first FROM embeddings""")
def letterboxed_pages(t: Tables) -> DataFrame:
    out = I.letterboxed(V.rasters(_spread(t.embeddings)), 416, "bgr", "unit")
    return out.select("page", "scale", F.size("tensor").cast("long").alias("values"), F.round(F.col("tensor")[0].cast("double"), 4).alias("first"))


@query("""SELECT vec_id AS page, round(list_sum([floor((greatest(-1, least(1, CAST(x AS DOUBLE))) + 1) * 127.5) FOR x IN embedding]), 1) AS total FROM embeddings""")
def greyscale_pages(t: Tables) -> DataFrame:
    out = I.greyscale(V.rasters(t.embeddings), 8, 8)
    return out.select("page", F.round(F.aggregate("grey", F.lit(0.0), lambda a, x: a + x.cast("double")), 1).alias("total"))


@query()
def template_margins(t: Tables) -> DataFrame:
    """Margin of every square to the mean tiles of other classes of its colour."""
    p = V.rasters(t.embeddings)
    tiles = I.inner_tiles(I.rectified(p, _whole(p), 64), 64, 1, 3)
    names = V.boards(t.embeddings).select(F.col("vec_id").alias("page"), F.posexplode("labels").alias("square", "label"))
    named = tiles.join(names, ["page", "square"])
    cells = named.select("label", L.parity(F.col("square")).cast("int").alias("parity"), F.posexplode("tile").alias("i", "v"))
    means = cells.groupBy("label", "parity", "i").agg(F.avg("v").cast("int").alias("v"))
    templates = means.groupBy("label", "parity").agg(F.transform(F.array_sort(F.collect_list(F.struct("i", "v"))), lambda z: z["v"]).alias("tile"))
    out = I.class_margins(I.template_distances(named.drop("number"), templates), ["page", "square"])
    return out.groupBy("label").agg(F.count(F.lit(1)).alias("squares"), F.min("margin").alias("least_margin"), F.count_if(F.col("nearest") != F.col("label")).alias("mismatches"))


@query("""SELECT page, unnest(list_filter([CASE WHEN m IN (2, 3) THEN 'edge' END, CASE WHEN m IN (4, 5) THEN 'pixels' END, CASE WHEN m BETWEEN 1 AND 5 THEN 'length' END], lambda x: x IS NOT NULL)) AS code
  FROM (SELECT vec_id AS page, vec_id % 9 AS m FROM embeddings)""")
def raster_violations(t: Tables) -> DataFrame:
    """Rasters cut short, without a height, too wide, too large by both edges together; one with alpha is fine."""
    p, m = V.rasters(t.embeddings), F.col("page") % 9
    raster = F.when(m == 1, F.expr("substring(raster, 1, 190)")).when(m == 6, F.concat("raster", F.expr("substring(raster, 1, 64)"))).otherwise(F.col("raster"))
    width = F.when(m == 3, 8193).when(m == 4, 8192).when(m == 5, 4899).otherwise(F.col("width"))
    height = F.when(m == 2, 0).when(m == 4, 2930).when(m == 5, 4899).otherwise(F.col("height"))
    return I.raster_violations(p.withColumns({"raster": raster, "width": width, "height": height}))


# --- scoring, snapshots -----------------------------------------------------

class _Corners:
    """A stand-in localiser: one board over the whole page, found twice."""

    def locate(self, page: object) -> list[dict]:
        w, h = page.width, page.height
        box = [(0, 0), (w, 0), (w, h), (0, h)]
        return [{"id": "b0", "corners": box}, {"id": "b1", "corners": box}]


class _Brightness:
    """A stand-in labeller: the class is the pixel's brightness band."""

    def label(self, page: object, board: dict) -> list[list[float] | None]:
        bands = [page.raster[3 * i] * 13 // 256 for i in range(64)]
        return [[0.88 if k == b else 0.01 for k in range(13)] for b in bands]


def stand_ins() -> P.Registry:
    registry = P.Registry()
    registry.register("localization", "whole-page", _Corners, "0" * 64)
    registry.register("labels", "brightness", _Brightness, "1" * 64)
    return registry


@query("""SELECT vec_id AS id, 'ok' AS status, 1 AS boards, array_to_string([['.', 'P', 'N', 'B', 'R', 'Q', 'K', 'p', 'n', 'b', 'r', 'q', 'k'][CAST(floor((greatest(-1, least(1, CAST(x AS DOUBLE))) + 1) * 127.5) AS INT) * 13 // 256 + 1] FOR x IN embedding], '') AS labels,
  0 AS uncertain, 'whole-page,brightness' AS providers FROM embeddings""")
def scored_pages(t: Tables) -> DataFrame:
    pages = V.rasters(t.embeddings).withColumnRenamed("page", "id")
    out = P.score_pages(pages, stand_ins(), "whole-page", "brightness", "run-1", L.LABELS)
    return out.select("id", "status", F.size("boards").cast("long").alias("boards"), F.array_join(F.col("boards")[0]["labels"], "").alias("labels"),
                      F.size(F.filter(F.col("boards")[0]["uncertain"], lambda u: u)).cast("long").alias("uncertain"),
                      F.array_join(F.transform("providers", lambda p: p["id"]), ",").alias("providers"))


view("shut", "SELECT x.id FROM {src} x JOIN {src} y ON x.n // 4 = y.n // 4 WHERE y.id IN (SELECT source FROM {worst}) UNION SELECT source FROM {excl}")
view("open", "SELECT s.id, s.source, s.sha, o.split FROM {smp} s JOIN {src} o ON o.id = s.source WHERE s.source NOT IN (SELECT id FROM {shut})")
view("chosen", """SELECT s.id, s.source, a.split, s.kind, s.revision, s.sha, s.kind IN ('boards', 'negative') AS detector_eligible FROM {smp} s JOIN {open} a ON a.id = s.id
  WHERE accepted AND a.split IN ('train', 'dev') AND s.id NOT IN (
    SELECT d.b FROM {said} d JOIN {open} p ON p.id = d.a JOIN {open} q ON q.id = d.b AND q.sha = p.sha WHERE d.decision = 'duplicate')""")


def chosen(t: Tables) -> DataFrame:
    # Sources of which a tenth is toxic take all of their lineage with them; what is out is out for duplicates too.
    seeds = V.exclusions(t.documents, t.labels, 10).select(F.col("source").alias("id"), "reason")
    excluded = keep(t.exclusions().unionByName(exclusion_closure(t.sources(), seeds)))
    pages = active_pages(t.samples(), t.sources(), excluded, "sha")
    dropped = known_pairs(pages, "sha", decisions(t)).select(F.col("b").alias("id")).distinct()
    return E.selection(t.samples(), t.sources(), excluded, dropped).select("id", "source", "split", "kind", "revision", "sha", "detector_eligible")


@query("SELECT * FROM chosen", "chosen")
def export_selection(t: Tables) -> DataFrame:
    return chosen(t)


_pieces = ", ".join(f"CAST(coalesce(sum(CAST(('0x' || substr(h, {1 + 15 * i}, 15)) AS BIGINT)), 0) AS HUGEINT) AS s{i}" for i in range(4))


@query(f"""SELECT n AS rows, sha256(n || ':' || s0 || ':' || s1 || ':' || s2 || ':' || s3) AS digest FROM (SELECT count(*) AS n, {_pieces} FROM (
  SELECT sha256('{{"id":' || id || ',"revision":' || revision || ',"sha":"' || sha || '"}}') AS h FROM chosen))""".replace("{{", "{").replace("}}", "}"), "chosen")
def snapshot_identity(t: Tables) -> DataFrame:
    return E.fingerprint(chosen(t), "id", "revision", "sha")


@query("""SELECT page AS sample, CASE WHEN page % 10 = 8 THEN '' ELSE string_agg('0 ' || cx || ' ' || cy || ' ' || w || ' ' || h || chr(10), '' ORDER BY number) END AS text FROM (
  SELECT page, number, printf('%.9g', (x0 + x1) / 2 / 4000) AS cx, printf('%.9g', (y0 + y1) / 2 / 4000) AS cy, printf('%.9g', (x1 - x0) / 4000) AS w, printf('%.9g', (y1 - y0) / 4000) AS h FROM bx) WHERE page % 10 <> 9 GROUP BY page""", "bx")
def detector_labels(t: Tables) -> DataFrame:
    x0, y0, x1, y1 = G.box().values()
    quad = F.array(G.point(x0, y0), G.point(x1, y0), G.point(x1, y1), G.point(x0, y1))
    boards = V.boxes(t.embeddings).select("page", F.struct("number", quad.alias("corners")).alias("b")).groupBy("page").agg(F.array_sort(F.collect_list("b")).alias("boards"))
    pages = boards.join(V.detector_pages(t.embeddings), "page").select(
        F.col("page").alias("id"), F.when(F.col("kind") == "negative", F.filter("boards", lambda b: F.lit(False))).otherwise(F.col("boards")).alias("boards"),
        F.col("kind").isin("boards", "negative").alias("detector_eligible"), F.lit(4000.0).alias("width"), F.lit(4000.0).alias("height"))
    return E.label_lines(pages)


@query("""RECURSIVE foe AS (SELECT b.page, b.number AS rank, b.number + 1 AS rn, coalesce(list(o.number) FILTER (WHERE o.number IS NOT NULL), []) AS foes FROM bx b LEFT JOIN bx o ON o.page = b.page
    AND o.number < b.number AND least(o.x1, b.x1) > greatest(o.x0, b.x0) AND least(o.y1, b.y1) > greatest(o.y0, b.y0) GROUP BY 1, 2, 3),
  step(page, rn, kept) AS (SELECT DISTINCT page, 0::BIGINT, []::BIGINT[] FROM bx
    UNION ALL SELECT s.page, o.rn, CASE WHEN list_has_any(s.kept, o.foes) THEN s.kept ELSE list_append(s.kept, o.rank) END FROM step s JOIN foe o ON o.page = s.page AND o.rn = s.rn + 1)
  SELECT page, unnest(arg_max(kept, rn)) AS rank FROM step GROUP BY page""", "bx")
def apart_grids(t: Tables) -> DataFrame:
    """Grids in given order, dropping any that touches an earlier kept one at all."""
    b = V.boxes(t.embeddings).withColumnRenamed("number", "rank").withColumn("score", F.lit(1.0))
    return D.suppress(b, 0.0, given_order=True).select("page", "rank")


# --- streams ----------------------------------------------------------------

def _stream(t: Tables, name: str) -> DataFrame:
    return t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet").option("maxFilesPerTrigger", 64).parquet(t.folder)


def _drain(df: DataFrame, name: str) -> DataFrame:
    """Run a stream over what is there into the shared folder and read it back."""
    target, state = shared_path(df.sparkSession, name), shared_path(df.sparkSession, name + "-state")
    spark = df.sparkSession
    provider = "spark.sql.streaming.stateStore.providerClass"
    before = spark.conf.get(provider)
    spark.conf.set(provider, "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    try:
        running = df.writeStream.format("parquet").option("path", target).option("checkpointLocation", state).trigger(availableNow=True).start()
        running.awaitTermination()
    finally:
        spark.conf.set(provider, before)
    return spark.read.schema(df.schema).parquet(target)


def _submissions(events: DataFrame) -> DataFrame:
    """Every event as a human submission against the revision it would find."""
    return events.select(F.col("user_id").alias("sample"), F.lit(0).cast("long").alias("revision"), F.col("event_type").alias("content"),
                         (F.col("event_id") % 7).cast("string").alias("reviewer"), F.lit(True).alias("human"), F.col("ts").cast("timestamp").alias("at"), F.col("event_id").alias("id"))


@query("""SELECT sample, CASE WHEN rn = 1 THEN 'correction' WHEN content = first AND reviewer = who THEN 'idempotent' ELSE 'stale' END AS outcome, count(*) AS n FROM (
  SELECT user_id AS sample, event_type AS content, event_id % 7 AS reviewer, row_number() OVER w AS rn, first_value(event_type) OVER w AS first, first_value(event_id % 7) OVER w AS who
  FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)) GROUP BY 1, 2""")
def stream_reviews(t: Tables) -> DataFrame:
    """All submissions are made against revision 0: the first opens revision 1, its retries are no-ops, others stale."""
    out = _drain(fold(_submissions(_stream(t, "events"))), "reviews")
    return out.groupBy("sample", "outcome").agg(F.count(F.lit(1)).alias("n"))


@query("SELECT count(DISTINCT (user_id, event_type, event_id % 7)) AS kept FROM events")
def stream_without_retries(t: Tables) -> DataFrame:
    out = _drain(without_retries(_submissions(_stream(t, "events")), "60 days"), "retries")
    return out.agg(F.count(F.lit(1)).alias("kept"))


@query("SELECT user_id AS worker, epoch_us(max(ts)) // 1000 AS last_ms FROM events GROUP BY 1")
def stream_liveness(t: Tables) -> DataFrame:
    beats = _stream(t, "events").select(F.col("user_id").alias("worker"), F.col("ts").cast("timestamp").alias("at"))
    out = _drain(liveness(beats, 100), "liveness")
    return out.groupBy("worker").agg(F.max("last_ms").alias("last_ms"))


@query("""SELECT event_id AS result, CASE WHEN event_id % 4 = user_id % 4 AND event_id % 5 = user_id % 5 THEN 'current' ELSE 'stale' END AS state FROM events""")
def stream_results(t: Tables) -> DataFrame:
    arriving = _stream(t, "events").select(F.col("event_id").alias("result"), F.col("user_id").alias("sample"), (F.col("event_id") % 4).alias("revision"),
                                           F.concat(F.lit("h"), (F.col("event_id") % 5).cast("string")).alias("image_sha"))
    return _drain(judged_results(arriving, queue_pages(t)), "results").select("result", "state")
