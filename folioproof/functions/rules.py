"""Row rules.  Each returns ``array<string>`` of violation codes; an empty array is a valid row.

A bad row is reported, never raised: one bad record must not abort a job over millions.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from . import geometry as G
from .labels import ORIENTATIONS, PAGE_KINDS, SPLITS, class_id
from .scalar import is_sha256, is_token, plain_https, public_https

# Domains of the record formats.
FORMATS = ["pdf", "png", "jpeg"]
DOWNSTREAM_RIGHTS = ["approved", "denied", "unknown"]
LINEAGE_KINDS = ["document", "edition", "artwork", "parent"]
RECORD_KINDS = ["piece-svg", "pdf", "license-evidence"]
DEFERRAL_REASONS = ["ambiguous", "geometry", "labels", "image-quality", "unreadable-geometry",
                    "ambiguous-pieces", "extensive-repair", "false-proposal", "missing-board"]
EFFECTS = ["blank", "paper", "faded", "soft"]
MAX_BYTES = 512 * 1024 * 1024
MAX_REVIEW_SECONDS = 14400


def codes(*rules: tuple[str, Column]) -> Column:
    """Names of the conditions that do not hold; an unknown (null) condition does not hold."""
    return F.array_compact(F.array(*[
        F.when(~F.coalesce(holds, F.lit(False)), F.lit(code)) for code, holds in rules]))


def _text(value: Column, longest: int) -> Column:
    return F.length(value).between(1, longest)


def source_rules() -> Column:
    """Admission of a source manifest (columns as in :data:`folioproof.sources.manifests.SOURCE`)."""
    c = F.col
    pages = c("pages")
    lineage = [F.coalesce(F.size(c("lineage")[k]) > 0, F.lit(False))
               & F.forall(c("lineage")[k], lambda v: is_token(v)) for k in LINEAGE_KINDS]
    provenance = [_text(c(k), 4000) for k in
                  ("revision", "attribution", "edition", "selection_reason", "pretrained_overlap")]
    evidence = [F.length(c("rights")[k]) > 0 for k in ("reviewer", "evidence_url", "license", "exclusions")]

    def every(conditions: list[Column]) -> Column:
        out = conditions[0]
        for extra in conditions[1:]:
            out = out & extra
        return out

    return codes(
        ("id", is_token(c("id"), 64)),
        ("sha256", is_sha256(c("sha256"))),
        ("split", c("split").isin(SPLITS)),
        ("format", c("format").isin(FORMATS)),
        ("byte-ceiling", c("max_bytes").between(1, MAX_BYTES)),
        ("pages", F.size(pages).between(1, 2000) & (F.size(F.array_distinct(pages)) == F.size(pages))
         & F.forall(pages, lambda p: p.between(1, 100000))),
        ("image-pages", (c("format") == "pdf") | ((F.size(pages) == 1) & (pages[0] == 1))),
        ("provenance", every(provenance)),
        ("private", ~c("private")),
        ("real", c("real")),
        ("lineage", every(lineage)),
        ("lineage-review", c("lineage_reviewed")),
        ("conditions", (F.size("conditions") > 0) & F.forall("conditions", lambda v: is_token(v))),
        ("rights-evidence", every(evidence)),
        ("rights-date", F.try_to_date(c("rights.review_date"), "yyyy-MM-dd").isNotNull()),
        ("rights-hash", is_sha256(c("rights.evidence_sha256"))),
        ("acquisition-rights", c("rights.acquisition") == "approved"),
        ("split-rights", F.when(c("split") == "train", c("rights.training"))
         .otherwise(c("rights.evaluation")) == "approved"),
        ("downstream-rights", c("rights.redistribution").isin(DOWNSTREAM_RIGHTS)
         & c("rights.model_publication").isin(DOWNSTREAM_RIGHTS)),
        ("url", plain_https(c("url"))))


def _finite(value: Column) -> Column:
    return value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))


def _inside(quad: Column, width: Column, height: Column) -> Column:
    return F.forall(quad, lambda p: _finite(p["x"]) & _finite(p["y"]) & p["x"].between(0, width)
                    & p["y"].between(0, height))


def board_geometry_rules(quad: Column, width: Column, height: Column) -> list[tuple[str, Column]]:
    return [("corners", F.size(quad) == 4),
            ("corner-bounds", _inside(quad, width, height)),
            ("convex", G.convex_clockwise(quad, 1.0)),
            ("corner-order", G.image_ordered(quad)),
            ("grid-size", F.array_min(G.edge_lengths(quad)) >= 16)]


def annotation_rules(kind: str = "kind", complete: str = "complete_page", boards: str = "boards",
                     width: str = "width", height: str = "height") -> Column:
    """A page annotation against its page size."""
    b, w, h = F.col(boards), F.col(width), F.col(height)

    def board_codes(x: Column) -> Column:
        return codes(
            ("labels", (F.size(x["labels"]) == 64) & F.forall(
                x["labels"], lambda v: class_id(v).isNotNull() & (F.length(v) == 1))),
            ("orientation", x["orientation"].isin(ORIENTATIONS)),
            *board_geometry_rules(x["corners"], w, h))

    page = codes(
        ("kind", F.col(kind).isin(PAGE_KINDS)),
        ("complete", F.col(complete)),
        ("board-count", F.size(b) <= 64),
        ("kind-boards", (F.col(kind) == "boards") == (F.size(b) > 0)))
    return F.array_sort(F.array_distinct(F.concat(page, F.flatten(F.transform(b, board_codes)))))


def _probabilities(p: Column) -> Column:
    total = F.aggregate(p, F.lit(0.0), lambda a, x: a + x)
    return p.isNull() | ((F.size(p) == 13) & F.forall(p, lambda x: x.between(0, 1)) & (F.abs(total - 1) <= 1e-4))


def result_rules(boards: str = "boards", status: str = "status", width: str = "width",
                 height: str = "height") -> Column:
    """A recognition result: boards of 64 squares with label, probabilities, uncertain."""
    b, w, h = F.col(boards), F.col(width), F.col(height)

    def board_codes(x: Column) -> Column:
        return codes(
            ("squares", F.size(x["squares"]) == 64),
            ("square-label", F.forall(x["squares"], lambda s: s["label"].isNull() | class_id(s["label"]).isNotNull())),
            ("probabilities", F.forall(x["squares"], lambda s: _probabilities(s["probabilities"]))),
            ("missing-evidence", F.forall(x["squares"], lambda s: s["uncertain"]
                                          | (s["label"].isNotNull() & s["probabilities"].isNotNull()))),
            ("corner-bounds", _inside(x["corners"], w, h)),
            ("convex", G.convex_clockwise(x["corners"], 0.0)))

    page = codes(("board-count", F.size(b) <= 16),
                 ("status", F.col(status).isin("ok", "unsupported", "error")),
                 ("success-needs-board", (F.col(status) != "ok") | (F.size(b) > 0)))
    return F.array_sort(F.array_distinct(F.concat(page, F.flatten(F.transform(b, board_codes)))))


def proposal_rules(boards: str = "boards", status: str = "status", providers: str = "providers",
                   total_ms: str = "total_ms", width: str = "width", height: str = "height") -> Column:
    """A proposal: two providers, boards exactly when ok, aligned probabilities and flags."""
    b, w, h = F.col(boards), F.col(width), F.col(height)

    def board_codes(x: Column) -> Column:
        p, u = x["probabilities"], x["uncertain"]
        return codes(
            ("id", _text(x["id"], 100)),
            ("labels", (F.size(x["labels"]) == 64) & F.forall(x["labels"], lambda v: class_id(v).isNotNull())),
            ("orientation", x["orientation"].isin(ORIENTATIONS)),
            ("uncertain", F.size(u) == 64),
            ("probabilities", (F.size(p) == 64) & F.forall(p, _probabilities)),
            ("missing-evidence", ~F.exists(F.arrays_zip(p.alias("p"), u.alias("u")),
                                           lambda z: z["p"].isNull() & ~F.coalesce(z["u"], F.lit(False)))),
            *board_geometry_rules(x["corners"], w, h))

    page = codes(("status", F.col(status).isin("ok", "unsupported")),
                 ("providers", F.size(providers) == 2),
                 ("timing", F.col(total_ms).between(0, 120000)),
                 ("board-count", F.size(b) <= 16),
                 ("status-boards", (F.col(status) == "ok") == (F.size(b) > 0)))
    return F.array_sort(F.array_distinct(F.concat(page, F.flatten(F.transform(b, board_codes)))))


def degradation_rules(config: Column) -> list[tuple[str, Column]]:
    blank = ((config["paper_noise"] == 0) & (config["ink_fade"] == 0) & (config["illumination"] == 0)
             & (config["blur_radius"] == 0))
    return [("variant", config["variant"].isin(EFFECTS)),
            ("seed", config["seed"].between(0, 0xFFFFFFFF)),
            ("paper-noise", config["paper_noise"].between(0, 3)),
            ("ink-fade", config["ink_fade"].between(0, 0.08)),
            ("illumination", config["illumination"].between(0, 0.06)),
            ("blur", config["blur_radius"].isin(0, 1)),
            ("blank-identity", (config["variant"] != "blank") | blank)]


def recipe_rules(sets: list[str]) -> Column:
    """A synthetic page recipe as made by :mod:`folioproof.operators.recipes`."""
    c = F.col
    usable, unusable = F.coalesce(c("boards"), F.array()), F.coalesce(c("unsupported_boards"), F.array())
    matrix = c("condition.perspective")

    def board_codes(b: Column) -> Column:
        quad, flat_quad = b["corners"], F.coalesce(b["render_corners"], b["corners"])
        tl, tr, br, bl = (flat_quad[i] for i in range(4))
        cross = (tr["x"] - tl["x"]) * (bl["y"] - tl["y"]) - (tr["y"] - tl["y"]) * (bl["x"] - tl["x"])
        again = [G.project([matrix[i] for i in range(9)], flat_quad[i]) for i in range(4)]
        same = F.lit(True)
        for i in range(4):
            same = (same & (F.abs(quad[i]["x"] - again[i]["x"]) < 1e-7)
                    & (F.abs(quad[i]["y"] - again[i]["y"]) < 1e-7))
        return codes(
            ("board-id", b["id"].rlike("^[a-z0-9-]{1,40}$")),
            ("set", b["set"].isin(sets)),
            ("labels", (F.size(b["labels"]) == 64) & F.forall(
                b["labels"], lambda v: class_id(v).isNotNull() & (F.length(v) == 1))),
            ("orientation", b["orientation"].isin(ORIENTATIONS)),
            ("corners", F.size(quad) == 4),
            ("render-corners", matrix.isNotNull() == b["render_corners"].isNotNull()),
            ("projection", matrix.isNull() | same),
            ("page-bounds", _inside(quad, c("width"), c("height")) & _inside(flat_quad, c("width"), c("height"))),
            ("degenerate", cross >= 64 * 64),
            ("parallelogram", (F.abs(br["x"] - tr["x"] - bl["x"] + tl["x"]) < 1e-7)
             & (F.abs(br["y"] - tr["y"] - bl["y"] + tl["y"]) < 1e-7)))

    page = codes(
        ("kind", c("kind").isin("boards", "negative", "partial")),
        ("usable-targets", (c("kind") == "boards") | (F.size(usable) == 0)),
        ("unsupported-targets", (c("kind") == "partial") | (F.size(unusable) == 0)),
        ("index", c("index") >= 0),
        ("size", c("width").between(200, 2400) & c("height").between(200, 2400)),
        ("board-count", (F.size(usable) <= 4) & (F.size(unusable) <= 4)
         & ((F.size(usable) > 0) | c("kind").isin("negative", "partial"))),
        *degradation_rules(c("condition.degradation")))
    return F.array_sort(F.array_distinct(F.concat(
        page, F.flatten(F.transform(usable, board_codes)), F.flatten(F.transform(unusable, board_codes)))))


def review_rules() -> Column:
    """A submission joined to its page (``current_revision``, ``current_sha``; null when unknown)."""
    c = F.col
    return codes(
        ("sample", is_token(c("sample").cast("string")) & c("current_revision").isNotNull()),
        ("reviewer", F.length(F.trim(c("reviewer"))).between(1, 80)),
        ("human", c("human").isNotNull()),
        ("seconds", (c("seconds") > 0) & (c("seconds") <= MAX_REVIEW_SECONDS)),
        ("image", c("image_sha") == c("current_sha")),
        ("revision", (c("revision") == c("current_revision")) | (c("revision") == c("current_revision") - 1)))


def deferral_rules() -> Column:
    c = F.col
    return codes(
        ("reason", c("reason").isin(DEFERRAL_REASONS)),
        ("seconds", c("seconds").between(0, MAX_REVIEW_SECONDS)),
        ("run", c("proposal_run").isNull() | is_sha256(c("proposal_run"))),
        ("stale", (c("revision") == c("current_revision")) & (c("image_sha") == c("current_sha"))))


def registry_rules() -> Column:
    """One provenance record on its own; links between records are checked by a join."""
    c = F.col
    return codes(
        ("id", is_token(c("id"), 100)),
        ("kind", c("kind").isin(RECORD_KINDS)),
        ("url", public_https(c("url"))),
        ("revision", _text(c("revision"), 200)),
        ("sha256", is_sha256(c("sha256"))),
        ("bytes", (c("bytes") > 0) & c("max_bytes").between(1, MAX_BYTES) & (c("bytes") <= c("max_bytes"))),
        ("attribution", _text(c("attribution"), 1000)),
        ("license", _text(c("license"), 500)),
        ("evidence", (F.size("evidence_ids") <= 20)
         & ((c("kind") == "license-evidence") | (F.size("evidence_ids") > 0))),
        ("pages", c("pages").isNull() | (F.size(F.array_distinct("pages")) == F.size("pages"))),
        ("split", c("split").isNull() | c("split").isin(SPLITS)))


def registry_violations(records: DataFrame) -> DataFrame:
    """(id, code) over a registry: row rules, repeated ids, dangling evidence."""
    own = records.select("id", F.explode(registry_rules()).alias("code"))
    repeated = records.groupBy("id").count().where("count > 1").select("id", F.lit("repeated-id").alias("code"))
    links = records.select("id", F.explode("evidence_ids").alias("evidence")).distinct()
    dangling = (links.join(records.select(F.col("id").alias("evidence")).distinct(), "evidence", "left_anti")
                .select("id", F.lit("dangling-evidence").alias("code")))
    return own.unionByName(repeated).unionByName(dangling).distinct()


def session_violations(entries: DataFrame) -> DataFrame:
    """(session, code) of paired evaluation sessions: one row per (session, index, mode)."""
    per_key = entries.groupBy("session", "index", "mode").agg(F.count(F.lit(1)).alias("n"))
    sizes = entries.groupBy("session").agg(
        F.count(F.lit(1)).alias("entries"), F.count_distinct("index").alias("inputs"),
        F.count_if(~F.coalesce((F.col("result_width") == F.col("width"))
                               & (F.col("result_height") == F.col("height")), F.lit(False))).alias("changed"))
    repeated = per_key.where("n > 1").select("session").distinct().withColumn("code", F.lit("repeated-entry"))
    rest = sizes.select("session", F.explode(F.array_compact(F.array(
        F.when(F.col("entries") > 40, F.lit("too-many-entries")),
        F.when(F.col("inputs") > 20, F.lit("too-many-inputs")),
        F.when(F.col("changed") > 0, F.lit("result-image-changed"))))).alias("code"))
    return repeated.unionByName(rest)
