"""Review log, proposals and the page queue."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions.scalar import stale
from ..plans.ordered import ordered, running, scan
from ..plans.session import keep
from .detect import touching
from .matching import claim_in_rounds

SCOPES = {"train-pending": ("train", False), "train-all": ("train", None), "accepted-train": ("train", True),
          "dev-pending": ("dev", False), "dev-all": ("dev", None), "accepted-dev": ("dev", True)}


def revisions(log: DataFrame) -> DataFrame:
    """Number the revisions of each page: a changed content is a correction and opens a new
    revision, an equal one confirms.  ``log`` has sample, content, at, id."""
    rows = ordered(log, [F.col("sample"), F.col("at"), F.col("id")])
    seen = scan(rows, ["sample"], previous={"_before": F.col("content")})
    seen = seen.withColumn("_changed", (~F.col("content").eqNullSafe(F.col("_before"))).cast("int"))
    return (scan(seen, ["sample"], sums={"revision": F.col("_changed")})
            .withColumn("decision", F.when(F.col("_changed") == 1, "correction").otherwise("confirmation"))
            .drop("_slot", "_before", "_changed"))


def page_state(log: DataFrame) -> DataFrame:
    """Current revision, content and acceptance per page: one human review of the current
    revision accepts; other reviews never do."""
    per_revision = revisions(log).groupBy("sample", "revision").agg(
        F.max_by("content", F.struct("at", "id")).alias("content"), F.bool_or("human").alias("accepted"),
        F.count(F.lit(1)).alias("reviews"), F.sum("seconds").alias("seconds"))
    return per_revision.groupBy("sample").agg(
        F.max("revision").alias("revision"), F.max_by("content", "revision").alias("content"),
        F.max_by("accepted", "revision").alias("accepted"), F.sum("reviews").alias("reviews"),
        F.sum("seconds").alias("seconds"))


def latest(df: DataFrame, key: list[str], order: list[str], *values: str) -> DataFrame:
    """The last row per key as an aggregate, so hot keys combine before the shuffle."""
    at = F.struct(*order) if len(order) > 1 else F.col(order[0])
    best = df.groupBy(*key).agg(F.max_by(F.struct(*values), at).alias("_v"))
    return best.select(*key, *[F.col(f"_v.{v}").alias(v) for v in values])


def latest_deferral(deferrals: DataFrame, samples: DataFrame) -> DataFrame:
    """Last deferral reason of the current revision."""
    current = deferrals.join(samples.select(F.col("id").alias("sample"), "revision"), ["sample", "revision"])
    return latest(current, ["sample", "revision"], ["deferral"], "reason")


def current_results(results: DataFrame, samples: DataFrame) -> DataFrame:
    """Proposal results with ``state`` 'current' or 'stale' by revision and image hash."""
    now = samples.select(F.col("id").alias("sample"), F.col("revision").alias("_r"), F.col("sha").alias("_s"))
    joined = results.join(now, "sample", "left")
    fresh = (F.col("revision") == F.col("_r")) & (F.col("image_sha") == F.col("_s"))
    return joined.withColumn("state", F.when(fresh, "current").otherwise("stale")).drop("_r", "_s")


def page_queue(samples: DataFrame, exclusions: DataFrame, drafts: DataFrame, deferrals: DataFrame,
               results: DataFrame) -> DataFrame:
    """One row per active page: draft flag, last deferral, count of current proposals, state."""
    active = samples.join(exclusions.select("source"), "source", "left_anti")
    draft = drafts.select(F.col("sample").alias("id"), "revision", F.col("kind").alias("draft_kind"))
    held = latest_deferral(deferrals, samples).select(
        F.col("sample").alias("id"), "revision", F.col("reason").alias("deferred_reason"))
    counts = (results.select(F.col("sample").alias("id"), "revision", F.col("image_sha").alias("sha"))
              .groupBy("id", "revision", "sha").agg(F.count(F.lit(1)).alias("_c")))
    return (active.join(draft, ["id", "revision"], "left").join(held, ["id", "revision"], "left")
            .join(counts, ["id", "revision", "sha"], "left")
            .select("id", "source", "page", "revision", "accepted",
                    F.col("draft_kind").isNotNull().alias("draft"), "deferred_reason",
                    F.coalesce("_c", F.lit(0)).alias("proposal_count"),
                    F.coalesce("draft_kind", "kind").alias("review_state")))


def queue_filter(name: str) -> Column:
    """Named views of the queue."""
    return {"all": F.lit(True), "pending": ~F.col("accepted"), "accepted": F.col("accepted"),
            "proposal": F.col("proposal_count") > 0, "deferred": F.col("deferred_reason").isNotNull(),
            "ambiguous": F.coalesce(F.col("review_state").isin("partial", "unsupported"), F.lit(False))}[name]


def proposal_scope(samples: DataFrame, sources: DataFrame, exclusions: DataFrame, scope: str,
                   limit: int | None = None) -> DataFrame:
    """Pages of a proposal run; qualification and regression are never a scope."""
    if scope not in SCOPES:
        raise ValueError(f"no proposals are made for {scope!r}")
    split, accepted = SCOPES[scope]
    rows = (samples.join(exclusions.select("source"), "source", "left_anti")
            .join(sources.where(F.col("split") == split).select(F.col("id").alias("source")), "source"))
    if accepted is not None:
        rows = rows.where(F.col("accepted") == accepted)
    rows = rows.select("id", "source", "page", "revision", "sha")
    return rows if limit is None else rows.orderBy("source", "page").limit(limit)


def unconfirmed(samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """Accepted pages without a human review of their revision and content."""
    human = reviews.where("human").select(F.col("sample").alias("id"), "revision", "content")
    return samples.where("accepted").join(human, ["id", "revision", "content"], "left_anti")


def promotable(samples: DataFrame, reviews: DataFrame) -> DataFrame:
    """Pending pages a human has already confirmed."""
    human = reviews.where("human").select(F.col("sample").alias("id"), "revision", "content")
    return samples.where("not accepted").join(human, ["id", "revision", "content"], "left_semi")


def attempt_ordinals(attempts: DataFrame, order: list[str]) -> DataFrame:
    """0-based attempt number per (run, sample)."""
    out = running(attempts, ["run", "sample"], [F.col(c) for c in order], number="_n")
    return out.withColumn("ordinal", F.col("_n") - 1).drop("_n")


def run_rollup(runs: DataFrame, attempts: DataFrame, results: DataFrame, now: Column,
               states: list[str], stale_after: float = 90) -> DataFrame:
    """Per run: attempts by state, completed pages, and the stale flag of a silent run."""
    by_state = attempts.groupBy("run").agg(*[
        F.count_if(F.col("state") == s).alias(f"attempts_{s}") for s in states])
    done = results.groupBy("run").agg(F.count(F.lit(1)).alias("completed"))
    quiet = F.col("state").isin("starting", "running") & stale(now, F.col("heartbeat"), stale_after)
    return (runs.join(by_state, "run", "left").join(done, "run", "left")
            .fillna(0, ["completed", *[f"attempts_{s}" for s in states]])
            .withColumn("state", F.when(quiet, "heartbeat-stale-resume-required").otherwise(F.col("state"))))


def polygon_matches(proposed: DataFrame, final: DataFrame, least: float = 0.5, big_page: int = 4096) -> DataFrame:
    """One-to-one proposal/review boards of a page by polygon IoU, largest first.

    Boards are ``page, number, corners, labels``.  Only boards whose bounds overlap are
    compared.  Ties go to the larger proposal number, then the larger review number.
    """

    def side(df: DataFrame, n: str) -> DataFrame:
        b = G.bounds(F.col("corners"))
        return df.select("page", F.col("number").alias(n), F.col("corners").alias(f"{n}_corners"),
                         F.col("labels").alias(f"{n}_labels"), *[v.alias(f"{n}_{k}") for k, v in b.items()])

    p, t = side(proposed, "p"), side(final, "t")
    meet = "least(p_x1, t_x1) > greatest(p_x0, t_x0) and least(p_y1, t_y1) > greatest(p_y0, t_y0)"
    big = keep(proposed.select("page").unionByName(final.select("page")).groupBy("page").count()
               .where(F.col("count") > big_page).select("page"))
    if big.isEmpty():
        near = p.join(t, "page").where(meet)
    else:
        # Oversized pages are paired through grid cells, not all with all, wherever bounds overlap:
        # a slanted board may fill any share of its bounds.
        few = F.broadcast(big)

        def bounds_of(df: DataFrame, n: str) -> DataFrame:
            return df.join(few, "page").select("page", F.col(n).alias("id"), *[
                F.col(f"{n}_{c}").alias(c) for c in ("x0", "y0", "x1", "y1")])

        links = touching(bounds_of(p, "p"), bounds_of(t, "t"), ["page"], 0.0).select(
            "page", F.col("l_id").alias("p"), F.col("r_id").alias("t"))
        near = (p.join(few, "page", "left_anti").join(t, "page").where(meet)
                .unionByName(links.join(p, ["page", "p"]).join(t, ["page", "t"]), allowMissingColumns=True))
    pairs = (near.withColumn("iou", G.polygon_iou(F.col("p_corners"), F.col("t_corners")))
             .where(F.col("iou") >= least))
    kept = claim_in_rounds(pairs.select("page", "p", "t", "iou"), ["page"],
                           F.struct(F.col("iou"), F.col("p"), F.col("t")))
    moved = G.corner_error(F.col("p_corners"), F.col("t_corners"))
    return pairs.join(kept.select("page", "p", "t"), ["page", "p", "t"]).select(
        "page", "p", "t", "iou", moved.alias("corner_pixels"),
        F.when(G.mean_edge(F.col("t_corners")) > 0, moved / G.square_width(F.col("t_corners"))).alias("corner_squares"),
        F.size(F.filter(F.zip_with("p_labels", "t_labels", lambda a, b: ~a.eqNullSafe(b)), lambda x: x))
        .alias("piece_corrections"))


def assistance(proposed: DataFrame, final: DataFrame, seconds: DataFrame) -> DataFrame:
    """Assistance metrics per reviewed page (``seconds`` has page, active_seconds)."""
    m = polygon_matches(proposed, final).groupBy("page").agg(
        F.count(F.lit(1)).alias("matched"), F.avg("corner_pixels").alias("corner_pixels"),
        F.avg("corner_squares").alias("corner_squares"), F.sum("piece_corrections").alias("piece_corrections"))
    p = proposed.groupBy("page").agg(F.count(F.lit(1)).alias("proposal_boards"))
    t = final.groupBy("page").agg(F.count(F.lit(1)).alias("review_boards"))
    zero = ["matched", "proposal_boards", "review_boards", "piece_corrections"]
    return (seconds.join(p, "page", "left").join(t, "page", "left").join(m, "page", "left").fillna(0, zero)
            .withColumn("false_boards", F.col("proposal_boards") - F.col("matched"))
            .withColumn("missed_boards", F.col("review_boards") - F.col("matched")))
