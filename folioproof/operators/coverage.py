"""Coverage of splits and of synthetic recipes."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.labels import LABELS, canonical_label, parity
from ..functions.scalar import identity


def by_split(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Pages, boards, sources and artwork groups per split.

    ``pages`` has id, source, kind, boards (count); ``sources`` has id, split, lineage.
    """
    per_source = pages.groupBy("source").agg(F.count(F.lit(1)).alias("pages"), F.sum("boards").alias("boards"))
    used = sources.join(per_source, sources["id"] == per_source["source"])
    totals = used.groupBy("split").agg(
        F.sum("pages").alias("pages"), F.sum("boards").alias("boards"), F.count(F.lit(1)).alias("sources"))
    art = used.select("split", F.explode("lineage.artwork").alias("a")).groupBy("split").agg(
        F.count_distinct("a").alias("artwork_groups"))
    return totals.join(art, "split", "left").fillna(0, ["artwork_groups"])


def kinds(pages: DataFrame, sources: DataFrame) -> DataFrame:
    """Page kinds and source conditions per split as (split, what, name, n)."""
    counts = pages.groupBy("source", "kind").agg(F.count(F.lit(1)).alias("n"))
    tagged = counts.join(sources.select(F.col("id").alias("source"), "split", "conditions"), "source")
    return tagged.select("split", "n", F.explode(F.concat(
        F.array(F.struct(F.lit("kind").alias("what"), F.col("kind").alias("name"))),
        F.transform("conditions", lambda c: F.struct(F.lit("condition").alias("what"), c.alias("name"))))).alias("e")
    ).groupBy("split", "e.what", "e.name").agg(F.sum("n").alias("n"))


def class_parity(boards: DataFrame, *by: str) -> DataFrame:
    """Squares per label and square colour."""
    squares = boards.select(*by, F.posexplode("labels").alias("square", "label"))
    return squares.groupBy(*by, canonical_label(F.col("label")).alias("label"),
                           parity(F.col("square")).cast("int").alias("parity")).agg(F.count(F.lit(1)).alias("n"))


def missing_cells(counts: DataFrame, domains: dict[str, list], groups: DataFrame | None = None) -> DataFrame:
    """Cells of the product of small fixed domains that ``counts`` does not hold.

    The product is exploded from literals, so it is as large as the domains say and no
    data takes part in it.  With ``groups``, distinct rows of further columns of ``counts``
    (splits, pages), each of them is held against the whole product.
    """
    cells = counts.sparkSession.range(1).select() if groups is None else groups
    over = [] if groups is None else groups.columns
    for name, values in domains.items():
        cells = cells.select("*", F.explode(F.array(*[F.lit(v) for v in values])).alias(name))
    return cells.join(counts.where("n > 0").select(*over, *domains).distinct(), [*over, *domains], "left_anti")


def missing_class_parity(boards: DataFrame, *by: str) -> DataFrame:
    """(by, label, parity) that no square has; ``by`` columns (a split, a page) give a report for each of their values."""
    groups = boards.select(*by).distinct() if by else None
    return missing_cells(class_parity(boards, *by), {"label": LABELS, "parity": [0, 1]}, groups)


def repetition(boards: DataFrame) -> DataFrame:
    """How often positions repeat: distinct ones, the most repeats, boards in repeated ones."""
    counts = boards.groupBy(identity(F.col("labels")).alias("position")).agg(F.count(F.lit(1)).alias("n"))
    return counts.agg(F.count(F.lit(1)).alias("positions"), F.coalesce(F.max("n"), F.lit(0)).alias("max_repetition"),
                      F.coalesce(F.sum(F.when(F.col("n") > 1, F.col("n"))), F.lit(0)).alias("repeated_boards"))


def recipe_counters(recipes: DataFrame) -> DataFrame:
    """All counters of a recipe table as (counter, key, n).

    Boards are costly to make, so their keys and squares are counted in one pass, to (set, effect,
    label, square); the coarser counters are sums of that table, not further passes.
    """
    effect = F.col("condition.degradation.variant")
    page_keys = F.array(
        F.struct(F.lit("page_kinds").alias("counter"), F.col("kind").alias("key")),
        F.struct(F.lit("effects").alias("counter"), F.coalesce(effect, F.lit("unknown")).alias("key")),
        F.struct(F.lit("perspective").alias("counter"), F.when(
            F.col("condition.perspective").isNotNull(), "projective").otherwise("affine-only").alias("key")))
    pages = recipes.select(F.explode(page_keys).alias("e")).groupBy("e.counter", "e.key").agg(F.count(F.lit(1)).alias("n"))
    boards = recipes.select(effect.alias("effect"), "layout", F.col("condition").alias("c"), F.explode("boards").alias("b"))
    joint = F.concat_ws(":", "b.set", "b.position_kind", "layout", "effect", F.col("c.background"), F.col("c.hatched"),
                        F.col("c.square_style"), F.col("c.border"), F.col("c.coordinates"),
                        F.col("c.affine.shear_x"), F.col("c.affine.rotation_deg"),
                        F.col("c.perspective").isNotNull(), "b.orientation")

    def counted(counter: F.Column, key: F.Column, label: F.Column, square: F.Column) -> F.Column:
        return F.struct(counter.cast("string").alias("counter"), key.cast("string").alias("key"), label.cast("string").alias("label"),
                        square.cast("int").alias("square"))

    none = F.lit(None)
    board_keys = F.array(*[counted(F.lit(counter), key, none, none) for counter, key in (
        ("sets", F.col("b.set")), ("position_kinds", F.col("b.position_kind")), ("joint_conditions", joint))])
    on_squares = F.transform("b.labels", lambda label, square: counted(none, none, label, square))
    rows = boards.select(F.col("b.set").alias("set"), "effect", F.explode(F.when(
        F.col("b.labels").isNull(), board_keys).otherwise(F.concat(board_keys, on_squares))).alias("e"))
    fine = (rows.groupBy("set", "effect", "e.counter", "e.key", "e.label", "e.square").agg(F.count(F.lit(1)).alias("n"))
            .withColumn("label", canonical_label(F.col("label"))).withColumn("parity", parity(F.col("square")).cast("int")))

    def level(counter: str, *keys: str) -> F.Column:
        return F.struct(F.lit(counter).alias("counter"), F.concat_ws(":", *keys).alias("key"))

    levels = F.when(F.col("counter").isNotNull(), F.array(F.struct("counter", "key"))).otherwise(F.array(
        level("classes", "label"), level("class_background", "label", "parity"),
        level("set_class_background", "set", "label", "parity"),
        level("set_effect_class_background", "set", "effect", "label", "parity")))
    per_board = fine.select("n", F.explode(levels).alias("e")).groupBy("e.counter", "e.key").agg(F.sum("n").alias("n"))
    return pages.unionByName(per_board)


def recipe_totals(recipes: DataFrame) -> DataFrame:
    """Usable boards, boards of unusable pages, and how often positions repeat, in one row."""
    sizes = recipes.select(F.size("boards").alias("b"), F.size("unsupported_boards").alias("u")).agg(
        F.sum("b").alias("training_boards"), F.sum("u").alias("unsupported_boards"))
    repeats = repetition(recipes.select(F.explode("boards.labels").alias("labels")))
    return repeats.select("*", *[sizes.select(c).scalar().alias(c) for c in ("training_boards", "unsupported_boards")])


def next_action(sources: F.Column, quarantined: F.Column, blockers: F.Column) -> F.Column:
    """What a curator should do next."""
    return (F.when(sources == 0, "add-sources").when(quarantined > 0, "repair-jobs")
            .when(blockers > 0, "resolve-cross-split-duplicates").otherwise("review-and-validate"))


def status(samples: DataFrame, sources: DataFrame, exclusions: DataFrame, pair_counts: DataFrame, states: DataFrame) -> DataFrame:
    """One row over the whole store; ``pair_counts`` and ``states`` are already aggregated."""
    jobs = states.agg(F.coalesce(F.sum(F.when(F.col("state") == "quarantined", F.col("jobs"))), F.lit(0)).alias("n")).scalar()
    n = sources.agg(F.count(F.lit(1))).scalar()
    blockers = pair_counts.select("cross_split_blockers").scalar()
    return page_counts(samples, exclusions).select(
        "*", n.alias("sources"), exclusions.agg(F.count(F.lit(1))).scalar().alias("excluded_sources"), blockers.alias("cross_split_blockers"),
        pair_counts.select("same_split_candidates").scalar().alias("same_split_candidates"),
        next_action(n, jobs, blockers).alias("next_action"))


def recipe_gate(counters: DataFrame, sets: list[str], effects: list[str]) -> DataFrame:
    """What a recipe table fails to expose: missing class cells and perspective values."""
    def keyed(counter: str, names: list[str]) -> DataFrame:
        rows = counters.where(F.col("counter") == counter).withColumn("_k", F.split("key", ":"))
        return rows.select("n", *[F.element_at("_k", i + 1).alias(c) for i, c in enumerate(names)])

    base = {"label": LABELS, "parity": ["0", "1"]}
    by_set = missing_cells(keyed("set_class_background", ["set", "label", "parity"]), {"set": sets, **base})
    by_effect = missing_cells(keyed("set_effect_class_background", ["set", "effect", "label", "parity"]),
                              {"set": sets, "effect": effects, **base})
    view = missing_cells(keyed("perspective", ["view"]), {"view": ["projective", "affine-only"]})
    return (by_set.select(F.lit("set_class_background").alias("gate"), F.concat_ws(":", "set", "label", "parity").alias("cell"))
            .unionByName(by_effect.select(F.lit("set_effect_class_background").alias("gate"),
                                          F.concat_ws(":", "set", "effect", "label", "parity").alias("cell")))
            .unionByName(view.select(F.lit("perspective").alias("gate"), F.col("view").alias("cell"))))


def job_states(jobs: DataFrame, exclusions: DataFrame) -> DataFrame:
    """Jobs by state, overall and for active sources."""
    tagged = jobs.join(exclusions.select("source", F.lit(True).alias("_x")), "source", "left")
    return tagged.groupBy("state").agg(F.count(F.lit(1)).alias("jobs"), F.count_if(F.col("_x").isNull()).alias("active_jobs"))


def incomplete(states: DataFrame) -> DataFrame:
    return states.agg((F.coalesce(F.sum(F.when(F.col("state") != "done", F.col("active_jobs"))), F.lit(0)) > 0)
                      .alias("acquisition_incomplete"))


def page_counts(samples: DataFrame, exclusions: DataFrame) -> DataFrame:
    active = samples.join(exclusions.select("source"), "source", "left_anti")
    return active.agg(F.count(F.lit(1)).alias("pages"), F.count_if("accepted").alias("accepted_pages"),
                      F.count_if(~F.col("accepted")).alias("review_queue"))


def exposure(examples: DataFrame, interval: str, dimensions: list[str]) -> DataFrame:
    """Examples seen per training interval along each dimension, in one aggregation."""
    spread = examples.select(interval, F.explode(F.array(*[
        F.struct(F.lit(d).alias("dimension"), F.col(d).cast("string").alias("name")) for d in dimensions])).alias("e"))
    return spread.groupBy(interval, "e.dimension", "e.name").agg(F.count(F.lit(1)).alias("n"))
