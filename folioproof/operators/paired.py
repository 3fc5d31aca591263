"""Two models on the same inputs.

``references``: entry, kind ('board' or other), corners, labels (64).
``boards``: entry, model, index, corners, squares array<struct<label, probabilities, uncertain>>.
``runs``: entry, model, mode, cold, total_ms, warnings array<string>.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions.labels import canonical_label, is_white, occupied
from .ledger import latency

EXACT_WITHIN = 0.25  # fixed value: corner displacement of an exact board, in square widths
COUNTS = ["expected_boards", "returned_boards", "missed_boards", "false_boards", "refinement_failures",
          "exact_boards", "occupied_empty_errors", "piece_class_errors", "color_errors", "wrong_squares",
          "confident_wrong_squares"]


def _square_errors(labels: Column, squares: Column, confident: float) -> dict[str, Column]:
    """Error counts of one board as expressions over its two arrays; nothing is exploded."""
    pairs = F.zip_with(labels, squares, lambda e, s: F.struct(
        canonical_label(e).alias("e"), canonical_label(s["label"]).alias("a"),
        F.coalesce(F.array_max(s["probabilities"]) >= confident, F.lit(False)).alias("sure")))
    wrong = F.filter(pairs, lambda z: ~z["e"].eqNullSafe(z["a"]))

    def count(rule) -> Column:
        return F.size(F.filter(wrong, rule)).cast("long")

    def both(z: Column) -> Column:
        return occupied(z["e"]) & occupied(z["a"])

    return {"wrong_squares": F.size(wrong).cast("long"),
            "occupied_empty_errors": count(lambda z: occupied(z["e"]) != occupied(z["a"])),
            "piece_class_errors": count(lambda z: both(z) & (F.lower(z["e"]) != F.lower(z["a"]))),
            "color_errors": count(lambda z: both(z) & (is_white(z["e"]) != is_white(z["a"]))),
            "confident_wrong_squares": count(lambda z: z["sure"])}


def compare(references: DataFrame, runs: DataFrame, boards: DataFrame, confident: float = 0.99) -> DataFrame:
    """One row per (entry, model).

    Errors are worked out per returned board, then the board of least corner displacement
    is kept by ``min_by`` over a few numbers, so its 64 squares are never shuffled again.
    """
    scored = boards.join(references.select("entry", "kind", F.col("corners").alias("ref_corners"), "labels"), "entry")
    errors = _square_errors(F.col("labels"), F.col("squares"), confident)
    scored = scored.select("entry", "model", "index", "kind",
                           G.corner_displacement(F.col("ref_corners"), F.col("corners")).alias("displacement"),
                           *[c.alias(n) for n, c in errors.items()])
    best = scored.groupBy("entry", "model").agg(
        F.count(F.lit(1)).alias("returned"),
        F.min_by(F.struct("displacement", *errors), F.struct("displacement", "index")).alias("b"))
    out = (runs.join(references.select("entry", "kind"), "entry").join(best, ["entry", "model"], "left"))
    returned = F.coalesce("returned", F.lit(0))
    is_board, empty = F.col("kind") == "board", returned == 0
    failed = F.exists("warnings", lambda w: F.lower(w).contains("refinement"))
    scored_board = is_board & ~empty

    def error(name: str, if_missed: int = 0) -> Column:
        return F.when(scored_board, F.col(f"b.{name}")).when(is_board, if_missed).otherwise(0).cast("long").alias(name)

    displacement = F.when(scored_board, F.col("b.displacement"))
    exact = F.when(~is_board, empty).when(empty, False).otherwise(
        (F.col("b.wrong_squares") == 0) & (displacement <= EXACT_WITHIN))
    return out.select(
        "entry", "model", "mode", "cold", "total_ms",
        is_board.cast("long").alias("expected_boards"), returned.cast("long").alias("returned_boards"),
        (is_board & empty).cast("long").alias("missed_boards"),
        F.when(~is_board, returned).otherwise(F.greatest(F.lit(0), returned - 1)).cast("long").alias("false_boards"),
        (~scored_board & failed).cast("long").alias("refinement_failures"),
        displacement.alias("displacement"), exact.cast("long").alias("exact_boards"),
        error("occupied_empty_errors"), error("piece_class_errors"), error("color_errors"),
        error("wrong_squares", 64), error("confident_wrong_squares"))


def totals(rows: DataFrame) -> DataFrame:
    """Counts per model.  Only this list of columns leaves: no hash, geometry or position."""
    return rows.groupBy("model").agg(
        F.count(F.lit(1)).alias("inputs"), F.count_if(F.col("mode") == "automatic").alias("automatic_inputs"),
        F.count_if(F.col("mode") == "manual-grid").alias("manual_grid_inputs"),
        *[F.sum(c).alias(c) for c in COUNTS], F.count("displacement").alias("displacement_count"),
        F.coalesce(F.sum("displacement"), F.lit(0.0)).alias("displacement_total"))


def latencies(rows: DataFrame) -> DataFrame:
    return latency(rows, ["model", "cold"], "total_ms")


def closest(references: DataFrame, boards: DataFrame) -> DataFrame:
    """(entry, model, index): the returned board nearest to the reference, the first on ties;
    the first board where the reference is not a board."""
    joined = boards.join(references.select("entry", "kind", F.col("corners").alias("_r")), "entry")
    error = F.when(F.col("kind") == "board", G.corner_error(F.col("_r"), F.col("corners"))).otherwise(0.0)
    return joined.groupBy("entry", "model").agg(F.min_by("index", F.struct(error, F.col("index"))).alias("index"))


def display_roles(references: DataFrame, boards: DataFrame) -> DataFrame:
    """Role of every returned board: scored, additional or false-return."""
    near = closest(references, boards).withColumnRenamed("index", "_best")
    out = (boards.select("entry", "model", "index").join(references.select("entry", "kind"), "entry")
           .join(near, ["entry", "model"]))
    role = (F.when(F.col("kind") != "board", "false-return").when(F.col("index") == F.col("_best"), "scored")
            .otherwise("additional"))
    return out.select("entry", "model", "index", role.alias("role"))


def parity(left: DataFrame, right: DataFrame, tolerances: dict[str, float]) -> DataFrame:
    """Largest difference per stage of two tables (stage, item, values), with shape errors.

    The stages come in the order of ``tolerances``; positions are compared inside the row.
    """
    order = {s: i for i, s in enumerate(tolerances)}
    a = left.select("stage", "item", F.col("values").alias("_l"))
    b = right.select("stage", "item", F.col("values").alias("_r"))
    joined = a.join(b, ["stage", "item"], "full_outer")
    bad = F.col("_l").isNull() | F.col("_r").isNull() | (F.size("_l") != F.size("_r")) | F.exists(
        F.concat("_l", "_r"), lambda x: x.isNull() | F.isnan(x))
    worst = F.array_max(F.zip_with("_l", "_r", lambda x, y: F.abs(x - y)))
    rows = joined.groupBy("stage").agg(F.max(F.when(~bad, worst)).alias("max_difference"),
                                       F.count_if(bad).alias("shape_errors"), F.count(F.lit(1)).alias("items"))
    place, limit = F.lit(None).cast("int"), F.lit(None).cast("double")
    for s, i in order.items():
        place = F.when(F.col("stage") == s, i).otherwise(place)
        limit = F.when(F.col("stage") == s, float(tolerances[s])).otherwise(limit)
    passed = (F.col("shape_errors") == 0) & (F.coalesce("max_difference", F.lit(0.0)) <= limit)
    return rows.select("stage", place.cast("int").alias("place"), "items", "max_difference", "shape_errors", passed.alias("passed"))


def first_failing(stages: DataFrame) -> DataFrame:
    return stages.agg(F.min_by("stage", F.when(~F.col("passed"), F.col("place"))).alias("first_failing"))


def matching_files(expected: DataFrame, files: DataFrame) -> DataFrame:
    """Mismatches of (index, sha256, bytes): every expected file present, in order, no extras."""
    from .upsert import agreement
    return agreement(expected, files, ["index"], ["sha256", "bytes"])
