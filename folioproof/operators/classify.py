"""Classification metrics over squares.

``squares`` has board, orientation, truth (class 0..12) and logits (array of 13 doubles).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions.labels import LABELS

# Reporting thresholds and the temperature grid.
CONFIDENCE_STEPS = [0.5, 0.7, 0.9, 0.95, 0.99]
TEMPERATURES = [0.25 + 0.025 * i for i in range(151)]
CONFIDENT = 0.99


def predicted(squares: DataFrame, temperature: float = 1.0) -> DataFrame:
    """Add probabilities, pred, confidence, correct and nll.

    The largest term of the shifted softmax is exp(0), so the confidence is one over the
    total: thirteen exponentials per square serve every metric, and the probability array
    is only built when somebody selects it.
    """
    t = float(temperature)
    shifted = squares.withColumn("_top", F.array_max("logits"))
    parts = [F.exp((F.col("logits")[i] - F.col("_top")) / t) for i in range(len(LABELS))]
    summed = shifted.withColumn("_total", sum(parts[1:], parts[0]))
    return (summed.withColumn("probabilities", F.transform(
                "logits", lambda x: F.exp((x - F.col("_top")) / t) / F.col("_total")))
            .withColumn("confidence", 1 / F.col("_total"))
            .withColumn("pred", (F.array_position("logits", F.col("_top")) - 1).cast("int"))
            .withColumn("correct", F.col("pred") == F.col("truth"))
            .withColumn("nll", F.log("_total") - (F.element_at("logits", F.col("truth") + 1) - F.col("_top")) / t)
            .drop("_top", "_total"))


def _domain(df: DataFrame, n: int, *names: str) -> DataFrame:
    out = df.sparkSession.range(1).select()
    for name in names:
        out = out.select("*", F.explode(F.sequence(F.lit(0), F.lit(n - 1))).alias(name))
    return out


def confusion(p: DataFrame, dense: bool = False) -> DataFrame:
    """(truth, pred, n); ``dense`` adds the zero cells of the 13 x 13 domain."""
    counts = p.groupBy("truth", "pred").agg(F.count(F.lit(1)).alias("n"))
    if not dense:
        return counts
    return (_domain(p, len(LABELS), "truth", "pred").join(F.broadcast(counts), ["truth", "pred"], "left")
            .fillna(0, ["n"]))


def class_scores(matrix: DataFrame) -> DataFrame:
    """Precision parts and F1 of the twelve occupied classes; denominators are at least one."""
    hit = F.when(F.col("truth") == F.col("pred"), F.col("n")).otherwise(0)
    sides = matrix.select(F.explode(F.array(
        F.struct(F.col("truth").alias("class"), hit.alias("tp"), F.col("n").alias("row"), F.lit(0).cast("long").alias("column")),
        F.struct(F.col("pred").alias("class"), F.lit(0).cast("long").alias("tp"), F.lit(0).cast("long").alias("row"),
                 F.col("n").alias("column")))).alias("s")).select("s.*")
    seen = sides.groupBy("class").agg(F.sum("tp").alias("tp"), F.sum("row").alias("row"), F.sum("column").alias("column"))
    every = _domain(matrix, len(LABELS), "class").where("class > 0")
    out = every.join(F.broadcast(seen), "class", "left").fillna(0)
    fp, fn = F.col("column") - F.col("tp"), F.col("row") - F.col("tp")
    return out.select("class", "tp", fp.alias("fp"), fn.alias("fn"),
                      (2 * F.col("tp") / F.greatest(F.lit(1), 2 * F.col("tp") + fp + fn)).alias("f1"))


def macro_f1(matrix: DataFrame) -> DataFrame:
    return class_scores(matrix).agg(F.avg("f1").alias("occupied_macro_f1"))


def error_blocks(matrix: DataFrame) -> DataFrame:
    """Empty/occupied, colour and piece-type errors from the blocks of the confusion."""
    t, p, n = F.col("truth"), F.col("pred"), F.col("n")

    def total(condition: Column) -> Column:
        return F.coalesce(F.sum(F.when(condition, n)), F.lit(0))

    both = (t > 0) & (p > 0)
    return matrix.agg(
        total((t == 0) != (p == 0)).alias("empty_occupied_errors"),
        total(both & ((t <= 6) != (p <= 6))).alias("color_errors"),
        total(both & ((t - 1) % 6 != (p - 1) % 6)).alias("piece_class_errors"))


def confidence_coverage(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Share and wrong count of squares at or above each confidence; one pass, no row blow-up."""
    by = by or []
    sums = [F.count(F.lit(1)).alias("squares")]
    for i, t in enumerate(CONFIDENCE_STEPS):
        sums += [F.count_if(F.col("confidence") >= t).alias(f"a{i}"),
                 F.count_if((F.col("confidence") >= t) & ~F.col("correct")).alias(f"w{i}")]
    steps = F.array(*[F.struct(F.lit(t).alias("threshold"), F.col(f"a{i}").alias("accepted"), F.col(f"w{i}").alias("wrong"))
                      for i, t in enumerate(CONFIDENCE_STEPS)])
    return p.groupBy(*by).agg(*sums).select(*by, "squares", F.explode(steps).alias("s")).select(
        *by, "s.threshold", (F.col("s.accepted") / F.col("squares")).alias("coverage"), "s.wrong")


def report(p: DataFrame, by: list[str] | None = None) -> DataFrame:
    """Board and square accuracy, NLL, confidence and confident errors; strata by ``by``."""
    by = by or []
    boards = p.groupBy("board", *by).agg(
        F.bool_and("correct").alias("exact"), F.count(F.lit(1)).alias("squares"), F.count_if("correct").alias("ok"),
        F.sum("nll").alias("nll"), F.sum("confidence").alias("confidence"),
        F.count_if(~F.col("correct") & (F.col("confidence") >= CONFIDENT)).alias("sure_wrong"))
    n = F.sum("squares")
    return boards.groupBy(*by).agg(
        F.count(F.lit(1)).alias("boards"), n.alias("squares"), F.count_if("exact").alias("exact_boards"),
        (F.count_if("exact") / F.count(F.lit(1))).alias("exact_board_accuracy"), (F.sum("ok") / n).alias("square_accuracy"),
        (F.sum("nll") / n).alias("nll"), (F.sum("confidence") / n).alias("mean_confidence"),
        F.sum("sure_wrong").alias("confident_wrong"))


def report_with_total(p: DataFrame, by: str) -> DataFrame:
    """Strata and total from one aggregation of boards."""
    strata = report(p, [by])
    n = F.sum("squares")
    total = strata.agg(
        F.sum("boards").alias("boards"), n.alias("squares"), F.sum("exact_boards").alias("exact_boards"),
        (F.sum("exact_boards") / F.sum("boards")).alias("exact_board_accuracy"),
        (F.sum(F.col("square_accuracy") * F.col("squares")) / n).alias("square_accuracy"),
        (F.sum(F.col("nll") * F.col("squares")) / n).alias("nll"),
        (F.sum(F.col("mean_confidence") * F.col("squares")) / n).alias("mean_confidence"),
        F.sum("confident_wrong").alias("confident_wrong")).withColumn(by, F.lit("all"))
    return strata.unionByName(total)


def temperature_curve(squares: DataFrame) -> DataFrame:
    """Mean NLL at each temperature of the grid.

    The grid is exploded beside each row inside the scan stage; the map-side combine
    leaves 151 partial sums per task, so the shuffle does not depend on the data.
    """
    grid = F.array(*[F.lit(t) for t in TEMPERATURES])
    top = F.array_max("logits")
    # Shift and target are worked out once per square, not once per temperature.
    base = squares.select(F.transform("logits", lambda x: x - top).alias("z"),
                          (F.element_at("logits", F.col("truth") + 1) - top).alias("zt"))
    spread = base.select("z", "zt", F.explode(grid).alias("temperature"))
    parts = [F.exp(F.col("z")[i] / F.col("temperature")) for i in range(len(LABELS))]
    nll = F.log(sum(parts[1:], parts[0])) - F.col("zt") / F.col("temperature")
    return spread.groupBy("temperature").agg(F.avg(nll).alias("nll"))


def calibrate(squares: DataFrame) -> DataFrame:
    """Best temperature (the lowest on ties), uncertainty threshold and what it accepts."""
    best = temperature_curve(squares).agg(F.min_by("temperature", F.struct("nll", "temperature")).alias("t")).first()["t"]
    p = predicted(squares, best)
    wrong = F.max(F.when(~F.col("correct"), F.col("confidence")))
    limit = p.agg(F.coalesce(F.least(F.lit(1.0), wrong + 1e-6), F.lit(0.0)).alias("t")).first()["t"]
    accepted = F.col("confidence") >= limit
    return p.agg(F.lit(best).alias("temperature"), F.lit(limit).alias("uncertainty_threshold"),
                 (F.count_if(accepted) / F.count(F.lit(1))).alias("accepted_coverage"),
                 F.count_if(accepted & ~F.col("correct")).alias("accepted_wrong"))


def board_squares(pages: DataFrame, split: str) -> DataFrame:
    """Squares of a split: pages of kind 'boards', one row per square with its class."""
    from ..functions.labels import class_id
    boards = pages.where((F.col("split") == split) & (F.col("kind") == "boards")).select(
        "page", F.posexplode("boards").alias("number", "b"))
    return boards.select("page", "number", F.col("b.orientation").alias("orientation"),
                         F.posexplode("b.labels").alias("square", "label")).withColumn("truth", class_id(F.col("label")))
