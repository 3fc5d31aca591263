"""Synthetic page recipes as column expressions over a table of indices.

Every value depends on the seed and the row's index alone, so a recipe table is a
projection: it needs no shuffle, and any slice of it can be made again anywhere.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import geometry as G
from ..functions.scalar import digest_number, let, texts
from ..plans.ordered import running

# Layouts, effects and legal positions of the recipe format.
PIECES = ["P", "N", "B", "R", "Q", "K", "p", "n", "b", "r", "q", "k"]
OPENINGS = ["rnbqkbnr/pppppppp/8/8/8/8/PPPPPPPP/RNBQKBNR",
            "rnbqkbnr/pppp1ppp/8/4p3/4P3/8/PPPP1PPP/RNBQKBNR",
            "rnbqkbnr/pppp1ppp/8/4p3/4P3/5N2/PPPP1PPP/RNBQKB1R"]
OCCUPIED = {"empty": 0, "sparse": 8, "medium": 22, "dense": 42}
EFFECTS = ["blank", "paper", "faded", "soft"]
DEFAULT_SETS = ["set-a", "set-b", "set-c"]
# Board edges (x, y, size) per layout variant.
FRAMES = {0: [(156, 178, 300)], 1: [(68, 110, 480)], 2: [(62, 126, 270), (460, 280, 210)],
          3: [(236, 118, 330), (62, 450, 150)]}


def _div(value: Column, by: int) -> Column:
    return F.floor(value / by)


def _pick(values: list[str], at: Column) -> Column:
    return F.element_at(texts(values), (at + 1).cast("int"))


def opening_labels(index: Column) -> Column:
    """64 labels of one of the legal positions."""
    boards = []
    for text in OPENINGS:
        for n in range(1, 9):
            text = text.replace(str(n), "." * n)
        boards.append(texts(list(text.replace("/", ""))))
    return F.element_at(F.array(*boards), (index % len(OPENINGS) + 1).cast("int"))


def random_labels(seed: Column | str, index: Column, board: int, occupied: Column) -> Column:
    """A board with ``occupied`` pieces on random squares, kinds cycling from a random start.

    Squares are ranked by 16 random bits each (four SHA-256 of the key), the square number
    breaking ties; the first ``occupied`` get a piece in rank order.
    """
    key = F.concat_ws(":", seed if isinstance(seed, Column) else F.lit(str(seed)), index.cast("string"), F.lit(str(board)))
    bits = F.concat(*[F.sha2(F.concat(key, F.lit(f":{i}")), 256) for i in range(4)])
    start = digest_number(seed, index, F.lit(board), F.lit("start")) % len(PIECES)
    squares = F.sequence(F.lit(0), F.lit(63))
    pieces = texts(PIECES)

    def ranked(b: Column) -> Column:
        return F.transform(F.array_sort(F.transform(squares, lambda s: F.struct(
            F.substr(b, s * 4 + 1, F.lit(4)).alias("u"), s.alias("s")))), lambda z: z["s"])

    def placed(order: Column, first: Column, most: Column) -> Column:
        # Sorting (square, place) back by square inverts the ranking.
        places = F.array_sort(F.transform(order, lambda s, r: F.struct(s.alias("s"), r.alias("r"))))
        return F.transform(places, lambda z: F.when(z["r"] < most, F.element_at(
            pieces, ((z["r"] + first) % len(PIECES) + 1).cast("int"))).otherwise(F.lit(".")))

    return let(bits, lambda b: let(ranked(b), lambda order: let(
        start, lambda first: let(occupied, lambda most: placed(order, first, most)))))


#: How strong each effect is: grain in grey levels, share of ink lost, uneven light, passes of softening.
STRENGTH = {"blank": (0.0, 0.0, 0.0, 0), "paper": (2.5, 0.0, 0.01, 0), "faded": (0.5, 0.05, 0.03, 0), "soft": (0.5, 0.01, 0.01, 1)}


def degradation(seed: Column | str, index: Column) -> Column:
    """The effect of a page, in turn, with its strengths and a seed of its own."""
    variant = _pick(EFFECTS, index % len(EFFECTS))
    table = F.create_map(*[x for name, values in STRENGTH.items() for x in (F.lit(name), F.struct(*[
        F.lit(v).alias(field) for v, field in zip(values, ("paper_noise", "ink_fade", "illumination", "blur_radius"))]))])
    return let(table[variant], lambda s: F.struct(
        variant.alias("variant"), digest_number(seed, index, F.lit("effect")).alias("seed"), s["paper_noise"].alias("paper_noise"),
        s["ink_fade"].alias("ink_fade"), s["illumination"].alias("illumination"), s["blur_radius"].alias("blur_radius")))


#: How much farther the far edge of a tilted page is than the near one.
TILT = 0.06


def perspective(width: Column, height: Column, index: Column) -> Column:
    """Every fifth page is tilted back about its left or its top edge; nothing leaves the page."""
    sideways = (index % 2 == 1).cast("double")
    matrix = F.array(F.lit(1.0), F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0), F.lit(0.0), TILT * sideways / width, TILT * (1 - sideways) / height, F.lit(1.0))
    return F.when(index % 5 == 4, matrix)


def recipes(indices: DataFrame, seed: str, sets: list[str] | None = None, index: str = "index",
            parts: int | None = None) -> DataFrame:
    """One page recipe per index (a non-negative long).

    Eight bytes per row go in and tens of kilobytes come out, so ``parts`` may spread the
    indices first; that shuffle is nothing beside the work it balances.
    """
    sets = sets or DEFAULT_SETS
    if parts:
        indices = indices.select(index).repartition(parts, index)
    i = F.col("index")
    variant = i % 4
    base = indices.select(F.col(index).alias("index")).select(
        "index", F.when(variant == 0, 612).otherwise(792).alias("width"),
        F.when(variant == 0, 792).otherwise(612).alias("height"),
        F.when(i % 20 == 0, "legal-opening").when(i % 29 == 28, "empty")
        .otherwise(_pick(["sparse", "medium", "dense"], i % 3)).alias("_position"),
        F.when(i % 7 == 0, "black-bottom").otherwise("white-bottom").alias("_side"),
        F.when(i % 6 == 0, 0.024).when(i % 6 == 3, -0.018).otherwise(0.0).alias("_shear"),
        F.when(i % 8 == 5, 1.25).when(i % 8 == 7, -1.25).otherwise(0.0).alias("_turn"))
    occupied = F.lit(0)
    for kind, n in OCCUPIED.items():
        occupied = F.when(F.col("_position") == kind, n).otherwise(occupied)
    # Each label array is a column of its own, so no later expression works it out again.
    base = base.select(
        "*", perspective(F.col("width"), F.col("height"), i).alias("_matrix"),
        F.when(F.col("_position") == "legal-opening", opening_labels(_div(i, 20))).otherwise(
            random_labels(seed, i, 0, occupied)).alias("_first"),
        F.when(variant >= 2, random_labels(seed, i, 1, F.when(variant == 2, OCCUPIED["sparse"]).otherwise(
            OCCUPIED["dense"]))).alias("_second"))

    def edge(number: int, part: int) -> str:
        cases = " ".join(f"WHEN {v} THEN {frames[number][part]}" for v, frames in FRAMES.items() if number < len(frames))
        return f"(CASE index % 4 {cases} END)"

    def board(number: int, labels: Column, set_at: Column, side: Column, kind: Column) -> Column:
        x, y, size = (edge(number, part) for part in range(3))

        def corner(px: str, py: str) -> Column:
            dx, dy = f"({px} + _shear * {py} - width / 2)", f"({py} - height / 2)"
            c, s = "cos(radians(_turn))", "sin(radians(_turn))"
            return F.expr(f"named_struct('x', if(_shear != 0 OR _turn != 0, width / 2 + {dx} * {c} - {dy} * {s}, double({px})), "
                          f"'y', if(_shear != 0 OR _turn != 0, height / 2 + {dx} * {s} + {dy} * {c}, double({py})))")

        matrix = [F.col("_matrix")[k] for k in range(9)]
        parent = F.when(kind == "legal-opening", F.concat(F.lit("opening-"), (_div(i, 20) % 3).cast("string"))).otherwise(
            F.concat(F.lit(f"teaching-{seed}-"), i.cast("string"), F.lit(f"-board-{number}")))
        return let(F.array(corner(x, y), corner(f"({x} + {size})", y), corner(f"({x} + {size})", f"({y} + {size})"), corner(x, f"({y} + {size})")), lambda moved: F.struct(
            F.lit(f"board-{number}").alias("id"), _pick(sets, set_at % len(sets)).alias("set"),
            F.when(side == "black-bottom", F.reverse(labels)).otherwise(labels).alias("labels"),
            F.when(F.col("_matrix").isNull(), moved).otherwise(F.transform(moved, lambda p: G.project(matrix, p))).alias("corners"),
            F.when(F.col("_matrix").isNotNull(), moved).alias("render_corners"),
            side.alias("orientation"), kind.alias("position_kind"), parent.alias("parent")))

    one = board(0, F.col("_first"), _div(i, 3), F.col("_side"), F.col("_position"))
    two = board(1, F.col("_second"), i + variant - 1, F.when(variant == 2, "white-bottom").otherwise("black-bottom"),
                F.when(variant == 2, "sparse").otherwise("dense"))
    drawn = F.array_compact(F.array(one, F.when(variant >= 2, two)))
    negative = i % 11 == 10
    partial = ~negative & (i % 37 == 36)
    made = base.withColumn("_boards", drawn)
    none = F.filter("_boards", lambda b: F.lit(False))
    return made.select(
        "index", "width", "height",
        F.when(negative, "negative").when(partial, "partial").otherwise("boards").alias("kind"),
        F.when(~negative & (variant >= 2), "multiple-boards").when(variant == 1, "large-board")
        .otherwise("small-board").alias("layout"),
        F.when(negative | partial, none).otherwise(F.col("_boards")).alias("boards"),
        F.when(partial, F.col("_boards")).otherwise(none).alias("unsupported_boards"),
        F.struct(
            F.lit(True).alias("captions"), (i % 2 == 0).alias("coordinates"),
            F.when(_div(i, 9) % 3 == 0, "cream").otherwise("paper").alias("background"), (i % 4 == 1).alias("hatched"),
            F.when(i % 5 == 2, "color").otherwise("grayscale").alias("square_style"),
            F.when(i % 3 == 0, "double").otherwise("single").alias("border"),
            F.struct(F.col("_shear").alias("shear_x"), F.col("_turn").alias("rotation_deg")).alias("affine"),
            F.col("_matrix").alias("perspective"), degradation(seed, _div(i, 4)).alias("degradation"),
            negative.alias("negative"), partial.alias("partial")).alias("condition"))


def split_keys(pages: DataFrame) -> DataFrame:
    """(item, key): pages that share a position or an effect control must share a split."""
    return pages.select(F.col("index").alias("item"), F.explode(F.concat(
        F.array(F.concat(F.lit("effect="), F.col("condition.degradation.seed").cast("string"))),
        F.transform("boards", lambda b: F.concat(F.lit("parent="), b["parent"])))).alias("key")).distinct()


def uniform_pages(documents: DataFrame, count: str, wanted: str) -> DataFrame:
    """Evenly spread page numbers of each document, first and last included, halves to even."""
    n = F.least(F.col(wanted), F.col(count)).cast("int")
    picks = F.array_sort(F.array_distinct(F.transform(
        F.sequence(F.lit(0), n - 1),
        lambda i: (F.bround(i * (F.col(count) - 1) / F.greatest(F.lit(1), n - 1), 0) + 1).cast("long"))))
    return documents.where(n > 0).withColumn("page", F.explode(picks))


def epoch_order(items: DataFrame, item: str, seed: int | str, epochs: int, batch: int) -> DataFrame:
    """(epoch, position, batch, item): every item once per epoch in a new seeded order.

    Resuming is a filter on (epoch, position); the order never has to be replayed.
    """
    spread = items.select(F.col(item).alias(item), F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch"))
    keyed = spread.withColumn("_u", F.md5(F.concat_ws(":", F.lit(str(seed)), F.col("epoch").cast("string"),
                                                      F.col(item).cast("string"))))
    out = running(keyed, ["epoch"], [F.col("_u"), F.col(item)], number="_n")
    return out.select("epoch", (F.col("_n") - 1).cast("long").alias("position"),
                      F.floor((F.col("_n") - 1) / batch).cast("long").alias("batch"), item)
