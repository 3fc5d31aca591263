"""Class labels of a board square and their expressions."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from .scalar import let, texts

# The thirteen classes in dataset order; '.' and 'empty' are one class.
LABELS = [".", "P", "N", "B", "R", "Q", "K", "p", "n", "b", "r", "q", "k"]
EMPTY_ALIAS = "empty"
# The class order of the wire format that lists kings first.
KING_FIRST = [".", "K", "Q", "R", "B", "N", "P", "k", "q", "r", "b", "n", "p"]
ORIENTATIONS = ["unknown", "white-bottom", "black-bottom"]
PAGE_KINDS = ["boards", "negative", "partial", "unsupported"]
SPLITS = ["train", "dev", "qualification", "regression"]
UNCERTAIN_BELOW = 0.7


def label_array() -> Column:
    return texts(LABELS)


def canonical_label(label: Column) -> Column:
    return F.when(label == EMPTY_ALIAS, F.lit(".")).otherwise(label)


def class_id(label: Column) -> Column:
    """0..12, or null for a label outside the domain."""
    at = F.array_position(label_array(), canonical_label(label))
    return F.when(at > 0, (at - 1).cast("int"))


def label_of(class_index: Column) -> Column:
    return F.element_at(label_array(), class_index.cast("int") + 1)


def class_ids(labels: Column) -> Column:
    return F.transform(labels, class_id)


def parity(square: Column) -> Column:
    """Colour of a square: 0 or 1."""
    return (F.floor(square / 8) + square % 8) % 2


def occupied(label: Column) -> Column:
    """A missing label counts as not occupied."""
    return F.coalesce(canonical_label(label) != ".", F.lit(False))


def is_white(label: Column) -> Column:
    return F.when(occupied(label), label == F.upper(label))


def reversed_labels(labels: Column) -> Column:
    """The same board seen from the other side."""
    return F.reverse(labels)


def image_order(probabilities: Column, classes: list[str] | None = None) -> Column:
    """64 x 13 model output (ranks from the bottom, own class order) in image order."""
    classes = classes or KING_FIRST
    take = [classes.index(x) for x in LABELS]

    def square(p: Column, i: Column) -> Column:
        tile = (7 - F.floor(i / 8)) * 8 + i % 8
        return F.transform(F.array(*[F.lit(c) for c in take]),
                           lambda c: F.element_at(p, (tile * 13 + c + 1).cast("int")))

    return let(probabilities, lambda p: F.transform(F.sequence(F.lit(0), F.lit(63)), lambda i: square(p, i)))


def placement(labels: Column, orientation: Column) -> Column:
    """Eight ranks with run-length empties; null while a label or the side is unknown."""
    seen = F.transform(labels, canonical_label)
    turned = F.when(orientation == "black-bottom", F.reverse(seen)).otherwise(seen)
    text = let(turned, lambda o: F.array_join(F.transform(
        F.sequence(F.lit(0), F.lit(7)), lambda row: F.array_join(F.slice(o, (row * 8 + 1).cast("int"), 8), "")), "/"))
    # Runs do not cross '/', so replacing the longest first is exact.
    for n in range(8, 0, -1):
        text = F.replace(text, F.lit("." * n), F.lit(str(n)))
    complete = (F.size(labels) == 64) & ~F.exists(labels, lambda x: x.isNull())
    return F.when(complete & (orientation != "unknown"), text)


def softmax(logits: Column, temperature: float = 1.0) -> Column:
    """Numerically stable softmax of an array column."""
    def shifted(top: Column) -> Column:
        return F.transform(logits, lambda x: F.exp((x - top) / float(temperature)))

    def scaled(powers: Column) -> Column:
        return let(F.aggregate(powers, F.lit(0.0), lambda a, x: a + x),
                   lambda total: F.transform(powers, lambda p: p / total))

    return let(F.array_max(logits), lambda top: let(shifted(top), scaled))


def best_class(values: Column) -> Column:
    """Index of the largest entry, the first on ties."""
    return (F.array_position(values, F.array_max(values)) - 1).cast("int")


def uncertain(confidence: Column) -> Column:
    return confidence < UNCERTAIN_BELOW


def unit_interval(value: Column) -> Column:
    return F.greatest(F.lit(0.0), F.least(F.lit(1.0), value))


def threshold_key(value: Column) -> Column:
    """0.50 -> '0.5', 0.55 -> '0.55'."""
    return F.regexp_replace(F.regexp_replace(F.format_number(value, 2), "0+$", ""), r"\.$", "")
