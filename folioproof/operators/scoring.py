"""Batch scoring of pages with caller-supplied models."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Protocol

import pandas as pd
from pyspark.sql import DataFrame, functions as F

BOARDS = ("array<struct<id:string,corners:array<struct<x:double,y:double>>,labels:array<string>,"
          "orientation:string,probabilities:array<array<double>>,uncertain:array<boolean>>>")


class Localizer(Protocol):
    """Finds boards on one page row: a list of dicts with id and corners (four (x, y))."""

    def locate(self, page: object) -> list[dict]: ...


class Labeler(Protocol):
    """Labels one located board: 64 rows of 13 probabilities, or None for a square."""

    def label(self, page: object, board: dict) -> list[list[float] | None]: ...


class Registry:
    """Closed set of model loaders by (capability, id); each has a manifest hash."""

    def __init__(self) -> None:
        self._loaders: dict[tuple[str, str], tuple[Callable[[], object], str]] = {}

    def register(self, capability: str, name: str, loader: Callable[[], object], sha256: str) -> None:
        if capability not in ("localization", "labels"):
            raise ValueError("unknown capability")
        if self._loaders.get((capability, name), (None, sha256))[1] != sha256:
            raise ValueError(f"{name} is registered with other contents")
        self._loaders[capability, name] = (loader, sha256)

    def get(self, capability: str, name: str) -> tuple[Callable[[], object], str]:
        return self._loaders[capability, name]


def _bounds_iou(a: list, b: list) -> float:
    ax, ay, bx, by = [p[0] for p in a], [p[1] for p in a], [p[0] for p in b], [p[1] for p in b]
    w = min(max(ax), max(bx)) - max(min(ax), min(bx))
    h = min(max(ay), max(by)) - max(min(ay), min(by))
    shared = max(0.0, w) * max(0.0, h)
    areas = (max(ax) - min(ax)) * (max(ay) - min(ay)) + (max(bx) - min(bx)) * (max(by) - min(by))
    return shared / max(1e-9, areas - shared)


def distinct_grids(boards: list[dict], most: float = 0.5) -> list[dict]:
    """Drop boards whose bounds overlap an earlier one too much."""
    kept: list[dict] = []
    for b in boards:
        if all(_bounds_iou(b["corners"], k["corners"]) <= most for k in kept):
            kept.append(b)
    return kept


def score_pages(pages: DataFrame, registry: Registry, localizer: str, labeler: str, run: str,
                labels: list[str], uncertain_below: float = 0.7, most_boards: int = 16) -> DataFrame:
    """Localise, de-duplicate and label every page; one proposal row per page.

    Models are loaded once per Python worker, on the executors.  A page that fails comes
    out with status 'error' and a warning instead of failing the job; one with more than
    ``most_boards`` boards has that status too, and all of its boards.  The provider
    identities are columns of the result.
    """
    locate, locate_sha = registry.get("localization", localizer)
    name, name_sha = registry.get("labels", labeler)
    kept = [c for c in ("id", "revision", "sha") if c in pages.columns]
    types = ", ".join(f"{c} {pages.schema[c].dataType.simpleString()}" for c in kept)
    schema = f"{types}, status string, boards {BOARDS}, warnings array<string>"

    def one(row: object, finder: Localizer, namer: Labeler) -> tuple[str, list[dict], list[str]]:
        try:
            found = distinct_grids(finder.locate(row))
            out = []
            for b in found:
                p = namer.label(row, b)
                best = [None if q is None else max(range(13), key=lambda i: (q[i], -i)) for q in p]
                out.append({"id": b["id"], "corners": [{"x": float(x), "y": float(y)} for x, y in b["corners"]],
                            "labels": ["." if i is None else labels[i] for i in best], "orientation": "unknown",
                            "probabilities": p,
                            "uncertain": [i is None or q[i] < uncertain_below for i, q in zip(best, p)]})
            if len(found) > most_boards:
                return "error", out, [f"{len(found)} boards exceed the format"]
            return ("ok" if out else "unsupported"), out, []
        except Exception as error:  # noqa: BLE001 - a page's failure is data
            return "error", [], [f"{type(error).__name__}: {error}"[:300]]

    def score(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        finder, namer = locate(), name()
        for pdf in parts:
            made = [one(row, finder, namer) for row in pdf.itertuples(index=False)]
            yield pdf[kept].assign(status=[m[0] for m in made], boards=[m[1] for m in made], warnings=[m[2] for m in made])

    return pages.mapInPandas(score, schema).select(
        F.lit(run).alias("run"), *kept, "status", "boards", "warnings",
        F.array(F.struct(F.lit(localizer).alias("id"), F.lit(locate_sha).alias("sha256")),
                F.struct(F.lit(labeler).alias("id"), F.lit(name_sha).alias("sha256"))).alias("providers"))
