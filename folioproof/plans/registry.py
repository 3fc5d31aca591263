"""Named queries over the driver tables and their SQL twins."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from ..sources import views as V

QUERIES: dict[str, Callable[["Tables"], DataFrame]] = {}
SQL: dict[str, str] = {}
VIEWS: dict[str, str] = {}


class Tables:
    """The tables of one folder, and the views built from them."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder

    def __getattr__(self, name: str) -> DataFrame:
        return V.table(self.spark, self.folder, name)

    def sources(self) -> DataFrame:
        return V.sources(self.documents)

    def samples(self) -> DataFrame:
        return V.samples(self.documents, self.labels)

    def exclusions(self) -> DataFrame:
        return V.exclusions(self.documents, self.labels)


def view(name: str, sql: str) -> None:
    VIEWS[name] = sql


def with_views(body: str, *names: str) -> str:
    """Put the named views, and those they use, before ``body``."""
    ordered: list[str] = []

    def add(name: str) -> None:
        for other in VIEWS:
            if other != name and f"{{{other}}}" in VIEWS[name]:
                add(other)
        if name not in ordered:
            ordered.append(name)

    for name in names:
        add(name)
    parts = [f"{n} AS ({_plain(VIEWS[n])})" for n in ordered]
    return ("WITH " + ",\n".join(parts) + "\n" if parts else "") + body


def _plain(sql: str) -> str:
    for name in VIEWS:
        sql = sql.replace(f"{{{name}}}", name)
    return sql


def query(sql: str | None = None, *views: str) -> Callable:
    def keep(fn: Callable[[Tables], DataFrame]) -> Callable[[Tables], DataFrame]:
        QUERIES[fn.__name__] = fn
        if sql is not None:
            body = _plain(sql)
            SQL[fn.__name__] = body if not views else (
                with_views(body, *views) if not body.lstrip().upper().startswith("RECURSIVE")
                else _recursive(body.lstrip()[len("RECURSIVE"):], *views))
        return fn

    return keep


def _recursive(body: str, *views: str) -> str:
    """``body`` starts with its own recursive CTEs; the views come before them."""
    text = with_views("", *views).rstrip()
    return text.replace("WITH ", "WITH RECURSIVE ", 1) + ",\n" + body
