"""URL rules in a trie of reversed host labels and path segments."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame

_HOST, _PATH = re.compile(r"[^/?#]*"), re.compile(r"[^?#]*")
_LOWER = {c: c + 32 for c in range(65, 91)}


def split_url(url: str | None) -> tuple[str, str]:
    """(host, path): the host lies after the first ``://``; both are empty without one."""
    at = -1 if url is None else url.find("://")
    if at < 0:
        return "", ""
    host = _HOST.match(url, at + 3)
    return host.group().translate(_LOWER), _PATH.match(url, host.end()).group()


class Trie:
    """Rules (verdict, text like ``example.com/en/``), the longest fitting one wins.

    A rule fits its host and all subdomains when the path starts with the rule's path, the
    part from the first ``/``.  More host labels come before a longer path.  Of two rules
    with the same host and path, block wins.  Nodes are dicts keyed by host label; a node
    keeps its path rules in a second trie keyed by whole segment, whose ends hold the
    beginnings that the next segment must have (``""`` after a closing slash).
    """

    def __init__(self, rules: Iterable[tuple[str, str]]) -> None:
        self.root: dict = {}
        for verdict, rule in sorted(rules, key=lambda r: (r[1], r[0] == "block")):
            host, slash, path = rule.partition("/")
            node = self.root
            for label in reversed(host.translate(_LOWER).split(".")):
                node = node.setdefault(("host", label), {})
            *whole, begin = (slash + path).split("/")
            for segment in whole:
                node = node.setdefault(("path", segment), {})
            node.setdefault("begins", {})[begin] = (rule, verdict)

    def find(self, host: str, path: str) -> tuple[str, str] | None:
        node, best = self.root, None
        segments = path.split("/")
        for label in reversed(host.split(".")):
            node = node.get(("host", label))
            if node is None:
                break
            best = self._below(node, segments) or best
        return best

    @staticmethod
    def _below(node: dict, segments: list[str]) -> tuple[str, str] | None:
        best = None
        for segment in segments:
            begins = node.get("begins")
            if begins:
                fit = [b for b in begins if segment.startswith(b)]
                if fit:
                    best = begins[max(fit, key=len)]
            node = node.get(("path", segment))
            if node is None:
                break
        return best


def judge(pages: DataFrame, rules: Iterable[tuple[str, str]], default: str = "allow",
          key: str = "page_id", url: str = "url") -> DataFrame:
    """(key, host, path, rule, verdict) of every row; other columns are not read.

    The trie is broadcast once; its size is that of the rule list the caller holds, not of
    the table.  A url that no rule fits (null and malformed ones too) gets ``default`` and a
    null rule.  Repeated rows are judged each; an empty table gives an empty result.
    """
    trie = pages.sparkSession.sparkContext.broadcast(Trie(rules))
    kind = pages.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find = trie.value.find
        for batch in batches:
            parts = [split_url(u) for u in batch.column(1).to_pylist()]
            found = [find(*p) if p[0] else None for p in parts]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([p[0] for p in parts], pa.string()), pa.array([p[1] for p in parts], pa.string()),
                 pa.array([f and f[0] for f in found], pa.string()),
                 pa.array([f[1] if f else default for f in found], pa.string())],
                names=[key, "host", "path", "rule", "verdict"])

    return pages.select(key, url).mapInArrow(run, f"{key} {kind}, host string, path string, rule string, verdict string")
