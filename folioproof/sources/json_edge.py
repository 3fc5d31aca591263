"""JSON records at the edge: parsed once, wanted paths typed, everything else a violation row."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, functions as F


def typed(text: Column, paths: Mapping[str, tuple[str, str]]) -> list[Column]:
    """A column for each name of ``paths`` (path, type): null where the path is missing or of another kind."""
    parsed = F.try_parse_json(text)
    return [F.try_variant_get(parsed, path, kind).alias(name) for name, (path, kind) in paths.items()]


def violations(lines: DataFrame, text: str, paths: Mapping[str, tuple[str, str]], longest: int) -> DataFrame:
    """(line, code) for each rule a record breaks; ``line`` is the SHA-256 of its text.

    'oversize': more than ``longest`` bytes, and then nothing else is looked at; 'malformed':
    no JSON object; 'missing:<name>': the path is not there or null; 'type:<name>': it is of
    another kind; 'non-finite:<name>': a number that is not finite.  A null text is malformed.
    """
    parsed = F.try_parse_json(text)
    size = F.coalesce(F.octet_length(text), F.lit(0))
    codes = []
    for name, (path, kind) in paths.items():
        there = F.try_variant_get("_v", path, "string").isNotNull()
        value = F.try_variant_get("_v", path, kind)
        codes.append(F.when(~there, f"missing:{name}").when(value.isNull(), f"type:{name}"))
        if kind == "double":
            codes.append(F.when(F.isnan(value) | (F.abs(value) == float("inf")), f"non-finite:{name}"))
    rows = lines.select(F.sha2(F.coalesce(text, F.lit("")), 256).alias("line"), size.alias("_n"), F.when(size <= longest, parsed).alias("_v"))
    # A record is an object; a bare number or list is none.
    whole = F.coalesce(F.schema_of_variant("_v").startswith("OBJECT"), F.lit(False))
    found = F.when(F.col("_n") > longest, F.array(F.lit("oversize"))).when(~whole, F.array(F.lit("malformed"))).otherwise(F.array_compact(F.array(*codes)))
    return rows.select("line", F.explode(found).alias("code"))
