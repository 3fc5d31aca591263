"""Identity, hashes, URLs and reproducible random numbers."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, functions as F


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with ``value`` worked out once per row.

    An expression used inside a lambda would otherwise be worked out once per element.
    """
    return F.transform(F.array(value), lambda v: body(v))[0]


def texts(values: list[str]) -> Column:
    """A constant array of strings as one expression, folded at planning time."""
    return F.split(F.lit("\u001f".join(values)), "\u001f")


def canonical(*columns: Column | str) -> Column:
    """Canonical text of a record: fields in name order, nulls kept."""
    return F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})


def identity(*columns: Column | str) -> Column:
    return F.sha2(canonical(*columns), 256)


def is_token(value: Column, longest: int = 80) -> Column:
    return F.coalesce(value.rlike("^[a-zA-Z0-9_-]{1,%d}$" % longest), F.lit(False))


def is_sha256(value: Column) -> Column:
    return F.coalesce(value.rlike("^[0-9a-f]{64}$"), F.lit(False))


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def plain_https(url: Column) -> Column:
    """https, a host, no user, no port but 443, no fragment."""
    port = F.regexp_extract(F.try_parse_url(url, F.lit("AUTHORITY")), r":(\d+)$", 1)
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & F.try_parse_url(url, F.lit("HOST")).isNotNull()
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & port.isin("", "443")
        & (F.coalesce(F.try_parse_url(url, F.lit("REF")), F.lit("")) == ""), F.lit(False))


def public_https(url: Column) -> Column:
    """https without credentials, query or fragment, and not the local host."""
    empty = F.lit("")
    return F.coalesce(
        (F.try_parse_url(url, F.lit("PROTOCOL")) == "https")
        & ~F.try_parse_url(url, F.lit("HOST")).isin("localhost", "127.0.0.1", "[::1]")
        & F.try_parse_url(url, F.lit("USERINFO")).isNull()
        & (F.coalesce(F.try_parse_url(url, F.lit("QUERY")), empty) == "")
        & (F.coalesce(F.try_parse_url(url, F.lit("REF")), empty) == ""), F.lit(False))


def digest_number(seed: Column | str | int, *parts: Column) -> Column:
    """32 bits of the md5 of 'seed:part:part…' as a long; the same in any SQL engine."""
    first = seed if isinstance(seed, Column) else F.lit(str(seed))
    text = F.concat_ws(":", first, *[p.cast("string") for p in parts])
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("long")


def uniform(seed: Column | str | int, *parts: Column) -> Column:
    """A reproducible number in [0, 1) per (seed, parts)."""
    return digest_number(seed, *parts) / F.lit(4294967296.0)


def stale(now: Column, heartbeat: Column, seconds: float) -> Column:
    """True when the last heartbeat is more than ``seconds`` ago; times as timestamps."""
    return (now.cast("timestamp").cast("double") - heartbeat.cast("timestamp").cast("double")) > seconds
