"""Array kernels over the words of many texts at once.

A block is a slice of an Arrow text column that holds about a megabyte (or one longer text).
Its words are found and hashed with numpy over the UTF-8 bytes, so no Python object is made
per word.  Null texts count as empty.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BLOCK_BYTES = 1 << 20
U = np.uint64
_GOLD, _ODD = U(0x9E3779B97F4A7C15), U(0xD1342543DE82EF95)

_lower = np.arange(256, dtype=np.uint8)
_lower[65:91] += 32
_every = np.arange(256)
#: Word bytes of ``[^\\x20\\x09-\\x0D]+``.
SPACED = ~((_every == 0x20) | ((_every >= 0x09) & (_every <= 0x0D)))
#: Word bytes of ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` after A-Z became lower case.
ALNUM = (_every >= 0x80) | ((_every >= 48) & (_every <= 57)) | ((_every >= 97) & (_every <= 122)) | ((_every >= 65) & (_every <= 90))


def mix(h: np.ndarray) -> np.ndarray:
    """Spread 64-bit values; equal stays equal."""
    h = (h ^ (h >> U(30))) * U(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U(27))) * U(0x94D049BB133111EB)
    return h ^ (h >> U(31))


_BYTE = mix((np.arange(256, dtype=np.uint64) + U(1)) * _GOLD)[_lower]


@dataclass
class Words:
    """Words of a block: byte bounds, the text each belongs to, and hashes of their lower-cased bytes."""

    data: np.ndarray
    offsets: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    hashes: np.ndarray
    bounds: np.ndarray  # bounds[i]:bounds[i + 1] are the words of text i

    def counts(self) -> np.ndarray:
        return np.diff(self.bounds)

    def distinct(self, memory: dict) -> tuple[list, np.ndarray]:
        """(what ``memory`` holds for each distinct word, the index into that list for each word)."""
        _, first, inverse = np.unique(self.hashes, return_index=True, return_inverse=True)
        raw = self.data.tobytes().lower()
        return [memory[raw[a:b]] for a, b in zip(self.starts[first].tolist(), self.ends[first].tolist())], inverse

    def text(self, first: int, last: int) -> bytes:
        """Words first..last-1 in normal form: lower case, one blank between."""
        d, s, e = self.data, self.starts, self.ends
        return b" ".join(d[s[i]:e[i]].tobytes().lower() for i in range(first, last))

    def windows(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        """(first word, hash) of every run of ``n`` words that stays in one text."""
        m = len(self.hashes) - n + 1
        if m <= 0:
            return np.empty(0, np.int64), np.empty(0, np.uint64)
        at = np.flatnonzero(self.doc[:m] == self.doc[n - 1:])
        return at, chain(self.hashes, n)[at]


def chain(h: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all runs of ``n`` neighbours."""
    m = len(h) - n + 1
    out = np.zeros(m, np.uint64)
    for j in range(n):
        out = out * _ODD + h[j:m + j]
    return mix(out ^ U(n * int(_GOLD) % (1 << 64)))


def _hash(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    lengths = ends - starts
    out = np.empty(len(starts), np.uint64)
    if not len(starts):
        return out
    total = np.cumsum(lengths)
    powers = np.multiply.accumulate(np.full(int(lengths.max()), _ODD, np.uint64))
    a = 0
    while a < len(starts):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + BLOCK_BYTES, "right")))
        size = lengths[a:b]
        first = total[a:b] - size - done
        place = np.arange(int(size.sum())) - np.repeat(first, size)
        value = _BYTE[data[place + np.repeat(starts[a:b], size)]] * powers[place]
        out[a:b] = np.add.reduceat(value, first)
        a = b
    return mix(out ^ (lengths.astype(np.uint64) * _GOLD))


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a text column; null is empty."""
    column = pc.fill_null(column.cast(pa.large_string()), "")
    _, offsets, data = column.buffers()
    ends = np.frombuffer(offsets, np.int64)[column.offset:column.offset + len(column) + 1] if len(column) else np.zeros(1, np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None and data.size else np.empty(0, np.uint8)
    return raw[ends[0]:ends[-1]], ends - ends[0]


def words(column: pa.Array, member: np.ndarray) -> Words:
    """The words of all texts of ``column``; ``member`` tells which bytes are part of words."""
    data, offsets = flat(column)
    inside = member[data]
    begins = offsets[:-1][np.diff(offsets) > 0]
    before = np.empty_like(inside)
    before[1:] = inside[:-1]
    before[begins] = False
    starts = np.flatnonzero(inside & ~before)
    after = np.empty_like(inside)
    after[:-1] = inside[1:]
    if len(inside):
        after[-1] = False
    after[begins[1:] - 1] = False
    ends = np.flatnonzero(inside & ~after) + 1
    bounds = np.searchsorted(starts, offsets)
    doc = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds))
    return Words(data, offsets, starts, ends, doc, _hash(data, starts, ends), bounds)


def blocks(batch: pa.RecordBatch, text: str, limit: int = BLOCK_BYTES) -> Iterator[pa.RecordBatch]:
    """Slices of a batch with about ``limit`` bytes of text each; no row is left out."""
    sizes = pc.fill_null(pc.binary_length(batch.column(text)), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    total, a = np.cumsum(sizes), 0
    while a < len(sizes):
        done = total[a - 1] if a else 0
        b = max(a + 1, int(np.searchsorted(total, done + limit, "right")))
        yield batch.slice(a, b - a)
        a = b


class Recent(dict):
    """A memory of two generations: what is looked up stays, what is not is forgotten in time."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        self[key] = value
        return value


def unique(values: np.ndarray) -> np.ndarray:
    """Sorted distinct values (by sorting, which is faster than hashing for long arrays)."""
    values = np.sort(values)
    return values[np.r_[True, values[1:] != values[:-1]]] if len(values) else values


def runs(at: np.ndarray) -> list[tuple[int, int]]:
    """Sorted positions as half-open runs of neighbours."""
    if not len(at):
        return []
    cut = np.flatnonzero(np.diff(at) > 1)
    return list(zip(at[np.r_[0, cut + 1]].tolist(), (at[np.r_[cut, len(at) - 1]] + 1).tolist()))


def without(w: Words, i: int, spans: list[tuple[int, int]]) -> str:
    """Text ``i`` without the given runs of words (numbered within the block); what follows moves up."""
    a, b = int(w.offsets[i]), int(w.offsets[i + 1])
    parts, at = [], a
    for first, last in spans:
        parts.append(w.data[at:w.starts[first]].tobytes())
        at = int(w.starts[last]) if last < w.bounds[i + 1] else int(w.ends[last - 1])
    parts.append(w.data[at:b].tobytes())
    return b"".join(parts).decode("utf-8", "replace")
