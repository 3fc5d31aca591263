"""Token ids of many texts under a lower-casing BPE vocabulary, each distinct word of a block once."""

from __future__ import annotations

import functools
from array import array
import unicodedata

import numpy as np
import pyarrow as pa
import xxhash
from tokenizers import Tokenizer

from . import words as W

#: Entries of each of the two generations of remembered words.
REMEMBERED = 250_000

_SPACE, _LETTER, _DIGIT, _OTHER, _ODD = range(5)
_CLASS = np.full(256, _OTHER, np.uint8)
_CLASS[[9, 10, 11, 12, 13, 32]] = _SPACE
_CLASS[65:91] = _CLASS[97:123] = _LETTER
_CLASS[48:58] = _DIGIT
#: A word with such a byte is not cut by the rule for plain ASCII words.
_SPECIAL = (np.arange(256) >= 127) | ((_CLASS == _OTHER) & (np.arange(256) < 33))
_SPECIAL[[ord("'"), ord("<")]] = True
_EDGES = ".,;:!?()[]-*#$%&\""


def _byte_letters() -> dict[int, str]:
    """The printable letter that stands for each byte in byte-level vocabularies."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + i) for i, b in enumerate(rest)}


class WordIds:
    """Ids equal to ``encode(text, add_special_tokens=False)`` of the whole text.

    For vocabularies whose tokens never cross white space, of word_bpe_49k's normaliser and
    pattern; the tests compare with whole-text encoding.  Plain ASCII words are cut into
    letters, single digits and the rest, and merged by the vocabulary's model; words of
    other letters are normalised first; anything else, words that may hold a special token
    among it, goes through the whole tokenizer.
    """

    def __init__(self, path: str) -> None:
        self.tokenizer = Tokenizer.from_file(path)
        self.model, self.normalizer = self.tokenizer.model, self.tokenizer.normalizer
        self.special = [t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()]
        self.letters = _byte_letters()
        self.memory = W.Recent(self._word, REMEMBERED)

    def _merge(self, part: str) -> list[int]:
        return [t.id for t in self.model.tokenize(part)]

    def _word(self, word: bytes) -> bytes:
        return array("I", self._merge(word.lower().decode()) if word.isalpha() else self._ids(word)).tobytes()

    def _ids(self, word: bytes) -> list[int]:
        text = word.decode("utf-8", "replace")
        raw = np.frombuffer(word, np.uint8)
        if not _SPECIAL[raw].any() and (_CLASS[raw] == _CLASS[raw[0]]).all():
            return self._merge(text)
        core = text.strip(_EDGES)
        # Lower case of a capital sigma depends on its place in Python only.
        if core.isalpha() and unicodedata.is_normalized("NFC", core) and "\u03a3" not in core:
            plain = core.lower()
            if plain.isalpha():
                lead, _, tail = text.partition(core)
                body = plain.encode().decode("latin-1").translate(self.letters)
                return [i for part in (lead, body, tail) if part for i in self._merge(part)]
        return self.tokenizer.encode(text, add_special_tokens=False).ids

    def __call__(self, column: pa.Array, end: int) -> tuple[np.ndarray, np.ndarray]:
        """(ids, bounds): text i has ids[bounds[i]:bounds[i + 1]], the last of them ``end``; null is empty."""
        data, offsets = W.flat(column)
        starts, ends = self._parts(data, offsets)
        hashes = W._hash(data, starts, ends)
        for i in self._has_mark(data, ends).tolist():
            hashes[i] = xxhash.xxh3_64_intdigest(data[starts[i]:ends[i]].tobytes(), 1)
        _, first, inverse = np.unique(hashes, return_index=True, return_inverse=True)
        raw, memory = data.tobytes(), self.memory
        known = [memory[raw[a:b]] for a, b in zip(starts[first].tolist(), ends[first].tolist())]
        table = np.frombuffer(b"".join(known), np.uint32)
        size = np.fromiter(map(len, known), np.int64, len(known)) // 4
        begin = np.cumsum(size) - size
        n = size[inverse]
        after = np.cumsum(n)
        ids = table[np.arange(int(n.sum())) + np.repeat(begin[inverse] - (after - n), n)]
        cuts = np.r_[0, after][np.searchsorted(starts, offsets)]
        return np.insert(ids, cuts[1:], end), cuts + np.arange(len(offsets))

    @staticmethod
    def _has_mark(data: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """Parts that hold a ``<``: their case matters."""
        return W.unique(np.searchsorted(ends, np.flatnonzero(data == ord("<")), "right"))

    @staticmethod
    def _parts(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        kind = _CLASS[data]
        if not len(kind):
            return np.empty(0, np.int64), np.empty(0, np.int64)
        begins = np.zeros(len(kind), bool)
        begins[offsets[:-1][np.diff(offsets) > 0]] = True
        gap = kind == _SPACE
        word = begins | np.r_[True, gap[1:] != gap[:-1]]
        number = np.cumsum(word) - 1
        special = _SPECIAL[data]
        odd = np.zeros(int(number[-1]) + 1, bool)
        odd[number[special]] = True
        kind[odd[number]] = _ODD
        cut = word | (kind == _DIGIT)
        cut[1:] |= kind[1:] != kind[:-1]
        starts = np.flatnonzero(cut)
        ends = np.r_[starts[1:], len(kind)]
        solid = ~gap[starts]
        return starts[solid], ends[solid]


@functools.cache
def word_ids(path: str) -> WordIds:
    """One memory for each worker process, kept from task to task."""
    return WordIds(path)
