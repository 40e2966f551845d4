"""Columnar text primitives shared by the operators of this subpackage.

A batch of texts becomes one array of code points; words, shingles and span
names are then computed with whole-array arithmetic, so the cost per character
is a few nanoseconds and nothing is done per word in Python.

Names are 64-bit hashes.  A span's name depends on its content alone: not on
its offset, its batch or its executor.  Each step of a name goes through a
bijective finalizer, so no sums or powers can cancel, as they do for some
texts in polynomial hashes modulo 2^64; long spans are named by a digest.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

U64 = np.uint64
LETTER, NUMBER, SPACE, BREAK = 1, 2, 3, 4
SHINGLE_WORDS = 5
CHUNK_CHARS = 300_000
_GOLD = U64(0x9E3779B97F4A7C15)
_PACK = 3  # code points of 21 bits in a word
_MASKS = np.array([(1 << 21 * k) - 1 for k in range(_PACK + 1)], U64)
_LONG = 60  # code points from which a span is named by a digest


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective finalizer on 64-bit words (the splitmix64 one)."""
    x = x.astype(U64, copy=True)
    x ^= x >> U64(30)
    x *= U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


def seeds(n: int, salt: int) -> np.ndarray:
    """n fixed pseudo-random odd words."""
    return mix(np.arange(1, n + 1, dtype=U64) * _GOLD + U64(salt)) | U64(1)


@lru_cache(1)
def char_classes() -> np.ndarray:
    """Class by code point: letter, number, white space, or 0."""
    import regex

    valid = [i for i in range(0x110000) if not 0xD800 <= i <= 0xDFFF]
    every, table = "".join(map(chr, valid)), np.zeros(0x110000, np.uint8)
    for cls, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
        for m in regex.finditer(pattern, every):
            table[valid[m.start()] : valid[m.end() - 1] + 1] = cls
    return table


@lru_cache(1)
def char_values() -> np.ndarray:
    return mix(np.arange(0x110000, dtype=U64) * _GOLD + U64(77))


@lru_cache(1)
def lower_table() -> np.ndarray:
    """Lower case by code point, one for one, so that places in a text are kept."""
    table = np.arange(0x110000, dtype=np.uint32)
    for i in range(0x110000):
        if not 0xD800 <= i <= 0xDFFF:
            c = chr(i)
            if c.isupper() or c.istitle():
                table[i] = ord(c.lower()[0])
    return table


def clean(texts: Iterable[str | None]) -> list[str]:
    return [t or "" for t in texts]


def chunks(sizes: Iterable[int], limit: int = CHUNK_CHARS) -> Iterator[tuple[int, int]]:
    """Ranges of whole texts of about `limit` characters; a longer text is a range of its own."""
    begin, total, i = 0, 0, -1
    for i, n in enumerate(sizes):
        if i > begin and total + n > limit:
            yield begin, i
            begin, total = i, 0
        total += n + 1
    if i >= begin:
        yield begin, i + 1


class Codes:
    """The code points of some texts, each text followed by a line break that belongs to none."""

    def __init__(self, texts: list[str], fold: bool = False):
        self.n = len(texts)
        self.text = "\n".join(texts) + "\n"
        self.cp = np.frombuffer(self.text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if fold:
            self.cp = lower_table()[self.cp]
        self.lens = np.fromiter(map(len, texts), np.int64, self.n)
        self.ends = np.cumsum(self.lens + 1) - 1
        self.starts = self.ends - self.lens
        self._packed: np.ndarray | None = None

    def names(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The 64-bit names of spans [start, end)."""
        if self._packed is None:
            cp = np.concatenate((self.cp, np.zeros(_PACK, np.uint32))).astype(U64)
            self._packed = cp[:-2] | cp[1:-1] << U64(21) | cp[2:] << U64(42)
        size = end - start
        out = mix(size.astype(U64) * _GOLD + U64(77))
        open_, step = np.flatnonzero((size > 0) & (size < _LONG)), 0
        while len(open_):
            left = size[open_] - step
            word = self._packed[start[open_] + step] & _MASKS[np.minimum(left, _PACK)]
            out[open_] = mix(out[open_] ^ word)
            open_, step = open_[left > _PACK], step + _PACK
        for i in np.flatnonzero(size >= _LONG).tolist():
            out[i] = int.from_bytes(hashlib.blake2b(self.cp[start[i] : end[i]], digest_size=8).digest(), "little")
        return out


class Words:
    """The words of some texts: maximal runs of letters and digits, in lower case.

    start, end: places in the code points; doc: the text's number; name: the
    word's 64-bit name; first: index of each text's first word (one more entry
    at the end).
    """

    def __init__(self, texts: list[str], letters_only: bool = False):
        self.codes = Codes(texts, fold=True)
        cls = char_classes()[self.codes.cp]
        inside = np.zeros(len(cls) + 2, np.int8)
        inside[1:-1] = (cls == LETTER) if letters_only else (cls == LETTER) | (cls == NUMBER)
        edge = np.diff(inside)
        self.start, self.end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.first = np.append(np.searchsorted(self.start, self.codes.starts), len(self.start))
        self.doc = np.repeat(np.arange(len(texts)), np.diff(self.first))
        self.name = self.codes.names(self.start, self.end)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def shingles(words: Words, size: int = SHINGLE_WORDS) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(name, doc, index of the first word) of each run of `size` words of a text.

    A text of one to size-1 words has one shingle, of all its words; a text
    without words has none.
    """
    n = len(words.name)
    factor = seeds(size, 5)
    if n >= size:
        m = n - size + 1
        name = np.zeros(m, U64)
        for k in range(size):
            name += words.name[k : k + m] * factor[k]
        at = np.flatnonzero(words.doc[:m] == words.doc[size - 1 :])
        name, doc = mix(name[at]), words.doc[at]
    else:
        name, doc, at = np.zeros(0, U64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    short = np.flatnonzero((words.counts > 0) & (words.counts < size))
    if len(short):
        more = np.array([int(mix(np.sum(words.name[a:b] * factor[: b - a], keepdims=True) + U64(b - a))[0]) for a, b in zip(words.first[short], words.first[short + 1])], U64)
        order = np.argsort(np.concatenate((doc, short)), kind="stable")
        name, doc, at = np.concatenate((name, more))[order], np.concatenate((doc, short))[order], np.concatenate((at, words.first[short]))[order]
    return name, doc, at


def distinct(name: np.ndarray, doc: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Each text's distinct names in ascending order, and each text's first index among them (one more at the end)."""
    order = np.lexsort((name, doc))
    name, doc = name[order], doc[order]
    new = np.ones(len(name), bool)
    new[1:] = (name[1:] != name[:-1]) | (doc[1:] != doc[:-1])
    name, doc = name[new], doc[new]
    return name, np.searchsorted(doc, np.arange(n + 1))


class NameSet:
    """Vectorised lookup of 64-bit names: a bit filter before binary search."""

    def __init__(self, names: np.ndarray):
        self.names = np.unique(np.asarray(names, U64))
        self.bits = max(16, int(np.ceil(np.log2(max(1, len(self.names)) * 32))))
        self.filter = np.zeros(1 << self.bits, bool)
        self.filter[(self.names >> U64(64 - self.bits)).astype(np.int64)] = True

    def find(self, names: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in `names`, index in self.names) of the members."""
        if not len(self.names):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        at = np.flatnonzero(self.filter[(names >> U64(64 - self.bits)).astype(np.int64)])
        got = np.searchsorted(self.names, names[at])
        hit = self.names[np.minimum(got, len(self.names) - 1)] == names[at]
        return at[hit], got[hit]


def signed(x: np.ndarray) -> np.ndarray:
    """64-bit names as Spark's LONG."""
    return x.view(np.int64)


def ranges(start: np.ndarray, count: np.ndarray) -> np.ndarray:
    """The concatenation of start[i] .. start[i]+count[i]-1."""
    total = int(count.sum())
    if not total:
        return np.zeros(0, np.int64)
    keep = count > 0
    start, count = start[keep], count[keep]
    steps = np.ones(total, np.int64)
    at = np.cumsum(count)[:-1]
    steps[0] = start[0]
    steps[at] = start[1:] - start[:-1] - count[:-1] + 1
    return np.cumsum(steps)
