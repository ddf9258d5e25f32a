"""Words and word hashes of many texts at once.

A word is a maximal run of characters other than space and U+0009..U+000D.
On UTF-8 bytes that is what ``bytes.split()`` yields.  Hashes are computed for
a whole batch of texts with a few numpy passes, never word by word.  They are
keyed and not linear: words go through a mixer eight bytes at a time (very long
ones through BLAKE2), and runs of words are mixed pair by pair, so that no
pattern of letters or words makes two of them meet by construction.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np

U64 = np.uint64
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_ODD = U64(0x9E3779B97F4A7C15)
_LENGTH = U64(0xA0761D6478BD642F)
_FIRST = np.array([(1 << 8 * k) - 1 for k in range(9)], U64)  # of eight bytes, the first k
BY_MIXER = 64  # bytes of a word that the mixer takes


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit values."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def _times(a: np.uint64, n: int) -> np.uint64:
    return U64(int(a) * n & (2**64 - 1))


def word_codes(data: bytes, starts: np.ndarray, ends: np.ndarray, seed: int) -> np.ndarray:
    """A 64-bit hash of each word data[start:end]; different words of eight bytes or fewer, equally long, have different ones."""
    eight = np.ndarray(len(data) + 1, "<u8", data + bytes(8), strides=(1,))
    n = ends - starts
    h = mix64(n.astype(U64) * _LENGTH + _times(_ODD, seed + 1))
    which, at, left = slice(None), starts, n
    for _ in range(0, BY_MIXER, 8):
        h[which] = mix64(h[which] * _ODD ^ (eight[at] & _FIRST[np.minimum(left, 8)]))
        more = np.flatnonzero(left > 8)
        if not len(more):
            return h
        which = more if isinstance(which, slice) else which[more]
        at, left = at[more] + 8, left[more] - 8
    key = seed.to_bytes(8, "little")
    for i in which.tolist():
        h[i] = int.from_bytes(hashlib.blake2b(data[starts[i] : ends[i]], digest_size=8, key=key).digest(), "little")
    return h


class Words:
    """Hashed words of a batch of texts.

    ``codes``: a 64-bit code of every word, text after text; ``first``: index of
    each text's first word, with one more entry at the end.  ``starts`` and
    ``ends`` give the words' bytes in ``data``.
    """

    def __init__(self, texts: list[bytes], seed: int = 0) -> None:
        self.data = b" ".join(texts) + b" "
        a = np.frombuffer(self.data, np.uint8)
        space = _SPACE[a]
        edge = np.flatnonzero(np.diff(space, prepend=True))  # in turn a start and the end after it
        self.starts, self.ends = edge[0::2], edge[1::2]
        self.codes = word_codes(self.data, self.starts, self.ends, seed)
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        self.first = np.searchsorted(self.starts, np.concatenate([[0], np.cumsum(lengths)]))
        self._doubled = [self.codes]

    def _runs(self, k: int) -> np.ndarray:
        """Hashes of all runs of 2**k words, by their first one."""
        while len(self._doubled) <= k:
            h, step = self._doubled[-1], 1 << (len(self._doubled) - 1)
            self._doubled.append(_two(h[:-step], h[step:]) if len(h) > step else h[:0])
        return self._doubled[k]

    def runs(self, start: np.ndarray | slice, size: int) -> np.ndarray:
        """A 64-bit hash of the ``size`` words from each start on: of the two runs of 2**k words that cover them, and their number."""
        k = size.bit_length() - 1
        h = self._runs(k)
        other = slice(start.start + size - (1 << k), start.stop + size - (1 << k)) if isinstance(start, slice) else start + (size - (1 << k))
        return mix64(_two(h[start], h[other]) + _times(_LENGTH, size))

    def spans(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """As ``runs``, of the words start..end-1 (one at least)."""
        n = end - start
        out = np.empty(len(n), U64)
        for size in np.unique(n).tolist():
            own = np.flatnonzero(n == size)
            out[own] = self.runs(start[own], size)
        return out

    def shingles(self, i: int, size: int) -> np.ndarray:
        """Hashes of text i's word windows, in order; of a shorter text, one of all its words."""
        a, b = int(self.first[i]), int(self.first[i + 1])
        return self.runs(slice(a, b - size + 1), size) if b - a > size else self.runs(slice(a, a + 1), b - a) if b > a else np.empty(0, U64)


def _two(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """A hash of two hashes in this order."""
    return mix64(mix64(a + _LENGTH) * _ODD ^ b)


def lower_ascii(text: bytes) -> bytes:
    """A-Z only."""
    return text.lower()


def encoded(values) -> list[bytes]:
    """UTF-8 of texts; null counts as empty."""
    return [v.encode("utf-8", "surrogatepass") if isinstance(v, str) else b"" for v in values]


def slices(texts: list[bytes], budget: int = 1 << 22) -> Iterator[tuple[int, int]]:
    """Index ranges of whole texts with about ``budget`` bytes each, so that memory is bounded by it or by one text."""
    at = size = 0
    for i, t in enumerate(texts):
        if i > at and size + len(t) > budget:
            yield at, i
            at, size = i, 0
        size += len(t) + 1
    if at < len(texts):
        yield at, len(texts)


PIECE = 1 << 22
_BLANK = re.compile(rb"[\x09-\x0d ]")


def pieces(text: bytes, overlap: int, budget: int = PIECE) -> Iterator[tuple[bytes, int]]:
    """Parts of a long text of about ``budget`` bytes, and the number of words before each.

    A part repeats the last ``overlap`` words of the one before it, so that each
    run of ``overlap`` + 1 words stands in one part alone.
    """
    at = before = 0
    size = budget
    while len(text) - at > size and (blank := _BLANK.search(text, at + size)):
        part = text[at : blank.start()]
        words = len(part.split())
        if words <= overlap:
            size *= 2
            continue
        yield part, before
        at += len(part.rsplit(None, overlap)[0]) if overlap else len(part)
        before += words - overlap
        size = budget
    yield text[at:], before
