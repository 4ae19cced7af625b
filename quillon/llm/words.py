"""Words and word hashes of whole Arrow batches, vectorised with numpy.

Words are runs of bytes other than ASCII white space; the UTF-8 bytes of a batch are handled as one
buffer, so the cost per document is small. A word's hash is a polynomial over randomised bytes, mixed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa

SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
_RANDOM = np.random.default_rng(5)
_BYTES = _RANDOM.integers(1, 2**63, 256, dtype=np.int64).astype(np.uint64) | np.uint64(1)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
BASE, STEP = 0xD1342543DE82EF95, np.uint64(0x9E3779B97F4A7C15)
MASK = (1 << 64) - 1
_INVERSE = pow(BASE, -1, 1 << 64)


_KNOWN: dict[int, np.ndarray] = {}


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base ** 2 ... modulo 2 ** 64."""
    if len(_KNOWN.get(base, ())) < n:
        out = np.full(n, base, np.uint64)
        out[0] = 1
        _KNOWN[base] = np.multiply.accumulate(out)
    return _KNOWN[base][:n] if n else np.zeros(0, np.uint64)


def mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


class Words:
    """Words of a column of texts: `doc` (row of each word), `start` and `end` (bytes in `buffer`), `first` (first word of each row, one more at the end)."""

    def __init__(self, texts: pa.Array, lower: bool = False):
        texts = pa.concat_arrays(texts.chunks) if isinstance(texts, pa.ChunkedArray) else texts
        if texts.null_count:
            texts = texts.fill_null("")
        binary = texts.cast(pa.large_binary()) if not pa.types.is_large_binary(texts.type) else texts
        _, at, data = binary.buffers()
        at = np.frombuffer(at, np.int64, len(binary) + 1, binary.offset * 8) if len(binary) else np.zeros(1, np.int64)
        raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
        self.buffer = raw[at[0] : at[-1]]
        if lower:
            self.buffer = _LOWER[self.buffer]
        at = at - at[0]
        n = len(self.buffer)
        word = ~SPACE[self.buffer]
        edge = np.zeros(n + 1, bool)  # a word also begins where its row does
        edge[at] = True
        begins = word.copy()
        begins[1:] &= ~word[:-1] | edge[1:n]
        ends = word.copy()
        ends[:-1] &= ~word[1:] | edge[1:n]
        self.start, self.end = np.flatnonzero(begins), np.flatnonzero(ends) + 1
        self.first = np.searchsorted(self.start, at)
        self.count = np.diff(self.first)
        self.doc = np.repeat(np.arange(len(at) - 1), self.count)

    def hashes(self, block: int = 1 << 18) -> np.ndarray:
        """A 64-bit hash of each word, whatever its place."""
        out = np.empty(len(self.start), np.uint64)
        w = 0
        while w < len(out):  # in blocks of bytes, so that the powers stay small
            base = self.start[w]
            last = max(w + 1, np.searchsorted(self.end, base + block, side="right"))
            stop = self.end[last - 1]
            n = stop - base
            sums = np.zeros(n + 1, np.uint64)
            np.cumsum(_BYTES[self.buffer[base:stop]] * _powers(BASE, n), out=sums[1:])
            a, b = self.start[w:last] - base, self.end[w:last] - base
            out[w:last] = (sums[b] - sums[a]) * _powers(_INVERSE, n)[a] + (b - a).astype(np.uint64)
            w = last
        return mixed(out)


def grams(h: np.ndarray, n: int) -> np.ndarray:
    """Hash of every n consecutive hashes; doubling, so it takes log n passes."""
    count = max(0, len(h) - n + 1)
    powers = {1: h}
    k = 1
    while 2 * k <= n:
        p = powers[k]
        powers[2 * k] = mixed(p[:-k] * STEP + p[k:]) if len(p) > k else p[:0]
        k *= 2
    out, at = None, 0
    for k in sorted(powers, reverse=True):
        while at + k <= n:
            part = powers[k][at : at + count]
            out = part.copy() if out is None else mixed(out * STEP + part)
            at += k
    return out[:count] if out is not None else h[:0]


def sliding_argmin(v: np.ndarray, n: int) -> np.ndarray:
    """Index of the leftmost least of every n consecutive values."""
    at = np.arange(len(v))
    k = 1
    while 2 * k <= n:
        a, b = at[:-k], at[k:]
        at = np.where(v[b] < v[a], b, a)
        k *= 2
    if k < n:
        a, b = at[: len(at) - (n - k)], at[n - k :]
        at = np.where(v[b] < v[a], b, a)
    return at


def inside(words: Words, n: int) -> np.ndarray:
    """Which word positions begin n words of one row."""
    out = np.zeros(len(words.doc), bool)
    if len(out) >= n:
        out[: len(out) - n + 1] = words.doc[: len(out) - n + 1] == words.doc[n - 1 :]
    return out
