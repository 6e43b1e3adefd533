"""Words of whole columns of texts as arrays: their places and 64-bit hashes, without a loop over words; NumPy, run on executors."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

from msgledger.llm.shingles import SHINGLE, mix

#: Bytes of text whose words are held together, of several documents or of one; and bytes that are looked at at once.
CHUNK, STRETCH = 1 << 20, 1 << 15
_LOWER = np.frombuffer(bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256)), np.uint8)
_SPACE = np.isin(np.arange(256), [32, *range(9, 14)])
_CODE = np.random.default_rng(20_023).integers(0, 1 << 63, 256, np.int64).astype(np.uint64) * np.uint64(2) + np.uint64(1)
_CODE_LOWER = _CODE[_LOWER]
_FOLLOWS = (np.arange(256) & 0xC0) == 0x80
_BYTES, _WORDS = 0x9E3779B97F4A7C13, 0xD6E8FEB86659FD93


class _Powers:
    """Powers of an odd number modulo 2^64 and of its inverse, as many as were asked for so far."""

    def __init__(self, base: int):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.empty(0, np.uint64)

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 1 << 16)
            self.up, self.down = (np.cumprod(np.append(np.uint64(1), np.full(size - 1, x, np.uint64)), dtype=np.uint64) for x in (self.base, self.inverse))
        return self.up[:n], self.down[:n]


_byte_powers, _word_powers = _Powers(_BYTES), _Powers(_WORDS)


@dataclass
class Words:
    r"""The words ``[^\x20\x09-\x0D]+`` of consecutive documents, A-Z lower-cased.

    ``first``: number of the first document in the column; ``size``: words of each. For each word its hash, start
    and end in code points of its document, and the number of line feeds before it in the chunk.
    """

    first: int
    size: np.ndarray
    hash: np.ndarray
    start: np.ndarray
    end: np.ndarray
    line: np.ndarray

    @property
    def offset(self) -> np.ndarray:
        """Where each document's words begin, and the end of the last one's."""
        return np.concatenate(([0], np.cumsum(self.size)))

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.size)), self.size)

    def sums(self) -> np.ndarray:
        """Sums of the words' hashes, weighted by powers: differences of two give the hash of the words between, see ``span_hash``."""
        return np.concatenate((np.zeros(1, np.uint64), np.cumsum(self.hash * _word_powers(len(self.hash))[0], dtype=np.uint64)))


def span_hash(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> np.ndarray:
    """64-bit hash of the words from ``lo`` to before ``hi``; it depends on these words alone."""
    return mix((sums[hi] - sums[lo]) * _word_powers(len(sums))[1][lo] + (hi - lo).astype(np.uint64))


def gram_hash(sums: np.ndarray, n: int) -> np.ndarray:
    """``span_hash`` of every ``n`` consecutive words."""
    m = max(len(sums) - n, 0)
    return mix((sums[n : n + m] - sums[:m]) * _word_powers(len(sums))[1][:m] + np.uint64(n))


def _stretches(raw: np.ndarray) -> Iterator[tuple[int, int]]:
    """Bounds of about STRETCH bytes, at white space."""
    lo, n = 0, len(raw)
    while lo < n:
        hi = min(lo + STRETCH, n)
        while hi < n:
            at = np.flatnonzero(_SPACE[raw[hi : hi + 4096]])
            if len(at):
                hi += int(at[0])
                break
            hi = min(hi + 4096, n)
        yield lo, hi
        lo = hi


def _words(raw: np.ndarray, bounds: np.ndarray, first: int) -> Words:
    """``raw``: bytes of documents, each from one of ``bounds`` to the next."""
    starts, ends, hashes, from_, to, lines = [], [], [], [], [], []
    points = line = 0
    at_bound = np.zeros(len(bounds), np.int64)  # code points before each bound
    for lo, hi in _stretches(raw):
        b = raw[lo:hi]
        inside = ~_SPACE[b]
        head = np.zeros(hi - lo + 1, bool)
        own = bounds[(bounds >= lo) & (bounds <= hi)] - lo
        head[own] = True
        start = np.flatnonzero(inside & (head[:-1] | ~np.concatenate(([False], inside[:-1]))))
        end = np.flatnonzero(inside & (head[1:] | ~np.concatenate((inside[1:], [False])))) + 1
        up, down = _byte_powers(hi - lo)
        total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_CODE_LOWER[b] * up, dtype=np.uint64)))
        hashes.append(mix((total[end] - total[start]) * down[start] + (end - start).astype(np.uint64)))
        point = np.concatenate((np.zeros(1, np.int32), np.cumsum(~_FOLLOWS[b], dtype=np.int32))) + points
        feed = np.cumsum(b == 10, dtype=np.int32) + line
        starts.append(start + lo)
        ends.append(end + lo)
        from_.append(point[start])
        to.append(point[end])
        lines.append(feed[start])
        at_bound[(bounds >= lo) & (bounds <= hi)] = point[own]
        points, line = int(point[-1]), int(feed[-1]) if len(feed) else line
    if not starts:
        none = np.empty(0, np.int64)
        return Words(first, np.zeros(len(bounds) - 1, np.int64), np.empty(0, np.uint64), none, none, none)
    start = np.concatenate(starts)
    size = np.diff(np.searchsorted(start, bounds))
    base = np.repeat(at_bound[:-1], size)
    return Words(first, size, np.concatenate(hashes), np.concatenate(from_) - base, np.concatenate(to) - base, np.concatenate(lines))


def words_of_column(column: pa.Array, chunk: int = CHUNK) -> Iterator[Words]:
    """The words of a column of texts without nulls, in chunks of whole documents of ``chunk`` bytes or one document more."""
    if not len(column):
        return
    _, places, data = column.buffers()
    bounds = np.frombuffer(places, np.int64 if pa.types.is_large_string(column.type) else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    i = 0
    while i < len(column):
        j = max(int(np.searchsorted(bounds, bounds[i] + chunk)), i + 1)
        j = min(j, len(column))
        yield _words(raw[bounds[i] : bounds[j]], bounds[i : j + 1] - bounds[i], i)
        i = j


def span_shingles(sums: np.ndarray, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the 5-word shingles of each span of words, one after the other, with repeats, and how many each has; of fewer words, one for all of them."""
    n = np.maximum(hi - lo - SHINGLE + 1, 1)
    at = np.repeat(lo - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    return span_hash(sums, at, np.minimum(at + SHINGLE, np.repeat(hi, n))), n
