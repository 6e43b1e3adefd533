"""Word shingles as sorted arrays of 64-bit hashes, MinHash samples, bands and parity bitmaps; NumPy, run on executors."""

from __future__ import annotations

import numpy as np
import xxhash

SHINGLE = 5
_LOWER = bytes(range(65)) + bytes(range(97, 123)) + bytes(range(91, 256))
_MULT = np.array([0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


class WordHashes(dict):
    """64-bit hash of each word, kept for words that come again; emptied when large."""

    LIMIT = 400_000

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.LIMIT:
            self.clear()
        h = self[word] = xxhash.xxh3_64_intdigest(word)
        return h


def words_of(text: str) -> list[bytes]:
    r"""Words ``[^\x20\x09-\x0D]+`` of the text, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_LOWER).split()


def mix(x: np.ndarray) -> np.ndarray:
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingle_set(words: list[bytes], hashes: WordHashes) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the 5-word shingles; fewer words make one shingle, none an empty set."""
    n = len(words)
    if n == 0:
        return np.empty(0, np.uint64)
    if n < SHINGLE:
        return np.array([xxhash.xxh3_64_intdigest(b"\x00" + b"\x00".join(words))], np.uint64)
    w = np.fromiter(map(hashes.__getitem__, words), np.uint64, n)
    m = n - SHINGLE + 1
    h = w[:m] * _MULT[0]
    for i in range(1, SHINGLE):
        h += w[i : i + m] * _MULT[i]
        h ^= h >> np.uint64(29)
    return np.unique(mix(h))


class Sketcher:
    """MinHash samples of a set, their bands, and their odd sketch.

    ``bands`` bands of ``rows`` samples: sets of similarity s share a band with probability
    1 - (1 - s^rows)^bands. The odd sketch folds each sample into one of ``BITS`` parity bits, so two
    sketches differ in at most twice as many bits as samples.
    """

    BITS = 1024

    def __init__(self, bands: int, rows: int, seed: int = 20_011):
        rng = np.random.default_rng(seed)
        self.bands, self.rows, self.k = bands, rows, bands * rows
        self.a = rng.integers(0, 1 << 32, self.k, np.uint32) | np.uint32(1)
        self.b = rng.integers(0, 1 << 32, self.k, np.uint32)
        self.fold = rng.integers(0, 1 << 32, self.k, np.uint32)
        self.powers = rng.integers(0, 1 << 63, rows, np.int64).astype(np.uint64) | np.uint64(1)
        self.band = rng.integers(0, 1 << 63, bands, np.int64).astype(np.uint64)

    def samples(self, s: np.ndarray) -> np.ndarray:
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        out = np.full(self.k, 0xFFFFFFFF, np.uint32)
        for lo in range(0, len(x), 2048):
            y = np.multiply.outer(self.a, x[lo : lo + 2048])
            y += self.b[:, None]
            np.minimum(out, y.min(axis=1), out=out)
        return out

    def many_samples(self, s: np.ndarray, n: np.ndarray, block: int = 4096) -> np.ndarray:
        """``samples`` of several sets, a row for each: ``s`` holds one after the other, ``n`` their sizes, none of them 0."""
        x = (s ^ (s >> np.uint64(32))).astype(np.uint32)
        ends = np.cumsum(n)
        out = np.empty((len(n), self.k), np.uint32)
        i = 0
        while i < len(n):
            lo = int(ends[i] - n[i])
            j = max(int(np.searchsorted(ends, lo + block, side="right")), i + 1)
            if j == i + 1:
                out[i] = self.samples(s[lo : ends[i]])
            else:
                y = np.multiply.outer(self.a, x[lo : ends[j - 1]])
                y += self.b[:, None]
                out[i:j] = np.minimum.reduceat(y, ends[i:j] - n[i:j] - lo, axis=1).T
            i = j
        return out

    def many_band_keys(self, samples: np.ndarray) -> np.ndarray:
        x = (samples.reshape(-1, self.bands, self.rows).astype(np.uint64) * self.powers).sum(axis=2, dtype=np.uint64)
        return mix(x ^ self.band).view(np.int64)

    def band_keys(self, samples: np.ndarray) -> np.ndarray:
        x = (samples.reshape(self.bands, self.rows).astype(np.uint64) * self.powers).sum(axis=1, dtype=np.uint64)
        return mix(x ^ self.band).view(np.int64)

    def odd_sketch(self, samples: np.ndarray) -> bytes:
        x = (samples ^ self.fold) * np.uint32(0x85EBCA6B)
        x ^= x >> np.uint32(15)
        x *= np.uint32(0xC2B2AE35)
        return parity(x >> np.uint32(22), self.BITS).tobytes()

    def differing_bits(self, num: int, den: int, miss: float = 1e-9) -> int:
        """Most bits in which the odd sketches of sets with similarity num/den or more differ, but for a chance of ``miss``."""
        from math import comb

        p, tail = 1 - num / den, 1.0
        for d in range(self.k + 1):
            tail -= comb(self.k, d) * p**d * (1 - p) ** (self.k - d)
            if tail < miss:
                return 2 * d
        return 2 * self.k


def parity(at: np.ndarray, bits: int) -> np.ndarray:
    """Bitmap whose bit i tells whether i occurs an odd number of times."""
    return np.packbits((np.bincount(at, minlength=bits) & 1).astype(bool))


def set_parity(s: np.ndarray, bits: int = 1024) -> np.ndarray:
    """Parity bitmap of the whole set: two of them differ in no more bits than the sets differ in elements."""
    return parity((s & np.uint64(bits - 1)).astype(np.int64), bits)


def common(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if len(a) > len(b):
        a, b = b, a
    at = np.searchsorted(b, a)
    at[at == len(b)] = 0
    return int(np.count_nonzero(b[at] == a))


def linked(sets: list[np.ndarray], odd: np.ndarray | None, most_bits: int, num: int, den: int, left: int | None = None) -> list[tuple[int, int]]:
    """A spanning forest of the pairs with den * intersection >= num * union, as index pairs.

    ``left``: only pairs of one set before that index and one from it on; None: all pairs. Pairs that
    are connected already aren't compared. A pair is compared in full unless sizes, odd sketches or the
    parity bitmaps of the full sets (the last two in blocks of rows) exclude it.
    """
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    order = np.argsort(size, kind="stable")
    size = size[order]
    side = order < left if left is not None else None
    whole = np.stack([set_parity(sets[i]) for i in order]).view(np.uint64)
    odd = odd[order].view(np.uint64) if odd is not None else None
    comp = np.arange(n)
    out: list[tuple[int, int]] = []
    # intersection >= t * union with t = num / den: smaller >= t * larger, and elements that differ <= (1 - t) / (1 + t) of both sizes
    ends = np.searchsorted(size * num, size * den, side="right")
    for i in range(n - 1):
        j = np.arange(i + 1, ends[i])
        j = j[comp[j] != comp[i]]
        if side is not None:
            j = j[side[j] != side[i]]
        if odd is not None and len(j):
            j = j[np.bitwise_count(odd[j] ^ odd[i]).sum(axis=1, dtype=np.int64) <= most_bits]
        if len(j):
            j = j[np.bitwise_count(whole[j] ^ whole[i]).sum(axis=1, dtype=np.int64) * (den + num) <= (den - num) * (size[j] + size[i])]
        for k in j.tolist():
            if comp[k] == comp[i]:
                continue
            both = common(sets[order[i]], sets[order[k]])
            if den * both >= num * (size[i] + size[k] - both):
                out.append((int(order[i]), int(order[k])))
                comp[comp == comp[k]] = comp[i]
    return out
