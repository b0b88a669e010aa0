"""Sets of word shingles: minimum-hash bands that deal them to blocks, and their exact similarity."""

from __future__ import annotations

from functools import lru_cache

import numpy as np
import xxhash

#: A pair of sets at similarity 0.8 shares none of the bands in about 3 of a million cases, a closer one less often.
BANDS, ROWS = 24, 4
_SEED = 42


def shingles(text: bytes, size: int) -> np.ndarray:
    """64-bit hashes of the text's shingles in order, repeats included; A-Z in lower case. Fewer words: all as one."""
    words = text.lower().split()
    if not words:
        return np.zeros(0, np.uint64)
    line, one = b" ".join(words), xxhash.xxh64_intdigest
    if len(words) <= size:
        return np.array([one(line, _SEED)], np.uint64)
    length = np.fromiter(map(len, words), np.int64, len(words))
    start = np.cumsum(length + 1) - length - 1
    stop = (start + length)[size - 1 :].tolist()
    return np.array([one(line[a:b], _SEED) for a, b in zip(start.tolist(), stop, strict=False)], np.uint64)


def fingerprint(hashes: np.ndarray) -> int:
    """SimHash: a bit is set if it is in over half of the hashes; zero without any."""
    ones = np.zeros(64, np.int64)
    for i in range(0, len(hashes), 8192):  # bits in blocks, so a very long text stays small
        ones += np.unpackbits(hashes[i : i + 8192].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * ones > len(hashes), bitorder="little").view(np.uint64)[0])


@lru_cache(maxsize=1)
def _turns() -> tuple[np.ndarray, np.ndarray]:
    """Odd factors and addends, one pair per minimum hash."""
    rng = np.random.default_rng(_SEED)
    mul = rng.integers(0, 1 << 31, (BANDS * ROWS, 1), np.uint32) * np.uint32(2) + np.uint32(1)
    return mul, rng.integers(0, 1 << 32, (BANDS * ROWS, 1), np.uint32)


def band_keys(hashes: np.ndarray) -> np.ndarray:
    """A 64-bit key per band of minimum hashes, the band's number among what it covers; an empty set has keys of its own."""
    mul, add = _turns()
    h = (hashes ^ (hashes >> np.uint64(32))).astype(np.uint32)
    low = np.full(BANDS * ROWS, 0xFFFFFFFF, np.uint32)
    for i in range(0, len(h), 2048):
        low = np.minimum(low, (h[None, i : i + 2048] * mul + add).min(axis=1))
    return np.array([xxhash.xxh64_intdigest(low[k * ROWS : (k + 1) * ROWS].tobytes(), k) for k in range(BANDS)], np.uint64)


def similar(a: np.ndarray, b: np.ndarray, similarity: float) -> bool:
    """Whether two sets (sorted, distinct) overlap by `similarity` or more. Two empty sets are equal."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= similarity * (len(a) + len(b) - both) - 1e-9


class Postings:
    """The sets of a block by element, so that one set meets all others at once."""

    def __init__(self, sets: list[np.ndarray]):
        self.size = np.array([len(s) for s in sets], np.int64)
        self.own = np.repeat(np.arange(len(sets)), self.size)
        _, self.code = np.unique(np.concatenate([np.zeros(0, np.uint64), *sets]), return_inverse=True)
        order = np.argsort(self.code, kind="stable")
        self.holder = self.own[order]
        count = np.bincount(self.code) if len(self.code) else np.zeros(0, np.int64)
        self.end = np.cumsum(count)
        self.begin = self.end - count
        self.edge = np.concatenate(([0], np.cumsum(self.size)))

    def similar(self, i: int, others: np.ndarray, similarity: float) -> np.ndarray:
        """Which of the others are similar to set i."""
        codes = self.code[self.edge[i] : self.edge[i + 1]]
        parts = [self.holder[a:b] for a, b in zip(self.begin[codes].tolist(), self.end[codes].tolist(), strict=True)]
        both = np.bincount(np.concatenate([np.zeros(0, np.int64), *parts]), minlength=len(self.size))[others]
        return both >= similarity * (self.size[i] + self.size[others] - both) - 1e-9
