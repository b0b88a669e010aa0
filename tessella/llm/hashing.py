"""Vectorised hashes of the words of many texts laid end to end."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

_P = 0x9E3779B97F4A7C15
_M = (1 << 64) - 1
_MIX = np.uint64(0xBF58476D1CE4E5B9)
#: Bytes of text hashed at once; a word that passes the end of a block is cut there.
BLOCK = 1 << 20


@lru_cache(maxsize=1)
def _powers() -> tuple[np.ndarray, np.ndarray]:
    """Powers of an odd number and of its inverse modulo 2**64."""
    n = BLOCK + 1
    up, down = np.full(n, _P, np.uint64), np.full(n, pow(_P, -1, 1 << 64), np.uint64)
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def mix(h: np.ndarray, bits: int) -> np.ndarray:
    """Hashes to bucket numbers of so many bits."""
    h = (h ^ (h >> np.uint64(31))) * _MIX
    return (h >> np.uint64(64 - bits)).astype(np.int64)


def word_hashes(b: np.ndarray, space: np.ndarray, prefix: int = 0) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash, start) of each run of bytes where `space` is false; of its first `prefix` bytes if given."""
    up, down = _powers()
    hashes, starts = [], []
    lo = 0
    while lo < len(b):
        hi = min(lo + BLOCK, len(b))
        if hi < len(b):  # end the block between words if it can
            gap = np.flatnonzero(space[lo:hi])
            hi = lo + int(gap[-1]) + 1 if len(gap) else hi
        s = space[lo:hi]
        edge = np.flatnonzero(np.diff(np.concatenate(([True], s, [True])).astype(np.int8)))
        begin, end = edge[::2], edge[1::2]
        total = np.concatenate(([np.uint64(0)], np.cumsum((b[lo:hi].astype(np.uint64) + np.uint64(1)) * up[: hi - lo], dtype=np.uint64)))
        end = np.minimum(end, begin + prefix) if prefix else end
        h = (total[end] - total[begin]) * down[begin]
        # one end mark, so that a word's length counts too
        hashes.append(h ^ (end - begin).astype(np.uint64) * np.uint64(0x2545F4914F6CDD1D))
        starts.append(begin + lo)
        lo = hi
    if not hashes:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(hashes), np.concatenate(starts)


def joined(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Texts with a space after each, and where each starts (and the end)."""
    return np.frombuffer(b"".join([t + b" " for t in texts]), np.uint8), np.cumsum([0, *(len(t) + 1 for t in texts)])
