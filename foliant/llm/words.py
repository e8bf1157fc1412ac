"""Words, hashes of words and of runs of tokens, for whole batches at once."""

from __future__ import annotations

import numpy as np
import xxhash

_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True
_M1, _M2, _M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xD6E8FEB86659FD93), np.uint64(0xC2B2AE3D27D4EB4F)
_BASES = (0x5851F42D4C957F2D, 0x2545F4914F6CDD1D)
_LONG = 256
_powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def mix(h: np.ndarray) -> np.ndarray:
    h = h ^ (h >> np.uint64(32))
    h *= _M2
    h ^= h >> np.uint64(29)
    h *= _M1
    h ^= h >> np.uint64(32)
    return h


def powers(which: int, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers 0..n of a base and of its inverse, modulo 2^64."""
    have = _powers.get(which)
    if have is None or len(have[0]) <= n:
        size, base = max(n + 1, 1 << 20), _BASES[which]
        have = tuple(np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size, b, np.uint64)]), dtype=np.uint64) for b in (base, pow(base, -1, 1 << 64)))
        _powers[which] = have
    return have


class Runs:
    """Hashes of any runs [a, b) of a sequence of 64-bit token hashes, each in constant time."""

    def __init__(self, tokens: np.ndarray, which: int = 0):
        up, self.down = powers(which, len(tokens))
        self.sums = np.zeros(len(tokens) + 1, np.uint64)
        np.cumsum(tokens * up[: len(tokens)], out=self.sums[1:])

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        return mix((self.sums[b] - self.sums[a]) * self.down[a])


def find_words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of all words (runs free of white space), and each text's range in them (one more than texts)."""
    inside = ~_SPACE[data]
    edge = np.zeros(len(data) + 1, bool)
    edge[offs] = True
    start, end = inside.copy(), inside.copy()
    if len(data):
        start[1:] &= ~inside[:-1] | edge[1:-1]
        end[:-1] &= ~inside[1:] | edge[1:-1]
    starts = np.flatnonzero(start)
    return starts, np.flatnonzero(end) + 1, np.searchsorted(starts, offs)


def hash_words(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hash of each word's bytes."""
    size = ends - starts
    h = size.astype(np.uint64) * _M3
    eight = np.ndarray((len(data),), "<u8", np.concatenate([data, np.zeros(8, np.uint8)]), 0, (1,))
    todo = np.arange(len(starts)) if not (size > _LONG).any() else np.flatnonzero(size <= _LONG)
    at, left = starts[todo], size[todo]
    while len(todo):
        chunk = eight[at]
        short = left < 8
        chunk[short] &= (np.uint64(1) << (left[short].astype(np.uint64) * np.uint64(8))) - np.uint64(1)
        x = (h[todo] ^ chunk) * _M1
        h[todo] = (x ^ (x >> np.uint64(31))) * _M2
        more = left > 8
        todo, at, left = todo[more], at[more] + 8, left[more] - 8
    for i in np.flatnonzero(size > _LONG):
        h[i] = xxhash.xxh3_64_intdigest(data[starts[i] : ends[i]].tobytes())
    return mix(h)


def shingles(hashes: np.ndarray, ranges: np.ndarray, n: int = 5) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of each text's runs of n words (of all its words, if it has fewer but any), and each text's range."""
    count = np.diff(ranges)
    made = np.where(count >= n, count - n + 1, (count > 0).astype(count.dtype))
    out = np.concatenate([[0], np.cumsum(made)])
    text = np.repeat(np.arange(len(count)), made)
    a = np.arange(out[-1]) - out[text] + ranges[text]
    return Runs(hashes)(a, np.minimum(a + n, ranges[text + 1])), out
