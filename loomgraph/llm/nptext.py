"""Vectorised words, shingles and 64-bit hashes over a batch of UTF-8 texts laid end to end."""

from __future__ import annotations

import numpy as np

U64 = np.uint64
_P = 0x9E3779B97F4A7C15
_INV = pow(_P, -1, 1 << 64)
#: Each byte's random 64-bit value, fixed by the seed: hashes must agree between runs and machines.
BYTE = np.random.default_rng(20240607).integers(1, 1 << 63, 256, dtype=np.uint64) * U64(2) + U64(1)
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
SPACE = np.zeros(256, bool)
SPACE[[0x20, *range(0x09, 0x0E)]] = True
_pow: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The first n powers of the base and of its inverse, mod 2**64."""
    if len(_pow[0]) < n:
        for k, base in ((0, _P), (1, _INV)):
            a = np.full(max(n, 1 << 16), base, np.uint64)
            a[0] = 1
            _pow[k] = np.multiply.accumulate(a)
    return _pow[0][:n], _pow[1][:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words that spreads every bit."""
    h = (h ^ (h >> U64(30))) * U64(0xBF58476D1CE4E5B9)
    h = (h ^ (h >> U64(27))) * U64(0x94D049BB133111EB)
    return h ^ (h >> U64(31))


def prefix_hashes(data: np.ndarray) -> np.ndarray:
    """H with H[j] - H[i] = the hash of data[i:j] times the base to the power i."""
    p, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum(BYTE[data] * p[: len(data)], out=out[1:])
    return out


def span_hashes(prefix: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, q = powers(len(prefix))
    return mix((prefix[end] - prefix[start]) * q[start] + (end - start).astype(np.uint64))


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end of every word (bytes other than 0x20 and 0x09-0x0D), and for each row the number of its first word (one more than rows)."""
    if len(data) == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(off), np.int64)
    gap = SPACE[data]
    before = np.empty(len(data), bool)
    before[0] = True
    before[1:] = gap[:-1]
    edges = off[:-1][off[:-1] < len(data)]
    before[edges] = True
    after = np.empty(len(data), bool)
    after[-1] = True
    after[:-1] = gap[1:]
    ends = off[1:][off[1:] > 0] - 1
    after[ends] = True
    start = np.flatnonzero(~gap & before)
    end = np.flatnonzero(~gap & after) + 1
    return start, end, np.searchsorted(start, off)


def shingles(data: np.ndarray, off: np.ndarray, n: int, lower: bool = True) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all n-word shingles, and for each row the number of its first one; fewer words give one shingle of them all, none give none."""
    if lower:
        data = LOWER[data]
    start, end, first = words(data, off)
    return word_shingles(span_hashes(prefix_hashes(data), start, end), first, n)


def word_shingles(h: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    count = np.diff(first)
    own = np.where(count > 0, np.maximum(1, count - n + 1), 0)
    begin = np.concatenate(([0], np.cumsum(own)))
    at = np.repeat(first[:-1] - begin[:-1], own) + np.arange(begin[-1])
    last = np.repeat(first[1:], own)
    total = np.zeros(len(at), np.uint64)
    for k in range(n):
        there = at + k < last
        word = h[np.minimum(at + k, max(0, len(h) - 1))] if len(h) else total
        total += np.where(there, (word ^ U64(k * 0x9E3779B9 + 1)) * U64(pow(_P, 2 * k + 3, 1 << 64)), U64(0))
    return mix(total), begin


#: For a byte, a 64-bit word of eight 8-bit lanes, lane k holding bit k.
LANES = np.array([sum((b >> k & 1) << 8 * k for k in range(8)) for b in range(256)], np.uint64)


def bit_counts(h: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """How many hashes of each row have each of the 64 bits set: rows x 64."""
    rows = len(begin) - 1
    out = np.zeros((rows, 64), np.int64)
    n = np.diff(begin)
    if len(h) == 0:
        return out
    # Lanes hold 255 at most, so each row is cut into runs of 255 hashes.
    runs = (n + 254) // 255
    owner = np.repeat(np.arange(rows), runs)
    first = np.concatenate(([0], np.cumsum(runs)))[:-1]
    at = np.repeat(begin[:-1], runs) + 255 * (np.arange(len(owner)) - np.repeat(first, runs))
    raw = h.view(np.uint8).reshape(-1, 8)
    live = np.flatnonzero(n)
    for byte in range(8):
        part = np.add.reduceat(LANES[raw[:, byte]], at).view(np.uint8).reshape(-1, 8).astype(np.int64)
        out[live, 8 * byte : 8 * byte + 8] = np.add.reduceat(part, first[live], axis=0)
    return out


def majority(counts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The 64-bit word whose bit is set where over half of n hashes have it."""
    bits = (2 * counts > n[:, None]).astype(np.uint8)
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64).ravel()
