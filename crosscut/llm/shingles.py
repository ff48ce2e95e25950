"""Word shingles, their fingerprints and MinHash signatures, in numpy over Arrow text buffers.

Words stand between white space (space, U+0009 to U+000D) after A-Z are lower-cased. A text's set holds its distinct
runs of k words as 64-bit hashes; a text with fewer words has the whole sequence as its one shingle, a text without
words none.
"""

from __future__ import annotations

import numpy as np

from .common import mix64, powers

GOLD = np.uint64(0x9E3779B97F4A7C15)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_IS_SPACE = np.zeros(256, bool)
_IS_SPACE[[9, 10, 11, 12, 13, 32]] = True
#: A random number for each byte, the same for both cases; none for white space.
_BYTE = np.where(_IS_SPACE, np.uint64(0), mix64(_LOWER.astype(np.uint64) + np.uint64(1)))
CHUNK = 1 << 18


def starts(data: np.ndarray, offs: np.ndarray) -> np.ndarray:
    """Where the words of all texts begin."""
    inside = ~_IS_SPACE[data]
    begin = inside.copy()
    begin[1:] &= ~inside[:-1]
    edge = offs[:-1][offs[:-1] < len(data)]
    begin[edge] = inside[edge]
    return np.flatnonzero(begin)


def words(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A hash of each word of all texts, and the n + 1 offsets of each text's words."""
    n, start = len(data), starts(data, offs)
    out = np.zeros(len(start), np.uint64)
    i = 0
    while i < len(start):  # a polynomial of the bytes, by differences of running sums over some words
        j = max(i + 1, int(np.searchsorted(start, start[i] + CHUNK)))
        lo, hi = int(start[i]), int(start[j]) if j < len(start) else n
        up, down = powers(hi - lo)
        run = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_BYTE[data[lo:hi]] * up[: hi - lo])))
        s = start[i:j] - lo
        out[i:j] = (run[np.append(s[1:], hi - lo)] - run[s]) * down[s]
        i = j
    return mix64(out), np.searchsorted(start, offs)


def sets(data: np.ndarray, offs: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """All distinct shingles, sorted within each text, and the n + 1 offsets of the texts."""
    w, at = words(data, offs)
    count = np.diff(at)
    runs = np.where(count >= k, count - k + 1, np.minimum(count, 1))
    edge = np.concatenate(([0], np.cumsum(runs)))
    text = np.repeat(np.arange(len(runs)), runs)
    first = at[:-1][text] + np.arange(edge[-1]) - edge[:-1][text]
    size = np.minimum(count, k)[text]
    h = np.full(len(first), 0x51ED27F5, np.uint64) + size.astype(np.uint64)
    whole = bool((size == k).all())
    for j in range(k):
        has = slice(None) if whole else size > j
        h[has] = mix64(h[has] * GOLD + w[first[has] + j])
    bounds = edge.tolist()
    for lo, hi in zip(bounds[:-1], bounds[1:], strict=True):
        h[lo:hi].sort()
    new = np.ones(len(h), bool)
    new[1:] = h[1:] != h[:-1]
    new[edge[:-1][runs > 0]] = True
    return h[new], np.concatenate(([0], np.cumsum(new)))[edge]


def fingerprints(shingle: np.ndarray, offs: np.ndarray) -> list[bytes]:
    """16 bytes that are equal for equal sets."""
    n = len(offs) - 1
    out = np.zeros((n, 2), np.uint64)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        out[full, 0] = np.add.reduceat(mix64(shingle), offs[full])
        out[full, 1] = np.add.reduceat(mix64(shingle * GOLD + np.uint64(1)), offs[full])
    return [r.tobytes() for r in out]


def signatures(shingle: np.ndarray, offs: np.ndarray, k: int, seed: int = 1) -> np.ndarray:
    """texts x k MinHash values (32 bits); all ones for empty sets."""
    rng = np.random.default_rng(seed)
    mult = rng.integers(0, 1 << 63, k, np.uint64) * np.uint64(2) + np.uint64(1)
    n = len(offs) - 1
    out = np.full((n, k), 0xFFFFFFFF, np.uint32)
    full = np.flatnonzero(np.diff(offs))
    if len(full):
        starts = offs[full]
        for j in range(k):
            out[full, j] = np.minimum.reduceat(((shingle * mult[j]) >> np.uint64(32)).astype(np.uint32), starts)
    return out


def sketches(sig: np.ndarray, bits: int = 128) -> np.ndarray:
    """The last bit of the first values, packed."""
    return np.packbits((sig[:, :bits] & 1).astype(bool), axis=1)


def overlap(a: np.ndarray, b: np.ndarray) -> int:
    """Size of the intersection of two sorted sets."""
    if not len(a) or not len(b):
        return 0
    at = np.minimum(np.searchsorted(b, a), len(b) - 1)
    return int((b[at] == a).sum())
