"""Vectorised rolling hashes over bytes and words.

A prefix sum P[i] = sum of v[j] * B^j (mod 2^64, B odd) gives the hash of any span [s, e) as
(P[e] - P[s]) * B^-s, whatever the span's place; ``mix`` spreads it over all bits.
"""

from __future__ import annotations

import numpy as np

U = np.uint64
BASE = 0x9E3779B97F4A7C15
_TABLE = np.random.default_rng(20240131).integers(1, 2**63, 256, dtype=np.uint64) | U(1)
_SPACE = np.zeros(256, bool)
_SPACE[[0x20, 9, 10, 11, 12, 13]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_powers: dict[str, np.ndarray] = {}


def _pow(kind: str, n: int) -> np.ndarray:
    have = _powers.get(kind)
    if have is None or len(have) < n:
        b = BASE if kind == "up" else pow(BASE, -1, 2**64)
        m = max(n + n // 8, 1 << 16)
        a = np.full(m, b, np.uint64)
        a[0] = 1
        have = _powers[kind] = np.multiply.accumulate(a)
    return have


def inverse(n: int) -> np.ndarray:
    return _pow("down", n)


def prefix(values: np.ndarray) -> np.ndarray:
    """P for uint64 values."""
    out = np.empty(len(values) + 1, np.uint64)
    out[0] = 0
    np.cumsum(values * _pow("up", len(values))[: len(values)], out=out[1:])
    return out


def byte_prefix(buf: np.ndarray) -> np.ndarray:
    return prefix(_TABLE[buf])


def span(p: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    return (p[e] - p[s]) * inverse(len(p))[s]


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    x = x + U((0x9E3779B97F4A7C15 * (2 * seed + 1)) % 2**64)
    x ^= x >> U(30)
    x *= U(0xBF58476D1CE4E5B9)
    x ^= x >> U(27)
    x *= U(0x94D049BB133111EB)
    x ^= x >> U(31)
    return x


def grams(p: np.ndarray, n: int, seed: int = 0) -> np.ndarray:
    """Hashes of all runs of n units of the sequence with prefix sums p."""
    m = len(p) - 1
    if m < n:
        return np.zeros(0, np.uint64)
    return mix((p[n:] - p[: m - n + 1]) * inverse(m + 1)[: m - n + 1], seed)


def lower(buf: np.ndarray) -> np.ndarray:
    return _LOWER[buf]


def words(buf: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts and ends of the words of rows that lie end to end, and offsets of each row's words."""
    n = len(buf)
    if n == 0:
        z = np.zeros(0, np.int64)
        return z, z, np.zeros(len(offs), np.int64)
    inside = ~_SPACE[buf]
    edge = np.zeros(n + 1, bool)
    edge[offs] = True
    first = inside.copy()
    first[1:] &= ~inside[:-1] | edge[1:n]
    last = inside.copy()
    last[:-1] &= ~inside[1:] | edge[1:n]
    starts, ends = np.flatnonzero(first), np.flatnonzero(last) + 1
    return starts, ends, np.searchsorted(starts, offs)


def word_hashes(buf: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    return mix(span(byte_prefix(buf), starts, ends) + (ends - starts).astype(np.uint64))


def slide(a: np.ndarray, w: int, op) -> np.ndarray:
    """op (minimum or maximum) over each run of w values."""
    done = 1
    while done < w:
        step = min(done, w - done)
        a = op(a[:-step], a[step:])
        done += step
    return a


def anchors(p: np.ndarray, offs: np.ndarray, window: int, k: int):
    """The k-grams that are the smallest by hash in some window of a row, and the windows they stand for.

    Equal windows choose equal grams, so documents that share a window share an anchor. Returns the
    anchors' positions and hashes, and the first and last start of the windows that chose each.
    """
    z = np.zeros(0, np.int64)
    n = len(p) - 1
    if n < window:
        return z, np.zeros(0, np.uint64), z, z
    h = grams(p, k)
    h |= U(1)
    w = window - k + 1
    low = slide(h, w, np.minimum)
    ends = np.repeat(offs[1:], np.diff(offs))[: len(low)]
    low[np.arange(window, window + len(low)) > ends] = 0
    pad = np.zeros(w - 1, np.uint64)
    best = slide(np.concatenate([pad, low, pad]), w, np.maximum)
    pos = np.flatnonzero(h == best[: len(h)])
    hp = h[pos]
    # the windows that chose a gram follow one another: a part of a run of equal minima
    begin = np.flatnonzero(np.append(True, low[1:] != low[:-1]))
    end = np.append(begin[1:], len(low)) - 1
    run = np.searchsorted(begin, np.minimum(pos, len(low) - 1), "right") - 1
    todo = np.flatnonzero(low[begin[run]] != hp)
    while len(todo):
        run[todo] -= 1
        todo = todo[low[begin[run[todo]]] != hp[todo]]
    first, last = np.maximum(begin[run], pos - w + 1), np.minimum(end[run], pos)
    return pos, hp, first, last


def ragged(starts: np.ndarray, lens: np.ndarray) -> np.ndarray:
    """starts[0], starts[0] + 1, ... for lens[0] values, and so on."""
    total = int(lens.sum())
    if total == 0:
        return np.zeros(0, np.int64)
    out = np.ones(total, np.int64)
    at = np.cumsum(lens)[:-1]
    keep = lens > 0
    s, n = starts[keep], lens[keep]
    out[0] = s[0]
    at = np.cumsum(n)[:-1]
    out[at] = s[1:] - (s[:-1] + n[:-1] - 1)
    return np.cumsum(out)


def covered(size: int, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """Which of size units lie in one of the spans."""
    d = np.zeros(size + 1, np.int64)
    np.add.at(d, starts, 1)
    np.add.at(d, ends, -1)
    return np.cumsum(d[:size]) > 0
