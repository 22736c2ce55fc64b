"""Words and word shingles of texts as 64-bit numbers, in numpy."""

from __future__ import annotations

from functools import lru_cache

import numpy as np

P = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads every bit (the finaliser of splitmix64)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


@lru_cache(maxsize=1)
def _bytes_table() -> np.ndarray:
    """A random number per byte; white characters are 0 and letters A-Z stand for a-z."""
    table = mixed(np.arange(1, 257, dtype=np.uint64) * P)
    table[65:91] = table[97:123]
    table[[32, 9, 10, 11, 12, 13]] = 0
    return table


@lru_cache(maxsize=1)
def _white() -> np.ndarray:
    white = np.zeros(256, bool)
    white[[32, 9, 10, 11, 12, 13]] = True
    return white


_POWERS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """The powers of an odd number modulo 2^64 and of its inverse, n of each at least."""
    held = 1 << max(16, int(n).bit_length())
    if held not in _POWERS:
        _POWERS.clear()
        both = []
        for base in (int(P), pow(int(P), -1, 1 << 64)):
            run = np.full(held, base, np.uint64)
            run[0] = 1
            both.append(np.multiply.accumulate(run))
        _POWERS[held] = (both[0], both[1])
    return _POWERS[held]


def word_hashes(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """The hash of every word, texts one after the other, and how many words each text has.

    Words are runs of bytes other than the white ones; A-Z count as a-z. A word's
    polynomial is the difference of two prefix sums, brought back to place 0.
    """
    hashes, counts, _ = word_hashes_and_ends(texts)
    return hashes, counts


def word_hashes_and_ends(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The same, and the last byte of every word."""
    raw = np.frombuffer(b" ".join([b"", *texts, b""]), np.uint8)
    white = _white()[raw]
    edge = np.flatnonzero(white[1:] != white[:-1])
    starts, ends = edge[::2] + 1, edge[1::2] + 1
    up, down = powers(len(raw))
    sums = np.cumsum(_bytes_table()[raw] * up[: len(raw)])
    hashes = mixed((sums[ends - 1] - sums[starts - 1]) * down[starts] + (ends - starts).astype(np.uint64))
    text_ends = np.cumsum([len(t) + 1 for t in texts])
    counts = np.diff(np.concatenate([[0], np.searchsorted(starts, text_ends, "right")]))
    return hashes, counts, raw[ends - 1]


class Lookup:
    """Places of 64-bit hashes in a sorted table; nearly constant time each, as hashes are spread evenly."""

    def __init__(self, table: np.ndarray):
        self.table = table
        self.shift = np.uint64(64 - max(4, int(len(table)).bit_length() + 1))
        buckets = np.arange((1 << int(64 - int(self.shift))) + 1, dtype=np.uint64)
        first = np.searchsorted(table >> self.shift, buckets)
        self.first = first[:-1].astype(np.int32)
        self.deepest = int(np.diff(first).max()) if len(table) else 0

    def find(self, hashes: np.ndarray) -> np.ndarray:
        """The place of each hash, -1 if the table lacks it."""
        out = np.full(len(hashes), -1, np.int64)
        start = self.first[hashes >> self.shift]
        for step in range(self.deepest):
            at = np.minimum(start + step, len(self.table) - 1)
            out = np.where(self.table[at] == hashes, at, out)
        return out


def shingle_hashes(words: np.ndarray, counts: np.ndarray, k: int, short: bool) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the k-word shingles of each text, in order and with repeats, and how many each text has.

    A text of fewer than k words has its whole sequence as one shingle if
    ``short``, else none.
    """
    n = len(words)
    text_ends = np.cumsum(counts)
    text_starts = text_ends - counts
    if n >= k:
        rolled = np.zeros(n - k + 1, np.uint64)
        for i in range(k):
            rolled = mixed(rolled * P + words[i : n - k + 1 + i])
    else:
        rolled = np.zeros(0, np.uint64)
    full = np.maximum(counts - k + 1, 0)
    if not short or not ((counts > 0) & (counts < k)).any():
        owner = np.repeat(np.arange(len(counts)), full)
        places = np.arange(len(owner)) - np.repeat(np.cumsum(full) - full, full) + text_starts[owner]
        return rolled[places], full
    out, sizes = [], full.copy()
    for i, (start, count) in enumerate(zip(text_starts.tolist(), counts.tolist())):
        if count >= k:
            out.append(rolled[start : start + count - k + 1])
        elif count:
            h = np.full(1, count, np.uint64)
            for w in range(start, start + count):
                h = mixed(h * P + words[w : w + 1])
            out.append(h)
            sizes[i] = 1
    return (np.concatenate(out) if out else np.zeros(0, np.uint64)), sizes


def seeds(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Odd multipliers and offsets of n hash functions."""
    base = mixed(np.arange(1, 2 * n + 1, dtype=np.uint64) * P)
    return base[:n] | np.uint64(1), base[n:]


def block_minima(hashes: np.ndarray, starts: np.ndarray, n: int, chunk: int = 1 << 18) -> np.ndarray:
    """MinHash values (upper 32 bits) of n hash functions over the blocks that begin at ``starts``: an array blocks x n."""
    a, b = seeds(n)
    out = np.empty((len(starts), n), np.uint32)
    # blocks are taken in groups, so that the products stay in cache
    edges = np.concatenate([starts, [len(hashes)]])
    at = 0
    while at < len(starts):
        to = max(at + 1, int(np.searchsorted(edges, edges[at] + chunk, "right")) - 1)
        part = hashes[edges[at] : edges[to]]
        local = (edges[at:to] - edges[at]).astype(np.intp)
        for k in range(n):
            out[at:to, k] = np.minimum.reduceat(((part * a[k] + b[k]) >> np.uint64(32)).astype(np.uint32), local)
        at = to
    return out
