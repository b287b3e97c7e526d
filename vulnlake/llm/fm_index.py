"""FM-index over a sequence of integer symbols, in numpy.

Symbol 0 separates texts and never matches.  The index is a suffix order (prefix doubling;
separators are told apart by their place, so that the order is total), its Burrows-Wheeler
transform in a wavelet matrix with popcount ranks, and sampled suffix positions.
"""

from __future__ import annotations

import numpy as np

SAMPLE = 8


class Bits:
    """Bit vector with rank."""

    def __init__(self, bits: np.ndarray):
        packed = np.packbits(bits.astype(bool), bitorder="little")
        self.words = np.append(np.pad(packed, (0, -len(packed) % 8)).view("<u8"), np.uint64(0))
        self.before = np.concatenate([[0], np.cumsum(np.bitwise_count(self.words), dtype=np.int64)])[:-1]

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before ``i``."""
        word, bit = i >> 6, (i & 63).astype(np.uint64)
        return self.before[word] + np.bitwise_count(self.words[word] & ((np.uint64(1) << bit) - np.uint64(1)))

    def get(self, i: np.ndarray) -> np.ndarray:
        return (self.words[i >> 6] >> (i & 63).astype(np.uint64) & np.uint64(1)).astype(np.int64)


class Wavelet:
    """Wavelet matrix: rank of a symbol before a place, and the symbol at a place with its rank."""

    def __init__(self, symbols: np.ndarray, depth: int):
        self.depth, self.levels, self.zeros = depth, [], []
        for d in range(depth - 1, -1, -1):
            bit = (symbols >> d & 1).astype(bool)
            self.levels.append(Bits(bit))
            self.zeros.append(int(len(bit) - bit.sum()))
            symbols = np.concatenate([symbols[~bit], symbols[bit]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        lo, hi = np.zeros(len(c), np.int64), i
        for d, b, z in zip(range(self.depth - 1, -1, -1), self.levels, self.zeros, strict=True):
            one = (c >> d & 1).astype(bool)
            rl, rh = b.rank(lo), b.rank(hi)
            lo, hi = np.where(one, z + rl, lo - rl), np.where(one, z + rh, hi - rh)
        return hi - lo

    def access(self, i: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        c, lo, hi = np.zeros(len(i), np.int64), np.zeros(len(i), np.int64), i
        for b, z in zip(self.levels, self.zeros, strict=True):
            one = b.get(hi)
            rl, rh = b.rank(lo), b.rank(hi)
            lo, hi = np.where(one == 1, z + rl, lo - rl), np.where(one == 1, z + rh, hi - rh)
            c = c << 1 | one
        return c, hi - lo


def suffix_order(symbols: np.ndarray) -> np.ndarray:
    """Starts of the suffixes in order; separators rank by place, below all other symbols."""
    n = len(symbols)
    zero = symbols == 0
    rank = np.where(zero, np.cumsum(zero) - 1, symbols + int(zero.sum())).astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    step = 1
    while True:
        ahead = np.full(n, -1, np.int64)
        ahead[:n - step] = rank[step:]
        key = rank * (n + 1) + ahead + 1
        order = np.argsort(key, kind="stable")
        key = key[order]
        new = np.concatenate([[0], np.cumsum(key[1:] != key[:-1])])
        rank[order] = new
        if n == 0 or new[-1] == n - 1 or step >= n:
            return order
        step *= 2


class FMIndex:
    def __init__(self, symbols: np.ndarray, sample: int = SAMPLE):
        """``symbols``: 0 is a separator; the sequence must end with one."""
        symbols = np.asarray(symbols, np.int64)
        self.n = len(symbols)
        self.top = int(symbols.max(initial=0))
        order = suffix_order(symbols)
        last = symbols[order - 1]  # the symbol before each suffix (of the first one: the last separator)
        self.wavelet = Wavelet(last, max(1, self.top.bit_length()))
        self.first = np.concatenate([[0], np.cumsum(np.bincount(symbols, minlength=self.top + 1))])
        # sampled: every ``sample``-th place, and every place after a separator, from where no step leads back
        marked = (order % sample == 0) | (last == 0)
        self.marked = Bits(marked)
        self.samples = order[marked]

    def search(self, patterns: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        """Row interval [lo, hi) of each pattern, by backward search over all at once."""
        k = len(patterns)
        size = np.array([len(p) for p in patterns], np.int64)
        lo, hi = np.zeros(k, np.int64), np.full(k, self.n, np.int64)
        if not k or not self.n:
            return lo, lo.copy()
        width = int(size.max())
        ends = np.zeros((k, width), np.int64)  # reversed patterns
        for r, p in enumerate(patterns):
            ends[r, :len(p)] = p[::-1]
        alive = np.arange(k)
        for j in range(width):
            alive = alive[size[alive] > j]
            c = ends[alive, j]
            known = (c > 0) & (c <= self.top)
            hi[alive[~known]] = lo[alive[~known]] = 0
            alive, c = alive[known], c[known]
            if not len(alive):
                break
            base = self.first[c]
            lo[alive], hi[alive] = base + self.wavelet.rank(c, lo[alive]), base + self.wavelet.rank(c, hi[alive])
            alive = alive[lo[alive] < hi[alive]]
        return lo, np.maximum(lo, hi)

    def locate(self, lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(interval number, place in the sequence) of every occurrence."""
        count = hi - lo
        which = np.repeat(np.arange(len(lo)), count)
        row = np.repeat(lo, count) + np.arange(len(which)) - np.repeat(np.cumsum(count) - count, count)
        place, steps = np.zeros(len(row), np.int64), 0
        live = np.arange(len(row))
        while len(live):
            r = row[live]
            found = self.marked.get(r) == 1
            place[live[found]] = self.samples[self.marked.rank(r[found])] + steps
            live, r = live[~found], r[~found]
            c, rank = self.wavelet.access(r)
            row[live] = self.first[c] + rank
            steps += 1
        return which, place
