"""A word-level FM-index in numpy: k-ordered BWT in a wavelet matrix, and matching statistics of texts that stream past it.

After it is built an index of n words holds the wavelet matrix (n log2 sigma bits), a byte
of common-prefix length a word, two bits' worth of group edges for each depth, and one
number for each group of equal `depth`-word prefixes. Neither the text nor the suffix
array is kept.
"""

from __future__ import annotations

import numpy as np

U = np.uint64


def _ranks(key: np.ndarray) -> np.ndarray:
    """Dense ranks of the values of key."""
    order = np.argsort(key, kind="stable")
    sorted_key = key[order]
    step = np.zeros(len(key), np.int32)
    step[1:] = sorted_key[1:] != sorted_key[:-1]
    out = np.empty(len(key), np.int32)
    out[order] = np.cumsum(step, dtype=np.int32)
    return out


def _packed(bits: np.ndarray) -> np.ndarray:
    padded = np.zeros((len(bits) // 64 + 1) * 64, np.uint8)
    padded[: len(bits)] = bits
    return np.packbits(padded, bitorder="little").view(np.uint64)


def _counts(words: np.ndarray) -> np.ndarray:
    counts = np.zeros(len(words), np.int32)
    np.cumsum(np.bitwise_count(words[:-1]), out=counts[1:], dtype=np.int32)
    return counts


def _below(words: np.ndarray, counts: np.ndarray, i: np.ndarray) -> np.ndarray:
    """Set bits before place i."""
    w = i >> 6
    return counts[w] + np.bitwise_count(words[w] & ((U(1) << (i & 63).astype(np.uint64)) - U(1)))


class Wavelet:
    """rank(c, i): how often symbol c stands in the first i places. n log2(sigma) bits and a count for each 64."""

    def __init__(self, symbols: np.ndarray, sigma: int):
        self.levels = max(1, int(sigma - 1).bit_length())
        self.bits, self.counts, self.zeros = [], [], []
        s = symbols.astype(np.int32)
        for level in range(self.levels - 1, -1, -1):
            b = ((s >> level) & 1).astype(np.uint8)
            self.bits.append(_packed(b))
            self.counts.append(_counts(self.bits[-1]))
            self.zeros.append(int(len(b) - b.sum()))
            s = np.concatenate([s[b == 0], s[b == 1]])

    def rank(self, c: np.ndarray, i: np.ndarray) -> np.ndarray:
        """c and i of one length, i in any number of rows."""
        x = np.concatenate([np.zeros((1, len(c)), np.int64), np.atleast_2d(i)])
        for k in range(self.levels):
            one = ((c >> (self.levels - 1 - k)) & 1).astype(bool)
            ones = _below(self.bits[k], self.counts[k], x)
            x = np.where(one, self.zeros[k] + ones, x - ones)
        return x[1:] - x[0]


class Edges:
    """For each depth the places where a group of suffixes with equal prefixes of that depth begins."""

    def __init__(self, common: np.ndarray, depth: int):
        """common: of each suffix with the one before, in words; 0 for the first."""
        self.n = len(common)
        rows = []
        for d in range(depth + 1):
            edge = common < d
            edge[:1] = True
            rows.append(_packed(edge))
        self.bits = np.concatenate(rows)
        self.wide = len(rows[0])
        place = np.arange(self.wide, dtype=np.int32)
        none = [r == 0 for r in rows]
        self.back = np.concatenate([np.maximum.accumulate(np.where(z, -1, place)) for z in none])
        self.ahead = np.concatenate([np.minimum.accumulate(np.where(z, self.wide, place)[::-1])[::-1] for z in none])
        self.deepest, self.counts = rows[-1], _counts(rows[-1])

    def before(self, depth: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The last edge at or before place i."""
        row, w = depth * self.wide, i >> 6
        bits = self.bits[row + w] & (~U(0) >> (63 - (i & 63)).astype(np.uint64))
        other = bits == 0
        if other.any():
            w = np.where(other, self.back[row + np.maximum(w - 1, 0)], w)
            bits = np.where(other, self.bits[row + w], bits)
        return (w.astype(np.int64) << 6) + _highest(bits)

    def after(self, depth: np.ndarray, i: np.ndarray) -> np.ndarray:
        """The first edge at or after place i, or n."""
        row, w = depth * self.wide, np.minimum(i >> 6, self.wide - 1)
        bits = np.where(i < self.n, self.bits[row + w] & (~U(0) << (i & 63).astype(np.uint64)), U(0))
        other = bits == 0
        if other.any():
            up = self.ahead[np.minimum(row + w + 1, len(self.ahead) - 1)]
            end = (w + 1 >= self.wide) | (up >= self.wide)
            w = np.where(other, np.where(end, 0, up), w)
            bits = np.where(other, np.where(end, U(0), self.bits[row + w]), bits)
        return np.where(bits == 0, self.n, (w.astype(np.int64) << 6) + _highest(bits & (~bits + U(1))))

    def group(self, i: np.ndarray) -> np.ndarray:
        """The number of the group, at the greatest depth, that holds place i."""
        return _below(self.deepest, self.counts, i + 1) - 1


def _highest(bits: np.ndarray) -> np.ndarray:
    """Place of the highest set bit of each nonzero word."""
    high = (bits >> U(32)).astype(np.uint32)
    upper = high > 0
    part = np.where(upper, high, bits.astype(np.uint32))
    return np.frexp(part.astype(np.float64))[1].astype(np.int64) - 1 + 32 * upper


class Index:
    """Of texts, for windows of `depth` words: suffixes are sorted by their first `depth` words only.

    Each text carries a number; of a group of suffixes with equal windows the smallest is kept.
    """

    def __init__(self, texts: np.ndarray, lengths: np.ndarray, numbers: np.ndarray, depth: int):
        """texts: words as 64-bit hashes, end to end; lengths: of each text; numbers: of each text."""
        self.depth = depth
        self.words, ids = np.unique(texts, return_inverse=True)
        t = np.zeros(len(texts) + len(lengths), np.int32)  # 0 ends each text
        t[np.arange(len(texts)) + np.repeat(np.arange(len(lengths)), lengths)] = ids + 1
        of = np.repeat(np.arange(len(lengths)), lengths + 1)
        self.n = n = len(t)
        ranks, h = [_ranks(t)], 1
        while h * 2 <= depth:
            ranks.append(_ranks(ranks[-1].astype(np.int64) * (n + 1) + self._ahead(ranks[-1], h) + 1))
            h *= 2
        sa = np.argsort(ranks[-1].astype(np.int64) * (n + 1) + self._ahead(ranks[-1], depth - h) + 1, kind="stable")
        common = np.zeros(n + 1, np.uint8)
        common[1:n] = self._common(sa, ranks, h)
        self.common = common
        self.edges = Edges(common[:n], depth)
        heads = np.flatnonzero(common[:n] < depth)
        heads = np.union1d([0], heads) if n else heads
        self.least = np.minimum.reduceat(numbers[of][sa], heads) if n else np.zeros(0, np.int64)
        self.bwt = Wavelet(t[sa - 1], len(self.words) + 1)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(t, minlength=len(self.words) + 1))])

    @staticmethod
    def _ahead(rank: np.ndarray, by: int) -> np.ndarray:
        out = np.full(len(rank), -1, np.int64)
        out[: max(0, len(rank) - by)] = rank[by:]
        return out

    def _common(self, sa: np.ndarray, ranks: list[np.ndarray], h: int) -> np.ndarray:
        """Words that neighbours in the order have in common, up to depth, by halving steps."""
        a, b, n = sa[:-1].copy(), sa[1:].copy(), len(sa)
        out = np.zeros(max(0, n - 1), np.int64)
        for rank in reversed(ranks):
            same = (a < n) & (b < n)
            same[same] = rank[a[same]] == rank[b[same]]
            out += h * same
            a, b, h = a + h * same, b + h * same, h // 2
        return np.minimum(out, self.depth)

    def _shorten(self, lo: np.ndarray, hi: np.ndarray, which: np.ndarray, depth: np.ndarray) -> None:
        """Intervals of the first `depth` words of what is matched."""
        lo[which] = self.edges.before(depth, lo[which])
        hi[which] = np.where(depth > 0, self.edges.after(depth, hi[which]), self.n)

    def statistics(self, texts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Backward search of texts, all at once: for each of their windows the smallest number of an indexed text that has it, -1 for none.

        A step to the left extends a match; where it can't, the match is shortened from
        the right to the longest one that may go on, so matches are the longest at each place.
        """
        ids = np.minimum(np.searchsorted(self.words, texts), max(0, len(self.words) - 1))
        ids = np.where(self.words[ids] == texts, ids + 1, 0) if len(self.words) else np.zeros(len(texts), np.int64)
        ends = np.cumsum(lengths)
        many = np.maximum(0, lengths - self.depth + 1)
        begin = np.cumsum(many) - many
        out = np.full(int(many.sum()), -1, np.int64)
        lo, hi, held = np.zeros(len(lengths), np.int64), np.full(len(lengths), self.n), np.zeros(len(lengths), np.int64)
        live = np.arange(len(lengths))
        for t in range(int(lengths.max(initial=0))):
            live = live[lengths[live] > t]
            full = live[held[live] == self.depth]
            if len(full):
                self._shorten(lo, hi, full, np.full(len(full), self.depth - 1))
                held[full] = self.depth - 1
            c = ids[ends[live] - 1 - t]
            lost = live[c == 0]
            lo[lost], hi[lost], held[lost] = 0, self.n, 0
            todo, c = live[c > 0], c[c > 0]
            while len(todo):
                a, b = self.first[c] + self.bwt.rank(c, np.stack([lo[todo], hi[todo]]))
                ok = a < b
                went = todo[ok]
                lo[went], hi[went] = a[ok], b[ok]
                held[went] += 1
                todo, c = todo[~ok], c[~ok]
                if len(todo):
                    less = np.maximum(self.common[lo[todo]], self.common[hi[todo]]).astype(np.int64)
                    self._shorten(lo, hi, todo, less)
                    held[todo] = less
            done = live[held[live] == self.depth]
            out[begin[done] + lengths[done] - 1 - t] = self.least[self.edges.group(lo[done])]
        return out
