"""A compressed FM-index over word sequences, and matching statistics by backward search.

The Burrows-Wheeler transform is held in a wavelet matrix whose levels are
packed bit vectors with rank counts, about 1.5 bits a word and level.  Longest
common prefixes with their previous and next smaller values give the parent of
a suffix interval, which is what shortens a match that can't be extended.  All
queries advance in lockstep, so each step is a few array operations.
"""

from __future__ import annotations

import numpy as np


class BitVector:
    def __init__(self, bits: np.ndarray):
        n = len(bits)
        packed = np.zeros(n // 64 + 1, np.uint64)
        raw = np.packbits(bits, bitorder="little")
        packed.view(np.uint8)[: len(raw)] = raw
        self.words = packed
        self.before = np.zeros(len(packed), np.int32)
        np.cumsum(np.bitwise_count(packed[:-1]), out=self.before[1:])
        self.zeros = n - int(np.count_nonzero(bits))

    def rank(self, i: np.ndarray) -> np.ndarray:
        """Ones before each position."""
        k = i >> 6
        mask = (np.uint64(1) << (i & 63).astype(np.uint64)) - np.uint64(1)
        return self.before[k] + np.bitwise_count(self.words[k] & mask)


class WaveletMatrix:
    def __init__(self, symbols: np.ndarray, bits: int):
        self.levels = []
        for b in range(bits - 1, -1, -1):
            bit = (symbols >> b) & 1
            self.levels.append((b, BitVector(bit.astype(bool))))
            symbols = np.concatenate([symbols[bit == 0], symbols[bit == 1]])

    def follow(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Where each position falls in the order of the last level; differences count the symbol."""
        for b, v in self.levels:
            r = v.rank(i)
            i = np.where((symbol >> b) & 1, v.zeros + r, i - r)
        return i


class FMIndex:
    """Of pieces of text, each an array of symbols from 1 on; no match crosses pieces."""

    def __init__(self, symbols: np.ndarray, lengths: np.ndarray, weight: np.ndarray):
        """weight: in how many places each piece occurs."""
        m, n = len(lengths), len(symbols) + len(lengths)
        ends = np.cumsum(lengths + 1) - 1
        text = np.zeros(n, np.int64)
        inside = np.ones(n, bool)
        inside[ends] = False
        text[inside] = symbols
        self.n = n
        self.sigma = int(text.max(initial=0)) + 1
        rank = text + m - 1
        rank[ends] = np.arange(m)  # each separator is a symbol of its own, so comparisons end there
        levels, h = [rank], 1
        order = np.argsort(rank, kind="stable")
        while True:
            nxt = np.full(n, -1, np.int64)
            nxt[: n - h] = rank[h:]
            key = rank * (n + self.sigma + 1) + nxt + 1
            order = np.argsort(key)
            new = np.concatenate([[False], key[order][1:] != key[order][:-1]])
            rank = np.empty(n, np.int64)
            rank[order] = np.cumsum(new)
            h *= 2
            if int(rank[order[-1]]) == n - 1:
                break
            levels.append(rank)
        self.sa = order
        bwt = text[order - 1]
        bits = max(1, int(self.sigma - 1).bit_length())
        self.wavelet = WaveletMatrix(bwt, bits)
        self.first = np.concatenate([[0], np.cumsum(np.bincount(text, minlength=self.sigma))[:-1]])
        self.begin = self.wavelet.follow(np.arange(self.sigma), np.zeros(self.sigma, np.int64))
        self._lcp(levels, order)
        piece = np.repeat(np.arange(m), lengths + 1)
        self.weight = np.concatenate([[0], np.cumsum(weight[piece][order])])
        self.least = [order]

    def _lcp(self, levels: list[np.ndarray], order: np.ndarray) -> None:
        n = self.n
        a, b = order[:-1], order[1:]
        size = np.zeros(n - 1, np.int64)
        for k in range(len(levels) - 1, -1, -1):
            i, j = a + size, b + size
            ok = (i < n) & (j < n)
            same = ok.copy()
            same[ok] = levels[k][i[ok]] == levels[k][j[ok]]
            size[same] += 1 << k
        self.lcp = np.concatenate([[-1], size, [-1]])
        self.prev = self._smaller(self.lcp, -1)
        self.next = self._smaller(self.lcp, 1)

    @staticmethod
    def _smaller(x: np.ndarray, step: int) -> np.ndarray:
        """The nearest position to one side with a smaller value; positions of the least value keep themselves."""
        to = np.arange(len(x)) + step
        to[0 if step < 0 else -1] -= step
        live = np.flatnonzero(x > x.min())
        to[x == x.min()] = np.flatnonzero(x == x.min())
        while len(live):
            live = live[x[to[live]] >= x[live]]
            to[live] = to[to[live]]
        return to

    def smallest(self, sp: np.ndarray, ep: np.ndarray) -> np.ndarray:
        """The first text position among each interval's suffixes."""
        k = np.frexp((ep - sp).astype(np.float64))[1] - 1
        while len(self.least) <= int(k.max(initial=0)):
            p, h = self.least[-1], 1 << (len(self.least) - 1)
            self.least.append(np.minimum(p[: len(p) - h], p[h:]))
        out = np.empty(len(sp), np.int64)
        for v in np.unique(k):
            of = k == v
            out[of] = np.minimum(self.least[v][sp[of]], self.least[v][ep[of] - (1 << int(v))])
        return out

    def matches(self, symbols: np.ndarray, begin: np.ndarray, ends: np.ndarray, least: int, times: int, own: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Matching statistics of streamed stretches [begin, end) of symbols, where they reach ``least``.

        symbols: 0 where the word isn't in the index.  times: a match counts if
        the index holds it so often.  own: place of each symbol in the order of
        the indexed text.  A stretch is read from its end; its matches end in it.
        Returns the starts, the longest match of each, and the longest one with
        an occurrence before the start itself (0: under ``least``).
        """
        at, begin = ends.astype(np.int64).copy(), begin.astype(np.int64)
        sp, ep, q = np.zeros(len(at), np.int64), np.full(len(at), self.n, np.int64), np.zeros(len(at), np.int64)
        live = np.flatnonzero(at > begin)
        found = []
        shift = self.first - self.begin
        while len(live):
            c = symbols[at[live] - 1]
            both = self.wavelet.follow(np.concatenate([c, c]), np.concatenate([sp[live], ep[live]])) + np.concatenate([shift[c], shift[c]])
            ns, ne = both[: len(live)], both[len(live) :]
            ok = (c > 0) & (ne > ns)
            ok &= self.weight[np.where(ok, ne, 0)] - self.weight[np.where(ok, ns, 0)] >= times
            go = live[ok]
            sp[go], ep[go], q[go] = ns[ok], ne[ok], q[go] + 1
            at[go] -= 1
            reach = go[q[go] >= least]
            if len(reach):
                found.append((at[reach], q[reach], sp[reach], ep[reach]))
            no = live[~ok]
            if len(no):
                drop = (q[no] == 0) | (c[~ok] == 0)
                skip = no[drop]
                at[skip] -= 1
                sp[skip], ep[skip], q[skip] = 0, self.n, 0
                up = no[~drop]
                sp[up], ep[up], q[up] = self._parent(sp[up], ep[up])
            live = live[at[live] > begin[live]]
        if not found:
            z = np.zeros(0, np.int64)
            return z, z, z
        at, q, sp, ep = map(np.concatenate, zip(*found))
        return at, q, self._before(sp, ep, q, own[at], least)

    def _parent(self, s, e):
        k = np.where(self.lcp[s] >= self.lcp[e], s, e)
        value = np.maximum(self.lcp[k], 0)
        root = self.lcp[k] <= 0
        left = np.where(root, 0, self.prev[k])
        right = np.where(root, self.n, self.next[k])
        return left, right, np.where(root, 0, value)

    def _before(self, s, e, q, own, least):
        s, e, q = s.copy(), e.copy(), q.copy()
        live = np.arange(len(s))
        while len(live):
            live = live[self.smallest(s[live], e[live]) >= own[live]]
            if not len(live):
                break
            s[live], e[live], q[live] = self._parent(s[live], e[live])
            short = q[live] < least
            q[live[short]] = 0
            live = live[~short]
        return q
