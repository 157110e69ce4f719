"""A run-length compressed Burrows-Wheeler index of a collection of byte strings.

``RunIndex`` keeps, of the Burrows-Wheeler transform, the runs of equal symbols and for each run head the
text position of that row, of the row above it (the end of the run before), and their common prefix.  That is
enough to stream over the text from left to right and know, for every position, the lexicographically
preceding suffix and how far the two agree: at a run head both are sampled; at any other position they are
those of the position before, moved on by one symbol.  Every string ends in a terminator of its own.
"""

from __future__ import annotations

import numpy as np

I64 = np.int64


def suffix_order(sym: np.ndarray) -> tuple[np.ndarray, np.ndarray, int, int]:
    """Suffix array by prefix doubling; symbol 0 is a terminator, smaller the earlier it stands.

    Also returns the packed first ``h`` symbols of each suffix (cleared behind a terminator) and the bits of one.
    """
    n = len(sym)
    bits = max(1, int(sym.max()).bit_length())
    ib = max(1, int(n - 1).bit_length())
    h = max(1, (62 - ib) // bits)
    key, alive = np.zeros(n, dtype=I64), np.ones(n, dtype=bool)
    padded = np.concatenate([sym, np.zeros(h, dtype=sym.dtype)])
    for k in range(h):
        s = padded[k : k + n]
        key = (key << bits) | np.where(alive, s, 0)
        alive &= s != 0
    low = I64((1 << ib) - 1)
    sa = np.sort((key << ib) | np.arange(n, dtype=I64)) & low
    head = np.ones(n, dtype=bool)
    ks = key[sa]
    head[1:] = (ks[1:] != ks[:-1]) | ~alive[sa[1:]]  # what holds a terminator is told apart by position
    rank = np.empty(n, dtype=I64)
    while True:
        slot = np.maximum.accumulate(np.where(head, np.arange(n), 0))
        rank[sa] = slot
        tail = np.ones(n, dtype=bool)
        tail[:-1] = head[1:]
        open_ = np.flatnonzero(~(head & tail))
        if not len(open_):
            return sa, key, h, bits
        step = h if "step" not in locals() else step * 2
        p = sa[open_]
        second = rank[np.minimum(p + step, n - 1)]
        if 3 * ib <= 62:
            packed = np.sort((slot[open_] << (2 * ib)) | (second << ib) | p)
            p, second = packed & low, (packed >> ib) & low
            first = packed >> (2 * ib)
        else:
            order = np.lexsort((p, second, slot[open_]))
            p, second, first = p[order], second[order], slot[open_][order]
        sa[open_] = p
        head[open_[0]] = True
        head[open_[1:]] = (first[1:] != first[:-1]) | (second[1:] != second[:-1])


class RunIndex:
    """Index of ``texts`` laid end to end (``data``, offsets ``off``), in their given order."""

    def __init__(self, data: np.ndarray, off: np.ndarray):
        k = len(off) - 1
        n = len(data) + k
        used = np.zeros(257, dtype=I64)
        used[1:][np.unique(data)] = 1
        code = np.cumsum(used)  # terminators 0, bytes from 1 in order
        at = np.arange(len(data)) + np.repeat(np.arange(k), np.diff(off))
        sym = np.zeros(n, dtype=I64)
        sym[at] = code[data.astype(I64) + 1]
        sa, key, h, bits = suffix_order(sym)
        before = np.where(sa > 0, sym[sa - 1], 0)
        heads = np.ones(n, dtype=bool)
        heads[1:] = (before[1:] != before[:-1]) | (before[1:] == 0)
        rows = np.flatnonzero(heads)
        self.n, self.runs = n, len(rows)
        self.symbols, self.lengths = before[rows], np.diff(np.append(rows, n))
        ends = off[1:] + np.arange(k)  # where the terminators stand
        p = sa[rows]
        q = np.where(rows > 0, sa[rows - 1], -1)
        order = np.argsort(p)
        self.at, self.source = p[order], q[order]
        self.common = self._agree(self.at, self.source, key, h, bits, ends)

    @staticmethod
    def _agree(p, q, key, h, bits, ends) -> np.ndarray:
        """Length of the common prefix of the suffixes at p and q (0 where there is no q), up to a terminator."""
        out = np.zeros(len(p), dtype=I64)
        most = np.minimum(ends[np.searchsorted(ends, p)] - p, np.where(q < 0, 0, ends[np.searchsorted(ends, np.maximum(q, 0))] - q))
        live = np.flatnonzero(most > 0)
        while len(live):
            x = key[p[live] + out[live]] ^ key[q[live] + out[live]]
            same = x == 0
            # leading equal symbols of the h packed ones
            width = np.frexp(np.maximum(x, 1).astype(np.float64))[1]
            # float rounding may lift the width by one: correct it
            width = np.where((x >> np.maximum(width - 1, 0)) == 0, width - 1, width)
            out[live] += np.where(same, h, (h * bits - width) // bits)
            live = live[same]
            live = live[out[live] < most[live]]
        return np.minimum(out, most)

    def matching(self) -> tuple[np.ndarray, np.ndarray]:
        """Streams over the text: for each position the preceding suffix in order and their common length."""
        length = np.diff(np.append(self.at, self.n))
        step = np.arange(self.n) - np.repeat(self.at, length)
        return np.repeat(self.source, length) + step, np.maximum(np.repeat(self.common, length) - step, 0)

    def repeats(self, size: int) -> np.ndarray:
        """Positions whose next ``size`` symbols also start at an earlier position."""
        source, common = self.matching()
        linked = np.flatnonzero(common >= size)
        root = np.arange(self.n)
        root[linked] = source[linked]
        while True:  # pointers double until each position knows the first row of its interval
            far = root[root[linked]]
            if np.array_equal(far, root[linked]):
                break
            root[linked] = far
        least = np.arange(self.n)
        np.minimum.at(least, root[linked], linked)
        out = np.zeros(self.n, dtype=bool)
        top = np.unique(root[linked])
        out[top] = least[top] < top
        out[linked] = least[root[linked]] < linked
        return np.flatnonzero(out)
