"""Candidate pairs of sets by count vectors: an R-tree with bounds from coordinate minima.

A set's tokens are hashed into groups and counted; the counts are its point.  The overlap of two
sets is at most the sum over the groups of the smaller count, and for all points under a node at
most that sum with the node's greatest counts, so a node is skipped for a query whose bound is
below what the node's smallest set would need.

A set of n tokens has about n / 4 groups (a power of two from ``2 ** LEAST_BITS`` to ``2 **
MOST_BITS``), since the bound tells little once a group's count is large; sets in dense
neighbourhoods have ``FINER`` times as many.  Of two points the finer one is folded.  Counts are
bytes; what goes beyond 255 is kept as the set's excess and added to the bound.
"""

from __future__ import annotations

import numpy as np

LEAF = 32
LEAST_BITS, MOST_BITS = 5, 10
FINER = 8
#: Bytes of points whose minima are summed at once.
AT_ONCE = 1 << 21


def group_bits(n: np.ndarray, finer: int = 1) -> np.ndarray:
    """Bits of the number of groups for sets of these sizes."""
    return np.clip(np.ceil(np.log2(np.maximum(n, 1) * (finer / 4))), LEAST_BITS, MOST_BITS + finer.bit_length() - 1).astype(np.int64)


def group_counts(value: np.ndarray, offsets: np.ndarray, finer: int = 1) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The points of sets given as concatenated hashes and offsets: bytes, their offsets, excesses."""
    n = np.diff(offsets)
    groups = np.left_shift(1, group_bits(n, finer))
    begin = np.append(0, np.cumsum(groups))
    group = (value >> np.uint64(20)).astype(np.int64) & np.repeat(groups - 1, n)
    counts = np.bincount(np.repeat(begin[:-1], n) + group, minlength=begin[-1])
    over = np.append(0, np.cumsum(np.maximum(counts - 255, 0)))
    return np.minimum(counts, 255).astype(np.uint8), begin, over[begin[1:]] - over[begin[:-1]]


def need(sizes: np.ndarray, other: np.ndarray | int, num: int, den: int) -> np.ndarray:
    """Least overlap of two sets of these sizes with overlap / union >= num / den."""
    return -((-num * (sizes + other)) // (num + den))


def folded(points: np.ndarray) -> np.ndarray:
    """Points with half the groups."""
    half = points.shape[1] // 2
    return points[:, :half].astype(np.uint16) + points[:, half:]


class Points:
    """Sets by number: size, label, excess, and their points by number of groups."""

    def __init__(self, counts: list[bytes], excess: np.ndarray, sizes: np.ndarray, labels: np.ndarray, num: int, den: int):
        self.sizes, self.labels, self.excess, self.num, self.den = sizes.astype(np.int64), labels, excess.astype(np.int64), num, den
        self.bits = np.array([len(c).bit_length() - 1 for c in counts], np.int64)
        self.place = np.zeros(len(sizes), np.int64)
        self.levels: dict[tuple[int, int], np.ndarray] = {}
        for bits in np.unique(self.bits).tolist():
            mine = np.flatnonzero(self.bits == bits)
            self.place[mine] = np.arange(len(mine))
            self.levels[bits, bits] = np.frombuffer(b"".join([counts[i] for i in mine.tolist()]), np.uint8).reshape(len(mine), 1 << bits)

    def _level(self, own: int, bits: int) -> np.ndarray:
        if (own, bits) not in self.levels:
            self.levels[own, bits] = folded(self._level(own, bits + 1))
        return self.levels[own, bits]

    def at(self, sets: np.ndarray, bits: int) -> np.ndarray:
        """The points of sets with at least so many groups, folded to as many."""
        own = self.bits[sets]
        kinds = np.unique(own).tolist()
        if len(kinds) == 1:
            return self._level(kinds[0], bits)[self.place[sets]]
        out = np.empty((len(sets), 1 << bits), np.uint16)
        for kind in kinds:
            mine = own == kind
            out[mine] = self._level(kind, bits)[self.place[sets[mine]]]
        return out

    def possible(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Pairs of different labels whose sizes allow the threshold."""
        x, y = self.sizes[a], self.sizes[b]
        return (self.labels[a] != self.labels[b]) & (self.num * x <= self.den * y) & (self.num * y <= self.den * x)

    def reach(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Which of these possible pairs have a bound that reaches the need."""
        out = np.zeros(len(a), bool)
        low = np.minimum(self.bits[a], self.bits[b])
        for bits in np.unique(low).tolist():
            mine = np.flatnonzero(low == bits)
            step = max(1, AT_ONCE >> bits)
            for at in range(0, len(mine), step):
                m = mine[at : at + step]
                x, y = a[m], b[m]
                bound = np.minimum(self.at(x, bits), self.at(y, bits)).sum(axis=1, dtype=np.int64) + self.excess[x] + self.excess[y]
                out[m] = bound >= need(self.sizes[x], self.sizes[y], self.num, self.den)
        return out


class CountRTree:
    """The tree over some sets, all at one number of groups."""

    def __init__(self, points: Points, sets: np.ndarray, bits: int):
        vectors = points.at(sets, bits).astype(np.uint16)
        # sets of one frequent label stand together, so that whole nodes can be passed over
        _, where, often = np.unique(points.labels[sets], return_inverse=True, return_counts=True)
        order = np.lexsort((*vectors.T[:4], points.sizes[sets], np.where(often[where] >= LEAF, where, -1)))
        self.points, self.sets, self.vectors = points, sets[order], vectors[order]
        self.sizes, self.labels, self.excess = points.sizes[self.sets], points.labels[self.sets], points.excess[self.sets]
        self.levels: list[tuple[np.ndarray, ...]] = []
        high, least, most, label, extra = self.vectors, self.sizes, self.sizes, (self.labels, self.labels), self.excess
        while len(high) > 1:
            at = np.arange(0, len(high), LEAF)
            high, least, most = np.maximum.reduceat(high, at), np.minimum.reduceat(least, at), np.maximum.reduceat(most, at)
            label, extra = (np.minimum.reduceat(label[0], at), np.maximum.reduceat(label[1], at)), np.maximum.reduceat(extra, at)
            self.levels.append((high, least, most, *label, extra))

    def pairs(self) -> tuple[np.ndarray, np.ndarray]:
        """Pairs of sets of different labels whose bound reaches the need."""
        found: list[tuple[np.ndarray, np.ndarray]] = []
        if self.levels:
            self._search(len(self.levels) - 1, 0, np.arange(len(self.sets)), found)
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        a, b = (self.sets[np.concatenate(x)] for x in zip(*found, strict=True))
        return a, b

    def _search(self, level: int, node: int, queries: np.ndarray, found: list) -> None:
        high, least, most, first, last, extra = (x[node] for x in self.levels[level])
        num, den, size = self.points.num, self.points.den, self.sizes[queries]
        queries = queries[(num * size <= den * most) & (num * least <= den * size) & ((self.labels[queries] != first) | (first != last))]
        good = []
        step = max(1, AT_ONCE // (2 * len(high)))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            bound = np.minimum(self.vectors[q], high).sum(axis=1, dtype=np.int64) + self.excess[q] + extra
            good.append(q[bound >= need(self.sizes[q], least, num, den)])
        queries = np.concatenate(good) if good else queries
        if not len(queries):
            return
        begin = node * LEAF
        stop = min(begin + LEAF, len(self.levels[level - 1][0]) if level else len(self.sets))
        if level:
            for child in range(begin, stop):
                self._search(level - 1, child, queries, found)
            return
        members = np.arange(begin, stop)
        step = max(1, AT_ONCE // (64 * len(high)))
        for at in range(0, len(queries), step):
            q = queries[at : at + step]
            i, j = np.nonzero(q[:, None] < members)
            i, j = q[i], members[j]
            ok = self.points.possible(self.sets[i], self.sets[j])
            i, j = i[ok], j[ok]
            for cut in range(0, len(i), step * 8):
                x, y = i[cut : cut + step * 8], j[cut : cut + step * 8]
                bound = np.minimum(self.vectors[x], self.vectors[y]).sum(axis=1, dtype=np.int64) + self.excess[x] + self.excess[y]
                near = bound >= need(self.sizes[x], self.sizes[y], num, den)
                found.append((x[near], y[near]))


def close_blocks(sets: np.ndarray, heads: np.ndarray, size: np.ndarray, most: int, points: "Points | Sizes") -> np.ndarray:
    """Distinct possible pairs within blocks of at most ``most`` sets, coded a * total + b with a < b."""
    total = len(points.sizes)
    codes = [np.zeros(0, np.int64)]
    for m in np.unique(size[size <= most]).tolist():
        blocks = heads[size == m]
        left, right = np.triu_indices(m, 1)
        step = max(1, (1 << 20) // max(1, len(left)))
        for at in range(0, len(blocks), step):
            base = blocks[at : at + step, None]
            a, b = sets[base + left].ravel(), sets[base + right].ravel()
            ok = points.possible(a, b)
            codes.append(np.unique(np.minimum(a, b)[ok] * total + np.maximum(a, b)[ok]))
    return np.unique(np.concatenate(codes))


def block_pairs(points: Points, sets: np.ndarray, heads: np.ndarray) -> np.ndarray:
    """Distinct pairs (a < b) of sets that share a block and whose bound reaches the need.  Block k
    is ``sets[heads[k]:heads[k + 1]]``.  A block of one leaf is that leaf; others have trees, one for
    every number of groups."""
    total = len(points.sizes)
    size = np.diff(np.append(heads, len(sets)))
    code = close_blocks(sets, heads, size, LEAF, points)
    good = points.reach(code // total, code % total)
    codes = [code[good]]
    for k in np.flatnonzero(size > LEAF).tolist():
        block = np.unique(sets[heads[k] : heads[k] + size[k]])
        bits = points.bits[block]
        for b in np.unique(bits).tolist():
            # with the finer sets that may link with one of these
            own = points.sizes[block[bits == b]]
            near = (bits > b) & (points.num * points.sizes[block] <= points.den * own.max()) & (points.num * own.min() <= points.den * points.sizes[block])
            x, y = CountRTree(points, block[(bits == b) | near], b).pairs()
            own = (points.bits[x] == b) | (points.bits[y] == b)
            codes.append(np.unique(np.minimum(x, y)[own] * total + np.maximum(x, y)[own]))
    code = np.unique(np.concatenate(codes))
    return np.stack([code // total, code % total], axis=1)


class Sizes:
    """Sets of which only size and label are known."""

    def __init__(self, sizes: np.ndarray, labels: np.ndarray, num: int, den: int):
        self.sizes, self.labels, self.num, self.den = sizes.astype(np.int64), labels, num, den

    possible = Points.possible
