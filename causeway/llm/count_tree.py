"""An R-tree over count vectors for set overlap joins.

A set's elements are hashed into groups; the counts by group are a point.  Two
sets share at most the sum over groups of the smaller count.  A node keeps the
greatest count of each group and the range of set sizes below it, so the sum
of the smaller of two nodes' counts bounds the overlap of every pair below
them.  Trees are loaded in bulk and joined with each other or with themselves.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass, field

import numpy as np

LEAST_GROUPS, MOST_GROUPS = 256, 65_536
FANOUT = 16


def groups_for(n: int) -> int:
    """Groups for a set of ``n``: a power of two from 4 n, so that elements that two
    sets don't share seldom meet in a group."""
    return min(MOST_GROUPS, max(LEAST_GROUPS, 1 << (4 * n - 1).bit_length()))


#: Counts above this are written as numbers, others as planes.
MOST_PLANES = 7


def count_vector(hashes: np.ndarray) -> bytes:
    """Counts by group, packed."""
    groups = groups_for(len(hashes))
    return pack(np.bincount((hashes >> np.uint64(20)).astype(np.int64) & (groups - 1), minlength=groups))


def pack(counts: np.ndarray) -> bytes:
    """The first byte tells the form, the next one the logarithm of the number of
    groups; the rest is compressed.  Form 0 has planes of bits, that of k tells which
    counts pass k; forms 1, 2 and 4 have so many bytes for each count."""
    top = int(counts.max())
    form = 0 if top <= MOST_PLANES else 1 if top < 256 else 2 if top < 65536 else 4
    raw = counts.astype(f"<u{form}") if form else np.packbits([counts > k for k in range(max(1, top))], axis=1)
    return bytes([form, len(counts).bit_length() - 1]) + zlib.compress(raw.tobytes(), 1)


def groups_of(packed: bytes) -> int:
    return 1 << packed[1]


def unpack(packed: bytes) -> np.ndarray:
    raw = zlib.decompress(memoryview(packed)[2:])
    if packed[0]:
        return np.frombuffer(raw, f"<u{packed[0]}")
    return np.unpackbits(np.frombuffer(raw, np.uint8).reshape(-1, groups_of(packed) // 8), axis=1).sum(axis=0, dtype=np.uint8)


def fold(counts: np.ndarray, groups: int) -> np.ndarray:
    """Counts (in the last axis) by fewer groups; both numbers are powers of two."""
    return counts.reshape(*counts.shape[:-1], -1, groups).sum(axis=-2, dtype=np.int32) if counts.shape[-1] > groups else counts


def shared_at_most(a: np.ndarray, b: np.ndarray) -> int:
    """The sum of the smaller counts."""
    least = min(len(a), len(b))
    return int(np.minimum(fold(a, least), fold(b, least)).sum(dtype=np.int64))


def vectors(packed: list[bytes]) -> np.ndarray:
    """The points, all by as many groups as the one with the fewest has."""
    found = [unpack(b) for b in packed]
    least = min(map(len, found), default=LEAST_GROUPS)
    return np.array([fold(v, least) for v in found], None if found else np.uint8).reshape(-1, least)


def least_overlap(a, b, percent: int):
    """Shared elements from which 100 * shared >= percent * union, for sizes a, b."""
    total = np.asarray(a, np.int64) + b
    return -(-percent * total // (100 + percent))


@dataclass
class Node:
    top: np.ndarray  # greatest count by group
    least: int
    most: int
    low: int  # least and greatest label
    high: int
    rows: np.ndarray | None = None
    below: list["Node"] = field(default_factory=list)


class CountTree:
    def __init__(self, points: np.ndarray, sizes: np.ndarray, labels: np.ndarray | None = None) -> None:
        """Leaves hold rows that follow each other in order of label, of size and then of
        their heaviest group, upper nodes hold ``FANOUT`` nodes.  With ``labels``
        only pairs of rows with different ones are looked for."""
        self.points, self.sizes, self.labelled = points, sizes, labels is not None
        self.labels = labels if self.labelled else np.zeros(len(sizes), int)
        order = np.lexsort((points.argmax(axis=1), sizes, self.labels)) if len(sizes) else np.zeros(0, int)
        level = []
        for i in range(0, len(order), FANOUT):
            rows = order[i : i + FANOUT]
            n, own = sizes[rows], self.labels[rows]
            level.append(Node(points[rows].max(axis=0), int(n.min()), int(n.max()), int(own.min()), int(own.max()), rows))
        while len(level) > 1:
            level = [self._parent(level[i : i + FANOUT]) for i in range(0, len(level), FANOUT)]
        self.root = level[0] if level else None

    @staticmethod
    def _parent(nodes: list[Node]) -> Node:
        low, high = min(n.low for n in nodes), max(n.high for n in nodes)
        return Node(np.max([n.top for n in nodes], axis=0), min(n.least for n in nodes), max(n.most for n in nodes), low, high, None, nodes)

    def folded(self, groups: int) -> "CountTree":
        return self if self.points.shape[1] == groups else CountTree(fold(self.points, groups), self.sizes, self.labels if self.labelled else None)

    def pairs(self, other: "CountTree", percent: int) -> tuple[np.ndarray, np.ndarray]:
        """Rows of both trees whose bound reaches the least overlap.  Joined with
        itself, each pair comes once."""
        groups = min(self.points.shape[1], other.points.shape[1])
        if self.points.shape[1] != other.points.shape[1]:
            return self.folded(groups).pairs(other.folded(groups), percent)
        left, right = [], []
        stack = [(self.root, other.root)] if self.root and other.root else []
        while stack:
            a, b = stack.pop()
            # Sizes so far apart that even a subset is too small a share.
            if 100 * a.most < percent * b.least or 100 * b.most < percent * a.least:
                continue
            if self.labelled and a.low == a.high == b.low == b.high:
                continue
            if np.minimum(a.top, b.top).sum(dtype=np.int64) < least_overlap(a.least, b.least, percent):
                continue
            if a.rows is not None and b.rows is not None:
                x, y = self.points[a.rows], other.points[b.rows]
                bound = np.minimum(x[:, None, :], y[None, :, :]).sum(axis=2, dtype=np.int64)
                n, m = self.sizes[a.rows][:, None], other.sizes[b.rows][None, :]
                ok = (bound >= least_overlap(n, m, percent)) & (100 * np.minimum(n, m) >= percent * np.maximum(n, m))
                if self.labelled:
                    ok &= self.labels[a.rows][:, None] != other.labels[b.rows][None, :]
                if a is b:
                    ok &= np.triu(np.ones_like(ok), 1)
                i, j = np.nonzero(ok)
                left.append(a.rows[i])
                right.append(b.rows[j])
            elif a is b:
                stack += [(x, y) for k, x in enumerate(a.below) for y in a.below[k:]]
            elif b.rows is not None or (a.rows is None and len(a.below) >= len(b.below)):
                stack += [(x, b) for x in a.below]
            else:
                stack += [(a, y) for y in b.below]
        empty = np.zeros(0, int)
        return np.concatenate([empty, *left]), np.concatenate([empty, *right])


def pairs_across(packed: list[bytes], sizes: np.ndarray, split: int | None, percent: int, labels: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose bound reaches the least overlap: among all of them, or
    with ``split`` between those before it and the others; with ``labels`` only of
    different ones.  There is a tree for
    each number of groups, joined with that of the same number and of the next one; sets
    further apart differ too much in size."""
    trees: list[dict[int, tuple[np.ndarray, CountTree]]] = []
    for rows in [range(len(packed))] if split is None else [range(split), range(split, len(packed))]:
        by_groups: dict[int, list[int]] = {}
        for i in rows:
            by_groups.setdefault(groups_of(packed[i]), []).append(i)
        trees.append({g: (np.array(r), CountTree(vectors([packed[i] for i in r]), sizes[r], None if labels is None else labels[r])) for g, r in by_groups.items()})
    left, right = [np.zeros(0, int)], [np.zeros(0, int)]
    for g, (rows, tree) in trees[0].items():
        for other in (g, 2 * g) if split is None else (g // 2, g, 2 * g):
            if other in trees[-1]:
                more, second = trees[-1][other]
                i, j = tree.pairs(second, percent)
                left.append(rows[i])
                right.append(more[j])
    return np.concatenate(left), np.concatenate(right)


def pairs_among(packed: list[bytes], sizes: np.ndarray, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of sets whose bound reaches the least overlap."""
    return pairs_across(packed, sizes, None, percent)
