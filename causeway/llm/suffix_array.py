"""Suffix arrays by induced sorting, and permuted common prefixes."""

from __future__ import annotations

import numpy as np


def suffix_array(s: list[int], top: int) -> list[int]:
    """Order of the suffixes of ``s``, whose numbers lie in 0..top.

    A suffix is S if it is smaller than the next one, else L.  Leftmost S
    positions (S after L) are sorted by their substrings, recursively where
    names repeat; two passes over the buckets then induce all others."""
    n = len(s)
    if n < 2:
        return list(range(n))
    small = bytearray(n)
    for i in range(n - 2, -1, -1):
        a, b = s[i], s[i + 1]
        small[i] = small[i + 1] if a == b else a < b
    sizes = [0] * (top + 2)
    for c in s:
        sizes[c + 1] += 1
    for c in range(top + 1):
        sizes[c + 1] += sizes[c]
    starts = sizes  # starts[c]: first slot of bucket c; starts[c + 1]: one past its last
    leftmost = [i for i in range(1, n) if small[i] and not small[i - 1]]

    def induce(seeds: list[int]) -> list[int]:
        sa = [-1] * n
        tails = starts[1:]
        for i in reversed(seeds):
            c = s[i]
            tails[c] -= 1
            sa[tails[c]] = i
        heads = starts[:]
        # The last suffix is L and follows the empty one.
        c = s[n - 1]
        sa[heads[c]] = n - 1
        heads[c] += 1
        for slot in range(n):
            i = sa[slot]
            if i > 0 and not small[i - 1]:
                c = s[i - 1]
                sa[heads[c]] = i - 1
                heads[c] += 1
        tails = starts[1:]
        for slot in range(n - 1, -1, -1):
            i = sa[slot]
            if i > 0 and small[i - 1]:
                c = s[i - 1]
                tails[c] -= 1
                sa[tails[c]] = i - 1
        return sa

    sa = induce(leftmost)
    if len(leftmost) < 2:
        return sa
    rank_of = [-1] * (n + 1)
    for k, i in enumerate(leftmost):
        rank_of[i] = k
    ends = leftmost[1:] + [n]
    names, name, before = [0] * len(leftmost), -1, None
    for i in sa:
        k = rank_of[i]
        if k >= 0:
            piece = s[i : ends[k] + 1]
            # A piece that the end cuts off is like no other.
            if piece != before or ends[k] == n:
                name, before = name + 1, piece
            if ends[k] == n:
                before = None
            names[k] = name
    if name + 1 < len(leftmost):
        order = suffix_array(names, name)
    else:
        order = [0] * len(names)
        for k, x in enumerate(names):
            order[x] = k
    return induce([leftmost[k] for k in order])


def permuted_lcp(data: str, sa: list[int], limit: int) -> tuple[list[int], list[int]]:
    """By text position: the suffix before it in ``sa`` (-1: none) and the length
    of their common prefix, counted up to ``limit``."""
    n = len(sa)
    before = [-1] * n
    for a, b in zip(sa, sa[1:]):
        before[b] = a
    plcp, h = [0] * n, 0
    for i, j in enumerate(before):
        if j < 0:
            h = 0
            continue
        # From one position to the next, a common prefix loses one at most.
        most = min(limit, n - i, n - j)
        if data[i + h : i + most] == data[j + h : j + most]:
            h = most
        else:
            while data[i + h] == data[j + h]:
                h += 1
        plcp[i] = h
        h = h - 1 if h else 0
    return before, plcp


def repeated_windows(pieces: list[list[int]], window: int) -> list[np.ndarray]:
    """For each piece, a list of numbers from 0, whether the ``window`` numbers from
    each place also start at another place in these pieces."""
    top = max((max(p) for p in pieces if p), default=0) + 1
    s: list[int] = []
    for p in pieces:
        s += p
        s.append(top)  # in no piece: a window with it equals none that lies in a piece
    before, plcp = permuted_lcp("".join(map(chr, s)), suffix_array(s, top), window)
    hit = np.zeros(len(s) + 1, bool)
    for i, (j, h) in enumerate(zip(before, plcp)):
        if h >= window:
            hit[i] = hit[j] = True
    out, at = [], 0
    for p in pieces:
        out.append(hit[at : at + max(0, len(p) - window + 1)].copy())
        at += len(p) + 1
    return out
