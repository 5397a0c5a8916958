"""Ratcliff-Obershelp similarity of many pairs of texts at once, in arrays.

Twice the matched characters over both lengths; matched are the longest common block (the first in a, then in b) and, in the
same way, what lies left and what lies right of it. All open stretches of all pairs are searched together, a place of a at a
time. Characters that make up more than a hundredth of a b of 200 or more only lengthen a block that others have begun."""

from __future__ import annotations

import numpy as np

#: Cells (pairs by characters of b) that are worked on together; from POPULAR characters on, frequent ones begin no block.
CELLS, POPULAR = 1 << 19, 200


def _codes(texts: list[str], width: int, filler: int) -> np.ndarray:
    out = np.full((len(texts), width), filler, dtype=np.int32)
    for k, t in enumerate(texts):
        out[k, : len(t)] = np.frombuffer(t.encode("utf-32-le", "surrogatepass"), dtype="<u4")
    return out


def _frequent(b: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """Places of b whose character is frequent there."""
    out = np.zeros(b.shape, dtype=bool)
    for k in np.flatnonzero(sizes >= POPULAR):
        row = b[k, : sizes[k]]
        _, inverse, count = np.unique(row, return_inverse=True, return_counts=True)
        out[k, : sizes[k]] = count[inverse] > sizes[k] // 100 + 1
    return out


def _longest(a, b, frequent, pair, alo, ahi, blo, bhi):
    """For each stretch the start in a, the start in b and the size of its longest block."""
    n, width = len(pair), int((bhi - blo).max())
    column = np.minimum(blo[:, None] + np.arange(width), b.shape[1] - 1)
    theirs = np.where((np.arange(width) < (bhi - blo)[:, None]) & ~frequent[pair[:, None], column], b[pair[:, None], column], -2)
    run = np.zeros((n, width + 1), dtype=np.int32)
    size, at_a, at_b = np.zeros(n, dtype=np.int64), alo.copy(), blo.copy()
    for i in range(int((ahi - alo).max())):
        place = alo + i
        mine = np.where(place < ahi, a[pair, np.minimum(place, a.shape[1] - 1)], -1)
        run[:, 1:] = np.where(theirs == mine[:, None], run[:, :-1] + 1, 0)
        top = run.argmax(axis=1)
        most = run[np.arange(n), top]
        better = most > size
        size[better] = most[better]
        at_a[better] = place[better] - most[better] + 1
        at_b[better] = blo[better] + top[better] - most[better]
    if frequent.any():
        for step in (-1, 1):  # frequent characters at either end
            live = np.arange(n)
            while len(live):
                i, j = (at_a[live] - 1, at_b[live] - 1) if step < 0 else (at_a[live] + size[live], at_b[live] + size[live])
                inside = (i >= alo[live]) & (j >= blo[live]) if step < 0 else (i < ahi[live]) & (j < bhi[live])
                live, i, j = live[inside], i[inside], j[inside]
                live = live[a[pair[live], i] == b[pair[live], j]]
                size[live] += 1
                if step < 0:
                    at_a[live] -= 1
                    at_b[live] -= 1
    return at_a, at_b, size


def ratios(left: list[str], right: list[str]) -> np.ndarray:
    """The similarity of each pair, in this order; of two empty texts 1."""
    out = np.ones(len(left))
    todo = [k for k, (x, y) in enumerate(zip(left, right, strict=True)) if x != y]
    todo.sort(key=lambda k: (len(right[k]), len(left[k])))
    while todo:
        width = max(len(right[todo[0]]), 1)
        some = todo[: max(1, CELLS // width)]
        some = [k for k in some if len(right[k]) <= 2 * width]
        todo = todo[len(some) :]
        a_size, b_size = (np.array([len(side[k]) for k in some]) for side in (left, right))
        a, b = (_codes([side[k] for k in some], max(int(n.max()), 1), filler) for side, n, filler in ((left, a_size, -1), (right, b_size, -2)))
        frequent, matched = _frequent(b, b_size), np.zeros(len(some), dtype=np.int64)
        pair = np.flatnonzero((a_size > 0) & (b_size > 0))
        alo, ahi, blo, bhi = np.zeros(len(pair), dtype=np.int64), a_size[pair], np.zeros(len(pair), dtype=np.int64), b_size[pair]
        while len(pair):
            i, j, size = _longest(a, b, frequent, pair, alo, ahi, blo, bhi)
            np.add.at(matched, pair, size)
            before, after = (size > 0) & (i > alo) & (j > blo), (size > 0) & (i + size < ahi) & (j + size < bhi)
            alo, ahi, blo, bhi, pair = (np.concatenate(x) for x in ((alo[before], (i + size)[after]), (i[before], ahi[after]), (blo[before], (j + size)[after]), (j[before], bhi[after]), (pair[before], pair[after])))
        out[some] = 2 * matched / (a_size + b_size)
    return out
