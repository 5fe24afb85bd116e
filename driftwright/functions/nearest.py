"""Exact nearest rows of one block of vectors in another.

A matrix product finds, for every vector, the few others that can be nearest; only their distances are then computed
as the definition says, so that results are those of the plain search.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

ROWS, COLUMNS, EXACT = 512, 2048, 20_000
# in the plain search, stand-ins that order infinite distances before undefined ones, and both before no distance
INFINITE, UNDEFINED = 1.7e308, 1.75e308


@dataclass
class Side:
    """Rows of a block in the order of their ids. ``plain`` rows have finite vectors and an id of their own; equal vectors
    among them are one of ``kinds``, which has its first and second row (-1: none)."""

    ids: np.ndarray
    vectors: np.ndarray
    order: np.ndarray
    plain: np.ndarray
    odd: np.ndarray
    kinds: np.ndarray
    kind: np.ndarray
    first: np.ndarray
    second: np.ndarray

    @classmethod
    def of(cls, ids, vectors) -> Side:
        order = np.argsort(ids, kind="stable")
        ids, vectors = ids[order], np.ascontiguousarray(vectors[order], dtype=np.float64) + 0.0  # -0.0 is 0.0
        again = ids[1:] == ids[:-1]
        alone = ~(np.append(again, False) | np.insert(again, 0, False)) if len(ids) else np.zeros(0, bool)
        usual = alone & (np.abs(vectors) < 1e150).all(axis=1)
        plain, odd = np.flatnonzero(usual), np.flatnonzero(~usual)
        width = vectors.shape[1]
        if width and len(plain):
            keys = np.ascontiguousarray(vectors[plain]).view(np.dtype((np.void, 8 * width))).ravel()
            _, at, kind = np.unique(keys, return_index=True, return_inverse=True)
            kind = kind.ravel()
        else:
            at, kind = np.zeros(min(1, len(plain)), dtype=np.int64), np.zeros(len(plain), dtype=np.int64)
        second = np.full(len(at), len(plain))
        later = np.setdiff1d(np.arange(len(plain)), at)
        np.minimum.at(second, kind[later], later)
        second = np.where(second < len(plain), np.append(plain, -1)[second], -1)
        return cls(ids, vectors, order, plain, odd, vectors[plain[at]], kind, plain[at], second)


class Best:
    """Least (distance, row) found for each of n vectors; ``seen`` is the greatest approximate score."""

    def __init__(self, n: int) -> None:
        self.dist, self.row, self.seen = np.full(n, np.inf), np.full(n, -1), np.full(n, -np.inf)

    def offer(self, at: np.ndarray, dist: np.ndarray, row: np.ndarray) -> None:
        order = np.lexsort((row, dist, at))
        at, dist, row = at[order], dist[order], row[order]
        lead = np.append(True, at[1:] != at[:-1]) if len(at) else np.zeros(0, bool)
        at, dist, row = at[lead], dist[lead], row[lead]
        better = (self.row[at] < 0) | (dist < self.dist[at]) | ((dist == self.dist[at]) & (row < self.row[at]))
        self.dist[at[better]], self.row[at[better]] = dist[better], row[better]


def distances(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Distances to six places between rows of equal position (or of shapes that broadcast)."""
    with np.errstate(invalid="ignore", over="ignore"):
        return np.round(np.sqrt(((x - y) ** 2).sum(axis=-1)), 6)


def _screened(x: Side, y: Side) -> tuple[Best, Best]:
    """Nearest other kind of every kind, both ways (one way within one block)."""
    a, b, same = x.kinds, y.kinds, x is y
    ours, theirs = Best(len(a)), Best(len(b))
    if not len(a) or not len(b):
        return ours, theirs
    aa, bb = (a * a).sum(axis=1) / 2, (b * b).sum(axis=1) / 2
    left = np.column_stack([a, np.ones(len(a)), -aa])
    right = np.ascontiguousarray(np.column_stack([b, -bb, np.ones(len(b))]).T)  # left @ right: minus half the squared distance
    unit = 8 * (a.shape[1] + 10) * np.finfo(np.float64).eps
    slack_a = unit * (np.sqrt(aa * bb.max()) * 2 + aa + bb.max())
    slack_b = unit * (np.sqrt(bb * aa.max()) * 2 + bb + aa.max())

    def threshold(best: Best, at: slice, top: np.ndarray, slack: np.ndarray) -> np.ndarray:
        """Scores below cannot be nearest, by the error of the product and the rounding to six places."""
        best.seen[at] = top = np.maximum(best.seen[at], top)
        return top - 2 * slack[at] - 1.1e-6 * np.sqrt(np.maximum(-2 * top, 0) + 2 * slack[at]) - 1e-12

    def confirm(i: np.ndarray, j: np.ndarray, best: Best, at: np.ndarray, row: np.ndarray) -> None:
        for k in range(0, len(i), EXACT):
            part = slice(k, k + EXACT)
            best.offer(at[part], distances(a[i[part]], b[j[part]]), row[part])

    for r in range(0, len(a), ROWS):
        for c in range(0, len(b), COLUMNS):
            rows, columns = slice(r, min(r + ROWS, len(a))), slice(c, min(c + COLUMNS, len(b)))
            score = left[rows] @ right[:, columns]
            if same:
                own = np.arange(max(r, c), min(rows.stop, columns.stop))
                score[own - r, own - c] = -np.inf
            top = score.max(axis=1)
            least = threshold(ours, rows, top, slack_a)
            look = np.flatnonzero((top >= least) & (top > -np.inf))
            i, j = np.nonzero(score[look] >= least[look, None])
            confirm(i := look[i] + r, j := j + c, ours, i, y.first[j])
            if not same:
                top = score.max(axis=0)
                least = threshold(theirs, columns, top, slack_b)
                look = np.flatnonzero(top >= least)
                i, j = np.nonzero(score[:, look] >= least[look])
                confirm(i := i + r, j := look[j] + c, theirs, j, x.first[i])
    return ours, theirs


def _plainly(x: Side, xs: np.ndarray, y: Side, ys: np.ndarray, out: Best) -> None:
    """Offer the rows ``xs`` of x their nearest of the rows ``ys`` of y, each pair by its definition."""
    if not len(ys):
        return
    step = max(1, 1_000_000 // max(1, len(ys) * x.vectors.shape[1]))
    for k in range(0, len(xs), step):
        at = xs[k : k + step]
        dist = distances(x.vectors[at][:, None], y.vectors[ys][None])
        dist = np.where(np.isnan(dist), UNDEFINED, np.minimum(dist, INFINITE))
        dist[x.ids[at][:, None] == y.ids[ys][None]] = np.inf
        near = dist.argmin(axis=1)
        found = dist[np.arange(len(at)), near]
        has = found < np.inf
        out.offer(at[has], found[has], ys[near[has]])


def _rows(side: Side, other: Side, kinds: Best) -> Best:
    """From kinds to rows; rows that are not plain, and what is near to them, are compared one by one."""
    out = Best(len(side.ids))
    found = kinds.row[side.kind] >= 0
    out.offer(side.plain[found], kinds.dist[side.kind][found], kinds.row[side.kind][found])
    if side is other:
        twin = np.where(side.first[side.kind] == side.plain, side.second[side.kind], side.first[side.kind])
        out.offer(side.plain[twin >= 0], np.zeros((twin >= 0).sum()), twin[twin >= 0])
    _plainly(side, side.plain, other, other.odd, out)
    _plainly(side, side.odd, other, np.arange(len(other.ids)), out)
    return out


def nearest(x: Side, y: Side) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """For x, and for y if it is another block: (positions, distances, positions in the other block), by distance, then id.

    Positions are those in the arrays given to ``Side.of``. Rows of one id are never near to each other. Distances that are
    undefined (NaN) come last, infinite ones before them.
    """
    found = []
    for (side, other), kinds in zip([(x, y), (y, x)][: 1 if x is y else 2], _screened(x, y), strict=False):
        best = _rows(side, other, kinds)
        at = np.flatnonzero(best.row >= 0)
        dist = best.dist[at]
        dist = np.where(dist >= UNDEFINED, np.nan, np.where(dist >= INFINITE, np.inf, dist))
        found.append((side.order[at], dist, other.order[best.row[at]]))
    return found
