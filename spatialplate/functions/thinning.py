"""Thinning of outlines in numpy, for all rings of an Arrow batch together.

Douglas and Peucker's rule (1973) says which points may go. A section whose
points have gone is a chord; where a chord would meet another side of its shape
the section is split again at its farthest point, until no chord does: a shape
whose sides don't meet stays one whose sides don't meet.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np

#: Shapes of up to so many sides are compared whole, larger ones on a grid of their own; pairs are compared in blocks of so many.
WHOLE, PAIRS = 32, 2_000_000


@dataclass
class Rings:
    """Points of many rings, one after another; `starts` has a place more than there are rings, `shapes` is each ring's shape."""

    x: np.ndarray
    y: np.ndarray
    starts: np.ndarray
    shapes: np.ndarray

    def __post_init__(self) -> None:
        sizes = np.diff(self.starts)
        self.ring = np.repeat(np.arange(len(sizes)), sizes)
        self.sizes, self.first, self.last = sizes, self.starts[:-1], self.starts[1:] - 1
        there = sizes > 0
        self.closed = np.zeros(len(sizes), bool)
        f, z = self.first[there], self.last[there]
        self.closed[there] = (sizes[there] > 1) & (self.x[f] == self.x[z]) & (self.y[f] == self.y[z])
        # One number for points that repeat their neighbour, and for the two ends of a closed ring.
        new = np.ones(len(self.x), bool)
        new[1:] = (self.ring[1:] != self.ring[:-1]) | (self.x[1:] != self.x[:-1]) | (self.y[1:] != self.y[:-1])
        self.spot = np.maximum.accumulate(np.where(new, np.arange(len(self.x)), 0)) if len(self.x) else np.zeros(0, np.int64)
        ends = self.closed[self.ring] & (self.spot == self.spot[self.last[self.ring]]) if len(self.x) else np.zeros(0, bool)
        self.spot = np.where(ends, self.first[self.ring], self.spot) if len(self.x) else self.spot


def _farthest(r: Rings, a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distance and place of the point between a and b farthest from the segment between them, for sections with points between."""
    sizes = b - a - 1
    begins = np.cumsum(sizes) - sizes
    of = np.repeat(np.arange(len(a)), sizes)
    i = np.arange(len(of)) - begins[of] + a[of] + 1
    px, py = r.x[i] - r.x[a[of]], r.y[i] - r.y[a[of]]
    dx, dy = (r.x[b] - r.x[a])[of], (r.y[b] - r.y[a])[of]
    length = dx * dx + dy * dy
    t = np.clip(np.divide(px * dx + py * dy, length, out=np.zeros(len(of)), where=length != 0), 0, 1)
    far = np.hypot(px - t * dx, py - t * dy)
    most = np.maximum.reduceat(far, begins)
    at = np.minimum.reduceat(np.where(far == most[of], i, np.iinfo(np.int64).max), begins)
    return most, np.minimum(at, b - 1)


def _split(r: Rings, keep: np.ndarray, a: np.ndarray, b: np.ndarray, tolerance: float) -> None:
    """Keep the farthest point of each section that is beyond the tolerance, and go on with both its parts, for all sections at once."""
    while len(a):
        inner = b - a > 1
        a, b = a[inner], b[inner]
        if not len(a):
            return
        most, at = _farthest(r, a, b)
        beyond = most > tolerance
        a, b, at = a[beyond], b[beyond], at[beyond]
        keep[at] = True
        a, b = np.concatenate([a, at]), np.concatenate([at, b])


def _force(r: Rings, keep: np.ndarray, a: np.ndarray, b: np.ndarray, at: np.ndarray, tolerance: float) -> None:
    keep[at] = True
    _split(r, keep, np.concatenate([a, at]), np.concatenate([at, b]), tolerance)


def _sections(r: Rings, keep: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Neighbours among the points kept, of the rings marked in `of`."""
    k = np.flatnonzero(keep & of[r.ring])
    a, b = k[:-1], k[1:]
    same = r.ring[a] == r.ring[b]
    return a[same], b[same]


def _fill(r: Rings, keep: np.ndarray, tolerance: float) -> None:
    """Closed rings keep four points if they have them, the farthest first."""
    while True:
        lacking = r.closed & (np.bincount(r.ring[keep], minlength=len(r.sizes)) < np.minimum(4, r.sizes))
        a, b = _sections(r, keep, lacking)
        a, b = a[b - a > 1], b[b - a > 1]
        if not len(a):
            return
        most, at = _farthest(r, a, b)
        order = np.lexsort((-at, most, r.ring[a]))
        best = order[np.append(np.diff(r.ring[a][order]) != 0, True)]
        _force(r, keep, a[best], b[best], at[best], tolerance)


def _near(r: Rings, a: np.ndarray, b: np.ndarray, chord: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs of a chord and another side of its shape that share a cell, in blocks."""
    shape = r.shapes[r.ring[a]]
    low = np.stack([np.minimum(r.x[a], r.x[b]), np.minimum(r.y[a], r.y[b])])
    high = np.stack([np.maximum(r.x[a], r.x[b]), np.maximum(r.y[a], r.y[b])])
    begins = np.flatnonzero(np.append(True, shape[1:] != shape[:-1]))
    group = np.cumsum(np.append(False, shape[1:] != shape[:-1]))
    count = np.diff(np.append(begins, len(a)))
    cells = np.where(count > WHOLE, np.ceil(np.sqrt(count)), 1.0)
    least, span = np.minimum.reduceat(low, begins, axis=1), np.maximum.reduceat(high, begins, axis=1) - np.minimum.reduceat(low, begins, axis=1)
    size = np.where(span > 0, span / cells, 1.0)
    place = lambda v: np.minimum(((v - least[:, group]) / size[:, group]).astype(np.int64), cells[group].astype(np.int64) - 1)
    c0, c1 = place(low), place(high)
    across, down = c1[0] - c0[0] + 1, c1[1] - c0[1] + 1
    n = across * down
    seg = np.repeat(np.arange(len(a)), n)
    step = np.arange(len(seg)) - np.repeat(np.cumsum(n) - n, n)
    width = cells[group].astype(np.int64)[seg]
    cell = (c0[1][seg] + step // across[seg]) * width + c0[0][seg] + step % across[seg]
    base = np.concatenate([[0], np.cumsum((cells * cells).astype(np.int64))])[group[seg]]
    order = np.argsort(base + cell, kind="stable")
    key, seg = (base + cell)[order], seg[order]
    first = np.flatnonzero(np.append(True, key[1:] != key[:-1]))
    held = np.diff(np.append(first, len(key)))
    of = np.repeat(np.arange(len(first)), held)
    mine = np.flatnonzero(chord[seg])
    many = held[of[mine]]
    blocks = (np.cumsum(many) - 1) // PAIRS if len(many) else many
    for block in np.unique(blocks):
        some = mine[blocks == block]
        n = held[of[some]]
        left = np.repeat(some, n)
        right = np.repeat(first[of[some]], n) + np.arange(len(left)) - np.repeat(np.cumsum(n) - n, n)
        i, j = seg[left], seg[right]
        close = (i != j) & (low[:, i] <= high[:, j]).all(axis=0) & (low[:, j] <= high[:, i]).all(axis=0)
        yield i[close], j[close]


def _meet(r: Rings, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether sides a-b and c-d have a point in common, besides the one at which they follow each other."""
    spot = r.spot
    return _common(r, a, b, c, d, spot[b] == spot[c], spot[d] == spot[a])


def _touch(r: Rings, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """_meet(), for which sides of a ring follow each other wherever one ends at the point where the other begins."""
    same = lambda p, q: (r.x[p] == r.x[q]) & (r.y[p] == r.y[q]) & (r.ring[p] == r.ring[q])
    return _common(r, a, b, c, d, same(b, c), same(d, a))


def _common(r: Rings, a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray, after: np.ndarray, before: np.ndarray) -> np.ndarray:
    x, y = r.x, r.y
    turn = lambda p, q, s: (x[q] - x[p]) * (y[s] - y[p]) - (y[q] - y[p]) * (x[s] - x[p])
    on = lambda p, q, s, t: (t == 0) & (x[s] >= np.minimum(x[p], x[q])) & (x[s] <= np.maximum(x[p], x[q])) & (y[s] >= np.minimum(y[p], y[q])) & (y[s] <= np.maximum(y[p], y[q]))
    ta, tb, tc, td = turn(c, d, a), turn(c, d, b), turn(a, b, c), turn(a, b, d)
    crossed = (np.sign(ta) * np.sign(tb) < 0) & (np.sign(tc) * np.sign(td) < 0)
    # Sides that follow each other meet again where the far end of one lies on the other.
    follow = (after & (on(a, b, d, td) | on(c, d, a, ta))) & ~before | (before & (on(a, b, c, tc) | on(c, d, b, tb))) & ~after | (after & before)
    apart = crossed | on(c, d, a, ta) | on(c, d, b, tb) | on(a, b, c, tc) | on(a, b, d, td)
    return np.where(after | before, follow, apart)


def meetings(r: Rings, shapes: int) -> np.ndarray:
    """For each of so many shapes, the pairs of its sides that have a point in common, besides the one at which they follow each other in their ring."""
    a = np.flatnonzero(r.ring[1:] == r.ring[:-1])
    with np.errstate(invalid="ignore"):
        clean = np.isfinite(r.x) & np.isfinite(r.y)
        a = a[clean[a] & clean[a + 1] & ((r.x[a] != r.x[a + 1]) | (r.y[a] != r.y[a + 1]))]
    found = [np.zeros(0, np.int64)]
    for i, j in _near(r, a, a + 1, np.ones(len(a), bool)) if len(a) else ():
        i, j = i[i < j], j[i < j]
        found.append(np.unique((i * len(a) + j)[_touch(r, a[i], a[i] + 1, a[j], a[j] + 1)]))  # a pair of a large shape may share several cells
    return np.bincount(r.shapes[r.ring[a[np.unique(np.concatenate(found)) // len(a)]]] if len(a) else [], minlength=shapes)


def _untangle(r: Rings, keep: np.ndarray, tolerance: float) -> None:
    """Split chords that meet other sides of their shape until none is left that can be split."""
    todo = np.ones(len(r.sizes), bool)
    while True:
        a, b = _sections(r, keep, todo)
        real = (r.x[a] != r.x[b]) | (r.y[a] != r.y[b])
        a, b = a[real], b[real]
        chord = b - a > 1
        thinned = np.zeros(int(r.shapes.max(initial=-1)) + 1, bool)
        thinned[r.shapes[r.ring[a[chord]]]] = True
        some = thinned[r.shapes[r.ring[a]]]
        a, b, chord = a[some], b[some], chord[some]
        if not len(a):
            return
        bad = np.zeros(len(a), bool)
        for i, j in _near(r, a, b, chord):
            met = _meet(r, a[i], b[i], a[j], b[j])
            bad[i[met]] = bad[j[met]] = True
        bad &= chord
        if not bad.any():
            return
        a, b = a[bad], b[bad]
        _, at = _farthest(r, a, b)
        _force(r, keep, a, b, at, tolerance)
        again = np.zeros(len(thinned), bool)
        again[r.shapes[r.ring[a]]] = True
        todo = again[r.shapes]


def kept(r: Rings, tolerance: float) -> np.ndarray:
    """Which points stay. Points without coordinates make no distance, and go unless they are ends."""
    keep = np.zeros(len(r.x), bool)
    there = r.sizes > 0
    a, b = r.first[there], r.last[there]
    keep[a] = keep[b] = True
    with np.errstate(invalid="ignore"):
        _split(r, keep, a, b, tolerance)
        _fill(r, keep, tolerance)
        clean = np.isfinite(r.x) & np.isfinite(r.y)
        whole = np.ones(int(r.shapes.max(initial=-1)) + 1, bool)
        whole[r.shapes[r.ring[~clean]]] = False
        if whole.all():
            _untangle(r, keep, tolerance)
        elif whole.any():
            mine = whole[r.shapes]
            points = mine[r.ring]
            part = Rings(r.x[points], r.y[points], np.concatenate([[0], np.cumsum(r.sizes[mine])]), r.shapes[mine])
            inner = keep[points]
            _untangle(part, inner, tolerance)
            keep[points] = inner
    return keep
