"""A multiway tree over whole-number vectors: split points with distance ranges to sibling subtrees.

Every node has a few split points; a vector belongs to the nearest one (hyperplanes between the points).
For each pair of siblings the node knows the least and largest distance between the first one's split
point and the vectors below the second one. A search for scores (inner products) within a window is a
search within an annulus around the query, as norms below a subtree are known; a subtree is left out if
for some split point its range misses all distances that the annulus allows by the triangle inequality.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

SLACK = 1e-6  # of a distance, far above what rounding can do


def distances(x: np.ndarray, points: np.ndarray) -> np.ndarray:
    """Euclidean distances of every row of `x` to every row of `points`."""
    squares = (x * x).sum(1)[:, None] + (points * points).sum(1)[None, :] - 2 * (x @ points.T)
    return np.sqrt(np.maximum(squares, 0))


def split_points(sample: np.ndarray, fanout: int) -> np.ndarray:
    """Up to `fanout` different vectors of the sample, each the farthest from those before it."""
    chosen = [0]
    near = distances(sample, sample[:1])[:, 0]
    while len(chosen) < fanout and near.max() > 0:
        chosen.append(int(near.argmax()))
        near = np.minimum(near, distances(sample, sample[chosen[-1] :][:1])[:, 0])
    return sample[chosen]


class Tree:
    """Split points by node, and where they lead: another node (0 and up) or leaf k as -1 - k."""

    def __init__(self, sample: np.ndarray, fanout: int, levels: int):
        self.points: list[np.ndarray] = []
        self.below: list[list[int]] = []
        self.leaves = 0
        self.spans: list[tuple[int, int]] = []  # leaves below each node
        self.root = self._grow(sample, fanout, levels)
        self.ranges: list[tuple[np.ndarray, np.ndarray]] = []
        self.norms = np.zeros((0, 2))

    def _grow(self, sample: np.ndarray, fanout: int, levels: int) -> int:
        points = split_points(sample, fanout) if levels and len(sample) else sample[:0]
        if len(points) < 2:
            self.leaves += 1
            return -self.leaves
        node = len(self.points)
        self.points.append(points)
        self.below.append([])
        self.spans.append((self.leaves, self.leaves))
        nearest = distances(sample, points).argmin(1)
        below = [self._grow(sample[nearest == k], fanout, levels - 1) for k in range(len(points))]
        self.below[node] = below
        self.spans[node] = self.spans[node][0], self.leaves
        return node

    def leaf(self, x: np.ndarray) -> np.ndarray:
        """The leaf of every row of `x`."""
        out = np.zeros(len(x), np.int64)
        todo = [(self.root, np.arange(len(x)))]
        while todo:
            at, rows = todo.pop()
            if at < 0:
                out[rows] = -1 - at
            elif len(rows):
                nearest = distances(x[rows], self.points[at]).argmin(1)
                todo += [(child, rows[nearest == k]) for k, child in enumerate(self.below[at])]
        return out

    def paths(self) -> dict[int, list[tuple[int, int]]]:
        """(node, child) on the way to every leaf."""
        found: dict[int, list[tuple[int, int]]] = {}

        def walk(at: int, path: list[tuple[int, int]]) -> None:
            if at < 0:
                found[-1 - at] = path
            else:
                for k, child in enumerate(self.below[at]):
                    walk(child, [*path, (at, k)])

        walk(self.root, [])
        return found

    def measure(self, x: np.ndarray, leaf: np.ndarray) -> Iterator[tuple[int, int, int, float, float]]:
        """(node, point, child, least, largest distance) over some vectors, and (-1, leaf, 0, ...) for their norms."""
        paths = self.paths()
        norm = np.sqrt((x * x).sum(1))
        extremes: dict[tuple[int, int, int], tuple[float, float]] = {}
        for k in np.unique(leaf):
            rows = x[leaf == k]
            some = norm[leaf == k]
            extremes[-1, int(k), 0] = (some.min(), some.max())
            for node, child in paths[int(k)]:
                d = distances(rows, self.points[node])
                for point, (low, high) in enumerate(zip(d.min(0), d.max(0), strict=True)):
                    was = extremes.get((node, point, child), (np.inf, -np.inf))
                    extremes[node, point, child] = (min(was[0], low), max(was[1], high))
        for (node, point, child), (low, high) in extremes.items():
            yield node, point, child, float(low), float(high)

    def fit(self, measured: list[tuple[int, int, int, float, float]]) -> None:
        """Take over the ranges of all vectors; subtrees without one stay empty and are never searched."""
        self.ranges = [(np.full((len(p), len(p)), np.inf), np.full((len(p), len(p)), -np.inf)) for p in self.points]
        self.norms = np.tile([np.inf, -np.inf], (self.leaves, 1))
        for node, point, child, low, high in measured:
            if node < 0:
                self.norms[point] = low, high
            else:
                self.ranges[node][0][point, child] = low
                self.ranges[node][1][point, child] = high

    def _norms(self, at: int) -> tuple[float, float]:
        if at < 0:
            return tuple(self.norms[-1 - at])
        parts = [self._norms(child) for child in self.below[at]]
        return min(p[0] for p in parts), max(p[1] for p in parts)

    def alive(self, x: np.ndarray, owner: np.ndarray, low: np.ndarray, high: np.ndarray, asked: np.ndarray | None = None) -> np.ndarray:
        """Whether window k of scores (`low` to `high` with query `x[owner[k]]`) may have a vector in each leaf.

        With `asked`, flags of leaves, only subtrees that hold one of those are looked at.
        """
        out = np.zeros((len(owner), self.leaves), bool)
        square = (x * x).sum(1)[owner]
        todo = [(self.root, np.arange(len(owner)))]
        while todo:
            at, windows = todo.pop()
            a, b = self.spans[at] if at >= 0 else (-1 - at, -at)
            if not len(windows) or (asked is not None and not asked[a:b].any()):
                continue
            least, most = self._norms(at)
            # The annulus that the window is among vectors of these norms.
            inner = square[windows] + least * least - 2 * high[windows]
            outer = square[windows] + most * most - 2 * low[windows]
            ends = np.sqrt(square[windows]) * most * (1 + SLACK) + 1
            # No inner product is beyond the product of the norms.
            windows_ok = (outer >= 0) & (low[windows] <= ends) & (high[windows] >= -ends) if most >= least else np.zeros(len(windows), bool)
            windows, inner, outer = windows[windows_ok], inner[windows_ok], outer[windows_ok]
            if at < 0:
                out[windows, -1 - at] = True
                continue
            d = distances(x, self.points[at])[owner[windows]]
            for k, child in enumerate(self.below[at]):
                near, far = self._norms(child)
                if far < near:
                    continue
                a = np.sqrt(np.maximum(square[windows] + near * near - 2 * high[windows], 0))[:, None]
                b = np.sqrt(np.maximum(square[windows] + far * far - 2 * low[windows], 0))[:, None]
                slack = SLACK * (1 + d)
                nearest = np.maximum(np.maximum(d - b, a - d), 0) - slack
                farthest = d + b + slack
                fits = (nearest <= self.ranges[at][1][None, :, k]) & (farthest >= self.ranges[at][0][None, :, k])
                todo.append((child, windows[fits.all(1)]))
        return out
