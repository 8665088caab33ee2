"""Orchard's nearest-neighbour search over small codebooks, in integers and in lockstep.

Every entry of a codebook has the list of all entries sorted by distance from it.  A
search walks the list of its best entry so far, jumps to the list of an entry that is
nearer, marks what it has looked at, and stops at an entry farther from the best one than
twice the best distance: by the triangle inequality no later one can be nearer, or as
near.  One state vector holds the searches of all parts of a block of vectors.
"""

from __future__ import annotations

import numpy as np


class Codebooks:
    """Entries of every part position, of shape (parts, entries, width), with their sorted lists."""

    def __init__(self, entries: np.ndarray):
        self.entries = entries.astype(np.int64)
        parts, k, width = self.entries.shape
        apart = ((self.entries[:, :, None] - self.entries[:, None]) ** 2).sum(axis=3)
        # equal distances stay in order of the index
        lists = np.argsort(apart, axis=2, kind="stable")
        self.parts, self.k, self.width = parts, k, width
        self.flat = self.entries.reshape(parts * k, width)
        self.near = lists.reshape(parts * k, k)
        self.far = np.take_along_axis(apart, lists, axis=2).reshape(parts * k, k)

    def nearest(self, vectors: np.ndarray, start: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Index of the nearest entry, the smallest of several, and its squared distance, for each part.

        ``vectors`` has the shape (rows, parts * width); ``start`` may hold entries to begin with.
        """
        n = len(vectors)
        x = vectors.astype(np.int64).reshape(n * self.parts, self.width)
        base = np.tile(np.arange(self.parts) * self.k, n)
        best = np.zeros(len(x), np.int64) if start is None else start.astype(np.int64).ravel()
        least = ((x - self.flat[base + best]) ** 2).sum(axis=1)
        seen = np.zeros((len(x), self.k), bool)
        every = np.arange(len(x))
        seen[every, best] = True
        row, at = every, np.zeros(len(x), np.int64)
        while len(row):
            own = base[row] + best[row]
            # squares: farther than twice the distance is more than four times its square
            going = self.far[own, at] <= 4 * least[row]
            if not going.all():
                row, at, own = row[going], at[going], own[going]
            entry = self.near[own, at]
            at = at + 1
            new = np.flatnonzero(~seen[row, entry])
            to, other = row[new], entry[new]
            seen[to, other] = True
            away = ((x[to] - self.flat[base[to] + other]) ** 2).sum(axis=1)
            better = (away < least[to]) | ((away == least[to]) & (other < best[to]))
            to = to[better]
            best[to], least[to] = other[better], away[better]
            at[new[better]] = 0
            left = at < self.k
            if not left.all():
                row, at = row[left], at[left]
        return best.reshape(n, self.parts), least.reshape(n, self.parts)
