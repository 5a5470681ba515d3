"""Marching cubes. The 256 cases follow from one rule, so neighbouring cells always agree and the surface is closed.

On each side of a cell every run of inside corners is cut off by one directed segment. A cut edge begins one segment
and ends another, so the segments of a cell are closed rings; a ring is split into triangles without a diagonal that
lies in a side of the cell.
"""

from __future__ import annotations

from functools import lru_cache

import numpy as np

#: Corner k of a cell is at bits (k >> 2, k >> 1, k) & 1 of (x, y, z); an edge joins corners that differ in one bit.
EDGES = [(a, a | bit) for bit in (4, 2, 1) for a in range(8) if not a & bit]


def _sides() -> list[list[int]]:
    """The corners of each side in turn, counter-clockwise from outside."""
    out = []
    for axis, bit in enumerate((4, 2, 1)):
        u, w = (2, 1) if axis == 0 else (1, 4) if axis == 1 else (4, 2)
        ring = [0, u, u | w, w]
        out += [ring[::-1], [bit | k for k in ring]]
    return out


def _split(ring: list[int], inside_side) -> list[tuple[int, int, int]]:
    """Triangles of a ring of cut edges; diagonals that lie in a side are avoided."""

    @lru_cache(maxsize=None)
    def best(i: int, j: int):
        if j - i < 2:
            return 0, ()
        out = None
        for k in range(i + 1, j):
            cost = sum(inside_side(ring[x], ring[y]) for x, y in ((i, k), (k, j)) if y - x > 1)
            left, right = best(i, k), best(k, j)
            one = (cost + left[0] + right[0], ((ring[i], ring[k], ring[j]), *left[1], *right[1]))
            out = one if out is None or one[0] < out[0] else out
        return out

    return list(best(0, len(ring) - 1)[1])


@lru_cache(maxsize=1)
def cases() -> list[np.ndarray]:
    """Triangles (three cut edges each) for every set of inside corners."""
    edge = {frozenset(e): k for k, e in enumerate(EDGES)}
    sides = _sides()
    on = [{edge[frozenset((s[k], s[(k + 1) % 4]))] for k in range(4)} for s in sides]
    together = lambda a, b: any(a in s and b in s for s in on)
    out = []
    for case in range(256):
        follow = {}
        for s in sides:
            inside = [case >> k & 1 for k in s]
            for k in range(4):
                if inside[k] and not inside[(k + 1) % 4]:
                    first = k
                    while inside[(first - 1) % 4]:
                        first -= 1
                    follow[edge[frozenset((s[k], s[(k + 1) % 4]))]] = edge[frozenset((s[first % 4], s[(first - 1) % 4]))]
        triangles = []
        while follow:
            ring = [next(iter(follow))]
            while (after := follow.pop(ring[-1])) != ring[0]:
                ring.append(after)
            triangles += _split(ring[::-1], together)
        out.append(np.array(triangles, np.int64).reshape(-1, 3))
    return out


def grid(low, high, res: int) -> np.ndarray:
    """Points of a regular grid with both ends, the last axis fastest."""
    axes = [np.linspace(low[k], high[k], res) for k in range(3)]
    return np.stack(np.meshgrid(*axes, indexing="ij"), -1).reshape(-1, 3)


def surface(field: np.ndarray, low, high, level: float = 0.0) -> tuple[np.ndarray, np.ndarray]:
    """Mesh of field = level, faces outward of field > level. A field on one side of the level gives no face."""
    field = np.asarray(field, np.float64)
    res = field.shape
    if field.max() <= level or field.min() >= level:
        return np.zeros((0, 3)), np.zeros((0, 3), np.int64)
    ids = np.arange(field.size).reshape(res)
    corner = np.stack([ids[k >> 2 : res[0] - 1 + (k >> 2), (k >> 1 & 1) : res[1] - 1 + (k >> 1 & 1), (k & 1) : res[2] - 1 + (k & 1)].ravel() for k in range(8)], 1)
    flat = field.ravel()
    case = ((flat[corner] > level) << np.arange(8)).sum(1)
    a_of, b_of = np.array(EDGES).T
    keys = []
    for value in np.unique(case):
        table = cases()[value]
        if len(table):
            cells = corner[case == value]
            keys.append((cells[:, a_of[table]] * np.int64(field.size) + cells[:, b_of[table]]).reshape(-1, 3))
    edge, faces = np.unique(np.concatenate(keys), return_inverse=True)
    a, b = edge // field.size, edge % field.size
    t = ((level - flat[a]) / (flat[b] - flat[a]))[:, None]
    place = lambda k: np.stack(np.unravel_index(k, res), 1)
    spacing = (np.asarray(high, np.float64) - np.asarray(low)) / (np.array(res) - 1)
    return np.asarray(low) + (place(a) * (1 - t) + place(b) * t) * spacing, faces.reshape(-1, 3)
