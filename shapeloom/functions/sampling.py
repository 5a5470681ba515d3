"""Points of surfaces and clouds."""

from __future__ import annotations

import numpy as np

from .mesh import areas, normals


def on_surface(v: np.ndarray, f: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    """n points, uniform over the area, and their faces."""
    return _drawn(v, f, areas(v, f), n, rng)


def _drawn(v: np.ndarray, f: np.ndarray, area: np.ndarray, n: int, rng: np.random.Generator) -> tuple[np.ndarray, np.ndarray]:
    total = area.sum()
    if not total > 0:
        raise ValueError("a surface without area")
    face = np.minimum(np.searchsorted(np.cumsum(area), rng.random(n) * total, "right"), len(f) - 1)
    r, s = np.sqrt(rng.random((n, 1))), rng.random((n, 1))
    a, b, c = v[f[face].T]
    return (1 - r) * a + r * (1 - s) * b + r * s * c, face


#: Points that are compared in blocks; more are sought in cells.
FEW_POINTS = 512


def thinned(points: np.ndarray, radius: float, most: int | None = None) -> np.ndarray:
    """Indices of the points kept when each is dropped that lies within radius of one kept before it; the first `most` of them where that is given."""
    if not radius > 0:
        return np.arange(len(points))[:most]
    keep = []
    if len(points) <= FEW_POINTS:
        gaps = lambda a, b: sum(np.square(p[:, None] - q) for p, q in zip(points[a].T, points[b].T))
        left, n = np.arange(len(points)), 0
        while len(left) and (most is None or n < most):
            # 64 points: of each, those it drops as the bits of a number
            block, left = left[:64], left[64:]
            close = np.zeros((len(block), 64), bool)
            close[:, : len(block)] = gaps(block, block) <= radius**2
            drops, open_, kept = np.packbits(close, axis=1, bitorder="little").view("<u8")[:, 0].tolist(), (1 << len(block)) - 1, []
            while open_:
                k = (open_ & -open_).bit_length() - 1
                kept.append(k)
                open_ &= ~(drops[k] | 1 << k)
            kept = block[kept]
            keep.append(kept)
            n += len(kept)
            left = left[(gaps(kept, left) > radius**2).all(0)]
        return np.concatenate(keep)[:most] if keep else np.zeros(0, np.int64)
    cells: dict[tuple, list[int]] = {}
    for k, (x, y, z) in enumerate(np.floor(points / radius).astype(np.int64).tolist()):
        near = [j for dx in (-1, 0, 1) for dy in (-1, 0, 1) for dz in (-1, 0, 1) for j in cells.get((x + dx, y + dy, z + dz), ())]
        if not near or ((points[near] - points[k]) ** 2).sum(1).min() > radius**2:
            cells.setdefault((x, y, z), []).append(k)
            keep.append(k)
    return np.array(keep, np.int64)[:most]


def cloud(v: np.ndarray, f: np.ndarray, n: int, seed: int) -> tuple[np.ndarray, int, int]:
    """(n x 6 positions and unit normals, evenly spread points, plain ones added to reach n)."""
    area = areas(v, f)
    dense, face = _drawn(v, f, area, 3 * n, np.random.default_rng(seed))
    keep = thinned(dense, float(np.sqrt(area.sum() / (3 * n))), n)
    points, face = dense[keep], face[keep]
    if len(keep) < n:
        more, more_face = _drawn(v, f, area, n - len(keep), np.random.default_rng(seed + 1))
        points, face = np.concatenate([points, more]), np.concatenate([face, more_face])
    return np.hstack([points, normals(v, f)[face]]), len(keep), n - len(keep)


def farthest(points: np.ndarray, m: int) -> np.ndarray:
    """Indices of m points, the first one first, then always the farthest from those chosen; the first of equals."""
    m = min(m, len(points))
    out, gap, at = np.zeros(m, np.int64), np.full(len(points), np.inf), 0
    for k in range(m):
        out[k] = at
        gap = np.minimum(gap, ((points - points[at]) ** 2).sum(1))
        at = int(gap.argmax())
    return out


def dropped_and_padded(points: np.ndarray, low: float, high: float, rng: np.random.Generator) -> np.ndarray:
    """As many rows as before: a random share between low and high, the rest drawn again from it; a row's channels stay together."""
    n = len(points)
    k = int(np.clip(n * rng.uniform(low, high), 1, n))
    kept = rng.permutation(n)[:k]
    return points[np.concatenate([kept, kept[rng.integers(0, k, n - k)]])]


def rotation(mode: str, rng: np.random.Generator, tilt: float = 15.0) -> np.ndarray:
    """A 3 x 3 rotation: so3 (uniform), yaw_tilt (any turn about the third axis, then up to tilt degrees about a level axis) or none."""
    if mode == "none":
        return np.eye(3)
    if mode == "so3":
        w, x, y, z = (q := rng.normal(size=4)) / np.linalg.norm(q)
        return np.array([[1 - 2 * (y * y + z * z), 2 * (x * y - z * w), 2 * (x * z + y * w)], [2 * (x * y + z * w), 1 - 2 * (x * x + z * z), 2 * (y * z - x * w)], [2 * (x * z - y * w), 2 * (y * z + x * w), 1 - 2 * (x * x + y * y)]])
    if mode == "yaw_tilt":
        yaw, lean, to = rng.uniform(0, 2 * np.pi), np.radians(rng.uniform(0, tilt)), rng.uniform(0, 2 * np.pi)
        turn = np.array([[np.cos(yaw), -np.sin(yaw), 0], [np.sin(yaw), np.cos(yaw), 0], [0, 0, 1]])
        k = np.array([[0, 0, np.sin(to)], [0, 0, -np.cos(to)], [-np.sin(to), np.cos(to), 0]])
        return (np.eye(3) + np.sin(lean) * k + (1 - np.cos(lean)) * k @ k) @ turn
    raise ValueError(f"unknown rotation {mode!r}")
