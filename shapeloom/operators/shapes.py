"""Operators on packed shapes: one row a mesh (xyz: 3 numbers a vertex, tri: 3 a face) or a cloud (points).

Each is one pass without a shuffle. A shape whose kernel fails keeps its row: results null, error says why.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.types import StructType

from ..functions import levelset, mesh, sampling, simplify
from ..functions.seeds import stable_seed
from ..sources.shapes import decode_stl, encode_stl

#: Shapes whose results are held at once.
AT_ONCE = 200


def _or_error(kernel: Callable, x):
    try:
        return kernel(x)
    except (ValueError, ArithmeticError, IndexError, np.linalg.LinAlgError) as e:
        return e


def each(shapes: DataFrame, made: str, kernel: Callable[[dict], dict] | None, drop: tuple[str, ...] = (), many: Callable[[list[dict]], list] | None = None) -> DataFrame:
    """shapes with the columns `made` (DDL) that kernel(row) returns, and error (null where all went well); `drop` goes, made columns replace equal names. many(rows), in place of a kernel, returns a result or an error for each of several rows."""
    new = StructType.fromDDL(made)
    keep = [f for f in shapes.schema.fields if f.name not in {*drop, *new.names, "error"}]
    schema = StructType([*keep, *new.fields]).add("error", "string")
    names, kept = new.names, [f.name for f in keep]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        # results are lists of Python numbers, far larger than the rows they came from
        for b in (batch[k : k + AT_ONCE] for batch in batches for k in range(0, len(batch), AT_ONCE)):
            given, rows = b.to_dict("records"), []
            for row, got in zip(given, many(given) if many else (_or_error(kernel, row) for row in given)):
                error, got = (f"{type(got).__name__}: {got}", {}) if isinstance(got, Exception) else (None, got)
                rows.append([*(row[k] for k in kept), *(got.get(k) for k in names), error])
            yield pd.DataFrame(rows, columns=schema.names, dtype=object)

    return shapes.mapInPandas(run, schema)


def unpacked(row: dict) -> mesh.Mesh:
    if row["xyz"] is None or row["tri"] is None:
        raise ValueError("no mesh")
    v, f = np.asarray(row["xyz"], np.float64).reshape(-1, 3), np.asarray(row["tri"], np.int64).reshape(-1, 3)
    if len(f) and (f.min() < 0 or f.max() >= len(v)):
        raise ValueError("a face names a vertex that is not there")
    return v, f


def packed(v: np.ndarray, f: np.ndarray) -> dict:
    return {"xyz": v.ravel().tolist(), "tri": f.ravel().tolist()}


def described(meshes: DataFrame) -> DataFrame:
    """n_vertices, n_faces, is_watertight, is_winding_consistent, euler_number, n_components, volume, area."""

    def kernel(row):
        v, f = unpacked(row)
        return {"n_vertices": len(np.unique(f)), "n_faces": len(f), "is_watertight": int(mesh.is_watertight(f)), "is_winding_consistent": int(mesh.is_consistent(f)), "euler_number": mesh.euler_number(f),
                "n_components": int(mesh.components(f).max(initial=-1)) + 1, "volume": mesh.volume(v, f), "area": float(mesh.areas(v, f).sum())}

    return each(meshes, "n_vertices int, n_faces int, is_watertight int, is_winding_consistent int, euler_number int, n_components int, volume double, area double", kernel, ("xyz", "tri"))


def normalized(meshes: DataFrame) -> DataFrame:
    """xyz in the shared frame; tx, ty, tz, scale of the move."""

    def kernel(row):
        v, f = unpacked(row)
        if not len(f):
            raise ValueError("no faces")
        shift, scale = mesh.frame(v, f)
        return packed((v + shift) * scale, f) | dict(zip(("tx", "ty", "tz"), shift.tolist())) | {"scale": scale}

    return each(meshes, "xyz array<double>, tri array<int>, tx double, ty double, tz double, scale double", kernel)


def repaired(meshes: DataFrame) -> DataFrame:
    """xyz, tri fit for labelling; repaired, ok (0/1)."""

    def kernel(row):
        v, f, changed, ok = mesh.repaired(*unpacked(row))
        return packed(v, f) | {"repaired": int(changed), "ok": int(ok)}

    return each(meshes, "xyz array<double>, tri array<int>, repaired int, ok int", kernel)


def shelled(meshes: DataFrame) -> DataFrame:
    """n_shells, n_nested, all_watertight (0/1), reference_volume."""

    def kernel(row):
        got = mesh.shells(*unpacked(row))
        return got | {"all_watertight": int(got["all_watertight"])}

    return each(meshes, "n_shells int, n_nested int, all_watertight int, reference_volume double", kernel, ("xyz", "tri"))


def intersections(meshes: DataFrame) -> DataFrame:
    """n_intersections: pairs of faces that meet and share no vertex."""
    return each(meshes, "n_intersections long", lambda row: {"n_intersections": mesh.self_intersections(*unpacked(row))}, ("xyz", "tri"))


def without_floaters(meshes: DataFrame, least: float = 0.001) -> DataFrame:
    return each(meshes, "xyz array<double>, tri array<int>", lambda row: packed(*mesh.without_floaters(*unpacked(row), least)))


def remeshed(meshes: DataFrame, target: int = 4000) -> DataFrame:
    """xyz, tri of at most target faces (0: as many as there are), or the input where a step broke it: failed_step, reason, faces_in, faces_out, emitted_broken.

    The last step is the file: the mesh is encoded as STL (single precision) and read again, and what was sound but is
    not in its file goes back to the input too (step export). emitted_broken tells of the file of what is given out.
    """
    sound = lambda f: len(f) > 0 and mesh.is_watertight(f) and mesh.is_consistent(f)
    written = lambda w, g: decode_stl(encode_stl(w, g))[1]

    def kernel(row):
        v, f = unpacked(row)
        (w, g), failure = simplify.remeshed(v, f, target) if target else ((v, f), None)
        h = written(w, g)
        if failure is None and sound(g) and not sound(h):
            w, g, failure = v, f, {"step": "export", "reason": "winding inconsistent" if mesh.is_watertight(h) else "not watertight"}
            h = written(w, g)
        return packed(w, g) | {"failed_step": (failure or {}).get("step"), "reason": (failure or {}).get("reason"), "faces_in": len(f), "faces_out": len(g), "emitted_broken": int(not sound(h))}

    return each(meshes, "xyz array<double>, tri array<int>, failed_step string, reason string, faces_in int, faces_out int, emitted_broken int", kernel)


def sampled(meshes: DataFrame, n: int = 1000, seed_of: str = "shape_id") -> DataFrame:
    """points (n x 6 packed), n_even, n_topup. The seed is the stable one of the text of column seed_of, so reruns agree."""

    def kernel(row):
        points, even, more = sampling.cloud(*unpacked(row), n, stable_seed(str(row[seed_of])))
        return {"points": points.ravel().tolist(), "n_even": even, "n_topup": more}

    return each(meshes, "points array<double>, n_even int, n_topup int", kernel)


def cloud_distances(pairs: DataFrame, width: int = 6, flag_above: float = 0.02) -> DataFrame:
    """Of a cloud (points) to its mesh: mean, p99 and max distance, and frame_flag (p99 above flag_above)."""

    def kernel(rows):
        clouds = [_or_error(lambda row: (np.asarray(row["points"], np.float64).reshape(-1, width)[:, :3], *unpacked(row)), row) for row in rows]
        found = mesh.distances_of([c for c in clouds if not isinstance(c, Exception)])
        # one call for clouds of one size
        level = iter(np.percentile(np.stack(found), 99, axis=1).tolist() if len({len(d) for d in found}) == 1 and len(found[0]) else [None] * len(found))
        found = iter(found)
        return [c if isinstance(c, Exception) else _or_error(described, (next(found), next(level))) for c in clouds]

    def described(of):
        d, p99 = of
        p99 = float(np.percentile(d, 99)) if p99 is None else p99
        return {"mean_d": float(d.mean()), "p99_d": p99, "max_d": float(d.max()), "frame_flag": int(p99 > flag_above)}

    return each(pairs, "mean_d double, p99_d double, max_d double, frame_flag int", None, ("xyz", "tri", "points"), kernel)


def farthest_points(clouds: DataFrame, m: int, width: int = 6) -> DataFrame:
    """centers: indices of m farthest points, from index 0."""
    return each(clouds, "centers array<int>", lambda row: {"centers": sampling.farthest(np.asarray(row["points"], np.float64).reshape(-1, width)[:, :3], m).tolist()})


def query_points(meshes: DataFrame, low, high, n: int, near_share: float = 0.75, sigmas: tuple[float, ...] = (0.003, 0.01), pad: float = 0.05, seed_of: str = "shape_id") -> DataFrame:
    """Labelled positions for training: n_near jittered from the surface, then uniform ones in the padded box; points (3 packed, half precision) and occ (winding number above 0.5 at the stored position)."""
    low, high = np.asarray(low, np.float64), np.asarray(high, np.float64)
    low, high = low - pad * (high - low), high + pad * (high - low)

    def kernel(row):
        v, f = unpacked(row)
        rng = np.random.default_rng(stable_seed(str(row[seed_of])))
        n_near = round(n * near_share)
        near = sampling.on_surface(v, f, n_near, rng)[0] + rng.normal(size=(n_near, 3)) * rng.choice(sigmas, (n_near, 1))
        points = np.concatenate([near, rng.uniform(low, high, (n - n_near, 3))]).clip(low, high).astype(np.float16).astype(np.float64)
        occ = mesh.winding(points, v, f) > 0.5
        return {"query": points.ravel().tolist(), "occ": occ.astype(int).tolist(), "n_near": n_near, "occ_near": float(occ[:n_near].mean()), "occ_uniform": float(occ[n_near:].mean())}

    return each(meshes, "query array<float>, occ array<tinyint>, n_near int, occ_near double, occ_uniform double", kernel)


def surfaces(fields: DataFrame, res: int, low=(-1.0, -1.0, -1.0), high=(1.0, 1.0, 1.0), level: float = 0.0, clamp: bool = True) -> DataFrame:
    """Mesh of each field (res^3 values, last axis fastest) at the level; clamp sets the outer voxels far below it, so surfaces close."""

    def kernel(row):
        field = np.array(row["field"], np.float64).reshape(res, res, res)
        if clamp:
            inner = field[1:-1, 1:-1, 1:-1].copy()
            field[:] = -1e4
            field[1:-1, 1:-1, 1:-1] = inner
        return packed(*levelset.surface(field, low, high, level))

    return each(fields, "xyz array<double>, tri array<int>", kernel, ("field",))
