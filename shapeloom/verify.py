"""Checks of an installation: libraries, gates, a network, its box, the inputs it is to read, and one decode."""

from __future__ import annotations

from importlib import import_module
from typing import NamedTuple

import numpy as np
from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from .functions.network import Network
from .operators import frames, inference, reports, shapes
from .sources import shapes as files
from .sources import tables


class Check(NamedTuple):
    section: str
    good: bool
    label: str
    detail: str = ""


def _libraries() -> list[Check]:
    out = []
    for name in ("numpy", "pandas", "pyarrow", "pyspark"):
        try:
            out.append(Check("libraries", True, name, import_module(name).__version__))
        except ImportError as e:
            out.append(Check("libraries", False, name, str(e)))
    return out


def _gates() -> list[Check]:
    right = lambda p, q, way: p >= q if way == "higher" else p <= q
    return [Check("gates", way in ("higher", "lower") and right(p, q, way), f"{name}: pass at {p}, partial at {q}, {way} is better") for name, p, q, way in frames.GATES]


def _network(spark: SparkSession, path: str) -> tuple[Network | None, list[Check]]:
    if not tables.exists(spark, path):
        return None, [Check("network", False, "is there", path)]
    try:
        net = inference.loaded(spark, path)
        wanted = Network.shapes_of(net.size)
    except (KeyError, ValueError, TypeError) as e:
        return None, [Check("network", False, "can be read", f"{type(e).__name__}: {e}")]
    wrong = sorted(k for k in wanted.keys() | net.w.keys() if k not in wanted or k not in net.w or net.w[k].shape != tuple(wanted[k]))
    finite = all(np.isfinite(x).all() for x in net.w.values())
    done = [Check("network", not wrong, "weights fit its size", f"{net.n_parameters():,} parameters" if not wrong else f"not {', '.join(wrong[:3])}"), Check("network", finite, "weights are finite")]
    return (None if wrong or not finite else net), done


def checks(spark: SparkSession, net: str, src: str, box: tuple | None, res: int = 128, target: int = 4000, n_points: int = 1000, decode: bool = True) -> list[Check]:
    """All checks in order; one that fails does not stop the others, but what needs a network or a box fails without it.

    Inputs are the .stl and .npy files below src: each mesh has a cloud of its name, clouds have n_points points with
    normals and lie in the box, meshes are in the frame (centroid at the origin, extent 1). The smallest cloud is decoded.
    """
    out = _libraries() + _gates()
    held, done = _network(spark, net)
    out += done
    out.append(Check("box", box is not None and all(a < b for a, b in zip(*box)), "the shapes' box is known and has an inside", str(box or "")))
    name = F.when(F.col("folder") == ".", F.col("stem")).otherwise(F.concat_ws("/", "folder", "stem"))
    clouds, meshes = files.read_clouds(spark, src).persist(), files.read_stl(spark, src).persist()
    pairs = frames.pair(meshes.select("stem"), clouds.select("stem")).agg(F.count(F.lit(1)).alias("n"), F.count_if(~(F.col("has_left") & F.col("has_right"))).alias("alone")).first()
    out.append(Check("inputs", pairs.n > 0 and not pairs.alone, "every mesh has a cloud and every cloud a mesh", f"{pairs.alone} of {pairs.n} alone"))
    axis = lambda f, a: f(F.filter("points", lambda x, i: i % 6 == a))
    over = F.greatest(*[x for a in range(3) for x in (box[0][a] - axis(F.array_min, a), axis(F.array_max, a) - box[1][a])]) if box else F.lit(0.0)
    flat = F.exists(F.sequence(F.lit(0), (F.size("points") / 6).cast("int") - 1), lambda i: ~F.coalesce(sum(F.pow(F.get("points", i * 6 + k), F.lit(2)) for k in (3, 4, 5)) > 0, F.lit(False)))
    whole = F.coalesce((F.col("width") == 6) & (F.size("points") == 6 * n_points), F.lit(False))
    bad = lambda c: F.count_if(~F.coalesce(c, F.lit(False)))
    c = clouds.agg(F.count(F.lit(1)).alias("n"), bad(whole).alias("shape"), bad(~flat | ~whole).alias("normals"), bad((over <= 0) | ~whole).alias("outside")).first()
    out.append(Check("inputs", c.n > 0 and not c["shape"], f"clouds are {n_points} x 6", f"{c['shape']} of {c.n} are not"))
    out.append(Check("inputs", not c.normals, "normals have a length", f"{c.normals} of {c.n} clouds"))
    out.append(Check("inputs", not c.outside, "clouds lie in the box", f"{c.outside} of {c.n} reach out"))
    moved = shapes.normalized(meshes.where("error is null").drop("error"))
    off = F.greatest(F.abs("tx"), F.abs("ty"), F.abs("tz"))
    m = moved.agg(F.count(F.lit(1)).alias("n"), bad((off < 1e-3) & (F.abs(1 / F.col("scale") - 1) < 1e-3)).alias("wrong")).first()
    out.append(Check("frame", not m.wrong, "meshes are centred with extent 1", f"{m.wrong} of {m.n} are not"))
    if decode:
        out += _decoded(spark, clouds.where("error is null and width = 6 and size(points) > 0").withColumn("shape_id", name), held, box, res, target)
    clouds.unpersist()
    meshes.unpersist()
    return out


def _decoded(spark: SparkSession, clouds, net: Network | None, box: tuple | None, res: int, target: int) -> list[Check]:
    least = reports.smallest(clouds.select(F.col("shape_id").alias("path"), F.size("points").alias("length"))).first()
    if net is None or box is None or least is None or least.path is None:
        return [Check("decode", False, "a network, a box and a cloud are there")]
    grid = frames.padded_bounds(spark.createDataFrame([box], "low array<double>, high array<double>")).first()
    one = clouds.where(F.col("shape_id") == least.path).select("shape_id", "points").limit(1)
    r = inference.meshes(one, net, res, grid.low, grid.high, target).first()
    if r is None or not r.faces_in:
        return [Check("decode", False, f"{least.path}: the field has a level set", (r and r.error) or "")]
    return [
        Check("decode", True, f"{least.path}: the field has a level set", f"{r.faces_in} faces at {res}"),
        Check("decode", r.failed_step is None, f"{least.path}: simplified to {r.faces_out} faces", "" if r.failed_step is None else f"reverted at {r.failed_step}: {r.reason}"),
        Check("decode", r.emitted_broken == 0, f"{least.path}: the written surface is closed and turned one way"),
    ]
