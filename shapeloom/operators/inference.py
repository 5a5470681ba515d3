"""From clouds to meshes: encode once a shape, decode its grid in chunks spread over tasks, extract, simplify, score."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.levelset import grid
from ..functions.network import Network
from . import shapes


def saved(spark: SparkSession, net: Network, path: str, bounds: tuple | None = None) -> None:
    """Writes the network as a table (name, shape, data); its size is that of the parameters. bounds: the box of the shapes it is trained on."""
    size = [(k, None, [float(v)]) for k, v in net.size.items()]
    rows = [(f"w:{k}", list(v.shape), v.ravel().tolist()) for k, v in net.w.items()]
    rows += [("bounds", [2, 3], [float(x) for corner in bounds for x in corner])] if bounds else []
    spark.createDataFrame([*(("s:" + k, s, d) for k, s, d in size), *rows], "name string, shape array<int>, data array<double>").coalesce(1).write.mode("overwrite").parquet(path)


def loaded(spark: SparkSession, path: str) -> Network:
    rows = {r.name: r for r in spark.read.parquet(path).collect()}
    size = {k[2:]: int(r.data[0]) for k, r in rows.items() if k.startswith("s:")}
    return Network(size, {k[2:]: np.array(r.data).reshape(r["shape"]) for k, r in rows.items() if k.startswith("w:")})


def bounds_of(spark: SparkSession, path: str) -> tuple | None:
    """The box of the shapes that a written network was trained on, if it carries one."""
    r = spark.read.parquet(path).where("name = 'bounds'").first()
    return r and (tuple(r.data[:3]), tuple(r.data[3:]))


def encoded(clouds: DataFrame, net: Network, width: int = 6) -> DataFrame:
    """code: the packed code of each cloud (points). The network's parameters (megabytes) are broadcast."""
    held = clouds.sparkSession.sparkContext.broadcast(net)
    return shapes.each(clouds, "code array<double>", lambda row: {"code": held.value.encode(np.asarray(row["points"], np.float64).reshape(-1, width)).ravel().tolist()}, ("points",))


def decoded(codes: DataFrame, net: Network, res: int, low, high, chunk: int = 1 << 16) -> DataFrame:
    """Rows (every column of codes but code, chunk, logits): the grid of each shape in chunks of positions, each a task's row."""
    held = codes.sparkSession.sparkContext.broadcast(net)
    parts = codes.where("code is not null").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.lit((res**3 - 1) // chunk)))).repartition("shape_id", "chunk")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        n = held.value
        for b in batches:
            logits = []
            for code, k in zip(b.pop("code"), b["chunk"]):
                positions = grid(low, high, res)[k * chunk : (k + 1) * chunk]
                logits.append(n.decode(np.asarray(code).reshape(-1, n.size["d_model"]), positions).astype(np.float32))
            b["logits"] = logits
            yield b

    keep = [f"`{f.name}` {f.dataType.simpleString()}" for f in parts.schema.fields if f.name != "code"]
    return parts.mapInPandas(run, f"{', '.join(keep)}, logits array<float>")


def fields(chunks: DataFrame) -> DataFrame:
    """field: the logits of each shape, chunks in order. A group is one shape's grid, whose size is res cubed."""
    rows = F.sort_array(F.collect_list(F.struct("chunk", "logits")))
    return chunks.groupBy("shape_id").agg(F.flatten(F.transform(rows, lambda r: r["logits"])).alias("field"))


#: Shapes of extent 1 around their area centroid lie inside, wherever that is.
FRAME = ((-1.0,) * 3, (1.0,) * 3)


def surfaces(clouds: DataFrame, net: Network, res: int = 128, low=FRAME[0], high=FRAME[1], drop_floaters: bool = True, width: int = 6, chunk: int = 1 << 16) -> DataFrame:
    """shape_id, xyz, tri of the level set of every cloud that could be encoded."""
    found = shapes.surfaces(fields(decoded(encoded(clouds, net, width).select("shape_id", "code"), net, res, low, high, chunk)), res, low, high)
    return shapes.without_floaters(found) if drop_floaters else found


def meshes(clouds: DataFrame, net: Network, res: int = 128, low=FRAME[0], high=FRAME[1], target: int = 4000, drop_floaters: bool = True, width: int = 6, chunk: int = 1 << 16) -> DataFrame:
    """shape_id, xyz, tri, failed_step, reason, faces_in, faces_out, emitted_broken of every cloud that could be encoded; target 0 keeps all faces."""
    return shapes.remeshed(surfaces(clouds, net, res, low, high, drop_floaters, width, chunk), target)


def scored(predicted: DataFrame, truth: DataFrame, n: int = 100_000, res: int = 128, low=FRAME[0], high=FRAME[1]) -> DataFrame:
    """One row a shape of truth: topology flags, self-intersections, IoU on a grid, Chamfer x 1000, normal consistency, Euler and component matches. A shape without a prediction scores 0 (Chamfer NaN) and has an error, so it stays in the means."""
    from ..functions import mesh, sampling

    both = truth.select("shape_id", "folder", F.col("xyz").alias("xyz_gt"), F.col("tri").alias("tri_gt")).join(predicted.select("shape_id", "xyz", "tri"), "shape_id", "left")

    def kernel(row):
        gt = shapes.unpacked({"xyz": row["xyz_gt"], "tri": row["tri_gt"]})
        v, f = shapes.unpacked(row)
        if not len(f):
            raise ValueError("an empty prediction")
        inside, inside_gt = mesh.occupied(v, f, low, high, res), mesh.occupied(*gt, low, high, res)
        either = (inside | inside_gt).sum()
        a, b = sampling.cloud(v, f, n, 0)[0], sampling.cloud(*gt, n, 0)[0]
        (da, ia), (db, ib) = mesh.nearest(a[:, :3], b[:, :3]), mesh.nearest(b[:, :3], a[:, :3])
        cosine = lambda x, y: np.abs((x[:, 3:] * y[:, 3:]).sum(1)).mean()
        hits, parts, parts_gt = mesh.self_intersections(v, f), int(mesh.components(f).max()) + 1, int(mesh.components(gt[1]).max()) + 1
        return {"watertight": int(mesh.is_watertight(f)), "winding_consistent": int(mesh.is_consistent(f)), "self_intersections": hits, "self_intersection_free": int(hits == 0),
                "iou": float((inside & inside_gt).sum() / either) if either else float("nan"), "chamfer_l2_x1e3": float(500 * (da.mean() + db.mean())), "normal_consistency": float((cosine(a, b[ia]) + cosine(b, a[ib])) / 2),
                "euler_match": int(mesh.euler_number(f) == mesh.euler_number(gt[1])), "n_components": parts, "n_components_gt": parts_gt}

    out = shapes.each(both, "watertight int, winding_consistent int, self_intersections int, self_intersection_free int, iou double, chamfer_l2_x1e3 double, normal_consistency double, euler_match int, n_components int, n_components_gt int", kernel, ("xyz", "tri", "xyz_gt", "tri_gt"))
    zero = [F.coalesce(c, F.lit(0)).alias(c) for c in ("watertight", "winding_consistent", "self_intersection_free", "euler_match")]
    failed = F.col("error").isNotNull()
    return out.select("shape_id", "folder", *zero, "self_intersections", *[F.when(failed, x).otherwise(F.col(c)).alias(c) for c, x in (("iou", 0.0), ("chamfer_l2_x1e3", float("nan")), ("normal_consistency", 0.0))], "n_components", "n_components_gt", "error")
