"""Queries of the per-shape kernels on packed solids, with closed forms in SQL as their oracles.

Solids: each row of `part` is a box, and by its key's remainder of 4 nothing else, a second box apart from it, one
inside it, or one that cuts through it. Boxes lack a face or have one turned by the rules of the relational proxies.
Fields: each row of `supplier` is a sphere sampled on a grid.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import shapes
from ..operators.rounds import dealt

RES = 14
_BOX = [(0, 0, 0), (1, 0, 0), (1, 1, 0), (0, 1, 0), (0, 0, 1), (1, 0, 1), (1, 1, 1), (0, 1, 1)]
_FACES = [(0, 2, 1), (0, 3, 2), (4, 5, 6), (4, 6, 7), (0, 1, 5), (0, 5, 4), (2, 3, 7), (2, 7, 6), (0, 4, 7), (0, 7, 3), (1, 2, 6), (1, 6, 5)]


def solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("p_partkey")
    # narrow rows spread before they are packed: a kernel's work is far more than its input's bytes
    part = dealt(spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", "p_brand", "p_size"), "p_partkey")
    ext = [1 + F.col("p_size") % 7, 1 + k % 5, 1 + k % 3]
    share = F.when(k % 4 == 2, 0.4).otherwise(0.5)
    start = [F.when(k % 4 == 1, ext[0] + 1.0).when(k % 4 == 2, 0.05 * ext[0]).otherwise(0.8 * ext[0]), *(F.when(k % 4 == 2, 0.05 * e).otherwise(0.27 * e) for e in ext[1:])]
    one = F.array(*[(c[a] * ext[a]).cast("double") for c in _BOX for a in range(3)])
    two = F.array(*[(start[a] + c[a] * share * ext[a]).cast("double") for c in _BOX for a in range(3)])
    number = lambda faces, by: F.array(*[F.lit(x + by) for t in faces for x in t])
    turned = [(0, 1, 2), *_FACES[1:]]
    # a row that lacks its last face and has a turned one lacks the face and is turned
    tri = F.when((k % 11 == 0) & (k % 13 == 0), number(turned[:-1], 0)).when(k % 11 == 0, number(_FACES[:-1], 0)).when(k % 13 == 0, number(turned, 0)).otherwise(number(_FACES, 0))
    return part.select(k.alias("shape_id"), F.col("p_brand").alias("folder"), F.when(k % 4 == 0, one).otherwise(F.concat(one, two)).alias("xyz"), F.when(k % 4 == 0, tri).otherwise(F.concat(tri, number(_FACES, 8))).alias("tri"))


def spheres(spark: SparkSession, sf_dir: str) -> DataFrame:
    k, at = F.col("s_suppkey"), lambda i: 2 * i / F.lit(RES - 1) - 1
    field = F.transform(F.sequence(F.lit(0), F.lit(RES**3 - 1)), lambda i: 0.5 + (k % 7) / 20 - F.sqrt(sum(at(F.floor(i / RES**p) % RES) ** 2 for p in (2, 1, 0))))
    # each becomes thousands of samples
    rows = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey", "s_nationkey"), "s_suppkey", 1_000)
    return rows.select(k.alias("shape_id"), F.expr("cast(s_nationkey as string)").alias("folder"), field.alias("field"))


def _report(spark, sf_dir):
    d = shapes.described(solids(spark, sf_dir))
    return d.select("shape_id", "n_vertices", "n_faces", "is_watertight", "is_winding_consistent", "euler_number", "n_components", F.round("volume", 6).alias("volume"), F.round("area", 6).alias("area"), "error")


def _shells(spark, sf_dir):
    d = shapes.shelled(solids(spark, sf_dir))
    return d.select("shape_id", "n_shells", "n_nested", "all_watertight", F.round("reference_volume", 6).alias("reference_volume"))


def _intersecting(spark, sf_dir):
    return shapes.intersections(solids(spark, sf_dir)).select("shape_id", (F.col("n_intersections") > 0).alias("intersects"))


def _repair(spark, sf_dir):
    d = shapes.repaired(solids(spark, sf_dir)).select("shape_id", "xyz", "tri", "repaired", "ok")
    return shapes.described(d).select("shape_id", "repaired", "ok", "n_faces", F.round("volume", 6).alias("volume"))


def _frame(spark, sf_dir):
    d = shapes.normalized(shapes.repaired(solids(spark, sf_dir)))
    low, high = (F.round(f(F.col("xyz")), 6) for f in (F.array_min, F.array_max))
    axis = lambda a: F.filter("xyz", lambda x, i: i % 3 == a)
    ext = F.greatest(*[F.array_max(axis(a)) - F.array_min(axis(a)) for a in range(3)])
    return d.select("shape_id", F.round(ext, 6).alias("max_extent"), (low < 0).alias("below"), (high > 0).alias("above"))


def _clouds(spark, sf_dir):
    d = shapes.cloud_distances(shapes.sampled(solids(spark, sf_dir), 64))
    return d.select("shape_id", (F.col("n_even") + F.col("n_topup")).alias("n_points"), F.abs(F.round("p99_d", 6)).alias("p99_d"), "frame_flag")


def _surface(spark, sf_dir):
    d = shapes.described(shapes.surfaces(spheres(spark, sf_dir), RES))
    radius = 0.5 + (F.col("shape_id") % 7) / 20
    # chords of a grid's spacing leave out a share in the square of spacing to radius
    bound = F.pow(2 / (RES - 1) / radius, F.lit(2))
    return d.select("shape_id", "is_watertight", "is_winding_consistent", "euler_number", "n_components", (F.abs(F.col("volume") / (4 / 3 * F.pi() * F.pow(radius, F.lit(3))) - 1) < bound).alias("volume_ok"))


def _remesh(spark, sf_dir):
    d = shapes.remeshed(shapes.surfaces(spheres(spark, sf_dir), RES), 150).select("shape_id", "xyz", "tri", "failed_step", "faces_out")
    return shapes.described(d).select("shape_id", "failed_step", "faces_out", "is_watertight", "is_winding_consistent", "euler_number")


def _labels(spark, sf_dir):
    d = shapes.query_points(shapes.normalized(shapes.repaired(solids(spark, sf_dir))), (-0.75,) * 3, (0.75,) * 3, 128)
    return d.select("shape_id", "n_near", F.size("occ").alias("n_queries"), ((F.col("occ_near") > 0.2) & (F.col("occ_near") < 0.8)).alias("near_is_mixed"))


def _centers(spark, sf_dir):
    at = lambda k: F.element_at("embedding", k).cast("double")
    rows = spark.read.parquet(f"{sf_dir}/embeddings.parquet").groupBy(F.col("label").alias("shape_id")).agg(F.sort_array(F.collect_list(F.struct("vec_id", F.array(at(1), at(2), at(3)).alias("p")))).alias("rows"))
    d = shapes.farthest_points(rows.select("shape_id", F.expr("transform(rows, r -> r.vec_id)").alias("ids"), F.expr("flatten(transform(rows, r -> r.p))").alias("points")), 4, 3)
    return d.select("shape_id", F.array_join(F.transform("centers", lambda c: F.element_at("ids", c + 1).cast("string")), ",").alias("centers"))


QUERIES = {"mesh_report": _report, "shell_report": _shells, "self_intersecting": _intersecting, "labelling_repair": _repair, "shared_frame": _frame, "sampled_clouds": _clouds, "marching_cubes": _surface, "remesh_chain": _remesh, "labelled_queries": _labels, "farthest_points": _centers}

_P = """with b as (select p_partkey as shape_id, p_partkey % 4 as kind, cast(1 + p_size % 7 as double) as x, cast(1 + p_partkey % 5 as double) as y, cast(1 + p_partkey % 3 as double) as z, p_partkey % 11 = 0 as holed, p_partkey % 13 = 0 as turned from part),
s as (select *, case when kind = 0 then 0 when kind = 2 then 0.4::double else 0.5::double end as w, cast(kind <> 0 as int) as two from b)"""

ORACLES = {
    "mesh_report": f"{_P} select shape_id, 8 * (1 + two) as n_vertices, 12 * (1 + two) - holed::int as n_faces, 1 - holed::int as is_watertight, 1 - turned::int as is_winding_consistent, 2 * (1 + two) - holed::int as euler_number, 1 + two as n_components, round(x*y*z * (1 + w*w*w - holed::int / 6::double), 6) as volume, round(2 * (x*y + y*z + z*x) * (1 + w*w) - holed::int * y*z / 2, 6) as area, null::varchar as error from s",
    "shell_report": f"{_P} select shape_id, 1 + two as n_shells, cast(kind = 2 as int) as n_nested, 1 - holed::int as all_watertight, round(x*y*z * (1 + w*w*w - holed::int / 6::double), 6) as reference_volume from s",
    "self_intersecting": f"{_P} select shape_id, kind = 3 as intersects from s",
    "labelling_repair": f"{_P} select shape_id, cast(holed or turned as int) as repaired, 1 as ok, 12 * (1 + two) as n_faces, round(x*y*z * (1 + w*w*w), 6) as volume from s",
    "shared_frame": f"{_P} select shape_id, 1.0::double as max_extent, true as below, true as above from s",
    "sampled_clouds": f"{_P} select shape_id, 64 as n_points, 0.0::double as p99_d, 0 as frame_flag from s",
    "marching_cubes": "select s_suppkey as shape_id, 1 as is_watertight, 1 as is_winding_consistent, 2 as euler_number, 1 as n_components, true as volume_ok from supplier",
    "remesh_chain": "select s_suppkey as shape_id, null::varchar as failed_step, 150 as faces_out, 1 as is_watertight, 1 as is_winding_consistent, 2 as euler_number from supplier",
    "labelled_queries": f"{_P} select shape_id, 96 as n_near, 128 as n_queries, true as near_is_mixed from s",
    "farthest_points": """with recursive p as (select label, vec_id, embedding[1]::double as x, embedding[2]::double as y, embedding[3]::double as z from embeddings),
f as (select *, row_number() over (partition by label order by vec_id) = 1 as first from p),
c1 as (select label, vec_id, x, y, z from f where first),
d1 as (select p.*, (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z) as d from p join c1 c using (label)),
c2 as (select * exclude (r) from (select *, row_number() over (partition by label order by d desc, vec_id) as r from d1) where r = 1),
d2 as (select p.* exclude (d), least(p.d, (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z)) as d from d1 p join c2 c using (label)),
c3 as (select * exclude (r) from (select *, row_number() over (partition by label order by d desc, vec_id) as r from d2) where r = 1),
d3 as (select p.* exclude (d), least(p.d, (p.x-c.x)*(p.x-c.x)+(p.y-c.y)*(p.y-c.y)+(p.z-c.z)*(p.z-c.z)) as d from d2 p join c3 c using (label)),
c4 as (select * exclude (r) from (select *, row_number() over (partition by label order by d desc, vec_id) as r from d3) where r = 1)
select c1.label as shape_id, concat_ws(',', c1.vec_id, c2.vec_id, c3.vec_id, c4.vec_id) as centers from c1 join c2 using (label) join c3 using (label) join c4 using (label)""",
}
