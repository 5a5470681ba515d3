"""Queries of the relational geometry on the packed solids and on finer boxes, with closed forms or another method in SQL as their oracles."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import oracle, spark_query
from ..operators import collapse, contours, geometry, repair, scatter, surfaces
from ..operators.rounds import Tables, dealt
from . import proxy, solids

#: Squares along an edge of a finer box.
PARTS = 6
#: Suppliers of a task: each becomes hundreds of faces.
FEW = 1_000


def _solids(spark: SparkSession, sf_dir: str) -> DataFrame:
    # written first: the solids' closed forms and what is asked of them are too much for one generated class
    return surfaces.triangles(Tables(spark).kept(solids.solids(spark, sf_dir).select("shape_id", "xyz", "tri")))


def blocks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A box for each supplier, each side of PARTS x PARTS squares of two faces; vertices are numbered by their place on the grid."""
    k = F.col("s_suppkey")
    rows = dealt(spark.read.parquet(f"{sf_dir}/supplier.parquet").select("s_suppkey"), "s_suppkey", FEW).select(k.alias("shape_id"), *[(1 + k % m).cast("double").alias(f"e{a}") for a, m in (("x", 7), ("y", 5), ("z", 3))])
    # worked out from a square's number in each row, the corners are a method too large for the JVM to compile
    names = [f"{a}{n}" for n in range(3) for a in "xyz"]
    unit = F.broadcast(spark.createDataFrame(_unit(), ", ".join(["fid long", *[f"{c} int" for c in "ijk"], *[f"{c} double" for c in names]])))
    return rows.crossJoin(unit).select("shape_id", "fid", *"ijk", *[(F.col(c) * F.col(f"e{c[0]}")).alias(c) for c in names])


def _unit() -> list[tuple]:
    """The faces of a box of edge 1: fid, three vertices, and their places."""
    out = []
    for q in range(6 * PARTS * PARTS):
        # a side lies across one axis, at its low or high end
        side, u, v = q // (PARTS * PARTS), q % (PARTS * PARTS) // PARTS, q % PARTS

        def corner(du: int, dv: int) -> tuple[int, tuple[float, ...]]:
            place = [side % 2 * PARTS if side // 2 == n else u + du if (side // 2 + 1) % 3 == n else v + dv for n in range(3)]
            return (place[0] * (PARTS + 1) + place[1]) * (PARTS + 1) + place[2], tuple(x / PARTS for x in place)

        for n, (p, s, t) in enumerate((((0, 0), (1, 0), (1, 1)), ((0, 0), (1, 1), (0, 1)))):
            at = [corner(*c) for c in ((p, s, t) if side % 2 else (p, t, s))]
            out.append((2 * q + n, *[i for i, _ in at], *[x for _, place in at for x in place]))
    return out


#: Places in units of the box: pid, x, y, z.
PLACES = [(0, 0.5, 0.5, 0.5), (1, 0.11, 0.83, 0.27), (2, 0.93, 0.06, 0.94), (3, 1.3, 0.4, 0.6), (4, -0.2, 0.9, -0.4), (5, 0.5, 1.09, 0.5), (6, 0.31, 0.47, 4.0), (7, 0.02, 0.5, 0.5), (8, -0.02, 0.5, 0.5)]


def places(tri: DataFrame) -> DataFrame:
    box = tri.groupBy("shape_id").agg(*[F.max(f"{a}0").alias(f"e{a}") for a in "xyz"])
    rows = F.array(*[F.struct(F.lit(p).alias("pid"), *[F.lit(float(c)).alias(f"u{a}") for a, c in zip("xyz", at)]) for p, *at in PLACES])
    return box.select("*", F.explode(rows).alias("r")).select("shape_id", "r.pid", *[(F.col(f"r.u{a}") * F.col(f"e{a}")).alias(a) for a in "xyz"])


def _components(spark, sf_dir):
    return surfaces.shells(_solids(spark, sf_dir)).select("shape_id", "label", "n_faces", "is_watertight", F.round("volume", 6).alias("volume"))


def _report(spark, sf_dir):
    return surfaces.described(_solids(spark, sf_dir)).withColumns({c: F.round(c, 6) for c in ("volume", "area")}).withColumn("error", F.lit(None).cast("string"))


def _shell_report(spark, sf_dir):
    return surfaces.shell_report(_solids(spark, sf_dir)).withColumn("reference_volume", F.round("reference_volume", 6))


def _floaters(spark, sf_dir):
    d = surfaces.described(surfaces.without_floaters(_solids(spark, sf_dir), 0.1))
    return d.select("shape_id", "n_components", "n_faces", F.round("volume", 6).alias("volume"))


def _intersecting(spark, sf_dir):
    return surfaces.crossing_counts(_solids(spark, sf_dir)).select("shape_id", (F.col("n_intersections") > 0).alias("intersects"))


def _crossings(spark, sf_dir):
    return surfaces.crossing_counts(_solids(spark, sf_dir))


def _winding(spark, sf_dir):
    tri = blocks(spark, sf_dir)
    return surfaces.winding(places(tri), tri).select("shape_id", "pid", (F.col("winding") > 0.5).alias("inside"), (F.abs(F.col("winding") - F.round("winding")) < 0.01).alias("sharp"))


def _labelled(spark, sf_dir):
    """Winding numbers of the relational boxes around their query points."""
    boxes, points = f"with {proxy.BOXES}", geometry._W.split(",\nr as")[0]
    tri = spark_query(f"{boxes} select shape_id, fid, i, j, k, ax as x0, ay as y0, az as z0, bx as x1, by_ as y1, bz as z1, cx as x2, cy as y2, cz as z2 from tri", proxy.SPREAD)(spark, sf_dir)
    return surfaces.winding(spark_query(f"{points} select shape_id, qid as pid, qx as x, qy as y, qz as z from q", proxy.SPREAD)(spark, sf_dir), tri)


def _numbers(spark, sf_dir):
    return _labelled(spark, sf_dir).select("shape_id", F.col("pid").alias("qid"), (F.round("winding", 4) + 0.0).alias("winding"))


def _occupancy(spark, sf_dir):
    return _labelled(spark, sf_dir).select("shape_id", F.col("pid").alias("qid"), (F.col("winding") > 0.5).alias("occ"))


def _rates(spark, sf_dir):
    rate = _labelled(spark, sf_dir).groupBy("shape_id", (F.col("pid") < 2).alias("near")).agg(F.avg(F.when(F.col("winding") > 0.5, 1).otherwise(0)).alias("rate"))
    return rate.groupBy("near").agg(F.round(F.avg("rate"), 9).alias("mean_rate"), F.count(F.lit(1)).alias("n_shapes"))


def _closest(spark, sf_dir):
    tri = blocks(spark, sf_dir)
    return surfaces.closest(places(tri), tri).select("shape_id", "pid", F.round(F.sqrt("d2"), 6).alias("distance"))


def _contour(spark, sf_dir):
    """The spheres' surfaces: vertices (told apart by number and place), faces, and the vertices' second moments."""
    tri = Tables(spark).kept(contours.level_surface(contours.samples(solids.spheres(spark, sf_dir), solids.RES), solids.RES))
    corner = F.explode(F.array(*[F.struct(F.col("ijk"[n]).alias("v"), *[F.col(f"{a}{n}").alias(a) for a in "xyz"]) for n in range(3)])).alias("c")
    v = tri.select("shape_id", corner).distinct().groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_vertices"), *[F.round(F.sum(F.col(f"c.{a}") ** 2), 6).alias(f"sum_{a}{a}") for a in "xyz"])
    e = surfaces.edges(tri).groupBy("shape_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("turn"))
    e = e.groupBy("shape_id").agg(F.min(((F.col("n") == 2) & (F.col("turn") == 0)).cast("int")).alias("closed"))
    f = tri.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_faces"), (F.sum(F.expr(surfaces.VOLUME6)) > 0).alias("outward"))
    return v.join(e, "shape_id").join(f, "shape_id")


#: Points a shape, and seed.
N_SAMPLES, N_CLOUD, SEED = 20, 12, 5


def _proxy_triangles(spark, sf_dir):
    return spark_query(f"with {proxy.BOXES} select shape_id, fid, i, j, k, ax as x0, ay as y0, az as z0, bx as x1, by_ as y1, bz as z1, cx as x2, cy as y2, cz as z2 from tri", proxy.SPREAD)(spark, sf_dir)


def _samples(spark, sf_dir):
    d = scatter.sampled(_proxy_triangles(spark, sf_dir), N_SAMPLES, SEED)
    return d.select("shape_id", "pid", "fid", *[F.round(a, 6).alias(a) for a in "xyz"], *[(F.col(f"n{a}") + 0.0).alias(f"n{a}") for a in "xyz"])


def _cloud(spark, sf_dir):
    d = scatter.cloud(_proxy_triangles(spark, sf_dir), N_CLOUD, SEED)
    return d.select("shape_id", "pid", "even", "fid", *[F.round(a, 6).alias(a) for a in "xyz"])


#: Faces that are left of a finer box; its flat sides and straight edges allow many fewer without a change of shape.
TARGET = 330


def _collapse(spark, sf_dir):
    tri = collapse.simplified(blocks(spark, sf_dir), TARGET)
    e = surfaces.edges(tri).groupBy("shape_id", "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("turn"))
    e = e.groupBy("shape_id").agg(F.min(((F.col("n") == 2) & (F.col("turn") == 0)).cast("int")).alias("closed"), F.count(F.lit(1)).alias("n_edges"))
    f = tri.groupBy("shape_id").agg(F.count(F.lit(1)).alias("n_faces"), (F.round(F.sum(F.expr(surfaces.VOLUME6)) / 6, 6)).alias("volume"), F.round(F.sum(F.expr(surfaces.AREA2)) / 2, 6).alias("area"))
    return f.join(e, "shape_id")


def _repair(spark, sf_dir):
    faces, report = repair.repaired(_solids(spark, sf_dir))
    size = faces.groupBy("shape_id").agg(F.count(F.lit(1)).cast("int").alias("n_faces"), F.round(F.sum(F.expr(surfaces.VOLUME6)) / 6, 6).alias("volume"))
    return report.join(size, "shape_id")


QUERIES = {
    "edge_collapse": _collapse, "labelling_repair": _repair,
    "grid_surface": _contour, "area_samples": _samples, "even_cloud": _cloud,
    "face_components": _components, "mesh_report": _report, "shell_report": _shell_report, "floater_filter": _floaters, "self_intersecting": _intersecting, "crossing_counts": _crossings,
    "cell_winding": _winding, "closest_on_faces": _closest, "winding_number": _numbers, "winding_occupancy": _occupancy, "occupancy_rates": _rates,
}
#: Plain SQL of operators that were replaced: all points by all faces.
PLAIN = {name: geometry.SQL[name] for name in ("winding_number", "winding_occupancy", "occupancy_rates")}

_AT = ", ".join(f"({p}, {x}::double, {y}::double, {z}::double)" for p, x, y, z in PLACES)
_BLOCK = f"with b as (select s_suppkey as shape_id, (1 + s_suppkey % 7)::double as ex, (1 + s_suppkey % 5)::double as ey, (1 + s_suppkey % 3)::double as ez from supplier), p as (select shape_id, pid, ux * ex as x, uy * ey as y, uz * ez as z, ex, ey, ez, ux between 0 and 1 and uy between 0 and 1 and uz between 0 and 1 as inside from b, (values {_AT}) as c(pid, ux, uy, uz))"
#: Corners of the solids' faces, from the closed forms of their boxes.
_FACE = ", ".join(f"({n}, {i}, {j}, {k})" for n, (i, j, k) in enumerate(solids._FACES))
_CORNER = ", ".join(f"({n}, {x}, {y}, {z})" for n, (x, y, z) in enumerate(solids._BOX))
_TRIANGLES = f"""{solids._P}, c as (select * from (values {_CORNER}) as c(vid, cx, cy, cz)), f as (select * from (values {_FACE}) as f(fid, i, j, k)),
o as (select shape_id, 0 as box, holed, turned, 0::double as dx, 0::double as dy, 0::double as dz, x, y, z from s union all
  select shape_id, 1, false, false, case when kind = 1 then x + 1 when kind = 2 then 0.05::double * x else 0.8::double * x end, case when kind = 2 then 0.05::double * y else 0.27::double * y end, case when kind = 2 then 0.05::double * z else 0.27::double * z end, w * x, w * y, w * z from s where two = 1),
t as (select shape_id, box, fid + 12 * box as fid, i + 8 * box as i, j + 8 * box as j, k + 8 * box as k, [[dx + a.cx * x, dy + a.cy * y, dz + a.cz * z], [dx + b.cx * x, dy + b.cy * y, dz + b.cz * z], [dx + d.cx * x, dy + d.cy * y, dz + d.cz * z]] as v
  from o join f on not (holed and fid = 11) join c a on a.vid = i join c b on b.vid = j join c d on d.vid = k)"""
#: Two triangles of different planes are apart if they are on one of eleven axes: their normals and the products of their edges.
_APART = """, pr as (select a.shape_id, a.fid as fa, b.fid as fb, a.v as p, b.v as q from t a join t b on a.shape_id = b.shape_id and a.fid < b.fid and a.i not in (b.i, b.j, b.k) and a.j not in (b.i, b.j, b.k) and a.k not in (b.i, b.j, b.k)),
eg as (select *, list_transform([1, 2, 3], lambda k: [p[k % 3 + 1][1] - p[k][1], p[k % 3 + 1][2] - p[k][2], p[k % 3 + 1][3] - p[k][3]]) as e, list_transform([1, 2, 3], lambda k: [q[k % 3 + 1][1] - q[k][1], q[k % 3 + 1][2] - q[k][2], q[k % 3 + 1][3] - q[k][3]]) as g from pr),
ax as (select shape_id, fa, fb, p, q, unnest([[e[1], e[2]], [g[1], g[2]], [e[1], g[1]], [e[1], g[2]], [e[1], g[3]], [e[2], g[1]], [e[2], g[2]], [e[2], g[3]], [e[3], g[1]], [e[3], g[2]], [e[3], g[3]]]) as m from eg),
nx as (select shape_id, fa, fb, p, q, [m[1][2] * m[2][3] - m[1][3] * m[2][2], m[1][3] * m[2][1] - m[1][1] * m[2][3], m[1][1] * m[2][2] - m[1][2] * m[2][1]] as n from ax),
pj as (select shape_id, fa, fb, list_transform(p, lambda c: c[1] * n[1] + c[2] * n[2] + c[3] * n[3]) as u, list_transform(q, lambda c: c[1] * n[1] + c[2] * n[2] + c[3] * n[3]) as w from nx),
hit as (select shape_id, fa, fb from pj group by all having not bool_or(list_min(u) > list_max(w) + 1e-9 or list_min(w) > list_max(u) + 1e-9))"""
#: Vertices of a closed surface on a grid: one on each edge whose ends lie on both sides. Its faces follow from Euler's formula.
_GRID = f"""with g as (select s_suppkey as shape_id, x, y, z, 0.5::double + (s_suppkey % 7)::double / 20 - sqrt(power(2 * x / {solids.RES - 1}::double - 1, 2) + power(2 * y / {solids.RES - 1}::double - 1, 2) + power(2 * z / {solids.RES - 1}::double - 1, 2)) as v
  from supplier, (select unnest(range({solids.RES})) as x), (select unnest(range({solids.RES})) as y), (select unnest(range({solids.RES})) as z)),
e as (select a.shape_id, a.x, a.y, a.z, b.x - a.x as dx, b.y - a.y as dy, b.z - a.z as dz, a.v / (a.v - b.v) as t from g a join (select shape_id, x, y, z, v, unnest([1, 2, 3]) as axis from g) b
  on b.shape_id = a.shape_id and b.x = a.x + (b.axis = 1)::int and b.y = a.y + (b.axis = 2)::int and b.z = a.z + (b.axis = 3)::int where (a.v > 0) <> (b.v > 0))
select shape_id, count(*) as n_vertices, 2 * (count(*) - 2) as n_faces, 1 as closed, true as outward, {", ".join(f"round(sum(power(2 * ({a} + t * d{a}) / {solids.RES - 1}::double - 1, 2)), 6) as sum_{a}{a}" for a in "xyz")} from e group by shape_id"""


def _drawn(name: str, n: int, seed: int) -> str:
    """Common table expressions: n points of each shape by the whole table's running sums."""
    return f"""{name}_d as (select shape_id, pid, sha1('{seed}/' || shape_id || '/' || pid) as sha from (select distinct shape_id from area), (select unnest(range({n})) as pid)),
{name} as (select d.shape_id, d.pid, a.fid, {", ".join(f"(1 - r) * {p} + r * (1 - s) * {q} + r * s * {t} as {c}" for c, p, q, t in (("x", "ax", "bx", "cx"), ("y", "ay", "by_", "cy"), ("z", "az", "bz", "cz")))}, nx / area2 as nx, ny / area2 as ny, nz / area2 as nz
  from (select *, ('0x' || substr(sha, 1, 15))::bigint as draw, sqrt(('0x' || substr(sha, 16, 12))::bigint / {float(1 << 48)}::double) as r, ('0x' || substr(sha, 28, 12))::bigint / {float(1 << 48)}::double as s from {name}_d) d
  join area a on a.shape_id = d.shape_id and d.draw % a.whole >= a.upto - a.w and d.draw % a.whole < a.upto)"""


_AREA = f"""{proxy.BOXES}, plain as (select *, {proxy.CROSS} from tri), sized as (select *, sqrt(nx * nx + ny * ny + nz * nz) as area2 from plain),
shares as (select *, floor(area2 / (max(area2) over (partition by shape_id) * count(*) over (partition by shape_id) / {scatter.WHOLE}::double))::bigint as w from sized),
area as (select *, (sum(w) over (partition by shape_id order by fid))::bigint as upto, (sum(w) over (partition by shape_id))::bigint as whole from shares)"""
#: Points in turn, each against all kept before it.
_CLOUD = f"""with recursive {_AREA}, {_drawn("dense", 3 * N_CLOUD, SEED)}, {_drawn("plainly", N_CLOUD, SEED + 1)},
wide as (select shape_id, sum(area2) / 2 / {3 * N_CLOUD} as r2 from area group by shape_id),
one as (select d.*, r2 from dense d join wide using (shape_id)),
turn as (select shape_id, pid, [[x, y, z]] as kept, true as good from one where pid = 0 union all
  select o.shape_id, o.pid, case when len(list_filter(t.kept, lambda k: power(k[1] - o.x, 2) + power(k[2] - o.y, 2) + power(k[3] - o.z, 2) <= o.r2)) = 0 then list_append(t.kept, [o.x, o.y, o.z]) else t.kept end,
    len(list_filter(t.kept, lambda k: power(k[1] - o.x, 2) + power(k[2] - o.y, 2) + power(k[3] - o.z, 2) <= o.r2)) = 0 from turn t join one o on o.shape_id = t.shape_id and o.pid = t.pid + 1),
evenly as (select shape_id, row_number() over (partition by shape_id order by pid) - 1 as pid, fid, x, y, z from turn join dense using (shape_id, pid) where good),
have as (select shape_id, least(count(*), {N_CLOUD}) as n from evenly group by shape_id)
select shape_id, pid, true as even, fid, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z from evenly where pid < {N_CLOUD}
union all select shape_id, pid + n, false, fid, round(x, 6), round(y, 6), round(z, 6) from plainly join have using (shape_id) where pid + n < {N_CLOUD}"""
ORACLES = {
    "edge_collapse": f"{_BLOCK} select distinct shape_id, {TARGET} as n_faces, 1 as closed, {TARGET * 3 // 2} as n_edges, round(ex * ey * ez, 6) as volume, round(2 * (ex * ey + ey * ez + ez * ex), 6) as area from p",
    "grid_surface": _GRID,
    "area_samples": oracle(f"with {_AREA}, {_drawn('drawn', N_SAMPLES, SEED)} select shape_id, pid, fid, round(x, 6) as x, round(y, 6) as y, round(z, 6) as z, nx + 0.0 as nx, ny + 0.0 as ny, nz + 0.0 as nz from drawn"),
    "even_cloud": oracle(_CLOUD),
    "face_components": f"{solids._P} select shape_id, 0::bigint as label, (12 - holed::int)::bigint as n_faces, 1 - holed::int as is_watertight, round(x*y*z * (1 - holed::int / 6::double), 6) as volume from s union all select shape_id, (12 - holed::int)::bigint, 12::bigint, 1, round(x*y*z*w*w*w, 6) from s where two = 1",
    "crossing_counts": f"{_TRIANGLES}{_APART} select b.shape_id, count(hit.fa) as n_intersections from b left join hit on hit.shape_id = b.shape_id group by b.shape_id",
    "cell_winding": f"{_BLOCK} select shape_id, pid, inside, true as sharp from p",
    "closest_on_faces": f"{_BLOCK} select shape_id, pid, round(case when inside then least(x, y, z, ex - x, ey - y, ez - z) else sqrt(power(greatest(0, -x, x - ex), 2) + power(greatest(0, -y, y - ey), 2) + power(greatest(0, -z, z - ez), 2)) end, 6) as distance from p",
}
