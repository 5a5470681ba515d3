"""Relational geometry of triangle tables: shells, crossings, winding numbers and closest points, by joins and aggregates.

A triangle table has a key `by`, fid, the vertices i, j, k and the corners x0, y0, z0, x1, ... z2. Work on one mesh is
spread over tasks by its faces and cells, so a large mesh is not one task. Rows with a null key, index or coordinate
are left out.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.mesh import nearest_face
from . import rounds
from .frames import box_pairs
from .rounds import Tables, components, gathered, lookup, same, shuffled

AXES = "xyz"
CORNERS = [f"{c}{n}" for n in range(3) for c in AXES]


def triangles(meshes: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, fid, i, j, k and corners of packed meshes (xyz: coordinates, tri: three indices a face); null meshes have none."""
    at = lambda v, a: F.get("xyz", (3 * v + a).cast("int"))
    vertex = lambda f, n: F.get("tri", (3 * f + n).cast("int"))
    faces = F.transform(F.sequence(F.lit(0), F.floor(F.size("tri") / 3).cast("int") - 1), lambda f: F.struct(f.cast("long").alias("fid"), *[vertex(f, n).alias("ijk"[n]) for n in range(3)], *[at(vertex(f, n), a).cast("double").alias(f"{c}{n}") for n in range(3) for a, c in enumerate(AXES)]))
    return meshes.where(F.col("xyz").isNotNull() & (F.size("tri") >= 3)).select(by, F.explode(faces).alias("f")).select(by, "f.*").dropna()


def _minus(a: str, b: str) -> str:
    return f"({a} - {b})"


def cross(p: str, q: str, r: str, a: str) -> str:
    """Component a of (q - p) x (r - p) as SQL; corners are suffixes of the axes."""
    b, c = AXES[(AXES.index(a) + 1) % 3], AXES[(AXES.index(a) + 2) % 3]
    return f"({_minus(b + q, b + p)} * {_minus(c + r, c + p)} - {_minus(c + q, c + p)} * {_minus(b + r, b + p)})"


def normal(a: str) -> str:
    return cross("0", "1", "2", a)


AREA2 = f"sqrt({' + '.join(f'power({normal(a)}, 2)' for a in AXES)})"
#: Six times the signed volume of a face with the origin.
VOLUME6 = " + ".join(f"{a}0 * ({b}1 * {c}2 - {c}1 * {b}2)" for a, b, c in ("xyz", "yzx", "zxy"))


def edges(faces: DataFrame, by: str = "shape_id", *more: str) -> DataFrame:
    """by, fid, lo, hi and the columns named: each face's three edges."""
    pairs = F.array(*[F.struct(F.least(a, b).alias("lo"), F.greatest(a, b).alias("hi"), (F.col(a) < F.col(b)).alias("up")) for a, b in (("i", "j"), ("j", "k"), ("k", "i"))])
    return faces.select(by, "fid", *more, F.explode(pairs).alias("e")).select(by, "fid", *more, "e.*")


def face_components(faces: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, fid, label: faces are linked over edges of exactly two faces; label is the least fid of the component. A written table."""
    links = edges(faces, by).groupBy(by, "lo", "hi").agg(F.min("fid").alias("a"), F.max("fid").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2")
    return components(faces.select(by, F.col("fid").alias("v")), links, by).withColumnRenamed("v", "fid")


def labelled(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """tri with label, the component of each face. Each fid stands once in a shape."""
    return shuffled(tri).alias("t").join(face_components(tri, by).alias("c"), same("t", "c", [by, "fid"])).select("t.*", "c.label")


def described(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, n_vertices, n_faces, is_watertight, is_winding_consistent, euler_number, n_components, volume, area: as of packed meshes, from aggregates of faces, edges and vertices."""
    tri = shuffled(tri)
    # a component is counted at the face it is named after, so the faces need no labels
    whole = tri.groupBy(by).agg(F.count(F.lit(1)).alias("n_faces"), (F.sum(F.expr(VOLUME6)) / 6).alias("volume"), (F.sum(F.expr(AREA2)) / 2).alias("area"))
    e = edges(tri, by).groupBy(by, "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("turn"))
    e = e.groupBy(by).agg(F.count(F.lit(1)).alias("n_edges"), F.min((F.col("n") == 2).cast("int")).alias("is_watertight"), F.min(((F.col("n") != 2) | (F.col("turn") == 0)).cast("int")).alias("is_winding_consistent"))
    v = tri.select(by, F.explode(F.array("i", "j", "k")).alias("v")).distinct().groupBy(by).agg(F.count(F.lit(1)).alias("n_vertices"))
    n = face_components(tri, by).where("label = fid").groupBy(by).agg(F.count(F.lit(1)).alias("n_components"))
    return whole.join(n, by).join(e, by).join(v, by).select(by, F.col("n_vertices").cast("int"), F.col("n_faces").cast("int"), "is_watertight", "is_winding_consistent", (F.col("n_vertices") - F.col("n_edges") + F.col("n_faces")).cast("int").alias("euler_number"), F.col("n_components").cast("int"), "volume", "area")


def shells(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, label, n_faces, volume (not signed), is_watertight, and the box lo_x ... hi_z of each component."""
    return _shells(labelled(tri, by), by)


def _shells(t: DataFrame, by: str) -> DataFrame:
    box = [x for a in AXES for x in (F.min(F.least(*[f"{a}{n}" for n in range(3)])).alias(f"lo_{a}"), F.max(F.greatest(*[f"{a}{n}" for n in range(3)])).alias(f"hi_{a}"))]
    each = t.groupBy(by, "label").agg(F.count(F.lit(1)).alias("n_faces"), (F.abs(F.sum(F.expr(VOLUME6))) / 6).alias("volume"), *box)
    tight = edges(t, by, "label").groupBy(by, "label", "lo", "hi").agg(F.count(F.lit(1)).alias("n")).groupBy(by, "label").agg(F.min((F.col("n") == 2).cast("int")).alias("is_watertight"))
    return each.join(tight, [by, "label"])


def shell_report(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, n_shells, n_nested, all_watertight, reference_volume. Nested: the centre of another shell's box lies inside a shell (winding number beyond a half). Outside a shell's box no point has one, so only boxes that meet are compared, by cells."""
    spark = tri.sparkSession
    made = Tables(spark)
    t = made.kept(labelled(tri, by))
    s = made.kept(_shells(t, by))
    total = s.groupBy(by).agg(F.count(F.lit(1)).cast("int").alias("n_shells"), F.min("is_watertight").alias("all_watertight"), F.sum("volume").alias("reference_volume"))
    pairs = box_pairs(s.select(by, F.col("label").alias("fid"), *[F.col(f"{k}_{a}").alias(f"{a}{n}") for a in AXES for n, k in enumerate(("lo", "hi"))]), by)
    pairs = pairs.select(by, F.col("fid_a").alias("label"), F.col("fid_b").alias("other")).unionByName(pairs.select(by, F.col("fid_b").alias("label"), F.col("fid_a").alias("other")))
    centre = s.select(by, F.col("label").alias("other"), *[((F.col(f"lo_{a}") + F.col(f"hi_{a}")) / 2).alias(a) for a in AXES])
    inside = F.lit(True)
    for a in AXES:
        inside = inside & F.col(a).between(F.col(f"lo_{a}"), F.col(f"hi_{a}"))
    points = pairs.join(centre, [by, "other"]).join(s.select(by, "label", *[f"{k}_{a}" for a in AXES for k in ("lo", "hi")]), [by, "label"]).where(inside)
    shell = F.struct(by, "label").alias("shell")
    points = made.kept(points.select(shell, F.col("other").alias("pid"), *AXES))
    own = t.join(points.select(F.col(f"shell.{by}").alias(by), F.col("shell.label").alias("label")).distinct(), [by, "label"], "left_semi").select(shell, *[c for c in t.columns if c not in (by, "label")])
    nested = winding(points, own, "shell").where("abs(winding) > 0.5").groupBy(F.col(f"shell.{by}").alias(by)).agg(F.count(F.lit(1)).cast("int").alias("n"))
    return made.last(total.join(nested, by, "left").select(by, "n_shells", F.coalesce("n", F.lit(0)).alias("n_nested"), "all_watertight", "reference_volume"))


def without_floaters(tri: DataFrame, least: float = 0.001, by: str = "shape_id") -> DataFrame:
    """The faces of components with at least `least` of their shape's largest volume; a component without volume counts its box. Volumes are sums in any order, so one that falls short by rounding (1e-9) counts as reaching it."""
    made = Tables(tri.sparkSession)
    t = made.kept(labelled(tri, by))
    box = F.lit(1.0)
    for a in AXES:
        box = box * (F.max(F.greatest(*[f"{a}{n}" for n in range(3)])) - F.min(F.least(*[f"{a}{n}" for n in range(3)])))
    size = t.groupBy(by, "label").agg((F.abs(F.sum(F.expr(VOLUME6))) / 6).alias("v"), box.alias("b")).select(by, "label", F.when(F.col("v") > 0, F.col("v")).otherwise(F.col("b")).alias("size"))
    most = size.groupBy(by).agg(F.max("size").alias("most"))
    kept = size.join(most, by).where(F.col("size") >= least * (1 - 1e-9) * F.col("most")).select(by, "label")
    return made.last(t.join(kept, [by, "label"], "left_semi").select(tri.columns))


# -- crossings


def _det(p: str, q: str, r: str, s: str) -> str:
    """Six times the signed volume of four points, given as prefixes of _x, _y, _z."""
    d = lambda u, a: f"({u}_{a} - {p}_{a})"
    return " + ".join(f"{d(q, a)} * ({d(r, b)} * {d(s, c)} - {d(r, c)} * {d(s, b)})" for a, b, c in ("xyz", "yzx", "zxy"))


def _once(rows: DataFrame, keep: list[str], made: list[Column]) -> DataFrame:
    """rows with columns that are worked out once: filters on them are not moved below them, which would repeat them."""
    return rows.select(*keep, F.explode(F.array(F.struct(*made))).alias("__made")).select(*keep, "__made.*")


def overlapping(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """keys of the pairs of triangles that have a point in common; touching counts. pairs: keys, a0_x ... a2_z, b0_x ... b2_z.

    Corners are on a side of the other triangle's plane by signed volumes, those below 1e-10 of the pair's largest (or
    of rounding) being on it. Apart are pairs with all corners strictly on one side. Of the rest, an edge that reaches the
    other plane meets the other triangle if it passes its three sides in one sense; triangles of one plane are apart if
    one lies outside an edge of the other.
    """
    names = [f"{t}{n}" for t in "ab" for n in range(3)]
    size = "greatest(" + ", ".join(f"abs({n}_{a} - a0_{a})" for n in names for a in AXES) + ")"
    corners = [f"{n}_{a}" for n in names for a in AXES]
    volumes = [F.expr(_det(f"{o}0", f"{o}1", f"{o}2", f"{t}{n}")).alias(f"__{t}{n}") for t, o in ("ab", "ba") for n in range(3)]
    x = _once(pairs, [*keys, *corners], [F.expr(size).alias("__size"), *volumes])
    for t in "ab":
        most = F.greatest(*[F.abs(f"__{t}{n}") for n in range(3)])
        bound = F.greatest(most * 1e-10, F.pow("__size", F.lit(3)) * 1e-14)
        x = x.withColumn("__bound", bound)
        x = x.withColumns({f"__{t}{n}": F.when(F.abs(f"__{t}{n}") <= F.col("__bound"), 0.0).otherwise(F.signum(f"__{t}{n}")) for n in range(3)})
    apart = lambda t: F.abs(sum(F.col(f"__{t}{n}") for n in range(3))) == 3
    x = x.where(~apart("a") & ~apart("b"))
    flat = (F.greatest(*[F.abs(f"__a{n}") for n in range(3)]) == 0) | (F.greatest(*[F.abs(f"__b{n}") for n in range(3)]) == 0)
    # one row for each edge p-q, with its triangle's third corner r and the other triangle u, v, w
    point = lambda p, name: [F.col(f"{p}_{a}").alias(f"{name}_{a}") for a in AXES]
    reaches = lambda t, n, m: (F.col(f"__{t}{n}") * F.col(f"__{t}{m}") <= 0) & ((F.col(f"__{t}{n}") != 0) | (F.col(f"__{t}{m}") != 0))
    edge = lambda t, o, n: F.struct(reaches(t, n, (n + 1) % 3).alias("reaches"), *point(f"{t}{n}", "p"), *point(f"{t}{(n + 1) % 3}", "q"), *point(f"{t}{(n + 2) % 3}", "r"), *point(f"{o}0", "u"), *point(f"{o}1", "v"), *point(f"{o}2", "w"))
    x = x.select(*keys, "__size", flat.alias("flat"), F.explode(F.array(*[edge(t, o, n) for t, o in ("ab", "ba") for n in range(3)])).alias("e")).where("flat or e.reaches").select(*keys, "__size", "flat", "e.*")
    d = lambda m, n, a: f"({m}_{a} - {n}_{a})"
    normals = [F.expr(f"{d('q', 'p', b)} * {d('r', 'p', c)} - {d('q', 'p', c)} * {d('r', 'p', b)}").alias(f"n_{a}") for a, b, c in ("xyz", "yzx", "zxy")]
    sides = [F.expr(_det("p", "q", r, s)).alias(n) for n, r, s in (("s0", "u", "v"), ("s1", "v", "w"), ("s2", "w", "u"))]
    x = _once(x, [*keys, "__size", "flat", *[f"{k}_{a}" for k in "pquvw" for a in AXES]], normals + sides)
    # within the plane, away from the edge's own triangle
    away = lambda u: " + ".join(f"{d(u, 'p', a)} * (n_{b} * {d('q', 'p', c)} - n_{c} * {d('q', 'p', b)})" for a, b, c in ("xyz", "yzx", "zxy"))
    x = _once(x, [*keys, "__size", "flat", "s0", "s1", "s2"], [F.expr(f"greatest({', '.join(away(u) for u in 'uvw')})").alias("__most")])
    slack = F.pow("__size", F.lit(3)) * 1e-14
    hit = ~F.col("flat") & ((F.least("s0", "s1", "s2") >= -slack) | (F.greatest("s0", "s1", "s2") <= slack))
    out = F.col("flat") & (F.col("__most") < -slack * F.col("__size"))
    x = x.groupBy(*keys, "flat").agg(F.max(hit).alias("hit"), F.max(out).alias("out"))
    return x.where("hit or (flat and not out)").select(*keys)


def crossings(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, fid_a, fid_b (fid_a < fid_b): faces of a shape that meet and share no vertex. Faces without area are left out. Candidates are faces whose boxes meet, found by cells."""
    good = shuffled(tri).where(F.expr(AREA2) > 1e-18)
    boxes = good.select(by, "fid", *[f(*[f"{a}{n}" for n in range(3)]).alias(f"{a}{k}") for a in AXES for k, f in ((0, F.least), (1, F.greatest))])
    side = lambda t: good.select(F.col(by), F.col("fid").alias(f"fid_{t}"), F.array("i", "j", "k").alias(f"v{t}"), *[F.col(f"{a}{n}").alias(f"{t}{n}_{a}") for n in range(3) for a in AXES])
    pairs = box_pairs(boxes, by).join(side("a"), [by, "fid_a"]).join(side("b"), [by, "fid_b"]).where(~F.arrays_overlap("va", "vb"))
    return overlapping(pairs, [by, "fid_a", "fid_b"])


def crossing_counts(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, n_intersections of every shape that has a face."""
    found = crossings(tri, by).groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    return shuffled(tri).select(by).distinct().join(found, by, "left").select(by, F.coalesce("n", F.lit(0)).alias("n_intersections"))


# -- a tree of cells


def _levels(n: Column, leaf: int) -> Column:
    """Depth at which a surface's cells, four times as many a level, hold some `leaf` faces."""
    return F.least(F.greatest(F.ceil(F.log2(n / leaf) / 2), F.lit(0)), F.lit(12)).cast("int")


class Tree:
    """Octree cells of each shape's faces, by the faces' centres: written tables `cells` (by, level, cx, cy, cz, n, leaf, area-weighted centre, first two moments of the normal vectors, box, radius) and `faces` (with their finest cell)."""

    def __init__(self, tri: DataFrame, by: str, leaf: int = 32):
        self.by, self.made = by, Tables(tri.sparkSession)
        t = shuffled(tri).dropna(subset=[by, *CORNERS]).select(by, "fid", *CORNERS, *[F.expr(f"({a}0 + {a}1 + {a}2) / 3").alias(f"m{a}") for a in AXES], *[F.expr(f"{normal(a)} / 2").alias(f"n{a}") for a in AXES])
        span = t.groupBy(by).agg(F.count(F.lit(1)).alias("__n"), *[F.min(f"m{a}").alias(f"__{a}") for a in AXES], F.greatest(*[F.max(f"m{a}") - F.min(f"m{a}") for a in AXES]).alias("__size"))
        span = lookup(self.made.kept(span.select(by, _levels(F.col("__n"), leaf).alias("top"), *[f"__{a}" for a in AXES], F.greatest("__size", F.lit(1e-300)).alias("__size"))))
        cell = lambda a: F.least(F.floor((F.col(f"m{a}") - F.col(f"__{a}")) / F.col("__size") * F.pow(F.lit(2.0), "top")), F.pow(F.lit(2.0), "top") - 1).cast("int")
        self.faces = self.made.kept(t.join(span, by).select(by, "fid", *CORNERS, *[f"{k}{a}" for k in "mn" for a in AXES], "top", *[cell(a).alias(f"c{a}") for a in AXES]))
        area = F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)
        f = self.faces.withColumn("area", area).withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top"))))
        at = [F.expr(f"shiftright(c{a}, top - level)").alias(f"c{a}") for a in AXES]
        f = f.select(by, "level", "top", *at, "area", *CORNERS, *[f"{k}{a}" for k in "mn" for a in AXES])
        sums = [x for a in AXES for x in (F.sum(F.col("area") * F.col(f"m{a}")).alias(f"w{a}"), F.avg(f"m{a}").alias(f"g{a}"), F.sum(f"n{a}").alias(f"d{a}"), F.min(F.least(*[f"{a}{k}" for k in range(3)])).alias(f"lo{a}"), F.max(F.greatest(*[f"{a}{k}" for k in range(3)])).alias(f"hi{a}"))]
        spread = [F.sum(F.col(f"n{a}") * F.col(f"m{b}")).alias(f"s{a}{b}") for a in AXES for b in AXES]
        g = f.groupBy(by, "level", "top", "cx", "cy", "cz").agg(F.count(F.lit(1)).alias("n"), F.sum("area").alias("area"), *sums, *spread)
        centre = {a: F.when(F.col("area") > 0, F.col(f"w{a}") / F.col("area")).otherwise(F.col(f"g{a}")) for a in AXES}
        g = g.select(by, "level", "cx", "cy", "cz", ((F.col("n") <= leaf) | (F.col("level") == F.col("top"))).alias("leaf"), *[centre[a].alias(f"o{a}") for a in AXES], *[f"{k}{a}" for k in ("d", "lo", "hi") for a in AXES], *[f"s{a}{b}" for a in AXES for b in AXES])
        g = g.withColumns({f"s{a}{b}": F.col(f"s{a}{b}") - F.col(f"d{a}") * F.col(f"o{b}") for a in AXES for b in AXES})
        far = F.sqrt(sum(F.pow(F.greatest(F.col(f"o{a}") - F.col(f"lo{a}"), F.col(f"hi{a}") - F.col(f"o{a}")), F.lit(2)) for a in AXES))
        self.cells = self.made.kept(g.withColumn("radius", far))
        self.top = self.cells.agg(F.max("level")).first()[0]
        if self.top:
            # a face's leaf is the first one on its way down
            path = self.faces.withColumn("level", F.explode(F.sequence(F.lit(0), F.col("top")))).select(by, "fid", "level", *at)
            first = path.join(self.cells.where("leaf").select(by, "level", "cx", "cy", "cz"), [by, "level", "cx", "cy", "cz"], "left_semi").groupBy(by, "fid").agg(F.min("level").alias("level"))
            self.faces = self.made.kept(self.faces.join(first, [by, "fid"]).select(by, "fid", *CORNERS, "level", *at))
        else:
            self.faces = self.faces.select(by, "fid", *CORNERS, F.lit(0).alias("level"), "cx", "cy", "cz")

    def root(self, points: DataFrame) -> DataFrame:
        """points (by, pid, x, y, z) with the root of their shape's tree."""
        return points.dropna(subset=[self.by, "pid", *AXES]).select(self.by, "pid", *AXES).join(self.cells.where("level = 0"), self.by)

    def below(self, rows: DataFrame) -> DataFrame:
        """Rows (by, pid, x, y, z, cells' columns) with each child of their cell instead of it."""
        up = [F.col(self.by), F.col("level"), *[F.col(f"c{a}") for a in AXES]]
        child = self.cells.withColumns({"__level": F.col("level") - 1, **{f"__c{a}": F.shiftright(f"c{a}", 1) for a in AXES}})
        p = rows.select(up[0], "pid", *AXES, *[c for c in ("best",) if c in rows.columns], up[1].alias("__level"), *[c.alias(f"__c{a}") for c, a in zip(up[2:], AXES)])
        return p.join(child, [self.by, "__level", *[f"__c{a}" for a in AXES]]).drop("__level", *[f"__c{a}" for a in AXES])

    def inside(self, rows: DataFrame, carry: list[str]) -> DataFrame:
        """Rows (by, level, cx, cy, cz of a leaf, carry) with each face of their cell."""
        return rows.select(self.by, "level", "cx", "cy", "cz", *carry).join(self.faces, [self.by, "level", "cx", "cy", "cz"])


def _gap(of: Column | str = "") -> Column:
    return F.sqrt(sum(F.pow(F.col(a) - F.col(f"o{a}"), F.lit(2)) for a in AXES))


def solid_angle() -> Column:
    """Of a face seen from (x, y, z), signed: positive from behind."""
    v = {(n, a): f"({a}{n} - {a})" for n in range(3) for a in AXES}
    length = [f"sqrt({' + '.join(f'{v[n, a]} * {v[n, a]}' for a in AXES)})" for n in range(3)]
    dot = lambda m, n: f"({' + '.join(f'{v[m, a]} * {v[n, a]}' for a in AXES)})"
    det = " + ".join(f"{v[0, a]} * ({v[1, b]} * {v[2, c]} - {v[1, c]} * {v[2, b]})" for a, b, c in ("xyz", "yzx", "zxy"))
    return F.expr(f"2 * atan2({det}, {length[0]} * {length[1]} * {length[2]} + {dot(0, 1)} * {length[2]} + {dot(1, 2)} * {length[0]} + {dot(2, 0)} * {length[1]})")


#: Solid angle of a far cell: dipole, and what its normals' places add in the first order.
_MOMENTS = (
    f"({' + '.join(f'd{a} * (o{a} - {a}) + s{a}{a}' for a in AXES)}) / power(__gap, 3)"
    f" - 3 * ({' + '.join(f's{a}{b} * (o{a} - {a}) * (o{b} - {b})' for a in AXES for b in AXES)}) / power(__gap, 5)"
)


def winding(points: DataFrame, tri: DataFrame, by: str = "shape_id", beta: float = 3.0, leaf: int = 32) -> DataFrame:
    """by, pid, winding: the winding number of a shape's faces around each of its points (by, pid, x, y, z).

    Cells further than beta times their radius count by two moments of their normals about their area-weighted centre;
    others are opened, leaves by their faces' exact solid angles. Points of shapes without faces are left out; repeated pids are one point.
    """
    tree = Tree(tri, by, leaf)
    if tree.top is None:
        return points.limit(0).select(by, "pid", F.lit(0.0).alias("winding"))
    front, sums, leaves = tree.root(points.dropDuplicates([by, "pid"])), [], []
    far = F.col("__gap") > beta * F.col("radius")
    for level in range(tree.top + 1):
        front = front.withColumn("__gap", _gap())
        front = tree.made.kept(front) if tree.top else front
        sums.append(front.where(far).select(by, "pid", F.expr(_MOMENTS).alias("angle")))
        leaves.append(front.where(~far & F.col("leaf")).select(by, "pid", *AXES, "level", "cx", "cy", "cz"))
        if level < tree.top:
            front = tree.below(front.where(~far & ~F.col("leaf")))
    near = tree.inside(reduce(DataFrame.unionByName, leaves), ["pid", *AXES]).select(by, "pid", solid_angle().alias("angle"))
    out = reduce(DataFrame.unionByName, [near, *sums]).groupBy(by, "pid").agg((F.sum("angle") / (4 * F.pi())).alias("winding"))
    return tree.made.last(out)


def _to_segment(m: int, n: int) -> str:
    """Squared distance from (x, y, z) to an edge of a face."""
    along = " + ".join(f"({a} - {a}{m}) * ({a}{n} - {a}{m})" for a in AXES)
    size = " + ".join(f"({a}{n} - {a}{m}) * ({a}{n} - {a}{m})" for a in AXES)
    t = f"least(greatest(coalesce(({along}) / nullif({size}, 0), 0), 0), 1)"
    return " + ".join(f"power({a} - {a}{m} - {t} * ({a}{n} - {a}{m}), 2)" for a in AXES)


def to_face() -> Column:
    """Squared distance from (x, y, z) to a face: to its plane where the foot lies inside, else to the nearest edge."""
    n = {a: normal(a) for a in AXES}
    inside = []
    for p, q in ((0, 1), (1, 2), (2, 0)):
        edge = {a: f"({a}{q} - {a}{p})" for a in AXES}
        turn = {a: f"({edge[b]} * ({c} - {c}{p}) - {edge[c]} * ({b} - {b}{p}))" for a, b, c in ("xyz", "yzx", "zxy")}
        inside.append(f"({' + '.join(f'{turn[a]} * {n[a]}' for a in AXES)}) >= 0")
    size = " + ".join(f"{n[a]} * {n[a]}" for a in AXES)
    height = " + ".join(f"({a} - {a}0) * {n[a]}" for a in AXES)
    rim = f"least({', '.join(_to_segment(p, q) for p, q in ((0, 1), (1, 2), (2, 0)))})"
    return F.expr(f"case when ({size}) > 0 and {' and '.join(inside)} then power({height}, 2) / ({size}) else {rim} end")


#: Pairs of a shape's points and faces that are measured in one task.
MOST_PAIRS = 10_000_000


def closest(points: DataFrame, tri: DataFrame, by: str = "shape_id", leaf: int = 32) -> DataFrame:
    """by, pid, fid, d2: the nearest face of its shape of each point (by, pid, x, y, z), the least fid of equals, and the squared distance to it.

    A cell's faces lie within its box, and all within its radius of its centre: cells whose box is further than the least
    of the others' far ends are closed, level by level; the faces of the leaves that remain are measured. Points of
    shapes without faces are left out; repeated pids are one point. Shapes of rounds.IN_ONE_TASK faces and points or fewer,
    and MOST_PAIRS pairs of both, are gathered once and all of their pairs measured where they are. A written table.
    """
    made = Tables(tri.sparkSession)
    faces = tri.dropna(subset=[by, *CORNERS]).select(by, "fid", *CORNERS)
    points = points.dropna(subset=[by, "pid", *AXES]).dropDuplicates([by, "pid"]).select(by, "pid", *[F.col(a).cast("double").alias(a) for a in AXES])
    count = lambda d, n: shuffled(d.groupBy(by).agg(F.count(F.lit(1)).alias(n)))
    large = count(faces, "n").join(count(points, "m"), by).where((F.greatest("n", "m") > rounds.IN_ONE_TASK) | (F.col("n") * F.col("m") > MOST_PAIRS))
    large = made.kept(large.select(by))
    some = None if large.isEmpty() else lookup(large)
    small = lambda d: shuffled(gathered(d if some is None else d.join(some, by, "left_anti"), by))
    both = small(faces).join(small(points).withColumnRenamed("e", "p"), "__key").select("__key", "e", "p")
    kind = {f.name: f.dataType.simpleString() for d in (faces, points) for f in d.schema}
    out = both.mapInArrow(_nearest, f"__key {kind[by]}, pid {kind['pid']}, fid {kind['fid']}, d2 double").withColumnRenamed("__key", by)
    return made.last(out if some is None else out.unionByName(_by_tree(points.join(some, by, "left_semi"), faces.join(some, by, "left_semi"), by, leaf)))


def _nearest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Key, pid, fid and d2 of (__key, e: faces, p: points)."""
    columns = lambda x: dict(zip((f.name for f in x.type.value_type), (c.to_numpy(zero_copy_only=False) for c in x.flatten().flatten())))
    spans = lambda x: x.offsets.to_numpy() - x.offsets[0].as_py()
    for batch in batches:
        e, p = batch.column(1), batch.column(2)
        face, pid = columns(e), p.flatten().flatten()[0]
        fid = face["fid"]
        corner, place = np.stack([face[c] for c in CORNERS], 1).reshape(-1, 3, 3), np.stack([x for c, x in columns(p).items() if c != "pid"], 1)
        key = np.repeat(np.arange(len(e)), np.diff(spans(e)))
        # the first of equals is the least fid
        order = np.lexsort((fid, key))
        fid, corner, found = fid[order], corner[order], []
        for (a, b), (c, d) in zip(zip(spans(e), spans(e)[1:]), zip(spans(p), spans(p)[1:])):
            row, d2 = nearest_face(place[c:d], corner[a:b])
            found.append((a + row, d2))
        row, d2 = (np.concatenate(x) for x in zip(*found)) if found else (np.zeros(0, np.int64), np.zeros(0))
        yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(np.repeat(np.arange(len(p)), np.diff(spans(p))))), pid, pa.array(fid[row]), pa.array(d2)], ["__key", "pid", "fid", "d2"])


def _by_tree(points: DataFrame, tri: DataFrame, by: str, leaf: int) -> DataFrame:
    """As closest, for shapes of any size."""
    tree = Tree(tri, by, leaf)
    if tree.top is None:
        return points.limit(0).select(by, "pid", F.lit(0).cast("long").alias("fid"), F.lit(0.0).alias("d2"))
    front, leaves = tree.root(points.dropDuplicates([by, "pid"])).withColumn("best", F.lit(float("inf"))), []
    near = F.sqrt(sum(F.pow(F.greatest(F.col(f"lo{a}") - F.col(a), F.col(a) - F.col(f"hi{a}"), F.lit(0.0)), F.lit(2)) for a in AXES))
    for level in range(tree.top + 1):
        x = front.withColumns({"near": near, "end": _gap() + F.col("radius")})
        best = x.groupBy(by, "pid").agg(F.min(F.least("end", "best")).alias("__best"))
        x = x.join(best, [by, "pid"]).withColumn("best", F.col("__best") * (1 + 1e-12)).drop("__best").where(F.col("near") <= F.col("best"))
        x = tree.made.kept(x) if level < tree.top else x
        leaves.append(x.where("leaf").select(by, "pid", *AXES, "level", "cx", "cy", "cz", "near", "best"))
        if level < tree.top:
            front = tree.below(x.where("not leaf"))
    every = reduce(DataFrame.unionByName, leaves)
    every = tree.made.kept(every) if tree.top else every
    best = every.groupBy(by, "pid").agg(F.min("best").alias("__best"))
    every = every.join(best, [by, "pid"]).where(F.col("near") <= F.col("__best"))
    found = tree.inside(every, ["pid", *AXES]).select(by, "pid", "fid", to_face().alias("d2"))
    return tree.made.last(found.groupBy(by, "pid").agg(F.min(F.struct("d2", "fid")).alias("m")).select(by, "pid", "m.fid", "m.d2"))
