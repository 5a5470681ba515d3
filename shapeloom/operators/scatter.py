"""Points scattered over triangle tables: uniform by area, and evenly spread."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.sampling import thinned
from . import rounds
from .rounds import Tables, gathered, larger, lookup, same, shuffled
from .surfaces import AREA2, AXES, CORNERS, normal

#: Areas are whole numbers of a shape's share in this, so that their sums do not depend on the order.
WHOLE = 1 << 40


def _digits(text: Column, start: int, n: int) -> Column:
    return F.conv(F.substring(text, start, n), 16, 10).cast("long")


#: Points that are drawn at once, or those of one shape.
AT_ONCE = 200_000
_POINT = ["pid", "fid", *AXES, *[f"n{a}" for a in AXES]]


def _sized(tri: DataFrame, by: str) -> DataFrame:
    """by, fid, corners, twice the area and normal of the faces that have an area."""
    x = tri.where(F.col(by).isNotNull()).select(by, "fid", *CORNERS, F.expr(AREA2).alias("area2"), *[F.expr(normal(a)).alias(f"n{a}") for a in AXES])
    return x.where((F.col("area2") > 0) & (F.col("area2") < float("inf")))


class _Faces:
    """Faces of several shapes, as columns of (shape, fid) in order, to draw points from as `sampled` does."""

    def __init__(self, names: list[str], shape: np.ndarray, column: dict[str, np.ndarray]):
        self.names, n = names, len(names)
        most, count = np.zeros(n), np.bincount(shape, minlength=n)
        np.maximum.at(most, shape, column["area2"])
        self.area2 = np.bincount(shape, column["area2"], n)
        w = np.floor(column["area2"] / (most[shape] * count[shape] / WHOLE)).astype(np.int64)
        order = np.lexsort((column["fid"], shape))
        order = order[w[order] > 0]
        self.column, shape = {c: x[order] for c, x in column.items()}, shape[order]
        self.upto = np.cumsum(w[order])
        ends = np.concatenate([[0], self.upto])[np.searchsorted(shape, np.arange(n + 1))]
        self.start, self.whole = ends[:-1], np.diff(ends)

    def drawn(self, shape: np.ndarray, pid: np.ndarray, seed: int) -> list[np.ndarray]:
        """fid, x, y, z and unit normals of the points pid of shapes."""
        sha = b"".join([hashlib.sha1(f"{seed}/{self.names[k]}/{p}".encode()).digest() for k, p in zip(shape.tolist(), pid.tolist())])
        sha = np.frombuffer(sha, np.dtype([("a", ">u8"), ("b", ">u8"), ("c", ">u4")]))
        a, b, c = (sha[x].astype(np.int64 if x == "c" else np.uint64) for x in "abc")
        bits = lambda x, n: (x & np.uint64((1 << n) - 1)).astype(np.int64)
        # 15, 12 and 12 of its digits
        u = (a >> np.uint64(4)).astype(np.int64) % self.whole[shape]
        r = np.sqrt((bits(a, 4) << 44 | (b >> np.uint64(20)).astype(np.int64)) / float(1 << 48))
        s = (bits(b, 20) << 28 | c >> 4) / float(1 << 48)
        f = np.searchsorted(self.upto, u + self.start[shape], "right")
        x = {k: v[f] for k, v in self.column.items()}
        return [x["fid"], *[(1 - r) * x[f"{a}0"] + r * (1 - s) * x[f"{a}1"] + r * s * x[f"{a}2"] for a in AXES], *[x[f"n{a}"] / x["area2"] for a in AXES]]


def _points(faces: _Faces, n: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """Shapes, and the columns of _POINT: n points of each that has an area."""
    shape, pid = np.repeat(np.flatnonzero(faces.whole), n), np.tile(np.arange(n), np.count_nonzero(faces.whole))
    return shape, [pid, *faces.drawn(shape, pid, seed)]


def _evenly(faces: _Faces, n: int, seed: int) -> tuple[np.ndarray, list[np.ndarray]]:
    """As _points, of `cloud`, with even."""
    shape, dense = _points(faces, 3 * n, seed)
    place, some = np.stack(dense[2:5], 1), np.flatnonzero(faces.whole)
    kept = [3 * n * k + thinned(place[3 * n * k : 3 * n * (k + 1)], float(r), n) for k, r in enumerate(np.sqrt(faces.area2[some] / 2 / (3 * n)))]
    have = np.array([len(k) for k in kept], np.int64)
    kept = np.concatenate(kept) if kept else np.zeros(0, np.int64)
    within = lambda m: np.arange(m.sum()) - np.repeat(np.cumsum(m) - m, m)
    more, pid = np.repeat(some, n - have), within(n - have)
    plain = faces.drawn(more, pid, seed + 1)
    both = [np.concatenate(x) for x in zip([within(have), *[x[kept] for x in dense[1:]]], [pid + np.repeat(have, n - have), *plain])]
    return np.concatenate([shape[kept], more]), [*both, np.arange(len(both[0])) < len(kept)]


def _here(faces: DataFrame, draw: Callable, n: int, made: list[str], by: str) -> DataFrame:
    """Points that draw(faces) gives, shape by shape: faces are gathered once, and those of some AT_ONCE points drawn from together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_once = max(1, AT_ONCE // max(1, n))
        for b in (batch.slice(k, at_once) for batch in batches for k in range(0, len(batch), at_once)):
            e = b.column(1)
            column = dict(zip((f.name for f in e.type.value_type), (x.to_numpy(zero_copy_only=False) for x in e.flatten().flatten())))
            shape, points = draw(_Faces(b.column(2).to_pylist(), np.repeat(np.arange(len(e)), np.diff(e.offsets.to_numpy())), column))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(shape)), *map(pa.array, points)], ["__key", *made])

    kind = {f.name: f.dataType.simpleString() for f in faces.schema} | {"pid": "bigint", "even": "boolean"}
    rows = gathered(faces, by).withColumn("__name", F.col("__key").cast("string"))
    return rows.mapInArrow(run, ", ".join([f"__key {kind[by]}", *[f"{c} {kind.get(c, 'double')}" for c in made]])).withColumnRenamed("__key", by)


def sampled(tri: DataFrame, n: int, seed: int = 0, by: str = "shape_id") -> DataFrame:
    """by, pid (0 to n - 1), fid, x, y, z and the face's unit normal nx, ny, nz: n points of each shape, uniform over its area.

    Prefix sums of the areas are taken in ranges of (by, fid), so a large mesh is not one task; shapes of
    rounds.IN_ONE_TASK faces or fewer are gathered once and drawn from where they are. A point's place in the
    whole area and in its face is the SHA-1 of seed, key and pid, the same in every layout. Places and faces meet in
    buckets of the area, as many as a shape has faces and points, so both sides stay linear. Faces without area, or
    under 2^-40 of faces times the largest one, get no point; a shape without area has none. A written table; each fid stands once in a shape.
    """
    made = Tables(tri.sparkSession)
    x = _sized(tri, by)
    if n > rounds.IN_ONE_TASK:
        return _sampled(x, n, seed, by)
    large = larger(x, made, by)
    out = _here(x if large is None else x.join(large, by, "left_anti"), lambda f: _points(f, n, seed), n, _POINT, by)
    return made.last(out if large is None else out.unionByName(_sampled(x.join(large, by, "left_semi"), n, seed, by)))


def _sampled(x: DataFrame, n: int, seed: int, by: str) -> DataFrame:
    """As sampled, for shapes of any size."""
    spark = x.sparkSession
    made = Tables(spark)
    x = made.kept(x)
    unit = x.groupBy(by).agg((F.max("area2") * F.count(F.lit(1)) / WHOLE).alias("unit"))
    x = x.join(lookup(made.kept(unit)), by).withColumn("w", F.floor(F.col("area2") / F.col("unit")).cast("long")).where("w > 0").drop("unit")
    x = made.kept(x.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), by, "fid").withColumn("part", F.spark_partition_id()))
    # a shape has at most one row a range here
    sums, earlier = x.groupBy(by, "part").agg(F.sum("w").alias("s"), F.count(F.lit(1)).alias("n")), (Window.unboundedPreceding, -1)
    sums = made.kept(sums.withColumn("start", F.coalesce(F.sum("s").over(Window.partitionBy(by).orderBy("part").rowsBetween(*earlier)), F.lit(0))))
    whole = made.kept(sums.groupBy(by).agg(F.sum("s").alias("whole"), F.sum("n").alias("faces")).select(by, "whole", F.ceil(F.col("whole") / (F.col("faces") + n)).alias("width")))
    inside = F.coalesce(F.sum("w").over(Window.partitionBy(by, "part").orderBy("fid").rowsBetween(*earlier)), F.lit(0))
    x = x.withColumn("inside", inside).join(sums.select(by, "part", "start"), [by, "part"]).withColumn("first", F.col("inside") + F.col("start")).join(lookup(whole), by)
    bucket = lambda c: F.floor(c / F.col("width")).cast("long")
    x = x.select(by, "fid", *CORNERS, *[f"n{a}" for a in AXES], "area2", "first", (F.col("first") + F.col("w")).alias("end"), F.explode(F.sequence(bucket(F.col("first")), bucket(F.col("first") + F.col("w") - 1))).alias("bucket"))
    draw = whole.select(by, "whole", "width", F.explode(F.sequence(F.lit(0), F.lit(n - 1)).cast("array<long>") if n > 0 else F.array().cast("array<long>")).alias("pid"))
    draw = draw.withColumn("sha", F.sha1(F.concat_ws("/", F.lit(str(seed)), F.col(by).cast("string"), F.col("pid").cast("string"))))
    draw = draw.withColumn("u", _digits(F.col("sha"), 1, 15) % F.col("whole"))
    draw = draw.select(by, "pid", "u", bucket(F.col("u")).alias("bucket"), F.sqrt(_digits(F.col("sha"), 16, 12) / float(1 << 48)).alias("r"), (_digits(F.col("sha"), 28, 12) / float(1 << 48)).alias("s"))
    met = draw.join(x, [by, "bucket"]).where("u >= first and u < end")
    at = [((1 - F.col("r")) * F.col(f"{a}0") + F.col("r") * (1 - F.col("s")) * F.col(f"{a}1") + F.col("r") * F.col("s") * F.col(f"{a}2")).alias(a) for a in AXES]
    return made.last(met.select(by, "pid", "fid", *at, *[(F.col(f"n{a}") / F.col("area2")).alias(f"n{a}") for a in AXES]))


def spread(points: DataFrame, by: str = "shape_id", radius: str = "radius", order: str = "pid") -> DataFrame:
    """The points (by, pid, x, y, z, radius, ...) that are kept when each, by ascending `order` and pid, is dropped that lies within the radius of one kept before it. A shape's rows share one radius; where it is not positive all are kept.

    Shapes of rounds.IN_ONE_TASK points or fewer are gathered once and taken in turn where they are.
    Rounds, for larger ones: each cell of 0.57 radii puts up its first point; one that no point still in question within the radius comes
    before is kept, and all within the radius of it go. A point meets at most the 125 candidates around it, so work is
    linear in the points however dense they are. The number of rounds is logarithmic where the order is random (a
    hash, or the draws of `sampled`), and as long as the longest ordered chain of neighbours otherwise. Rows with a null key, pid, order or coordinate are left out, and each pid
    stands once in a shape. A written table.
    """
    made = Tables(points.sparkSession)
    full = points.dropna(subset=[by, "pid", order, *AXES])
    some = full.where(F.col(radius) > 0)
    large = larger(some, made, by)
    # the pid and the order may be one column
    small = gathered((some if large is None else some.join(large, by, "left_anti")).select(by, F.struct(*points.columns).alias("row"), F.struct(F.col(order).alias("o"), F.col("pid").alias("pid"), *[F.col(a).cast("double").alias(a) for a in AXES], F.col(radius).cast("double").alias("r")).alias("at")), by)
    schema = T.StructType([T.StructField("row", T.StructType(points.schema.fields))])
    out = full.where(~F.coalesce(F.col(radius) > 0, F.lit(False))).unionByName(small.mapInArrow(_in_turn, schema).select("row.*"))
    if large is not None:
        out = out.unionByName(_spread(some.join(large, by, "left_semi").select(points.columns), by, radius, order))
    return made.last(out)


def _in_turn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The rows that are kept of (__key, e: rows and their order, place and radius)."""
    for batch in batches:
        e = batch.column(1)
        row, at = e.flatten().flatten()
        o, pid, x, y, z, r = at.flatten()
        key = np.repeat(np.arange(len(e)), np.diff(e.offsets.to_numpy()))
        by = pc.sort_indices(pa.table({"k": key, "o": o, "pid": pid}), [("k", "ascending"), ("o", "ascending"), ("pid", "ascending")]).to_numpy()
        place, r = np.stack([a.to_numpy(zero_copy_only=False)[by] for a in (x, y, z)], 1), r.to_numpy(zero_copy_only=False)
        # a key's rows stay together in the order
        ends = e.offsets.to_numpy() - e.offsets[0].as_py()
        kept = [by[a + thinned(place[a:b], float(r[a]))] for a, b in zip(ends[:-1].tolist(), ends[1:].tolist()) if b > a]
        yield pa.RecordBatch.from_arrays([row.take(pa.array(np.concatenate(kept) if kept else np.zeros(0, np.int64)))], ["row"])


def _spread(full: DataFrame, by: str, radius: str, order: str) -> DataFrame:
    """As spread, for shapes of any size; radii are positive."""
    spark = full.sparkSession
    made, state = Tables(spark), Tables(spark)
    size = F.col("r") * 0.57
    alive = full.select(by, F.struct(F.col(order).alias("o"), F.col("pid").alias("pid")).alias("key"), *AXES, F.col(radius).cast("double").alias("r"))
    alive = state.kept(alive.select("*", *[F.floor(F.col(a) / size).alias(f"c{a}") for a in AXES]))
    cell, kept = [f"c{a}" for a in AXES], []
    offsets = F.explode(F.array(*[F.struct(*[F.lit(d).alias(a) for a, d in zip(AXES, (k // 25 - 2, k // 5 % 5 - 2, k % 5 - 2))]) for k in range(125)])).alias("d")
    while not alive.isEmpty():
        first = alive.groupBy(by, *cell).agg(F.min(F.struct("key", *AXES)).alias("m")).select(by, "m", *cell, offsets)
        first = first.select(by, "m", *[(F.col(f"c{a}") + F.col(f"d.{a}")).alias(f"c{a}") for a in AXES])
        near = sum((F.col(a) - F.col(f"m.{a}")) ** 2 for a in AXES) <= F.col("r") ** 2
        met = state.kept(first.join(alive, [by, *cell]).where(near).select(by, F.col("m.key").alias("first"), "key"))
        won = state.kept(met.groupBy(by, "first").agg(F.max((F.col("key") < F.col("first")).cast("int")).alias("later")).where("later = 0").select(by, "first"))
        kept.append(made.kept(won.select(by, F.col("first.pid").alias("pid"))))
        gone = met.join(won, [by, "first"], "left_semi").select(by, "key").distinct()
        alive = state.kept(alive.join(gone, [by, "key"], "left_anti"))
        state.drop(1)
    state.drop()
    if not kept:
        return full
    names = kept[0]
    for k in kept[1:]:
        names = names.unionByName(k)
    return made.last(full.alias("p").join(shuffled(names).alias("k"), same("p", "k", [by, "pid"]), "left_semi").select(full.columns))


def cloud(tri: DataFrame, n: int, seed: int = 0, by: str = "shape_id") -> DataFrame:
    """by, pid (0 to n - 1), even, fid, x, y, z, nx, ny, nz: of 3 n samples in order, those with none kept within the radius sqrt(area / 3 n) before them, at most n; then plain samples of the next seed up to n, with even = false. A shape without area has none. Shapes of rounds.IN_ONE_TASK faces or fewer are gathered once, and all is done where they are. A written table."""
    made = Tables(tri.sparkSession)
    columns = [by, "pid", "even", *_POINT[1:]]
    if 3 * n > rounds.IN_ONE_TASK:
        return _cloud(tri, n, seed, by).select(columns)
    x = _sized(tri, by)
    large = larger(x, made, by)
    out = _here(x if large is None else x.join(large, by, "left_anti"), lambda f: _evenly(f, n, seed), 3 * n, [*_POINT, "even"], by).select(columns)
    return made.last(out if large is None else out.unionByName(_cloud(tri.join(large, by, "left_semi"), n, seed, by)))


def _cloud(tri: DataFrame, n: int, seed: int, by: str) -> DataFrame:
    """As cloud, by joins."""
    made = Tables(tri.sparkSession)
    radius = tri.where(F.expr(AREA2) < float("inf")).groupBy(by).agg(F.sqrt(F.sum(F.expr(AREA2)) / 2 / (3 * n)).alias("radius"))
    even = spread(sampled(tri, 3 * n, seed, by).join(radius, by), by).drop("radius")
    # at most 3 n rows a shape
    even = made.kept(even.withColumn("pid", F.row_number().over(Window.partitionBy(by).orderBy("pid")).cast("long") - 1).where(F.col("pid") < n).withColumn("even", F.lit(True)))
    have = even.groupBy(by).agg(F.count(F.lit(1)).alias("have"))
    more = sampled(tri, n, seed + 1, by).join(have, by).where(F.col("pid") < n - F.col("have")).withColumn("pid", F.col("pid") + F.col("have")).drop("have").withColumn("even", F.lit(False))
    columns = [by, "pid", "even", *_POINT[1:]]
    return made.last(even.select(columns).unionByName(more.select(columns)))
