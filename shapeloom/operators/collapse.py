"""Simplification of triangle tables by rounds of independent edge collapses."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.simplify import MOST_FACES, TURN, in_rounds
from .rounds import Tables, gathered, larger, same, shuffled
from .surfaces import AXES, CORNERS, normal

#: Coefficients of a quadric: products of (x, y, z, 1) with itself.
_PAIRS = [("x", "x"), ("x", "y"), ("x", "z"), ("x", "d"), ("y", "y"), ("y", "z"), ("y", "d"), ("z", "z"), ("z", "d"), ("d", "d")]
_Q = [f"q{a}{b}" for a, b in _PAIRS]
#: Faces whose edges and their surroundings are held at once, or those of one shape.
AT_ONCE = 20_000


def _around(tri: DataFrame, by: str) -> DataFrame:
    """by, fid, u, s, t and their places: each face from each of its corners, in turn."""
    turns = [F.struct(*[F.col("ijk"[(n + m) % 3]).alias(c) for m, c in enumerate("ust")], *[F.col(f"{a}{(n + m) % 3}").alias(f"{c}{a}") for m, c in enumerate("ust") for a in AXES]) for n in range(3)]
    return tri.select(by, "fid", F.explode(F.array(*turns)).alias("c")).select(by, "fid", "c.*")


def _quadrics(tri: DataFrame, by: str) -> DataFrame:
    """by, v and the sum of its faces' plane quadrics, weighted by area."""
    f = tri.select(by, "i", "j", "k", *CORNERS, *[F.expr(normal(a)).alias(f"n{a}") for a in AXES])
    f = f.withColumn("size", F.sqrt(F.col("nx") ** 2 + F.col("ny") ** 2 + F.col("nz") ** 2)).where("size > 0").withColumn("nd", -(F.col("nx") * F.col("x0") + F.col("ny") * F.col("y0") + F.col("nz") * F.col("z0")))
    f = f.select(by, F.explode(F.array("i", "j", "k")).alias("v"), *[(F.col(f"n{a}") * F.col(f"n{b}") / F.col("size")).alias(q) for q, (a, b) in zip(_Q, _PAIRS)])
    return f.groupBy(by, "v").agg(*[F.sum(q).alias(q) for q in _Q])


def _cost(p: list[Column]) -> Column:
    """The quadric at a place."""
    at = dict(zip("xyzd", [*p, F.lit(1.0)]))
    return sum(F.col(q) * at[a] * at[b] * (1 if a == b else 2) for q, (a, b) in zip(_Q, _PAIRS))


def _best() -> Column:
    """The cheapest of the quadric's own minimum (where it is well determined), the middle and both ends: cost, x, y, z."""
    det = "(qxx * (qyy * qzz - qyz * qyz) - qxy * (qxy * qzz - qyz * qxz) + qxz * (qxy * qyz - qyy * qxz))"
    minimum = [
        f"-(qxd * (qyy * qzz - qyz * qyz) - qxy * (qyd * qzz - qyz * qzd) + qxz * (qyd * qyz - qyy * qzd)) / {det}",
        f"-(qxx * (qyd * qzz - qyz * qzd) - qxd * (qxy * qzz - qyz * qxz) + qxz * (qxy * qzd - qyd * qxz)) / {det}",
        f"-(qxx * (qyy * qzd - qyd * qyz) - qxy * (qxy * qzd - qyd * qxz) + qxd * (qxy * qyz - qyy * qxz)) / {det}",
    ]
    sure = F.expr(f"{det} > 1e-3 * power((qxx + qyy + qzz) / 3, 3)")
    option = lambda n, p: F.struct(F.greatest(_cost(p), F.lit(0.0)).alias("cost"), F.lit(n).alias("n"), *[c.alias(a) for c, a in zip(p, AXES)])
    ends = [[F.col(f"{c}{a}") for a in AXES] for c in "us"]
    middle = [(p + q) / 2 for p, q in zip(*ends)]
    plain = F.least(option(1, middle), option(2, ends[0]), option(3, ends[1]))
    return F.when(sure, F.least(option(0, [F.expr(m) for m in minimum]), plain)).otherwise(plain)


def _allowed(around: DataFrame, quadrics: DataFrame, by: str) -> DataFrame:
    """by, u, s (u < s), key, x, y, z: edges that may go, with cost and place. Edge and ends lie inside a sound surface; the ends share just two neighbours, which keep three faces or more; no face is turned over."""
    low = F.col("u") < F.col("s")
    e = around.groupBy(by, F.least("u", "s").alias("lo"), F.greatest("u", "s").alias("hi")).agg(F.count(F.lit(1)).alias("n"), F.sum(low.cast("int")).alias("ups"))
    degree = around.groupBy(by, "u").agg(F.count(F.lit(1)).alias("degree"))
    fixed = e.where("n <> 2 or ups <> 1").select(by, F.explode(F.array("lo", "hi")).alias("u")).unionByName(degree.where(F.col("degree") > MOST_FACES).select(by, "u")).distinct()
    quad = shuffled(quadrics.join(fixed.select(by, F.col("u").alias("v")), [by, "v"], "left_anti"))
    part = lambda c: quad.select(by, F.col("v").alias(c), *[F.col(q).alias(f"{c}_{q}") for q in _Q])
    x = around.where(low).select(by, "u", "s", *[f"{c}{a}" for c in "us" for a in AXES]).join(part("u"), [by, "u"]).join(part("s"), [by, "s"])
    x = x.select(by, "u", "s", *[f"{c}{a}" for c in "us" for a in AXES], *[(F.col(f"u_{q}") + F.col(f"s_{q}")).alias(q) for q in _Q])
    x = x.select(by, F.col("u").alias("lo"), F.col("s").alias("hi"), F.explode(F.array(_best())).alias("b")).where(F.col("b.cost") < float("inf"))
    x = x.select(by, "lo", "hi", F.col("b.cost").alias("cost"), *[F.col(f"b.{a}").alias(f"p{a}") for a in AXES], F.explode(F.array(F.struct(F.col("lo").alias("u"), F.col("hi").alias("other")), F.struct(F.col("hi").alias("u"), F.col("lo").alias("other")))).alias("e"))
    x = x.select(by, "lo", "hi", "cost", *[f"p{a}" for a in AXES], "e.u", "e.other")
    ring = around.join(degree.select(by, F.col("u").alias("s"), F.col("degree").alias("s_degree")), [by, "s"])
    x = x.join(shuffled(ring), [by, "u"])
    cross = lambda c, a, b: (F.col(f"s{a}") - F.col(f"{c}{a}")) * (F.col(f"t{b}") - F.col(f"{c}{b}")) - (F.col(f"s{b}") - F.col(f"{c}{b}")) * (F.col(f"t{a}") - F.col(f"{c}{a}"))
    turns = ("yz", "zx", "xy")
    dot = lambda c, d: sum(cross(c, a, b) * cross(d, a, b) for a, b in turns)
    both = (F.col("s") == F.col("other")) | (F.col("t") == F.col("other"))
    fine = both | ((dot("u", "p") > 0) & (dot("u", "p") >= TURN * F.sqrt(dot("u", "u")) * F.sqrt(dot("p", "p"))))
    x = x.groupBy(by, "lo", "hi").agg(F.first("cost").alias("cost"), *[F.first(f"p{a}").alias(a) for a in AXES], F.min(fine).alias("fine"), F.count(F.lit(1)).alias("n"), F.size(F.collect_set("s")).alias("near"), F.min(F.when(F.col("t") == F.col("other"), F.col("s_degree"))).alias("left"))
    x = x.where("fine and n - near = 2 and left > 3")
    return x.select(by, "lo", "hi", F.struct(F.col("cost").cast("float").alias("cost"), F.xxhash64("lo", "hi").alias("h"), "lo", "hi").alias("key"), *AXES)


def _independent(edges: DataFrame, around: DataFrame, by: str) -> DataFrame:
    """Those edges that come first by key among all that have an end at or beside one of their ends: no two of them touch or are joined by an edge."""
    ends = edges.select(by, "key", F.explode(F.array("lo", "hi")).alias("u"))
    at = ends.groupBy(by, "u").agg(F.min("key").alias("first"))
    beside = around.select(by, "u", "s").unionByName(around.select(by, F.col("s").alias("u"), F.col("u").alias("s"))).distinct()
    near = beside.join(at.select(by, F.col("u").alias("s"), "first"), [by, "s"]).select(by, "u", "first").unionByName(at).groupBy(by, "u").agg(F.min("first").alias("first"))
    won = ends.join(near, [by, "u"]).groupBy(by, "key").agg(F.min("first").alias("first")).where(F.col("first") == F.col("key")).select(by, "key")
    return edges.join(won, [by, "key"], "left_semi")


def _here(target: int, most_rounds: int):
    """The faces that are left of (__key, e: its faces), whole shapes of some AT_ONCE faces together."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ends = batch.column(1).offsets.to_numpy() - batch.column(1).offsets[0].as_py()
            column = dict(zip((f.name for f in batch.column(1).type.value_type), (x.to_numpy(zero_copy_only=False) for x in batch.column(1).flatten().flatten())))
            first = 0
            while first < len(batch):
                last = max(first + 1, int(np.searchsorted(ends, ends[first] + AT_ONCE, "right")) - 1)
                at = slice(ends[first], ends[last])
                shape = np.repeat(np.arange(last - first), np.diff(ends[first : last + 1]))
                rows, f, corner = in_rounds(shape, np.stack([column[c][at] for c in "ijk"], 1), np.stack([column[c][at] for c in CORNERS], 1).reshape(-1, 3, 3), target, most_rounds)
                corner = corner.reshape(-1, 9)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(first, last - first).take(pa.array(shape[rows])), pa.array(column["fid"][at][rows]), *[pa.array(x) for x in f.T], *[pa.array(x) for x in corner.T]], ["__key", "fid", *"ijk", *CORNERS])
                first = last

    return run


def simplified(tri: DataFrame, target: int, by: str = "shape_id", most_rounds: int = 1000) -> DataFrame:
    """The triangle table (by, fid, i, j, k, x0 ... z2) with at most `target` faces a shape where collapses allow it: quadrics, cheapest edges first
    (costs in single precision, equal ones by a hash of the ends, so that the order of the rows does not matter).

    Each round, every edge that is the cheapest among all that have an end at or beside its own is collapsed; such edges
    do not influence one another, so a large mesh is simplified by all tasks at once, some tenth of its vertices a round.
    An edge may go where the surface stays sound (its ends share just two neighbours, neither of three faces) and no face turns over; rims,
    edges of other than two faces and vertices of more than 64 faces stay. Of the collapses that would leave fewer than
    `target` faces (or one less), the dearest wait. A shape ends when it has `target` faces or no edge may go. Shapes of
    rounds.IN_ONE_TASK faces or fewer are gathered once and go through the same rounds where they are; of larger ones each
    round is written. Rows with unknown values are left out; vertices keep the number of their lesser end. A written table.
    """
    made = Tables(tri.sparkSession)
    faces = tri.select(by, "fid", *[F.col(c).cast("long").alias(c) for c in "ijk"], *[F.col(c).cast("double").alias(c) for c in CORNERS]).dropna().where("i <> j and j <> k and k <> i")
    large = larger(faces, made, by)
    small = gathered(faces if large is None else faces.join(large, by, "left_anti"), by)
    kind = {f.name: f.dataType.simpleString() for f in faces.schema}
    out = small.mapInArrow(_here(target, most_rounds), ", ".join([f"__key {kind[by]}", *[f"{c} {kind[c]}" for c in faces.columns if c != by]])).withColumnRenamed("__key", by)
    return made.last(out if large is None else out.unionByName(_spread(faces.join(large, by, "left_semi"), target, by, most_rounds)))


def _spread(faces: DataFrame, target: int, by: str, most_rounds: int) -> DataFrame:
    """As simplified, for shapes of any size."""
    spark = faces.sparkSession
    made, state = Tables(spark), Tables(spark)
    faces = state.kept(faces)
    quadrics, done = state.kept(_quadrics(faces, by)), []
    for _ in range(most_rounds):
        count = faces.groupBy(by).agg(F.count(F.lit(1)).alias("n_faces"))
        around = state.kept(_around(faces.join(count.where(F.col("n_faces") > target).select(by), by, "left_semi"), by))
        allowed = state.kept(_allowed(around, quadrics, by))
        won = state.kept(_independent(allowed, around, by))
        # a collapse takes two faces; where there are more than needed, the cheapest go (a share of them where they are very many)
        room = won.groupBy(by).agg(F.count(F.lit(1)).alias("won")).join(count, by).withColumn("room", F.ceil((F.col("n_faces") - target) / 2))
        fits = won.join(room.where("won <= room").select(by), by, "left_semi")
        over = won.join(room.where("won > room and won <= 100000").select(by, "room"), by)
        over = over.withColumn("r", F.row_number().over(Window.partitionBy(by).orderBy("key"))).where("r <= room").select(won.columns)
        many = won.join(room.where("won > room and won > 100000").select(by, (F.col("room") / F.col("won")).alias("share")), by)
        many = many.where((F.pmod("key.h", F.lit(1 << 20)) + 0.5) / (1 << 20) < 0.9 * F.col("share")).select(won.columns)
        won = state.kept(fits.unionByName(over).unionByName(many).drop("key"))
        # shapes that have no more to do go to the result
        going = state.kept(won.select(by).distinct())
        done.append(made.kept(faces.join(going, by, "left_anti")))
        if going.isEmpty():
            break
        moved = won.select(by, F.explode(F.array("lo", "hi")).alias("v"), F.col("lo").alias("to"), *AXES)
        f = faces.join(going, by, "left_semi")
        for n, c in enumerate("ijk"):
            m = moved.select(by, F.col("v").alias(c), F.col("to").alias(f"__{c}"), *[F.col(a).alias(f"__{a}{n}") for a in AXES])
            f = f.join(m, [by, c], "left").withColumns({f"{a}{n}": F.coalesce(f"__{a}{n}", f"{a}{n}") for a in AXES})
        f = f.select(by, "fid", *[F.coalesce(f"__{c}", c).alias(c) for c in "ijk"], *CORNERS).where("i <> j and j <> k and k <> i")
        faces = state.kept(f)
        q = quadrics.join(going, by, "left_semi").alias("q").join(moved.select(by, "v", "to").alias("m"), same("q", "m", [by, "v"]), "left")
        quadrics = state.kept(q.groupBy(F.col(f"q.{by}").alias(by), F.coalesce("m.to", "q.v").alias("v")).agg(*[F.sum(c).alias(c) for c in _Q]))
        state.drop(2)
    else:
        done.append(made.kept(faces))
    out = made.last(reduce(DataFrame.unionByName, done))
    state.drop()
    return out
