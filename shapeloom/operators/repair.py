"""Repair of triangle tables by joins: small holes closed, faces turned to agree and outward."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Tables, components, same, shuffled
from .surfaces import AXES, VOLUME6, edges


def sound(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, sound: whether every edge of a shape has exactly two faces, which pass it in both directions."""
    e = edges(tri, by).groupBy(by, "lo", "hi").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("up"), 1).otherwise(-1)).alias("turn"))
    return e.groupBy(by).agg(F.min((F.col("n") == 2) & (F.col("turn") == 0)).alias("sound"))


def filled(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """tri with holes closed whose rim has three or four edges, by one or two faces from the rim's least vertex.

    A rim is a ring of edges of one face each, followed from its least vertex over both neighbours, which are joined; so
    no rim is walked. Longer rims stay open, and so do those that touch at a vertex. New faces have fids below 0 (faces
    are numbered from 0) and any direction.
    """
    made = Tables(tri.sparkSession)
    rim = edges(tri, by).groupBy(by, "lo", "hi").agg(F.count(F.lit(1)).alias("n")).where("n = 1 and lo <> hi")
    near = rim.select(by, F.col("lo").alias("v"), F.col("hi").alias("w")).unionByName(rim.select(by, F.col("hi").alias("v"), F.col("lo").alias("w")))
    near = made.kept(near.groupBy(by, "v").agg(F.min("w").alias("a"), F.max("w").alias("b"), F.count(F.lit(1)).alias("n")).where("n = 2").drop("n"))
    beside = lambda name: near.select(by, F.col("v").alias(name), (F.col("a") + F.col("b")).alias(f"{name}_sum"))
    # the vertex beyond either neighbour
    rings = near.where("v < a").join(beside("a"), [by, "a"]).join(beside("b"), [by, "b"]).withColumn("p", F.col("a_sum") - F.col("v")).withColumn("q", F.col("b_sum") - F.col("v"))
    three = rings.where("p = b").select(by, "v", "a", "b", F.lit(None).cast(near.schema["v"].dataType).alias("q"))
    four = rings.where("p = q and p > v").select(by, "v", "a", "b", "q").join(near.select(by, F.col("v").alias("q")), [by, "q"], "left_semi")
    rings = made.kept(three.unionByName(four.select(three.columns)))
    face = lambda t, *c: F.struct((-1 - t - 2 * F.col("v").cast("long")).alias("fid"), *[F.col(x).alias(n) for x, n in zip(c, "ijk")])
    new = F.when(F.col("q").isNull(), F.array(face(0, "v", "a", "b"))).otherwise(F.array(face(0, "v", "a", "q"), face(1, "v", "q", "b")))
    new = rings.select(by, F.explode(new).alias("f")).select(by, "f.*")
    wanted = new.select(by, F.explode(F.array("i", "j", "k")).alias("v")).distinct()
    corner = tri.select(by, F.explode(F.array(*[F.struct(F.col(c).alias("v"), *[F.col(f"{a}{n}").alias(a) for a in AXES]) for n, c in enumerate("ijk")])).alias("c")).select(by, "c.*")
    place = made.kept(corner.join(wanted, [by, "v"], "left_semi").groupBy(by, "v").agg(*[F.min(a).alias(a) for a in AXES]))
    for n, c in enumerate("ijk"):
        new = new.join(place.select(by, F.col("v").alias(c), *[F.col(a).alias(f"{a}{n}") for a in AXES]), [by, c])
    # what the caller's faces carry besides is unknown of new ones
    return made.last(tri.unionByName(new, allowMissingColumns=True).select(tri.columns))


def oriented(tri: DataFrame, by: str = "shape_id") -> DataFrame:
    """tri with faces turned so that neighbours agree and no component's volume is below zero; a turned face has its first and last corner exchanged.

    Faces are linked over edges of exactly two faces. Each face stands twice in a graph, as it is and turned; links join
    the two that agree, so a component falls into two sheets, and the one of the least face as it is is kept. Where both
    sheets are one (a Moebius strip) faces stay as they are. Work and rounds are those of components.
    """
    made = Tables(tri.sparkSession)
    e = edges(tri, by).groupBy(by, "lo", "hi").agg(F.min("fid").alias("f"), F.max("fid").alias("g"), F.count(F.lit(1)).alias("n"), F.sum(F.col("up").cast("int")).alias("ups")).where("n = 2 and f <> g")
    links = F.array(*[F.struct((2 * F.col("f") + s).alias("a"), (2 * F.col("g") + F.when(F.col("ups") == 1, s).otherwise(1 - s)).alias("b")) for s in (0, 1)])
    nodes = tri.select(by, F.explode(F.array(2 * F.col("fid"), 2 * F.col("fid") + 1)).alias("v"))
    label = components(nodes, e.select(by, F.explode(links).alias("l")).select(by, "l.*"), by)
    # the sheet of the least face as it is has an even label, that of it turned the next odd one
    sheet = label.where("v % 2 = 0").select(by, F.floor(F.col("v") / 2).alias("fid"), F.floor(F.col("label") / 2).alias("part"), (F.col("label").bitwiseAND(1) == 1).alias("turned"))
    t = made.kept(shuffled(tri).alias("t").join(sheet.alias("s"), same("t", "s", [by, "fid"])).select("t.*", F.col("s.part").alias("__part"), F.col("s.turned").alias("__turned")))
    signed = F.sum(F.when(F.col("__turned"), -F.expr(VOLUME6)).otherwise(F.expr(VOLUME6)))
    inward = t.groupBy(by, "__part").agg((signed < 0).alias("__inward"))
    t = t.join(inward, [by, "__part"]).withColumn("__swap", F.col("__turned") != F.col("__inward"))
    swapped = {c: F.when(F.col("__swap"), F.col(d)).otherwise(F.col(c)) for c, d in (("i", "k"), ("k", "i"), *((f"{a}{m}", f"{a}{n}") for a in AXES for m, n in ((0, 2), (2, 0))))}
    return made.last(t.select(*[swapped[c].alias(c) if c in swapped else c for c in tri.columns]))


def repaired(tri: DataFrame, by: str = "shape_id") -> tuple[DataFrame, DataFrame]:
    """(faces; by, repaired, ok): sound shapes as they are, small holes of the others closed and their faces turned; ok: sound after it (0/1). Each fid stands once in a shape. Written tables."""
    made = Tables(tri.sparkSession)
    state = made.kept(sound(tri, by))
    broken = made.kept(tri.join(state.where("not sound"), by, "left_semi"))
    mended = made.kept(oriented(filled(broken, by), by))
    good = tri.join(state.where("sound"), by, "left_semi")
    faces = made.kept(good.unionByName(mended.select(good.columns)))
    after = sound(mended, by).select(by, F.col("sound").alias("after"))
    report = made.kept(state.join(after, by, "left").select(by, (~F.col("sound")).cast("int").alias("repaired"), F.coalesce("after", "sound").cast("int").alias("ok")))
    made.drop(2)
    return faces, report
