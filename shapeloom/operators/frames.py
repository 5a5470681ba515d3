"""Operators on a user's own DataFrames: gates, splits, pairs, ranks, spatial joins, batches.

All are built-in functions and joins on keys, but for the running best, which folds ranges of the log.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .rounds import Tables, lookup, shuffled
from .scans import running_best  # noqa: F401

#: Sizes of cells in which nearest points are sought: the largest is eight times the mean spacing of points that fill
#: their box, the smallest a 16th of it, and where more than CROWD points share one of these, smaller ones, down to 2^-24.
NEAR_LEVELS, FINE_LEVELS, FINER_LEVELS, CROWD = 4, 4, 24, 8
#: Gate, pass, partial, direction.
GATES = [
    ("watertight", 0.98, 0.90, "higher"),
    ("winding_consistent", 0.98, 0.90, "higher"),
    ("self_intersection_free", 1.00, 0.90, "higher"),
    ("iou128", 0.90, 0.80, "higher"),
    ("chamfer_l2_x1e3", 1.00, 2.00, "lower"),
    ("normal_consistency", 0.90, 0.80, "higher"),
    ("euler_match", 0.85, 0.70, "higher"),
]


def known(c: Column) -> Column:
    """A number, or null for null and NaN."""
    x = c.cast("double")
    return F.when(~F.isnan(x), x)


def verdict(value: Column, passed: Column, partial: Column, direction: Column) -> Column:
    """PASS, PARTIAL or FAIL; bounds count as reached, an unknown value fails."""
    value = known(value)
    better = lambda bound: ((direction == "higher") & (value >= bound)) | ((direction == "lower") & (value <= bound))
    return F.when(value.isNull(), "FAIL").when(better(passed), "PASS").when(better(partial), "PARTIAL").otherwise("FAIL")


def gates(scores: DataFrame, spec: list[tuple] = GATES, by: str = "folder") -> DataFrame:
    """scope ('*' for all rows, else the value of `by`), gate, value, n, n_missing, verdict.

    One hash aggregate over the rows; gates are told apart in its few result rows only. Null and NaN are left out of a
    mean and counted in n_missing. An empty table has scope '*' alone, with unknown values.
    """
    # rows pass one aggregate; the totals add up the groups' sums
    groups = scores.groupBy(by).agg(F.count(F.lit(1)).alias("rows"), *[x for name, *_ in spec for x in (F.sum(known(F.col(name))).alias(f"s_{name}"), F.count(known(F.col(name))).alias(f"n_{name}"))])
    total = groups.agg(F.sum("rows").alias("rows"), *[F.sum(f"{k}_{name}").alias(f"{k}_{name}") for name, *_ in spec for k in "sn"])
    both = groups.select(F.col(by).cast("string").alias("scope"), *[c for c in groups.columns if c != by]).unionByName(total.select(F.lit("*").alias("scope"), "*"))
    one = lambda name, passed, partial, direction: F.struct(F.lit(name).alias("gate"), (F.col(f"s_{name}") / F.when(F.col(f"n_{name}") > 0, F.col(f"n_{name}"))).alias("value"), F.coalesce(f"n_{name}", F.lit(0)).alias("n"), F.lit(float(passed)).alias("pass_at"), F.lit(float(partial)).alias("partial_at"), F.lit(direction).alias("direction"))
    long = both.select("scope", F.coalesce("rows", F.lit(0)).alias("rows"), F.explode(F.array(*[one(*g) for g in spec])).alias("g")).select("scope", "rows", "g.*")
    return long.select("scope", "gate", "value", "n", (F.col("rows") - F.col("n")).alias("n_missing"), verdict(F.col("value"), F.col("pass_at"), F.col("partial_at"), F.col("direction")).alias("verdict"))


def domain_gaps(scores: DataFrame, most: float, by: str = "folder", value: str = "iou128") -> DataFrame:
    """folder, folder_iou, overall_iou (mean over rows, not over folders), gap, interferes (gap above `most`)."""
    groups = scores.groupBy(F.col(by).alias("folder")).agg(F.sum(known(F.col(value))).alias("s"), F.count(known(F.col(value))).alias("n"))
    total = groups.agg((F.sum("s") / F.sum("n")).alias("overall_iou"))
    out = groups.select("folder", (F.col("s") / F.col("n")).alias("folder_iou")).join(F.broadcast(total))
    gap = F.col("overall_iou") - F.col("folder_iou")
    return out.select("folder", "folder_iou", "overall_iou", gap.alias("gap"), (gap > most).alias("interferes"))


def split(rows: DataFrame, share: float = 0.1, id: str = "stem", by: str = "folder", pinned: DataFrame | None = None) -> DataFrame:
    """rows with side ('val' for the share of each group, at least one row, else 'train') and pinned.

    Order within a group is by the SHA-1 of the id; rows whose id is in pinned (a column of the same name) are held out
    first and always. The n-th hash of a group is found by counting hash prefixes, so a group of any size is not sorted
    in one task: only rows that share the prefix where the share ends are ranked.
    """
    h = F.sha1(F.col(id).cast("string"))
    x = rows.withColumn("pinned", F.lit(0)) if pinned is None else rows.join(pinned.select(F.col(id).alias("__pin")).where("__pin is not null").distinct(), F.col(id) == F.col("__pin"), "left").withColumn("pinned", F.col("__pin").isNotNull().cast("int")).drop("__pin")
    x = x.withColumn("__p", F.conv(F.substring(h, 1, 3), 16, 10).cast("int")).withColumn("__h", h)
    bins = x.groupBy(by, F.when(F.col("pinned") == 1, -1).otherwise(F.col("__p")).alias("__p")).agg(F.count(F.lit(1)).alias("k"))
    w = Window.partitionBy(by).orderBy("__p")
    bins = bins.select(by, "__p", "k", F.sum("k").over(Window.partitionBy(by)).alias("n"), F.coalesce(F.sum("k").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("before"))
    want = F.greatest(F.lit(1), F.bround(F.col("n") * F.lit(float(share))))
    edge = bins.where((F.col("before") < want) & (want <= F.col("before") + F.col("k"))).select(F.col(by).alias("__by"), F.col("__p").alias("__edge"), (want - F.col("before")).cast("long").alias("__left"))
    x = x.join(edge, F.col(by).eqNullSafe(F.col("__by")), "left")
    at = (F.col("pinned") == 0) & (F.col("__p") == F.col("__edge"))
    spread = F.when(~at, F.xxhash64("__h", id))
    rank = F.row_number().over(Window.partitionBy(by, spread).orderBy("__h", id))
    val = (F.col("pinned") == 1) | (F.col("__p") < F.col("__edge")) | (at & (rank <= F.col("__left")))
    return x.withColumn("side", F.when(val, "val").otherwise("train")).drop("__p", "__h", "__by", "__edge", "__left")


def missing(wanted: DataFrame, rows: DataFrame, on: str = "stem") -> DataFrame:
    """The keys that were wanted and that no row has, once each."""
    return wanted.select(on).where(F.col(on).isNotNull()).distinct().join(rows.select(on), on, "left_anti")


def pair(left: DataFrame, right: DataFrame, on: str = "stem") -> DataFrame:
    """on, has_left, has_right: every key of either side once."""
    one = lambda d, c: d.select(on).where(F.col(on).isNotNull()).distinct().withColumn(c, F.lit(True))
    x = one(left, "has_left").join(one(right, "has_right"), on, "full_outer")
    return x.select(on, F.coalesce("has_left", F.lit(False)).alias("has_left"), F.coalesce("has_right", F.lit(False)).alias("has_right"))


def strict(rows: DataFrame, facts: DataFrame, on: str) -> DataFrame:
    """rows joined with facts; a row whose key is not in facts stops the query with an error that names it."""
    x = rows.join(facts.withColumn("__there", F.lit(True)), on, "left")
    return x.withColumn("__there", F.coalesce("__there", F.raise_error(F.concat(F.lit("no entry for "), F.coalesce(F.col(on).cast("string"), F.lit("null")))).cast("boolean"))).where("__there").drop("__there")


def in_order(rows: DataFrame, wanted: list, on: str = "stem") -> DataFrame:
    """The rows whose key was asked for, with ordinal (its first place in the list, from 0)."""
    first = {k: i for i, k in reversed(list(enumerate(wanted)))}
    asked = rows.sparkSession.createDataFrame(list(first.items()), T.StructType([*rows.select(on).schema.fields, T.StructField("ordinal", T.IntegerType())]))
    return rows.join(F.broadcast(asked), on)


def ranked(rows: DataFrame, order: list[Column], name: str = "place", parts: int = 0) -> DataFrame:
    """rows with their place (from 1) in the whole table's ascending order, without one task that holds all: ranges of the order are ranked apart and raised by the rows of the ranges before. Ties get an arbitrary order."""
    spark = rows.sparkSession
    keys = [f"__o{k}" for k in range(len(order))]
    x = rows.select("*", *[c.alias(k) for c, k in zip(order, keys)])
    # written, so that both uses see the same ranges
    x = Tables(spark).kept(x.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), *keys).withColumn("__part", F.spark_partition_id()))
    counts = {r["__part"]: r["count"] for r in x.groupBy("__part").count().collect()}
    before, done = [], 0
    for k in sorted(counts):
        before.append((k, done))
        done += counts[k]
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0)], "__part int, __before long"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy(*keys)) + F.col("__before")
    return x.join(offsets, "__part").withColumn(name, place.cast("long")).drop("__part", "__before", *keys)


def sums_before(counts: DataFrame, key: str, n: str) -> tuple[DataFrame, int]:
    """(counts with before, the sum of n over all rows of lesser key, and the whole sum); keys are distinct. Ranges of the key are summed apart, and only one sum a range comes to the driver."""
    spark = counts.sparkSession
    x = Tables(spark).kept(counts.repartitionByRange(int(spark.conf.get("spark.sql.shuffle.partitions")), key).withColumn("__part", F.spark_partition_id()))
    parts, before, done = {r["__part"]: r["s"] for r in x.groupBy("__part").agg(F.sum(n).alias("s")).collect()}, [], 0
    for k in sorted(parts):
        before.append((k, done))
        done += parts[k]
    offsets = F.broadcast(spark.createDataFrame(before or [(0, 0)], "__part int, __start long"))
    w = Window.partitionBy("__part").orderBy(key).rowsBetween(Window.unboundedPreceding, -1)
    return x.join(offsets, "__part").withColumn("before", F.coalesce(F.sum(n).over(w), F.lit(0)) + F.col("__start")).drop("__part", "__start"), done


def spearman(rows: DataFrame, a: str, b: str) -> DataFrame:
    """One row rho, n: the correlation of the ranks of two numbers, ties at their mean rank; rows where one is unknown are left out, and rho is null where one does not vary. Equal pairs are counted first, so only distinct values are ranked and joined."""
    pairs = rows.select(known(F.col(a)).alias("a"), known(F.col(b)).alias("b")).dropna().groupBy("a", "b").agg(F.count(F.lit(1)).alias("n"))
    pairs = Tables(rows.sparkSession).kept(pairs)
    total, x = 0, pairs
    for c in ("a", "b"):
        placed, total = sums_before(pairs.groupBy(c).agg(F.sum("n").alias("k")), c, "k")
        # mean ranks less their mean
        x = x.join(placed.select(c, (F.col("before") + (F.col("k") + 1) / 2 - (total + 1) / 2).alias(f"r{c}")), c)
    dot = lambda p, q: F.sum(F.col("n") * F.col(p) * F.col(q))
    return x.agg((dot("ra", "rb") / F.nullif(F.sqrt(dot("ra", "ra") * dot("rb", "rb")), F.lit(0.0))).alias("rho"), F.coalesce(F.sum("n"), F.lit(0)).alias("n"))


def evenly_spaced(rows: DataFrame, order: list[Column], n: int) -> DataFrame:
    """n rows evenly spaced over the order, first and last included, with pick (from 0); positions are rounded half to even, and a row may be picked twice."""
    x = ranked(rows, order, "__place")
    total = x.count()
    picks = [(i, round(i * (total - 1) / (n - 1)) + 1 if n > 1 else 1) for i in range(n)] if total else []
    return x.join(F.broadcast(rows.sparkSession.createDataFrame(picks, "pick int, __place long")), "__place").drop("__place")


def nearest(a: DataFrame, b: DataFrame, by: str = "shape_id", carry: tuple[str, ...] = ()) -> DataFrame:
    """Of every point of a (by, pid, x, y, z): by, pid, near (the pid of the nearest point of b of the same shape; the least of equals), d2, and near_<c> of the columns to carry.

    Cells of many sizes, each twice the one before: the least cell around a point that holds points of b bounds its
    distance, by the farthest corner of the box of these. A second join takes the cells, about as large as the bound, that
    reach into a ball of that radius, so a point meets some dozen others whatever the density around it. Of points with
    equal coordinates one is sought and one is found. Points with none of b in a cell of the largest size, so of clouds that
    lie apart, go down the tree of b's cells by proven bounds instead (surfaces.closest), as the tops of both clouds would
    otherwise all meet. Points without a partner shape are left out, and so are those with null coordinates or keys.
    Each pid stands once in a shape.
    """
    from .surfaces import closest

    full, made = [by, "pid", "x", "y", "z"], Tables(a.sparkSession)
    a, b = a.dropna(subset=full), b.dropna(subset=full)
    span = lambda d, s: d.groupBy(by).agg(*[f(c).alias(f"{s}{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias(f"{s}n"))
    box = span(a, "a").join(span(b, "b"), by)
    whole = F.greatest(*[F.greatest(f"ahi{c}", f"bhi{c}") - F.least(f"alo{c}", f"blo{c}") for c in "xyz"])
    size = F.greatest(F.greatest(*[F.col(f"bhi{c}") - F.col(f"blo{c}") for c in "xyz"]) / F.cbrt("bn"), whole / (1 << 20), F.lit(1e-9))
    box = lookup(made.kept(box.select(by, size.alias("__size"), *[F.least(f"alo{c}", f"blo{c}").alias(f"__{c}") for c in "xyz"])))
    side = F.col("__size") * F.pow(F.lit(2.0), F.col("level"))
    cell = lambda c, at: F.floor((at - F.col(f"__{c}")) / side).cast("long")
    cells = [cell(c, F.col(c)).alias(f"c{c}") for c in "xyz"]
    one = lambda d: made.kept(d.groupBy(by, "x", "y", "z").agg(F.min("pid").alias("pid")).join(box, by))
    p, q = one(a), one(b)
    at_levels = lambda d, low, high: d.withColumn("level", F.explode(F.sequence(F.lit(low), F.lit(high)))).select(by, "pid", "level", *cells, "x", "y", "z")
    where = [by, "level", "cx", "cy", "cz"]
    boxes = lambda d: d.groupBy(*where).agg(*[f(c).alias(f"{k}{c}") for c in "xyz" for k, f in (("lo", F.min), ("hi", F.max))], F.count(F.lit(1)).alias("n"))
    held = made.kept(boxes(at_levels(q, -FINE_LEVELS, NEAR_LEVELS - 1)))
    tried = at_levels(p, -FINE_LEVELS, NEAR_LEVELS - 1)
    # only what lies in crowded cells is told apart by finer ones
    crowded = held.where((F.col("level") == -FINE_LEVELS) & (F.col("n") > CROWD)).select(*where)
    if not crowded.isEmpty():
        inside = lambda d: at_levels(shuffled(d.withColumn("level", F.lit(-FINE_LEVELS)).withColumns({f"c{c}": x for c, x in zip("xyz", cells)})).join(crowded, where, "left_semi").drop("level", "cx", "cy", "cz"), -FINER_LEVELS, -FINE_LEVELS - 1)
        held, tried = held.unionByName(boxes(inside(q))), tried.unionByName(inside(p))
    most = sum(F.greatest(F.abs(F.col(c) - F.col(f"lo{c}")), F.abs(F.col(c) - F.col(f"hi{c}"))) ** 2 for c in "xyz")
    bound = shuffled(tried).join(shuffled(held), where).groupBy(by, "pid").agg(F.min(most).alias("bound"))
    p = made.kept(p.join(shuffled(bound), [by, "pid"], "left").withColumn("level", F.greatest(F.coalesce(F.ceil(F.log2(F.sqrt("bound") / F.col("__size"))).cast("int"), F.lit(-FINER_LEVELS)), F.lit(-FINER_LEVELS))))
    far = p.where("bound is null").select(full)
    used = lookup(made.kept(p.where("bound is not null").select(by, "level").distinct()))
    there = q.join(used, by).select(by, "level", *cells, F.col("pid").alias("near"), F.col("x").alias("bx"), F.col("y").alias("b_y"), F.col("z").alias("bz"))
    reach, ball = F.sqrt("bound") * (1 + 1e-9), p.where("bound is not null")
    for c in "xyz":
        ball = ball.withColumn(f"c{c}", F.explode(F.sequence(cell(c, F.col(c) - reach), cell(c, F.col(c) + reach))))
    # how far the cell begins from the point; a rounded quotient is off by less than a hundredth of a cell
    gap = lambda c: F.greatest(F.abs(F.col(f"__{c}") + (F.col(f"c{c}") + 0.5) * side - F.col(c)) - side * 0.51, F.lit(0.0))
    ball = ball.where(sum(gap(c) ** 2 for c in "xyz") <= reach * reach).select(*full, "bound", "level", "cx", "cy", "cz")
    d2 = (F.col("x") - F.col("bx")) ** 2 + (F.col("y") - F.col("b_y")) ** 2 + (F.col("z") - F.col("bz")) ** 2
    met = ball.join(shuffled(there), where).where(d2 <= F.col("bound") * (1 + 1e-9))
    found = met.groupBy(by, "pid").agg(F.min(F.struct(d2.alias("d2"), "near")).alias("m")).select(by, "pid", "m.near", "m.d2")
    if not far.isEmpty():
        # a point is a face whose corners are equal
        spots = q.join(far.select(by).distinct(), by, "left_semi").select(by, F.col("pid").alias("fid"), *[F.col(c).alias(f"{c}{n}") for n in range(3) for c in "xyz"])
        found = found.unionByName(closest(far, spots, by).select(by, "pid", F.col("fid").alias("near"), "d2"))
    found = shuffled(p.select(full)).join(shuffled(found), [by, "pid"]).drop("pid")
    found = shuffled(a.select(full)).join(shuffled(found), [by, "x", "y", "z"]).select(by, "pid", "near", "d2")
    if carry:
        found = found.join(shuffled(b.select(by, F.col("pid").alias("near"), *[F.col(c).alias(f"near_{c}") for c in carry])), [by, "near"])
    return found.select(by, "pid", "near", "d2", *[f"near_{c}" for c in carry])


def chamfer(a: DataFrame, b: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, chamfer_l2_x1e3: half the sum of both directions' mean squared distances, times a thousand."""
    one, two = (nearest(p, q, by).groupBy(by).agg(F.avg("d2").alias(c)) for p, q, c in ((a, b, "u"), (b, a, "v")))
    return one.join(two, by).select(by, (0.5 * (F.col("u") + F.col("v")) * 1000).alias("chamfer_l2_x1e3"))


def normal_consistency(a: DataFrame, b: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, normal_consistency: mean over both directions of the absolute cosine between a point's normal (nx, ny, nz) and its nearest point's."""

    def side(p: DataFrame, q: DataFrame, name: str) -> DataFrame:
        m = nearest(p, q, by, ("nx", "ny", "nz")).join(p.select(by, "pid", "nx", "ny", "nz"), [by, "pid"])
        dot = sum(F.col(f"n{c}") * F.col(f"near_n{c}") for c in "xyz")
        size = F.sqrt(sum(F.col(f"n{c}") ** 2 for c in "xyz")) * F.sqrt(sum(F.col(f"near_n{c}") ** 2 for c in "xyz"))
        return m.groupBy(by).agg(F.avg(F.abs(dot) / F.when(size > 0, size)).alias(name))

    return side(a, b, "u").join(side(b, a, "v"), by).select(by, ((F.col("u") + F.col("v")) / 2).alias("normal_consistency"))


def box_pairs(boxes: DataFrame, by: str = "shape_id", most_cells: int = 64) -> DataFrame:
    """by, fid_a, fid_b (fid_a < fid_b): boxes (by, fid, x0, y0, z0, x1, y1, z1) of one shape that meet; touching counts.

    Cells are as large as nearly all boxes of the shape (99 %), at least 1/4096 of its extent. A pair is found in each
    cell that both cover and given out only in the one that holds the greater of their lower corners, so nothing is
    deduplicated. The few boxes that would cover more than most_cells cells meet all boxes of their shape.
    """
    span = F.greatest(*[F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"])
    whole = F.greatest(*[F.max(f"{c}1") - F.min(f"{c}0") for c in "xyz"])
    size = boxes.groupBy(by).agg(F.greatest(F.percentile_approx(span, F.lit(0.99), F.lit(1000)), whole / 4096, F.lit(1e-9)).alias("size"))
    x = shuffled(boxes).select(by, "fid", *[f"{c}{k}" for c in "xyz" for k in (0, 1)]).join(size, by)
    n = lambda c: F.floor(F.col(f"{c}1") / F.col("size")) - F.floor(F.col(f"{c}0") / F.col("size")) + 1
    x = x.withColumn("large", n("x") * n("y") * n("z") > most_cells)
    small = x.where("not large")
    for c in "xyz":
        small = small.withColumn(f"c{c}", F.explode(F.sequence(F.floor(F.col(f"{c}0") / F.col("size")), F.floor(F.col(f"{c}1") / F.col("size")))))
    named = lambda d, s: d.select(by, *[F.col(c).alias(f"{c}_{s}") for c in ("fid", "large", *(f"{c}{k}" for c in "xyz" for k in (0, 1)))], *[c for c in d.columns if c in ("cx", "cy", "cz", "size")])
    meets = reduce(lambda p, q: p & q, [(F.col(f"{c}0_a") <= F.col(f"{c}1_b")) & (F.col(f"{c}0_b") <= F.col(f"{c}1_a")) for c in "xyz"])
    home = reduce(lambda p, q: p & q, [F.floor(F.greatest(f"{c}0_a", f"{c}0_b") / F.col("size")) == F.col(f"c{c}") for c in "xyz"])
    pairs = named(small, "a").join(named(small.drop("size"), "b"), [by, "cx", "cy", "cz"]).where((F.col("fid_a") < F.col("fid_b")) & meets & home).select(by, "fid_a", "fid_b")
    rest = named(x.where("large").drop("size"), "a").join(named(x.drop("size"), "b"), by).where(meets & (F.col("fid_a") != F.col("fid_b")) & (~F.col("large_b") | (F.col("fid_a") < F.col("fid_b"))))
    return pairs.unionByName(rest.select(by, F.least("fid_a", "fid_b").alias("fid_a"), F.greatest("fid_a", "fid_b").alias("fid_b")))


def disjoint_pairs(faces: DataFrame, by: str = "shape_id") -> DataFrame:
    """by, disjoint_pairs: pairs of faces (by, fid, i, j, k) of a shape without a common vertex: all pairs less those that meet at a vertex.

    Pairs that meet are counted, not made: of two faces with c common vertices, c have one vertex each, c(c-1)/2 two and
    c(c-1)(c-2)/6 all three, and their alternating sum is 1. So pairs at each vertex, less those at each two vertices, and
    those at each three, are one aggregate, linear in the faces even where many meet at one vertex.
    """
    known = faces.where(F.col(by).isNotNull() & F.col("fid").isNotNull()).select(by, F.array_sort(F.array_compact(F.array_distinct(F.array("i", "j", "k")))).alias("v"))
    at = lambda n: F.get("v", F.lit(n))
    every = F.array(*[F.array(*[at(n) for n in places]) for places in ((0,), (1,), (2,), (0, 1), (0, 2), (1, 2), (0, 1, 2))])
    held = known.select(by, F.explode(F.filter(every, lambda s: ~F.exists(s, lambda x: x.isNull()))).alias("s")).select(by, F.get("s", F.lit(0)).alias("p"), F.get("s", F.lit(1)).alias("q"), F.get("s", F.lit(2)).alias("r"))
    met = held.groupBy(by, "p", "q", "r").agg(F.count(F.lit(1)).alias("n"))
    touch = met.groupBy(by).agg(F.sum(F.when(F.col("q").isNotNull() & F.col("r").isNull(), -1).otherwise(1) * F.col("n") * (F.col("n") - 1) / 2).alias("touching"))
    n = faces.groupBy(by).agg(F.count(F.lit(1)).alias("n"))
    out = n.join(touch, by, "left").select(by, (F.col("n") * (F.col("n") - 1) / 2 - F.coalesce("touching", F.lit(0))).cast("long").alias("disjoint_pairs"))
    return out.where("disjoint_pairs > 0")


def batches(queries: DataFrame, steps: int, size: int, near_share: float = 0.75, seed: int = 0) -> DataFrame:
    """step, shape_id, slot, qid, pool, and the query's other columns: `size` queries of every shape for each step, drawn with replacement, the first round(size * near_share) (half to even) from pool 'near' and the rest from 'uniform'.

    queries: shape_id, pool, qid (from 0 within a shape and pool), ... A draw is the SHA-1 of seed, step, shape and slot,
    so batches do not depend on the layout, and a validation set is the same call with another seed.
    """
    near = round(size * near_share)
    have = queries.groupBy("shape_id", "pool").agg(F.count(F.lit(1)).alias("n"))
    slot = F.explode(F.when(F.col("pool") == "near", F.sequence(F.lit(0), F.lit(near - 1)) if near else F.array().cast("array<int>")).otherwise(F.sequence(F.lit(near), F.lit(size - 1)) if near < size else F.array().cast("array<int>")))
    drawn = have.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps - 1)))).withColumn("slot", slot)
    text = F.concat_ws("/", F.lit(str(seed)), F.col("step").cast("string"), F.col("shape_id").cast("string"), F.col("slot").cast("string"))
    draw = F.conv(F.substring(F.sha1(text), 1, 12), 16, 10).cast("long") % F.col("n")
    return drawn.select("step", "shape_id", "pool", "slot", draw.alias("qid")).join(queries, ["shape_id", "pool", "qid"])


def padded_bounds(bounds: DataFrame, pad: float = 0.05) -> DataFrame:
    """low and high (arrays of three) moved outward by the pad's share of each axis' extent."""
    given = bounds.select(F.col("low").alias("__low"), F.col("high").alias("__high"))
    grow = lambda side, s: F.transform(F.sequence(F.lit(0), F.lit(2)), lambda k: F.get(side, k) + s * pad * (F.get("__high", k) - F.get("__low", k)))
    return given.select(grow("__low", -1).alias("low"), grow("__high", 1).alias("high"))


def overflow(shapes: DataFrame, bounds: DataFrame, axes: str = "xyz") -> DataFrame:
    """shapes (min_x, max_x, ...) with worst (how far one reaches out of bounds(low, high), below 0 if nowhere) and inside. The bounds are one row."""
    x = shapes.join(F.broadcast(bounds))
    out = F.greatest(*[y for k, c in enumerate(axes) for y in (F.get("low", F.lit(k)) - F.col(f"min_{c}"), F.col(f"max_{c}") - F.get("high", F.lit(k)))])
    return x.withColumn("worst", out).withColumn("inside", out <= 0).drop("low", "high")
