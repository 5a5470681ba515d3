"""Operators behind reports: states of rows, shortfalls, offsets, runs of equal keys and the tables of figures.

All are built-in functions; windows run over keys that a shape or folder bounds, or over counts made before.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import frames

#: A mover is named from this change on, and so many of them.
LEAST_MOVE, MOVERS = 1e-4, 4
#: Fixed value: a plot's cube is the drawn shapes' largest extent by this.
CUBE = 1.05


def shortfall(built: DataFrame, n_points: int) -> DataFrame:
    """One row of rows (status, n_topup): n_ok, n_topped_up, share_topped_up, topup_points, worst_share. Rows that are not ok, and null counts, are none; an empty table gives zeros."""
    ok = F.col("status") == "ok"
    short = ok & (F.col("n_topup") > 0)
    got = built.agg(F.count_if(ok).alias("n_ok"), F.count_if(short).alias("n_topped_up"), F.coalesce(F.sum(F.when(short, F.col("n_topup"))), F.lit(0)).cast("long").alias("topup_points"), F.coalesce(F.max(F.when(short, F.col("n_topup"))) / F.lit(float(n_points)), F.lit(0.0)).alias("worst_share"))
    return got.select("n_ok", "n_topped_up", (F.col("n_topped_up") / F.greatest(F.lit(1), F.col("n_ok"))).alias("share_topped_up"), "topup_points", "worst_share")


def tetrahedra_status(rows: DataFrame) -> DataFrame:
    """rows with status and note, from error, surf_watertight and n_tets: error (it has one), skip (an open surface is not filled), fail (no tetrahedra), ok. Unknown facts count as failed."""
    closed, filled = F.coalesce(F.col("surf_watertight") == 1, F.lit(False)), F.coalesce(F.col("n_tets") > 0, F.lit(False))
    state = lambda *x: F.when(F.col("error").isNotNull(), x[0]).when(~closed, x[1]).when(~filled, x[2]).otherwise(x[3])
    return rows.withColumns({"status": state("error", "skip", "fail", "ok"), "note": state(F.col("error"), F.lit("open surface"), F.lit("no tetrahedra"), F.lit(""))})


def answer_status(rows: DataFrame, n_points: int) -> DataFrame:
    """rows with status, why and warnings of inference.

    Reads error, reject, n_given (points), n_topup, overflow (how far the box reaches out of the data's, null where no
    box is known), found (faces of the level set), failed_step, reason, broken (0/1). status: error (the file or a kernel
    failed), reject (the input is refused, reject says why), fail (no level set), ok. A row that is not ok has no
    surface; its warnings are those known by then. Warnings stand in a fixed order, joined by "; ".
    """
    nothing = F.coalesce(F.col("found"), F.lit(0)) == 0
    status = F.when(F.col("error").isNotNull(), "error").when(F.col("reject").isNotNull(), "reject").when(nothing, "fail").otherwise("ok")
    why = F.when(F.col("error").isNotNull(), F.col("error")).when(F.col("reject").isNotNull(), F.col("reject")).when(nothing, "no level set in the grid").otherwise("")
    warnings = [
        F.when(F.col("n_topup") > 0, F.concat(F.col("n_topup").cast("string"), F.lit(" points topped up"))),
        F.when(F.col("overflow") > 0, F.concat(F.lit("reaches out of the data's box by "), F.format_string("%.4f", F.col("overflow").cast("double")))),
        F.when(F.col("n_given") != n_points, F.concat(F.col("n_given").cast("string"), F.lit(f" points, not {n_points}"))),
        F.when(F.col("failed_step").isNotNull(), F.concat(F.lit("simplification reverted at "), F.col("failed_step"), F.lit(": "), F.coalesce("reason", F.lit("?")))),
        F.when(F.col("broken") == 1, F.lit("the written surface is broken")),
    ]
    return rows.withColumns({"status": status, "why": why, "warnings": F.array_join(F.array_compact(F.array(*warnings)), "; ")})


def offsets(counts: DataFrame, by: str, order: str, n: str = "n") -> DataFrame:
    """counts with start: the sum of n over the rows of the same `by` before it, 0 at first. counts has one row a part, so a window holds one shape's parts; null n is 0."""
    before = Window.partitionBy(by).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return counts.withColumn("start", F.coalesce(F.sum(F.coalesce(F.col(n), F.lit(0))).over(before), F.lit(0)).cast("long"))


def expanded(counts: DataFrame, by: str, order: str, n: str = "n") -> DataFrame:
    """Each row n times, with its place in `by` from 0; rows of n 0 go."""
    x = offsets(counts, by, order, n).where(F.col(n) > 0)
    return x.select("*", F.explode(F.sequence(F.col("start"), F.col("start") + F.col(n) - 1)).alias("place")).drop("start")


def joined_shells(tets: DataFrame, nodes: DataFrame, corners: tuple[str, ...] = ("a", "b", "c", "d"), by: str = "shape_id", part: str = "shell") -> DataFrame:
    """tets with corners numbered over the whole shape: each shell's numbers (from 0) are raised by the nodes of the shells before it. Only counts of nodes are joined."""
    start = offsets(nodes.groupBy(by, part).agg(F.count(F.lit(1)).alias("n")), by, part).select(by, part, "start")
    x = tets.join(start, [by, part])
    return x.withColumns({c: F.col(c) + F.col("start") for c in corners}).drop("start")


def runs(rows: DataFrame, key: str, order: list[str], by: str) -> DataFrame:
    """rows with starts (the key differs from the row before in `by`, or there is none) and run (from 1). Null is a key like others; rows of one `by` are sorted together."""
    w = Window.partitionBy(by).orderBy(*order)
    first = F.row_number().over(w) == 1
    x = rows.withColumn("starts", first | ~F.col(key).eqNullSafe(F.lag(key).over(w)))
    return x.withColumn("run", F.sum(F.col("starts").cast("long")).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def smallest(files: DataFrame, by: str | None = None, path: str = "path", size: str = "length") -> DataFrame:
    """The path of the smallest file (the first of equals), of all or of each `by`."""
    least = F.min(F.struct(F.col(size).alias("s"), F.col(path).alias("p")))
    known = files.where(F.col(size).isNotNull())
    return (known.groupBy(by) if by else known.groupBy()).agg(least.alias("least")).select(*([by] if by else []), F.col("least.p").alias(path), F.col("least.s").alias(size))


def cube(points: DataFrame, axes: str = "xyz") -> DataFrame:
    """One row low_*, high_*: the cube around the middle of all points that holds them with some margin. Unknown coordinates are left out; without points all are null."""
    box = points.agg(*[f(a).alias(f"{k}{a}") for a in axes for k, f in (("__0", F.min), ("__1", F.max))])
    half = F.greatest(*[F.col(f"__1{a}") - F.col(f"__0{a}") for a in axes]) / 2 * CUBE
    middle = lambda a: (F.col(f"__0{a}") + F.col(f"__1{a}")) / 2
    return box.select(*[x for a in axes for x in ((middle(a) - half).alias(f"low_{a}"), (middle(a) + half).alias(f"high_{a}"))])


def histogram(rows: DataFrame, value: str = "iou", bins: int = 20) -> DataFrame:
    """bin (from 0), low, high, n of values in 0..1; 1 is in the last bin, unknown values in none, empty bins stay."""
    x = frames.known(F.col(value))
    counted = rows.where(x.isNotNull()).select(F.least(F.floor(x * bins), F.lit(bins - 1)).cast("int").alias("bin")).where("bin >= 0").groupBy("bin").agg(F.count(F.lit(1)).alias("n"))
    every = rows.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))
    return every.join(F.broadcast(counted), "bin", "left").select("bin", (F.col("bin") / bins).alias("low"), ((F.col("bin") + 1) / bins).alias("high"), F.coalesce("n", F.lit(0)).alias("n"))


def compared(a: DataFrame, b: DataFrame, on: str = "shape_id", value: str = "iou") -> DataFrame:
    """Shapes of both evaluations: value_a, value_b, delta, and change (fixed, broken, right, wrong) of euler_match."""
    x = a.select(on, frames.known(F.col(value)).alias("value_a"), F.col("euler_match").alias("__a")).join(b.select(on, frames.known(F.col(value)).alias("value_b"), F.col("euler_match").alias("__b")), on)
    right = lambda c: F.coalesce(F.col(c) == 1, F.lit(False))
    change = F.when(right("__a") & right("__b"), "right").when(right("__a"), "broken").when(right("__b"), "fixed").otherwise("wrong")
    return x.select(on, "value_a", "value_b", (F.col("value_b") - F.col("value_a")).alias("delta"), change.alias("change"))


def movers(pairs: DataFrame, on: str = "shape_id") -> DataFrame:
    """The rows of `compared` that moved most, by the size of delta and name."""
    return pairs.where(F.abs("delta") >= LEAST_MOVE).orderBy(F.abs("delta").desc(), on).limit(MOVERS)


def transitions(pairs: DataFrame) -> DataFrame:
    """change, n, share of the rows of `compared`; changes that do not occur have n 0."""
    names = ("right", "wrong", "fixed", "broken")
    n = pairs.agg(*[F.count_if(F.col("change") == x).alias(x) for x in names], F.count(F.lit(1)).alias("all"))
    each = n.select("all", F.explode(F.array(*[F.struct(F.lit(x).alias("change"), F.col(x).alias("n")) for x in names])).alias("e"))
    return each.select("e.change", "e.n", (F.col("e.n") / F.greatest(F.lit(1), F.col("all"))).alias("share"))


def figures(scores: DataFrame, n: int = 6, other: DataFrame | None = None, log: DataFrame | None = None) -> dict[str, DataFrame]:
    """The tables behind figures of an evaluation: gate bars, IoU histogram, shapes picked evenly over the IoU ranking; against another evaluation: pairs, movers, transitions; of a training log: its running best."""
    rows = scores.withColumnRenamed("iou", "iou128")
    out = {"gates": frames.gates(rows), "histogram": histogram(scores), "picks": frames.evenly_spaced(scores.where("error is null").select("shape_id", "iou", "euler_match"), [-F.col("iou"), F.col("shape_id")], n)}
    if other is not None:
        both = compared(scores, other)
        out |= {"pairs": both, "movers": movers(both), "transitions": transitions(both)}
    if log is not None:
        out["loss"] = frames.running_best(log.withColumn("run", F.lit("run")), patience=1 << 30).join(log.select("step", "train_bce"), "step")
    return out


def stop_gates(shapes: DataFrame, watertight_least: float = 0.6, misfit_most: float = 0.05, coordinate_most: float = 1.0, spread_most: float = 0.02) -> DataFrame:
    """One row: the share of watertight shapes, of misfits, the farthest coordinate and the spread of extents (of the largest and least, to the mean), whether each stops, and stops: any of them. One aggregate.

    shapes: is_watertight, misfit (0/1 or booleans), reach (the largest absolute coordinate), extent. Unknown values are
    left out of their own share; where all of a kind are unknown its gate and stops are null, but a gate that stops holds.
    """
    one = lambda c: F.avg(F.col(c).cast("int"))
    got = shapes.agg(one("is_watertight").alias("watertight"), one("misfit").alias("misfit"), F.max("reach").alias("reach"), ((F.max("extent") - F.min("extent")) / F.avg("extent")).alias("spread"))
    gates = {"stop_watertight": F.col("watertight") < watertight_least, "stop_misfit": F.col("misfit") > misfit_most, "stop_reach": F.col("reach") > coordinate_most, "stop_spread": F.col("spread") > spread_most}
    return got.withColumns(gates).withColumn("stops", reduce(Column.__or__, [F.col(g) for g in gates]))
