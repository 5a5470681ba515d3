"""Queries of the DataFrame operators on proxies. Their oracles are the plain SQL forms, which share nothing with the operators."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.dialect import spark_query
from ..operators import corpus, frames, gates, geometry
from ..operators import shapes as kernels
from . import proxy, solids


_eval = spark_query(f"with {proxy.EVAL} select * from eval")
_cloud = spark_query(f"with {proxy.CLOUDS} select * from cloud")
_tri = spark_query(f"with {proxy.BOXES} select * from tri", proxy.SPREAD)
_corpus = spark_query(f"with {proxy.CORPUS} select * from corpus")
_log = spark_query(f"with {proxy.LOG} select * from log")


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _halves(spark, sf_dir):
    cloud = _cloud(spark, sf_dir)
    return cloud.where("pid % 2 = 0"), cloud.where("pid % 2 = 1")


def _gates(spark, sf_dir):
    return frames.gates(_eval(spark, sf_dir)).withColumn("value", F.round("value", 9))


def _verdicts(spark, sf_dir):
    return frames.gates(_eval(spark, sf_dir)).where("scope = '*'").groupBy("verdict").agg(F.count(F.lit(1)).alias("n_gates"))


def _gap(spark, sf_dir):
    d = frames.domain_gaps(_eval(spark, sf_dir), 0.001)
    return d.select("folder", *[F.round(c, 9).alias(c) for c in ("folder_iou", "overall_iou", "gap")], "interferes")


def _split(spark, sf_dir):
    return frames.split(_corpus(spark, sf_dir)).select("stem", "folder", "side")


def _pinned(spark, sf_dir):
    pins = _table(spark, sf_dir, "labels").where("toxic = 1").select(F.col("doc_id").alias("stem"))
    return frames.split(_corpus(spark, sf_dir), pinned=pins).select("stem", "folder", "side", "pinned")


def _pair(spark, sf_dir):
    d = frames.pair(_table(spark, sf_dir, "pages").select(F.col("page_id").alias("stem")), _corpus(spark, sf_dir))
    return d.select("stem", F.col("has_left").alias("has_mesh"), F.col("has_right").alias("has_cloud"))


def _strict(spark, sf_dir):
    labels = _table(spark, sf_dir, "labels").select(F.col("doc_id").alias("stem"), "quality")
    known = _corpus(spark, sf_dir).join(labels, "stem", "left_semi")
    return frames.strict(known, labels, "stem").select("stem", "folder", "quality")


def _spaced(spark, sf_dir):
    d = _eval(spark, sf_dir).where("error = ''").groupBy("stem").agg(F.round(F.avg("iou128"), 9).alias("iou"))
    return frames.evenly_spaced(d, [-F.col("iou"), F.col("stem")], 6).select("pick", "stem", "iou")


def _spearman(spark, sf_dir):
    d = _eval(spark, sf_dir).where("error = ''").groupBy("stem").agg(F.max("pred_faces").alias("f"), F.round(F.avg("iou128"), 9).alias("q"))
    return frames.spearman(d, "f", "q").select(F.round("rho", 6).alias("rho"), "n")


def _batches_of_epoch(spark, sf_dir):
    log = _log(spark, sf_dir)
    d = frames.ranked(log.select("step"), [F.sha1(F.col("step").cast("string")), F.col("step")], "rn")
    n = log.count()
    return d.where(F.col("rn") <= n // 32 * 32).select("step", F.floor((F.col("rn") - 1) / 32).cast("long").alias("batch"))


def _nearest(spark, sf_dir):
    return frames.nearest(*_halves(spark, sf_dir)).select("shape_id", F.col("pid").alias("pa"), F.col("near").alias("nearest"), F.round("d2", 6).alias("d2"))


def _chamfer(spark, sf_dir):
    return frames.chamfer(*_halves(spark, sf_dir)).withColumn("chamfer_l2_x1e3", F.round("chamfer_l2_x1e3", 6))


def _normals(spark, sf_dir):
    return frames.normal_consistency(*_halves(spark, sf_dir)).withColumn("normal_consistency", F.round("normal_consistency", 6))


def _p99(spark, sf_dir):
    d = frames.nearest(*_halves(spark, sf_dir)).groupBy("shape_id").agg(F.avg(F.sqrt("d2")).alias("m"), F.percentile(F.sqrt("d2"), F.lit(0.99)).alias("p"), F.max(F.sqrt("d2")).alias("x"))
    return d.select("shape_id", F.round("m", 6).alias("mean_d"), F.round("p", 6).alias("p99_d"), F.round("x", 6).alias("max_d"), (F.col("p") > 0.25).alias("frame_flag"))


def _corners(axis: str) -> list[str]:
    return [{"by": "by_"}.get(p + axis, p + axis) for p in "abc"]


def _boxes(spark, sf_dir):
    return _tri(spark, sf_dir).select("shape_id", "fid", *[f(*_corners(c)).alias(f"{c}{k}") for c in "xyz" for k, f in ((0, F.least), (1, F.greatest))])


def _candidates(spark, sf_dir):
    return frames.box_pairs(_boxes(spark, sf_dir))


def _disjoint(spark, sf_dir):
    return frames.disjoint_pairs(_tri(spark, sf_dir).select("shape_id", "fid", "i", "j", "k"))


def _best(spark, sf_dir):
    log = _log(spark, sf_dir).groupBy(F.floor(F.col("step") / 100).alias("step")).agg(F.min("val_bce").alias("val_bce")).withColumn("run", F.lit("run"))
    d = frames.running_best(log, least=0.01, patience=5)
    return d.select("step", F.round("value", 9).alias("v"), F.round("best", 9).alias("best"), "stale", "stopped")


def _floaters(spark, sf_dir):
    d = kernels.described(kernels.without_floaters(solids.solids(spark, sf_dir), 0.1).drop("error"))
    return d.select("shape_id", "n_components", "n_faces", F.round("volume", 6).alias("volume"))


def _crossings(spark, sf_dir):
    return kernels.intersections(solids.solids(spark, sf_dir)).select("shape_id", (F.col("n_intersections") > 0).alias("intersects"), (F.col("n_intersections") >= 4).alias("several"))


def _train_batches(spark, sf_dir):
    cloud = _cloud(spark, sf_dir).select("shape_id", F.when(F.col("pid") % 4 == 3, "uniform").otherwise("near").alias("pool"), "pid", "x")
    rank = F.expr("row_number() over (partition by shape_id, pool order by pid) - 1")
    return frames.batches(cloud.withColumn("qid", rank.cast("long")), 5, 16, 0.75, 7).select("step", "shape_id", "slot", "pool", "pid", F.round("x", 6).alias("x"))


def _padded(spark, sf_dir):
    box = _tri(spark, sf_dir).agg(*[f(g(*_corners(c))).alias(f"{k}_{c}") for c in "xyz" for k, f, g in (("low", F.min, F.least), ("high", F.max, F.greatest))])
    d = frames.padded_bounds(box.select(F.array(*[f"low_{c}" for c in "xyz"]).alias("low"), F.array(*[f"high_{c}" for c in "xyz"]).alias("high")))
    return d.select(*[F.round(F.get(k, F.lit(i)), 9).alias(f"{k}_{c}") for k in ("low", "high") for i, c in enumerate("xyz")])


def _overflow(spark, sf_dir):
    boxes = _boxes(spark, sf_dir).groupBy("shape_id").agg(*[x for c in "xyz" for x in (F.min(f"{c}0").alias(f"min_{c}"), F.max(f"{c}1").alias(f"max_{c}"))])
    # the frame is the mean box, so that some shapes reach out of it
    mean = boxes.agg(F.array(*[F.avg(f"min_{c}") for c in "xyz"]).alias("low"), F.array(*[F.avg(f"max_{c}") for c in "xyz"]).alias("high"))
    return frames.overflow(boxes, mean).select("shape_id", F.round("worst", 9).alias("worst"), "inside")


QUERIES = {
    "gates_overall_and_folder": _gates, "gate_verdict_counts": _verdicts, "domain_gap": _gap, "split_within_folder": _split, "split_pinned": _pinned, "pair_full_outer": _pair, "manifest_strict_join": _strict,
    "evenly_spaced_rank": _spaced, "spearman_faces_iou": _spearman, "epoch_batches": _batches_of_epoch, "nearest_neighbour": _nearest, "chamfer_l2": _chamfer, "normal_consistency": _normals, "frame_p99": _p99, "aabb_candidates": _candidates,
    "vertex_sharing_filter": _disjoint, "running_best": _best, "floater_filter": _floaters, "crossing_counts": _crossings, "train_batches": _train_batches, "padded_bounds": _padded, "bbox_overflow": _overflow,
}

_TRI = f"with {proxy.BOXES}"
#: Where the plain SQL of the same name is not the oracle.
ORACLES = {
    "running_best": f"""with recursive {proxy.LOG}, b as (select cast(floor(step / 100) as bigint) as step, min(val_bce) as v, row_number() over (order by cast(floor(step / 100) as bigint)) as rn from log group by cast(floor(step / 100) as bigint)),
f as (select rn, step, v, v as best, cast(0 as bigint) as stale from b where rn = 1 union all select b.rn, b.step, b.v, case when b.v < f.best - 0.01 then b.v else f.best end, case when b.v < f.best - 0.01 then cast(0 as bigint) else f.stale + 1 end from f join b on b.rn = f.rn + 1)
select step, round(v, 9) as v, round(best, 9) as best, stale, stale >= 5 as stopped from f""",
    "floater_filter": f"{solids._P}, t as (select *, two = 1 and w*w*w >= 0.1 * (1 - holed::int / 6::double) as kept from s) select shape_id, 1 + kept::int as n_components, 12 * (1 + kept::int) - holed::int as n_faces, round(x*y*z * (1 + case when kept then w*w*w else 0 end - holed::int / 6::double), 6) as volume from t",
    "crossing_counts": f"{solids._P} select shape_id, kind = 3 as intersects, kind = 3 as several from s",
    "train_batches": f"""with {proxy.CLOUDS}, q as (select shape_id, pid, x, case when pid % 4 = 3 then 'uniform' else 'near' end as pool from cloud), r as (select *, row_number() over (partition by shape_id, pool order by pid) - 1 as qid, count(*) over (partition by shape_id, pool) as n from q),
d as (select distinct shape_id, pool, n, step, slot from r, (select unnest(range(5)) as step) a, (select unnest(range(16)) as slot) b where (pool = 'near') = (slot < 12))
select d.step::int as step, d.shape_id, d.slot::int as slot, d.pool, r.pid, round(r.x, 6) as x from d join r on r.shape_id = d.shape_id and r.pool = d.pool and r.qid = ('0x' || substr(sha1('7/' || d.step || '/' || d.shape_id || '/' || d.slot), 1, 12))::bigint % d.n""",
    "padded_bounds": f"{_TRI}, u as (select min(least(ax,bx,cx)) as x0, max(greatest(ax,bx,cx)) as x1, min(least(ay,by_,cy)) as y0, max(greatest(ay,by_,cy)) as y1, min(least(az,bz,cz)) as z0, max(greatest(az,bz,cz)) as z1 from tri) select round(x0-0.05*(x1-x0), 9) as low_x, round(y0-0.05*(y1-y0), 9) as low_y, round(z0-0.05*(z1-z0), 9) as low_z, round(x1+0.05*(x1-x0), 9) as high_x, round(y1+0.05*(y1-y0), 9) as high_y, round(z1+0.05*(z1-z0), 9) as high_z from u",
    "bbox_overflow": f"{_TRI}, b as (select shape_id, min(least(ax,bx,cx)) as x0, max(greatest(ax,bx,cx)) as x1, min(least(ay,by_,cy)) as y0, max(greatest(ay,by_,cy)) as y1, min(least(az,bz,cz)) as z0, max(greatest(az,bz,cz)) as z1 from tri group by shape_id), m as (select avg(x0) as lx, avg(x1) as hx, avg(y0) as ly, avg(y1) as hy, avg(z0) as lz, avg(z1) as hz from b) select shape_id, round(greatest(lx-x0, x1-hx, ly-y0, y1-hy, lz-z0, z1-hz), 9) as worst, greatest(lx-x0, x1-hx, ly-y0, y1-hy, lz-z0, z1-hz) <= 0 as inside from b join m on true",
}
#: Plain SQL of operators that were replaced, as oracles of the same name.
PLAIN = {name: (gates.SQL | corpus.SQL | geometry.SQL)[name] for name in QUERIES if name not in ORACLES}
