"""Command verbs: python -m shapeloom prepare | scan | train | meshify | infer | evaluate | gates | figures | remesh | verify | tetrahedralize.

Tables are Parquet below the output folder; meshes are STL files. With --config FILE (YAML or JSON) the file's section of
the verb's name gives paths and options that the command line does not; paths in it are relative to the file. Exit codes: 0 done, 1 a gate stopped it, 2 nothing to do.
"""

from __future__ import annotations

import argparse
import json
import sys

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import verify as verification
from .operators import frames, inference, reports, shapes, training
from .sources import shapes as files
from .sources import tables

#: Libraries that fill a surface with tetrahedra, in the order of preference; none is substituted by another method.
BACKENDS = ("tetgen", "gmsh", "wildmeshing")


def _kept(df: DataFrame, path: str) -> DataFrame:
    df.write.mode("overwrite").parquet(path)
    return df.sparkSession.read.parquet(path)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumn("shape_id", F.when(F.col("folder") == ".", F.col("stem")).otherwise(F.concat_ws("/", "folder", "stem")))


def _export(meshes: DataFrame, root: str) -> int:
    return files.write_files(files.as_stl(meshes).withColumn("name", F.concat("shape_id", F.lit(".stl"))), root, "name", "stl").count()


def prepare(spark: SparkSession, src: str, out: str, n_points: int = 1000, n_queries: int = 100_000, val_share: float = 0.1, limit: int = 0, force: bool = False, pin_val: str | None = None) -> int:
    """STL files -> build (one row a file, status ok/reject/error), meshes in the shared frame, clouds, labelled queries and the split within folders. Two files of one stem stop it.

    Queries that an earlier run made stay, whatever its options, and only those of new shapes and of files whose content
    has changed are made, unless force is given; the table is partitioned by folder. limit: the first so many files by folder and name. pin_val: JSON of shape ids that are held out first and
    always; those that are not there are listed in pins_missing. summary.json tells counts and the points' shortfall.
    """
    read = _named(files.read_stl(spark, src, limit))
    if read.isEmpty():
        return 2
    if not files.collisions(read).isEmpty():
        return 1
    fit = shapes.repaired(read.where("error is null").drop("error"))
    made = _kept(shapes.normalized(fit.where("error is null and ok = 1").drop("error")), f"{out}/meshes")
    state = read.select("shape_id", "folder", "stem", "path", "sha1", F.col("error").alias("read_error")).join(fit.select("shape_id", "ok", F.col("error").alias("fit_error")), "shape_id", "left").join(made.select("shape_id", "scale", "tx", "ty", "tz", F.col("error").alias("frame_error")), "shape_id", "left")
    error = F.coalesce("read_error", "fit_error", "frame_error")
    status = F.when(error.isNotNull(), "error").when(F.col("ok") == 0, "reject").otherwise("ok")
    _kept(state.select("shape_id", "folder", "stem", "path", "sha1", status.alias("status"), F.coalesce(error, F.when(F.col("ok") == 0, "not sound after repair"), F.lit("")).alias("error"), "scale", "tx", "ty", "tz"), f"{out}/build")
    good = made.where("error is null").drop("error")
    _kept(shapes.sampled(good, n_points).select("shape_id", "folder", "points", "n_even", "n_topup", "error"), f"{out}/clouds")
    axis = lambda f, a: f(F.filter("xyz", lambda x, i: i % 3 == a))
    box = good.agg(*[F.min(axis(F.array_min, a)).alias(f"low{a}") for a in range(3)], *[F.max(axis(F.array_max, a)).alias(f"high{a}") for a in range(3)]).first()
    if box[0] is None:
        return 2
    _kept(spark.createDataFrame([(list(box[:3]), list(box[3:]))], "low array<double>, high array<double>"), f"{out}/bounds")
    asked = lambda d: shapes.query_points(d, list(box[:3]), list(box[3:]), n_queries).drop("xyz", "tri")
    tables.refreshed(f"{out}/queries", good, asked, everything=force)
    pins = None if pin_val is None else spark.createDataFrame([(x,) for x in tables.read_names(pin_val)], "shape_id string")
    _kept(frames.split(good.select("shape_id", "folder"), val_share, "shape_id", "folder", pins), f"{out}/split")
    if pins is not None:
        _kept(frames.missing(pins, good, "shape_id"), f"{out}/pins_missing")
    built = spark.read.parquet(f"{out}/build").select("shape_id", "status").join(spark.read.parquet(f"{out}/clouds").select("shape_id", "n_topup"), "shape_id", "left")
    sides = spark.read.parquet(f"{out}/split").agg(F.count_if(F.col("side") == "train").alias("n_train"), F.count_if(F.col("side") == "val").alias("n_val"))
    states = built.agg(F.count_if(F.col("status") == "reject").alias("n_reject"), F.count_if(F.col("status") == "error").alias("n_error"))
    # three single rows side by side
    tables.write_summary(reports.shortfall(built, n_points).crossJoin(states).crossJoin(sides), f"{out}/summary.json")
    return 0


def scan(spark: SparkSession, data: str, p99_most: float = 0.02, watertight_least: float = 0.6, misfit_most: float = 0.05, coordinate_most: float = 1.0, spread_most: float = 0.02) -> int:
    """Audits clouds against their meshes and the shared frame; 1 where a stop gate holds."""
    meshes, clouds = (spark.read.parquet(f"{data}/{x}") for x in ("meshes", "clouds"))
    # one row a shape; both sides carry packed shapes, so the join is by sorted shuffle unless Spark knows a side is small
    audit = _kept(shapes.cloud_distances(meshes.select("shape_id", "folder", "xyz", "tri").join(clouds.select("shape_id", "points"), "shape_id"), flag_above=p99_most), f"{data}/pair_audit")
    topology = _kept(shapes.described(meshes.select("shape_id", "folder", "xyz", "tri")), f"{data}/manifest")
    axis = lambda f, a: f(F.filter("xyz", lambda x, i: i % 3 == a))
    extent = F.greatest(*[axis(F.array_max, a) - axis(F.array_min, a) for a in range(3)])
    frame = meshes.select("shape_id", F.greatest(F.array_max("xyz"), -F.array_min("xyz")).alias("reach"), extent.alias("extent"))
    rows = frame.join(topology.select("shape_id", "is_watertight"), "shape_id", "left").join(audit.select("shape_id", F.col("frame_flag").alias("misfit")), "shape_id", "left")
    got = reports.stop_gates(rows, watertight_least, misfit_most, coordinate_most, spread_most).first()
    return 2 if got.stops is None else int(got.stops)


def train(spark: SparkSession, data: str, out: str, steps: int = 1000, batch: int = 32, n: int = 2048, smoke: int = 0, smoke_bce: float = 0.5, size: str | None = None) -> int:
    """Prepared shapes -> networks and a log (see operators.training). With smoke, 1 where the best loss on the probe shapes is above smoke_bce. size: JSON of the network's size where it is not the full one."""
    got = training.train(spark, data, out, steps=steps, batch=batch, n=n, size=json.loads(size) if size else None, smoke=smoke)
    return int(smoke > 0 and not got["best"] <= smoke_bce)


def _bounds(spark: SparkSession, data: str | None) -> tuple:
    """The box of the data, padded, or the frame where no data is named."""
    if data is None:
        return inference.FRAME
    r = frames.padded_bounds(spark.read.parquet(f"{data}/bounds")).first()
    return tuple(r.low), tuple(r.high)


def _box(spark: SparkSession, net: str, data: str | None, bounds: str | None) -> tuple | None:
    """The shapes' box: of a file (JSON) before the network's own before the data's; None where there is none."""
    given = tables.read_bounds(spark, bounds).first() if bounds else None
    own = inference.bounds_of(spark, net)
    ready = spark.read.parquet(f"{data}/bounds").select("low", "high").first() if data else None
    box = tables.first_given(given, own, ready)
    return box and (list(box[0]), list(box[1]))


def _grid(spark: SparkSession, box: tuple | None) -> tuple:
    if box is None:
        return inference.FRAME
    r = frames.padded_bounds(spark.createDataFrame([box], "low array<double>, high array<double>")).first()
    return tuple(r.low), tuple(r.high)


def meshify(spark: SparkSession, net: str, data: str, out: str, side: str = "val", names: str | None = None, limit: int = 0, res: int = 128, drop_floaters: bool = False) -> int:
    """Prepared clouds of a side of the split (or those that the JSON file names lists; the first `limit` by name) -> level sets as a table and STL files, not simplified. Shapes without a level set have a row and no file."""
    clouds = spark.read.parquet(f"{data}/clouds").where("error is null").select("shape_id", "points")
    chosen = frames.in_order(clouds, tables.read_names(names, side), "shape_id").drop("ordinal") if names else clouds.join(spark.read.parquet(f"{data}/split").where(F.col("side") == side).select("shape_id"), "shape_id", "left_semi")
    if limit:
        chosen = chosen.join(chosen.select("shape_id").orderBy("shape_id").limit(limit), "shape_id", "left_semi")
    made = _kept(inference.surfaces(chosen, inference.loaded(spark, net), res, *_grid(spark, _box(spark, net, data, None)), drop_floaters), f"{out}/surfaces")
    return 0 if _export(made.where("size(tri) > 0"), f"{out}/stl") else 2


def infer(spark: SparkSession, src: str, net: str, out: str, res: int = 128, target: int = 4000, data: str | None = None, bounds: str | None = None, n_points: int = 1000, no_decimate: bool = False, no_drop_floaters: bool = False) -> int:
    """Clouds (.npy, taken as they are) and meshes (.stl, put in the frame and sampled) -> STL files and a report of every input (see reports.answer_status); 1 where an emitted surface is broken, or a cloud and a mesh have one name (listed in collisions). bounds: JSON of the shapes' box, before the network's own and that of data, a prepared folder."""
    read, cloud = _named(files.read_stl(spark, src)).persist(), _named(files.read_clouds(spark, src))
    none = lambda kind, c: F.lit(None).cast(kind).alias(c)
    row = lambda d, kind, points=None, topup=None, error="error", reject=None: d.select("shape_id", F.lit(kind).alias("kind"), F.col(points) if points else none("array<double>", "points"), F.col(topup) if topup else none("int", "n_topup"), F.col(error).alias("error") if error else none("string", "error"), (reject if reject is not None else none("string", "reject")).alias("reject"))
    framed = _kept(shapes.normalized(read.where("error is null and size(tri) > 0").drop("error")).select("shape_id", "xyz", "tri", "error"), f"{out}/framed")
    flat = F.exists(F.sequence(F.lit(0), (F.size("points") / 6).cast("int") - 1), lambda i: ~F.coalesce(sum(F.pow(F.get("points", i * 6 + k), F.lit(2)) for k in (3, 4, 5)) > 0, F.lit(False)))
    refused = F.when(F.col("error").startswith("ValueError: a cloud of shape"), F.col("error")).when(F.col("width") != 6, "points without normals").when(F.size("points") == 0, "no points").when(flat, "normals of length zero")
    parts = [
        row(read.where("error is not null"), "stl"), row(read.where("error is null and size(tri) = 0"), "stl", error=None, reject=F.lit("no faces")), row(framed.where("error is not null"), "stl"),
        row(shapes.sampled(framed.where("error is null").drop("error"), n_points), "stl", "points", "n_topup"),
        row(cloud.withColumn("reject", refused).withColumn("error", F.when(F.col("reject").isNull(), F.col("error"))), "npy", "points", reject=F.col("reject")),
    ]
    given = parts[0]
    for p in parts[1:]:
        given = given.unionByName(p)
    given = _kept(given, f"{out}/inputs")
    read.unpersist()
    if given.isEmpty():
        return 2
    twice = _kept(given.groupBy("shape_id").agg(F.sort_array(F.collect_list("kind")).alias("kinds")).where("size(kinds) > 1"), f"{out}/collisions")
    if not twice.isEmpty():
        return 1
    box = _box(spark, net, data, bounds)
    made = _kept(inference.meshes(given.where("error is null and reject is null").select("shape_id", "points"), inference.loaded(spark, net), res, *_grid(spark, box), 0 if no_decimate else target, not no_drop_floaters), f"{out}/predicted")
    _export(made.where("size(tri) > 0"), f"{out}/stl")
    facts = shapes.described(made.select("shape_id", "xyz", "tri")).drop("error")
    axis = lambda f, a: f(F.filter("points", lambda x, i: i % 6 == a))
    over = F.greatest(*[x for a in range(3) for x in (box[0][a] - axis(F.array_min, a), axis(F.array_max, a) - box[1][a])]) if box else F.lit(None).cast("double")
    asked = given.select("shape_id", "kind", F.col("error").alias("input_error"), "reject", "n_topup", F.when(F.col("points").isNotNull(), F.size("points") / 6).cast("int").alias("n_given"), F.greatest(over, F.lit(0.0)).alias("overflow") if box else over.alias("overflow"))
    rows = asked.join(made.select("shape_id", "failed_step", "reason", "faces_in", "faces_out", F.col("emitted_broken").alias("broken"), F.col("error").alias("mesh_error")), "shape_id", "left")
    rows = rows.withColumns({"error": F.coalesce("input_error", "mesh_error"), "found": F.col("faces_in"), "broken": F.when(F.col("faces_out") > 0, F.col("broken"))})
    report = _kept(reports.answer_status(rows, n_points).drop("input_error", "mesh_error", "found").join(facts, "shape_id", "left"), f"{out}/report")
    return int(not report.where("broken = 1").isEmpty())


def evaluate(spark: SparkSession, predicted: str, data: str, out: str, n: int = 100_000, res: int = 128, limit: int = 0) -> int:
    """Scores of every held-out shape (the first `limit` by folder and name, if given) in the data's box; shapes without a prediction stay in as failures."""
    held = spark.read.parquet(f"{data}/split").where("side = 'val'").select("shape_id", "folder")
    held = held.orderBy("folder", "shape_id").limit(limit) if limit else held
    truth = spark.read.parquet(f"{data}/meshes").join(held.select("shape_id"), "shape_id", "left_semi")
    return 2 if _kept(inference.scored(spark.read.parquet(predicted), truth, n, res, *_bounds(spark, data)), out).isEmpty() else 0


def gates(spark: SparkSession, scores: str, out: str, domain_gap_max: float = 0.10, names: str | None = None) -> int:
    """Scores (of evaluate) -> gates and domain gaps as tables and CSV, and a summary as JSON. names: a JSON file of the shapes that count. 1 where, of several folders, one's IoU lies below the overall one by more than domain_gap_max."""
    rows = spark.read.parquet(scores).withColumnRenamed("iou", "iou128")
    if names is not None:
        rows = frames.in_order(rows, tables.read_names(names), "shape_id").drop("ordinal")
    if rows.isEmpty():
        return 2
    judged = _kept(frames.gates(rows), f"{out}/gates")
    gaps = _kept(frames.domain_gaps(rows, domain_gap_max), f"{out}/gaps")
    tables.write_csv(judged, f"{out}/gates_csv", ["scope", "gate", "value", "n", "n_missing", "verdict"], ["scope", "gate"])
    tables.write_csv(gaps, f"{out}/gaps_csv", gaps.columns, ["folder_iou", "folder"])
    counts = judged.where("scope = '*'").groupBy("verdict").count()
    tables.write_summary(rows.agg(F.count(F.lit(1)).alias("n_shapes"), F.count("error").alias("n_failed")).join(counts.agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("verdict", "count")))).alias("verdicts"))), f"{out}/summary.json")
    return int(gaps.count() > 1 and not gaps.where("interferes").isEmpty())


def figures(spark: SparkSession, scores: str, out: str, other: str | None = None, run: str | None = None, n: int = 6) -> int:
    """Tables behind the figures of scores, one CSV folder each (see reports.figures); other: a second evaluation; run: a training folder, whose log is the loss curve."""
    rows = spark.read.parquet(scores)
    if rows.isEmpty():
        return 2
    made = reports.figures(rows, n, spark.read.parquet(other) if other else None, spark.read.parquet(f"{run}/log") if run else None)
    for name, table in made.items():
        tables.write_csv(table, f"{out}/{name}", table.columns, [table.columns[0]])
    return 0


def remesh(spark: SparkSession, src: str, out: str, target: int = 4000, reverts_csv: str | None = None) -> int:
    """STL files -> STL files within the budget of faces, and a table (and CSV) of those given back unchanged."""
    read = _named(files.read_stl(spark, src)).where("error is null").drop("error")
    done = _kept(shapes.remeshed(read, target), f"{out}/remeshed")
    if not _export(done.where("error is null"), f"{out}/stl"):
        return 2
    reverts = _kept(done.where("failed_step is not null").select("shape_id", "failed_step", "reason", "faces_in", "faces_out", "emitted_broken"), f"{out}/reverts")
    if reverts_csv:
        tables.write_csv(reverts, reverts_csv, reverts.columns, ["shape_id"])
    return 0


def verify(spark: SparkSession, net: str, src: str, data: str | None = None, res: int = 128, target: int = 4000, n_points: int = 1000, no_decode: bool = False) -> int:
    """Prints one line a check (see verify.checks) and a summary; 1 where one fails."""
    done = verification.checks(spark, net, src, _box(spark, net, data, None) if tables.exists(spark, net) else None, res, target, n_points, not no_decode)
    for c in done:
        print(f"{'ok  ' if c.good else 'FAIL'}  {c.section}: {c.label}" + (f"  {c.detail}" if c.detail else ""))
    bad = [c.label for c in done if not c.good]
    print(f"{len(bad)} of {len(done)} checks failed" + "".join(f"\n  {x}" for x in bad))
    return int(bool(bad))


def available_backend() -> str | None:
    """The first library for tetrahedra that can be imported."""
    from importlib.util import find_spec

    return next((b for b in BACKENDS if find_spec(b)), None)


#: Options that name a place.
PLACES = {"data", "bounds", "names", "pin_val", "other", "run", "reverts_csv"}


def _configured(argv: list[str]) -> tuple[dict, str | None, list[str]]:
    """(the sections of --config, its path, the other arguments)."""
    first = argparse.ArgumentParser(add_help=False, allow_abbrev=False)
    first.add_argument("--config")
    known, rest = first.parse_known_args(argv)
    return (tables.read_settings(known.config).values if known.config else {}), known.config, rest


def main(argv: list[str] | None = None, spark: SparkSession | None = None) -> int:
    config, where, argv = _configured(sys.argv[1:] if argv is None else argv)
    p = argparse.ArgumentParser(prog="shapeloom", epilog="--config FILE: paths and options from the file's section of the verb's name; the command line comes first")
    verbs = p.add_subparsers(dest="verb", required=True)
    for verb, names, options in (
        ("prepare", ("src", "out"), {"n_points": 1000, "n_queries": 100_000, "limit": 0, "force": False, "pin_val": None}), ("scan", ("data",), {"p99_most": 0.02, "watertight_least": 0.6, "misfit_most": 0.05, "coordinate_most": 1.0, "spread_most": 0.02}), ("train", ("data", "out"), {"steps": 1000, "batch": 32, "n": 2048, "smoke": 0, "smoke_bce": 0.5, "size": None}),
        ("meshify", ("net", "data", "out"), {"side": "val", "names": None, "limit": 0, "res": 128, "drop_floaters": False}), ("infer", ("src", "net", "out"), {"res": 128, "target": 4000, "data": None, "bounds": None, "n_points": 1000, "no_decimate": False, "no_drop_floaters": False}),
        ("evaluate", ("predicted", "data", "out"), {"n": 100_000, "res": 128, "limit": 0}), ("gates", ("scores", "out"), {"domain_gap_max": 0.10, "names": None}), ("figures", ("scores", "out"), {"other": None, "run": None, "n": 6}), ("remesh", ("src", "out"), {"target": 4000, "reverts_csv": None}),
        ("verify", ("net", "src"), {"data": None, "res": 128, "target": 4000, "n_points": 1000, "no_decode": False}), ("tetrahedralize", ("src",), {"backend": None, "size_factor": 1.0, "volume_tol": 0.01, "no_write": False}),
    ):
        v = verbs.add_parser(verb)
        section = {str(k).replace("-", "_"): x for k, x in ((argv[:1] == [verb] and config.get(verb)) or {}).items()}
        if unknown := set(section) - {*names, *options}:
            p.error(f"{where}: no setting {', '.join(sorted(unknown))} of {verb} among {', '.join((*names, *options))}")
        section = {k: tables.resolved(str(x), where) if x is not None and (k in names or k in PLACES) else x for k, x in section.items()}
        for x in names:
            v.add_argument(x, **({"nargs": "?", "default": section[x]} if x in section else {}))
        for x, default in options.items():
            how = {"action": "store_true"} if default is False else {"type": str if default is None else type(default)}
            # texts are parsed as on the command line; a whole number may stand for a fraction
            own = section.get(x, default)
            own = json.dumps(own) if isinstance(own, (dict, list)) else type(default)(own) if default is not None and default is not False else own
            v.add_argument(f"--{x.replace('_', '-')}", **how, default=own)
    given = vars(p.parse_args(argv))
    verb = given.pop("verb")
    if verb == "tetrahedralize":
        print(f"no tetrahedra: {given['backend'] or available_backend() or 'none of ' + ', '.join(BACKENDS)} is not supported here")
        return 2
    return {"prepare": prepare, "scan": scan, "train": train, "meshify": meshify, "infer": infer, "evaluate": evaluate, "gates": gates, "figures": figures, "remesh": remesh, "verify": verify}[verb](spark or SparkSession.builder.getOrCreate(), **given)
