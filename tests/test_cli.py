"""The verbs from files to scores, on spheres and boxes."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom import cli
from shapeloom.cli import main
from shapeloom.functions import levelset, mesh
from shapeloom.functions.network import Network
from shapeloom.operators import inference
from shapeloom.sources import tables
from shapeloom.sources.shapes import decode_stl, encode_stl
from shapeloom.sources.tables import read_csv, read_text, write_bounds


def ball(radius, res=12):
    g = levelset.grid((-1,) * 3, (1,) * 3, res)
    return levelset.surface((radius - np.linalg.norm(g, axis=1)).reshape(res, res, res), (-1,) * 3, (1,) * 3)


def test_from_files_to_scores(spark, tmp_path):
    src, data, out = tmp_path / "src", str(tmp_path / "data"), str(tmp_path / "out")
    for k in range(4):
        (src / f"f{k % 2}").mkdir(parents=True, exist_ok=True)
        v, f = ball(0.4 + k / 10)
        (src / f"f{k % 2}" / f"s{k}.stl").write_bytes(encode_stl(v + k, f))
    (src / "f0" / "open.stl").write_bytes(encode_stl(v, f[20:]))
    (src / "f0" / "bad.stl").write_bytes(b"?")
    assert main(["prepare", str(src), data, "--n-points", "64", "--n-queries", "60"], spark) == 0
    build = {r.stem: r for r in spark.read.parquet(f"{data}/build").collect()}
    assert {k: r.status for k, r in build.items()} == {"s0": "ok", "s1": "ok", "s2": "ok", "s3": "ok", "open": "reject", "bad": "error"}
    assert sorted((r.folder, r.side) for r in spark.read.parquet(f"{data}/split").collect()) == [("f0", "train"), ("f0", "val"), ("f1", "train"), ("f1", "val")]
    occ = spark.read.parquet(f"{data}/queries").select(F.avg("occ_near"), F.count("*")).first()
    assert 0.2 < occ[0] < 0.8 and occ[1] == 4
    assert main(["scan", data], spark) == 0 and spark.read.parquet(f"{data}/pair_audit").agg(F.max("max_d")).first()[0] < 1e-6
    inference.saved(spark, Network.fresh({"d_model": 8, "n_heads": 2, "n_layers": 1, "n_freq": 2, "n_centers": 4, "max_freq": 2}, 3), str(tmp_path / "net"))
    (src / "f0" / "none.stl").write_bytes(encode_stl(v, f[:0]))
    for name, points in (("short", np.ones((9, 6))), ("flat", np.zeros((9, 6))), ("bare", np.ones((9, 3))), ("line", np.ones(9))):
        np.save(src / f"{name}.npy", points)
    assert main(["infer", str(src), str(tmp_path / "net"), out, "--res", "8", "--target", "100", "--data", data, "--n-points", "64"], spark) == 0
    report = {r.shape_id: r for r in spark.read.parquet(f"{out}/report").collect()}
    assert len(report) == 11 and report["f0/bad"].status == "error" and {k for k, r in report.items() if r.status == "reject"} == {"f0/none", "flat", "bare", "line"}
    assert report["flat"].why == "normals of length zero" and report["short"].status in ("ok", "fail") and "9 points, not 64" in report["short"].warnings and "reaches out" in report["short"].warnings
    assert all(r.broken == 0 for r in report.values() if r.status == "ok" and not r.failed_step)
    assert main(["meshify", str(tmp_path / "net"), data, str(tmp_path / "raw"), "--res", "8", "--limit", "1"], spark) in (0, 2)
    assert spark.read.parquet(str(tmp_path / "raw" / "surfaces")).count() == 1
    assert main(["evaluate", f"{out}/predicted", data, str(tmp_path / "scores"), "--n", "50", "--res", "8"], spark) == 0
    assert spark.read.parquet(str(tmp_path / "scores")).count() == 2
    assert main(["figures", str(tmp_path / "scores"), str(tmp_path / "figs"), "--other", str(tmp_path / "scores")], spark) == 0
    figs = {x: read_csv(spark, str(tmp_path / "figs" / x)).collect() for x in ("gates", "histogram", "picks", "pairs", "movers", "transitions")}
    assert len(figs["histogram"]) == 20 and sum(int(r.n) for r in figs["histogram"]) == 2 and len(figs["pairs"]) == 2 and not figs["movers"]
    assert main(["remesh", str(src), str(tmp_path / "small"), "--target", "80", "--reverts-csv", str(tmp_path / "reverts")], spark) == 0
    assert [r.shape_id for r in read_csv(spark, str(tmp_path / "reverts")).collect()] == ["f0/none", "f0/open"]
    for k in range(4):
        v, f = decode_stl((tmp_path / "small" / "stl" / f"f{k % 2}" / f"s{k}.stl").read_bytes())
        assert len(f) == 80 and mesh.is_watertight(f) and mesh.is_consistent(f)
    assert [r.shape_id for r in spark.read.parquet(str(tmp_path / "small" / "reverts")).orderBy("shape_id").collect()] == ["f0/none", "f0/open"]


def test_stops(spark, tmp_path):
    (tmp_path / "a").mkdir()
    (tmp_path / "none").mkdir()
    for place in ("", "a"):
        (tmp_path / place / "same.stl").write_bytes(encode_stl(*ball(0.5)))
    assert main(["prepare", str(tmp_path), str(tmp_path / "out")], spark) == 1
    assert main(["tetrahedralize", str(tmp_path)], spark) == 2


def test_prepare_again(spark, tmp_path):
    src, data = tmp_path / "src", str(tmp_path / "data")
    src.mkdir()
    for k in range(3):
        (src / f"s{k}.stl").write_bytes(encode_stl(*ball(0.4 + k / 10)))
    few = ["--n-points", "32"]
    assert main(["prepare", str(src), data, "--n-queries", "20", "--limit", "2", *few], spark) == 0
    assert sorted(r.shape_id for r in spark.read.parquet(f"{data}/queries").collect()) == ["s0", "s1"]
    (tmp_path / "pins.json").write_text('{"val": ["s1", "gone"]}')
    assert main(["prepare", str(src), data, "--n-queries", "30", "--pin-val", str(tmp_path / "pins.json"), *few], spark) == 0
    size = lambda: {r.shape_id: len(r.occ) for r in spark.read.parquet(f"{data}/queries").collect()}
    assert size() == {"s0": 20, "s1": 20, "s2": 30}
    assert [r.shape_id for r in spark.read.parquet(f"{data}/split").where("side = 'val'").collect()] == ["s1"]
    assert [r.shape_id for r in spark.read.parquet(f"{data}/pins_missing").collect()] == ["gone"]
    assert main(["prepare", str(src), data, "--n-queries", "30", "--force", *few], spark) == 0
    assert set(size().values()) == {30}
    told = json.loads(read_text(f"{data}/summary.json"))
    assert (told["n_ok"], told["n_train"], told["n_val"], told["n_reject"]) == (3, 2, 1, 0)


def test_a_changed_file_is_prepared_anew_and_others_are_not_touched(spark, tmp_path):
    src, data = tmp_path / "src", str(tmp_path / "data")
    for folder in ("007", "b", "c"):
        (src / folder).mkdir(parents=True)
    for k, folder in enumerate(("007", "007", "b", "c")):
        (src / folder / f"s{k}.stl").write_bytes(encode_stl(*ball(0.4 + k / 10)))
    few = ["--n-points", "32", "--n-queries", "20"]
    assert main(["prepare", str(src), data, *few], spark) == 0
    read = lambda: {r.shape_id: r for r in tables.by_folder(spark, f"{data}/queries").withColumn("file", F.input_file_name()).collect()}
    before = read()
    assert {k: r.folder for k, r in before.items()} == {"007/s0": "007", "007/s1": "007", "b/s2": "b", "c/s3": "c"}
    (src / "007" / "s0.stl").write_bytes(encode_stl(*ball(0.9)))
    (src / "b" / "s4.stl").write_bytes(encode_stl(*ball(0.6)))
    assert main(["prepare", str(src), data, *few], spark) == 0
    after = read()
    assert set(after) == {*before, "b/s4"} and after["007/s0"].sha1 != before["007/s0"].sha1 and after["007/s0"].query != before["007/s0"].query
    assert all((after[k].query, after[k].sha1) == (before[k].query, before[k].sha1) for k in ("007/s1", "b/s2", "c/s3"))
    # files of folders without a change are the same ones
    assert all(after[k].file == before[k].file for k in ("b/s2", "c/s3"))
    assert main(["prepare", str(src), data, *few], spark) == 0
    assert {k: r.file for k, r in read().items()} == {k: r.file for k, r in after.items()}


def test_settings_from_a_file(spark, tmp_path):
    (tmp_path / "src").mkdir()
    for k in range(2):
        (tmp_path / "src" / f"s{k}.stl").write_bytes(encode_stl(*ball(0.4 + k / 10)))
    place = tmp_path / "all.yaml"
    place.write_text("prepare: {src: src, out: data, n-points: 32, n_queries: 20}\nscan: {data: data, watertight_least: 1, coordinate_most: 0.01}\nremesh: {depth: 3}\n")
    assert main(["prepare", "--config", str(place)], spark) == 0
    read = lambda x: [len(r.occ) for r in spark.read.parquet(str(tmp_path / x / "queries")).collect()]
    assert read("data") == [20, 20]
    # the command line comes first
    assert main(["prepare", "--config", str(place), str(tmp_path / "src"), str(tmp_path / "more"), "--n-queries", "24"], spark) == 0
    assert read("more") == [24, 24]
    assert main(["scan", "--config", str(place)], spark) == 1 and main(["scan", "--config", str(place), "--coordinate-most", "1"], spark) == 0
    with pytest.raises(SystemExit):
        main(["remesh", "--config", str(place), "a", "b"], spark)


def test_verify(spark, tmp_path, capsys):
    src, net = tmp_path / "in", str(tmp_path / "net")
    src.mkdir()
    assert main(["verify", net, str(src), "--res", "8"], spark) == 1
    assert "FAIL  network: is there" in capsys.readouterr().out
    v, f = ball(0.5)
    shift, scale = mesh.frame(v, f)
    v = (v + shift) * scale
    (src / "a.stl").write_bytes(encode_stl(v, f))
    np.save(src / "a.npy", np.hstack([v[:16] * 0.9, v[:16]]))
    inference.saved(spark, Network.fresh({"d_model": 8, "n_heads": 2, "n_layers": 1, "n_freq": 2, "n_centers": 4, "max_freq": 2}, 3), net, ((-0.5,) * 3, (0.5,) * 3))
    assert inference.bounds_of(spark, net) == ((-0.5,) * 3, (0.5,) * 3)
    assert main(["verify", net, str(src), "--no-decode", "--n-points", "16"], spark) == 0
    # a box from a file comes before the network's own
    write_bounds(spark.createDataFrame([([0.0] * 3, [1.0] * 3)], "low array<double>, high array<double>"), str(tmp_path / "box.json"))
    assert cli._box(spark, net, None, str(tmp_path / "box.json")) == ([0.0] * 3, [1.0] * 3) and cli._box(spark, net, None, None) == ([-0.5] * 3, [0.5] * 3)
    np.save(src / "b.npy", np.full((16, 6), 0.7))
    assert main(["verify", net, str(src), "--no-decode", "--n-points", "16"], spark) == 1
    told = capsys.readouterr().out
    assert "FAIL  inputs: every mesh" in told and "FAIL  inputs: clouds lie" in told and "ok    inputs: normals" in told
