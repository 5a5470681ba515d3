"""CSV, JSON and settings, and the gate verb."""

import json

import pytest

from shapeloom.cli import main
from shapeloom.sources import tables


def test_csv_round_trip(spark, tmp_path):
    rows = spark.createDataFrame([("b", 1.5, True, None), ("a", None, False, 'x, "y"')], "stem string, v double, ok boolean, error string")
    tables.write_csv(rows, f"{tmp_path}/t", ["stem", "ok", "v", "error"], ["stem"])
    (part,) = [p for p in (tmp_path / "t").iterdir() if p.suffix == ".csv"]
    assert part.read_text().splitlines()[0] == "stem,ok,v,error"
    got = tables.read_csv(spark, f"{tmp_path}/t", "stem string, v double, ok int, error string, more int").orderBy("stem").collect()
    assert [(r.stem, r.v, r.ok, r.error, r.more) for r in got] == [("a", None, 0, 'x, "y"', None), ("b", 1.5, 1, None, None)]
    assert set(tables.read_csv(spark, f"{tmp_path}/t").dtypes) == {(c, "string") for c in ("stem", "ok", "v", "error")}


def test_json_forms(spark, tmp_path):
    split = spark.createDataFrame([("s2", "f", "train"), ("s1", "f", "val"), ("s3", "g", "train")], "shape_id string, folder string, side string")
    tables.write_summary(tables.folders_of(split), f"{tmp_path}/split.json")
    got = json.loads((tmp_path / "split.json").read_text())
    assert got == {"train": ["s2", "s3"], "val": ["s1"], "by_folder": {"f": {"train": ["s2"], "val": ["s1"]}, "g": {"train": ["s3"], "val": []}}}
    assert tables.read_names(f"{tmp_path}/split.json") == ["s1"]
    tables.write_text(f"{tmp_path}/list.json", '["b", 3]')
    assert tables.read_names(f"{tmp_path}/list.json") == ["b", "3"]
    tables.write_bounds(spark.createDataFrame([([0.0, 1.0, 2.0], [3.0, 4.0, 5.0])], "low array<double>, high array<double>"), f"{tmp_path}/bounds.json")
    assert tables.read_bounds(spark, f"{tmp_path}/bounds.json").collect() == [([0.0, 1.0, 2.0], [3.0, 4.0, 5.0])]
    with pytest.raises(ValueError):
        tables.write_summary(split, f"{tmp_path}/no.json")
    with pytest.raises(ValueError):
        tables.read_names(f"{tmp_path}/bounds.json")


def test_settings(tmp_path):
    pytest.importorskip("yaml")
    (tmp_path / "s.yaml").write_text("a:\n  b: 3\nc: x\n")
    s = tables.read_settings(f"{tmp_path}/s.yaml")
    assert s.a.b == 3 and s.c == "x" and tables.resolved("d/e", f"{tmp_path}/s.yaml") == f"{tmp_path}/d/e" and tables.resolved("/d", "s") == "/d"
    with pytest.raises(AttributeError, match="no setting 'z'"):
        s.a.z  # noqa: B018
    assert tables.first_given(None, 0, 5) == 0 and tables.first_given(None) is None


def test_gate_verb(spark, tmp_path):
    names = "watertight int, winding_consistent int, self_intersection_free int, iou double, chamfer_l2_x1e3 double, normal_consistency double, euler_match int"
    good, bad = (1, 1, 1, 0.95, 0.2, 0.95, 1), (0, 0, 0, 0.0, float("nan"), 0.0, 0)
    rows = [(f"s{k}", "f", *(good if k < 9 else bad), None if k < 9 else "broken") for k in range(10)] + [("g1", "g", *good, None)]
    spark.createDataFrame(rows, f"shape_id string, folder string, {names}, error string").write.parquet(f"{tmp_path}/scores")
    assert main(["gates", f"{tmp_path}/scores", f"{tmp_path}/out"], spark) == 0
    got = {(r.scope, r.gate): r for r in spark.read.parquet(f"{tmp_path}/out/gates").collect()}
    assert got["f", "watertight"].value == 0.9 and got["f", "watertight"].n == 10 and got["f", "watertight"].verdict == "PARTIAL"
    assert (got["f", "chamfer_l2_x1e3"].n, got["f", "chamfer_l2_x1e3"].n_missing, got["f", "chamfer_l2_x1e3"].verdict) == (9, 1, "PASS")
    assert json.loads((tmp_path / "out" / "summary.json").read_text())["n_failed"] == 1
    assert main(["gates", f"{tmp_path}/scores", f"{tmp_path}/out", "--domain-gap-max", "0.001"], spark) == 1
    tables.write_text(f"{tmp_path}/names.json", '["s1", "s9"]')
    assert main(["gates", f"{tmp_path}/scores", f"{tmp_path}/out", "--names", f"{tmp_path}/names.json", "--domain-gap-max", "0.001"], spark) == 0
    assert spark.read.parquet(f"{tmp_path}/out/gates").where("gate = 'iou128' and scope = '*'").first().n == 2
