"""Report operators on nulls, ties and empty tables; the file as the last step of simplification."""

import numpy as np

from shapeloom.functions import levelset
from shapeloom.operators import reports, shapes


def made(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_empty_tables(spark):
    built = made(spark, [], "status string, n_topup int")
    assert tuple(reports.shortfall(built, 10).first()) == (0, 0, 0.0, 0, 0.0)
    scores = made(spark, [], "shape_id string, iou double, euler_match int")
    assert [r.n for r in reports.histogram(scores, bins=3).orderBy("bin").collect()] == [0, 0, 0]
    assert {r.change: (r.n, r.share) for r in reports.transitions(reports.compared(scores, scores)).collect()} == dict.fromkeys(("right", "wrong", "fixed", "broken"), (0, 0.0))
    assert set(reports.cube(made(spark, [], "x double, y double, z double")).first()) == {None}
    assert reports.smallest(made(spark, [], "path string, length long")).first().path is None


def test_histogram_keeps_the_ends_and_leaves_unknown_values_out(spark):
    rows = made(spark, [(x,) for x in (0.0, 1.0, 0.5, None, float("nan"))], "iou double")
    assert [r.n for r in reports.histogram(rows, bins=2).orderBy("bin").collect()] == [1, 2]


def test_changes_and_movers(spark):
    schema = "shape_id string, iou double, euler_match int"
    a = made(spark, [("a", 0.5, 1), ("b", 0.5, 0), ("c", 0.5, 1), ("d", 0.5, None), ("e", None, 1), ("only", 0.1, 1)], schema)
    b = made(spark, [("a", 0.5, 1), ("b", 0.75, 1), ("c", 0.25, 0), ("d", 0.50001, 0), ("e", 0.9, 1)], schema)
    both = reports.compared(a, b)
    assert {r.shape_id: r.change for r in both.collect()} == {"a": "right", "b": "fixed", "c": "broken", "d": "wrong", "e": "right"}
    assert [r.shape_id for r in reports.movers(both).collect()] == ["b", "c"]


def test_runs_with_null_keys(spark):
    rows = made(spark, [(1, k, v) for k, v in enumerate([None, None, "a", "a", None, "b"])], "g int, at int, key string")
    assert [(r.starts, r.run) for r in reports.runs(rows, "key", ["at"], "g").orderBy("at").collect()] == [(True, 1), (False, 1), (True, 2), (False, 2), (True, 3), (True, 4)]


def test_smallest_of_equals(spark):
    files = made(spark, [("b", 3), ("a", 3), ("c", 9), ("d", None)], "path string, length long")
    assert tuple(reports.smallest(files).first()) == ("a", 3)


def test_states_in_their_order(spark):
    rows = made(spark, [("x", 0, 0), (None, None, 5), (None, 0, 5), (None, 1, 0), (None, 1, None), (None, 1, 5)], "error string, surf_watertight int, n_tets int")
    assert [r.status for r in reports.tetrahedra_status(rows).collect()] == ["error", "skip", "skip", "fail", "fail", "ok"]


def test_a_mesh_that_its_file_breaks_is_given_back(spark):
    g = levelset.grid((-1,) * 3, (1,) * 3, 10)
    v, f = levelset.surface((0.6 - np.linalg.norm(g, axis=1)).reshape(10, 10, 10), (-1,) * 3, (1,) * 3)
    # far from the origin single precision cannot tell the corners apart
    rows = [("near", *shapes.packed(v, f).values()), ("far", *shapes.packed(v + 1e8, f).values())]
    got = {r.shape_id: r for r in shapes.remeshed(made(spark, rows, "shape_id string, xyz array<double>, tri array<int>"), 0).collect()}
    assert (got["near"].failed_step, got["near"].emitted_broken) == (None, 0)
    assert got["far"].failed_step == "export" and got["far"].emitted_broken == 1 and got["far"].faces_out == len(f)
