"""DataFrame operators against brute force, and on empty and odd tables."""

import numpy as np
import pandas as pd
import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from shapeloom.functions import levelset, mesh
from shapeloom.operators import frames


def points(spark, rows, dim="shape_id long, pid long, x double, y double, z double"):
    return spark.createDataFrame(rows, dim)


def test_nearest_equals_brute_force(spark):
    rng = np.random.default_rng(0)
    a, b = rng.normal(size=(60, 3)), np.concatenate([rng.normal(size=(80, 3)) * 0.1, [[50, 50, 50]], [[0, 0, 0]] * 2])
    rows = lambda p, s: [(s, k, *map(float, x)) for k, x in enumerate(p)]
    left = points(spark, rows(a, 1) + rows(a[:5], 2) + [(3, 0, 0.0, 0.0, 0.0), (1, 99, None, 0.0, 0.0), (None, 1, 0.0, 0.0, 0.0)])
    right = points(spark, rows(b, 1) + rows(b[:1], 2))
    got = {(r.shape_id, r.pid): (r.near, r.d2) for r in frames.nearest(left, right).collect()}
    for s, p, q in ((1, a, b), (2, a[:5], b[:1])):
        d = ((p[:, None] - q[None]) ** 2).sum(2)
        for k in range(len(p)):
            assert got.pop((s, k)) == (int(d[k].argmin()), pytest.approx(d[k].min()))
    assert not got and frames.nearest(left.limit(0), right).count() == 0 and frames.nearest(left, right.limit(0)).count() == 0


def test_box_pairs_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    low = rng.integers(0, 20, (80, 3)).astype(float)
    high = low + rng.integers(0, 3, (80, 3))
    high[:3] = 25
    rows = [(1, k, *(float(v) for c in range(3) for v in (low[k, c], high[k, c]))) for k in range(80)] + [(2, 0, 0.0, 1.0, 0.0, 1.0, 0.0, 1.0)]
    boxes = spark.createDataFrame(rows, "shape_id long, fid long, x0 double, x1 double, y0 double, y1 double, z0 double, z1 double")
    want = {(1, i, j) for i in range(80) for j in range(i + 1, 80) if (low[i] <= high[j]).all() and (low[j] <= high[i]).all()}
    for most in (64, 1):
        got = [tuple(r) for r in frames.box_pairs(boxes, most_cells=most).collect()]
        assert set(got) == want and len(got) == len(want)


def test_ranks_without_one_task(spark):
    rows = spark.createDataFrame([(k, (k * 7919) % 501) for k in range(500)], "id long, v long")
    got = frames.ranked(rows, [-F.col("v")], parts=7).orderBy("place").collect()
    assert [r.place for r in got] == list(range(1, 501)) and [r.v for r in got] == sorted((r.v for r in got), reverse=True)
    picks = frames.evenly_spaced(rows, [F.col("v")], 5).orderBy("pick").collect()
    assert [r.v for r in picks] == [sorted(r.v for r in got)[round(i * 499 / 4)] for i in range(5)]
    assert frames.evenly_spaced(rows.limit(0), [F.col("v")], 5).count() == 0


def test_split_of_groups(spark):
    import hashlib

    rows = spark.createDataFrame([(k, "ab"[k % 3 > 0]) for k in range(300)] + [(900, "one")], "stem long, folder string")
    pins = spark.createDataFrame([(k,) for k in range(0, 60, 3)] + [(None,)], "stem long")
    for pinned in (None, pins):
        got = frames.split(rows, pinned=pinned).collect()
        held = {r.stem for r in got if r.side == "val"}
        pinned_ids = set(range(0, 60, 3)) if pinned is not None else set()
        want = {900}
        for folder in (0, 1):
            ids = sorted((k for k in range(300) if (k % 3 > 0) == folder), key=lambda k: (k not in pinned_ids, hashlib.sha1(str(k).encode()).hexdigest()))
            want |= set(ids[: max(1, round(len(ids) * 0.1))]) | (pinned_ids & set(ids))
        assert held == want and len(got) == 301


def test_gates_by_brute_force(spark):
    rng = np.random.default_rng(2)
    names = [g[0] for g in frames.GATES]
    rows = [(f"f{k % 3}", *(None if rng.random() < 0.1 else float("nan") if rng.random() < 0.1 else float(rng.random() * 1.2) for _ in names)) for k in range(90)]
    scores = spark.createDataFrame(rows, "folder string, " + ", ".join(f"{n} double" for n in names))
    for r in frames.gates(scores).collect():
        spec = next(g for g in frames.GATES if g[0] == r.gate)
        all_ = [x[1 + names.index(r.gate)] for x in rows if r.scope in ("*", x[0])]
        v = [x for x in all_ if x is not None and x == x]
        mean = sum(v) / len(v)
        ok = (lambda b: mean >= b) if spec[3] == "higher" else (lambda b: mean <= b)
        assert (r.n, r.n_missing) == (len(v), len(all_) - len(v)) and r.value == pytest.approx(mean) and r.verdict == ("PASS" if ok(spec[1]) else "PARTIAL" if ok(spec[2]) else "FAIL")
    empty = frames.gates(scores.limit(0)).collect()
    assert {r.scope for r in empty} == {"*"} and {r.verdict for r in empty} == {"FAIL"} and len(empty) == 7


def test_strict_join_fails_on_a_missing_key(spark):
    rows, facts = spark.createDataFrame([(1,), (2,)], "stem long"), spark.createDataFrame([(1, "x")], "stem long, v string")
    assert frames.strict(rows.where("stem = 1"), facts, "stem").collect() == [(1, "x")]
    with pytest.raises(PySparkException, match="no entry for 2"):
        frames.strict(rows, facts, "stem").collect()
    assert [(r.stem, r.ordinal) for r in frames.in_order(rows, [5, 2, 1, 2]).orderBy("ordinal").collect()] == [(2, 1), (1, 2)]


def test_grids_by_columns_equal_solid_angles():
    rng = np.random.default_rng(3)
    g = levelset.grid((-1,) * 3, (1,) * 3, 16)
    for field in (0.7 - np.linalg.norm(g, axis=1), 0.6 - np.abs(g).max(1), 0.5 - np.abs(np.linalg.norm(g, axis=1) - 0.6) - 0.3 + rng.normal(size=len(g)) * 0.05):
        field = field.reshape(16, 16, 16)
        field[0], field[-1], field[:, 0], field[:, -1], field[:, :, 0], field[:, :, -1] = (-1,) * 6
        v, f = levelset.surface(field, (-1,) * 3, (1,) * 3)
        for low, high, res in (((-0.9, -0.8, -1), (0.8, 0.95, 0.9), 13), ((-1,) * 3, (1,) * 3, 16)):
            w = mesh.winding(levelset.grid(low, high, res), v, f)
            clear = np.abs(w - np.round(w)) < 1e-6
            assert (mesh.inside_grid(v, f, low, high, res)[clear] == (w > 0.5)[clear]).all() and clear.mean() > 0.8


def test_nearest_of_clouds_that_lie_apart(spark):
    r = np.random.default_rng(6)
    # the first lies far from its partner, the second around it, the third has copies
    a = {1: r.random((400, 3)) + 50, 2: np.concatenate([r.random((50, 3)), r.random((50, 3)) + [0, 900, 0]]), 3: np.repeat([[0.0, 0, 0], [70, 0, 0]], 40, 0)}
    b = {1: r.random((3000, 3)), 2: r.random((300, 3)), 3: np.repeat([[0.0, 0, 1], [0, 1, 0]], 30, 0)}
    rows = lambda d: spark.createDataFrame([(k, i, *map(float, p), float(i)) for k, v in d.items() for i, p in enumerate(v)], "shape_id int, pid long, x double, y double, z double, w double")
    got = frames.nearest(rows(a), rows(b), carry=("w",)).toPandas()
    for k in a:
        d2 = ((a[k][:, None] - b[k][None]) ** 2).sum(-1)
        mine = got[got.shape_id == k].set_index("pid").sort_index()
        assert len(mine) == len(a[k]) and np.allclose(mine.d2, d2.min(1), rtol=1e-12) and (mine.near == mine.near_w).all()
        assert (d2[np.arange(len(d2)), mine.near] <= d2.min(1) * (1 + 1e-12)).all()
    assert (got[got.shape_id == 3].near == 0).all()


def test_nearest_of_clouds():
    rng = np.random.default_rng(4)
    a, b = rng.normal(size=(300, 3)), np.concatenate([rng.normal(size=(500, 3)) * [1, 0.1, 0.01], [[40, 0, 0]] * 3])
    d = ((a[:, None] - b[None]) ** 2).sum(2)
    got, at = mesh.nearest(a, b)
    assert np.allclose(got, d.min(1)) and (at == d.argmin(1)).all()


def test_spearman_of_ties_unknown_values_and_constants(spark):
    rows = [(1.0, 2.0), (1.0, 2.0), (2.0, 2.0), (3.0, 1.0), (4.0, None), (float("nan"), 1.0), (5.0, 0.5), (5.0, 7.0)]
    got = frames.spearman(spark.createDataFrame(rows, "a double, b double"), "a", "b").first()
    known = pd.DataFrame(rows, columns=["a", "b"]).dropna()
    assert got.n == len(known) and abs(got.rho - known.rank().corr().iloc[0, 1]) < 1e-12
    assert tuple(frames.spearman(spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "a double, b double"), "a", "b").first()) == (None, 2)
    assert tuple(frames.spearman(spark.createDataFrame([], "a double, b double"), "a", "b").first()) == (None, 0)
