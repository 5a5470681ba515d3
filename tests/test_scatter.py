"""Level surfaces, scattered points and the running best against brute force."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.functions import levelset
from shapeloom.operators import contours, rounds, scans, scatter, surfaces
from tests.test_surfaces import sphere, table


def grid_of(spark, fields: dict, res: int):
    rows = [(k, [None if v is None else float(v) for v in np.ravel(f)]) for k, f in fields.items()]
    return contours.samples(spark.createDataFrame(rows, "shape_id int, field array<double>"), res).repartition(5)


def ball(res: int, radius: float):
    at = np.linspace(-1, 1, res)
    x, y, z = np.meshgrid(at, at, at, indexing="ij")
    return radius - np.sqrt(x * x + y * y + z * z)


def test_a_random_field_has_the_faces_of_the_kernel(spark):
    fields = {k: np.random.default_rng(k).normal(size=(7, 7, 7)) for k in (1, 2)}
    got = contours.level_surface(grid_of(spark, fields, 7), 7, level=0.2).toPandas()
    assert not got.duplicated(["shape_id", "fid"]).any()
    for k, field in fields.items():
        v, f = levelset.surface(field, (-1,) * 3, (1,) * 3, 0.2)
        turned = lambda t: min(tuple(np.roll(t, -n, axis=0).round(6).ravel() + 0.0) for n in range(3))
        mine = got[got.shape_id == k][[f"{a}{n}" for n in range(3) for a in "xyz"]].to_numpy().reshape(-1, 3, 3)
        assert sorted(map(turned, mine)) == sorted(map(turned, v[f]))
        places = got[got.shape_id == k]
        by_id = {(i, *p) for n, c in enumerate("ijk") for i, *p in places[[c, *(f"{a}{n}" for a in "xyz")]].itertuples(index=False)}
        assert len(by_id) == len(v)


def test_one_fine_field_is_spread_over_tasks_and_closed(spark):
    # parts of the aggregate are joined by the runtime's plan where they are small
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    tri = contours.level_surface(grid_of(spark, {1: ball(40, 0.7)}, 40), 40)
    assert tri.select(F.spark_partition_id().alias("p")).distinct().count() == 4
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    d = surfaces.described(tri).collect()[0]
    assert (d.is_watertight, d.is_winding_consistent, d.euler_number, d.n_components) == (1, 1, 2, 1)
    assert d.volume == pytest.approx(4 / 3 * np.pi * 0.7**3, rel=0.01)


def test_odd_fields(spark):
    holed = ball(9, 0.7).ravel().tolist()
    holed[0], holed[1], holed[2] = None, float("nan"), float("inf")
    inside = ball(9, 0.7).ravel().tolist()
    inside[9 * 9 * 4 + 9 * 4 + 6] = None
    grid = grid_of(spark, {1: ball(9, 0.7), 2: holed, 3: np.ones((9, 9, 9)), 4: -np.ones((9, 9, 9)), 5: inside, None: ball(9, 0.7)}, 9)
    n = {r.shape_id: r["count"] for r in contours.level_surface(grid.unionByName(grid), 9).groupBy("shape_id").count().collect()}
    # corners of the grid are far from the surface, the other one is not
    assert n[1] == n[2] > n[5] > 0 and set(n) == {1, 2, 5}
    assert contours.level_surface(grid.limit(0), 9).count() == 0


def test_samples_are_uniform_and_do_not_depend_on_the_layout(spark):
    v, f = sphere(6, 8)
    tri = table(spark, {1: (v, f), 2: (v * [3, 1, 1], f), 3: (v * 0, f)})
    got = scatter.sampled(tri, 4000, 3).toPandas().sort_values(["shape_id", "pid"], ignore_index=True)
    again = scatter.sampled(tri.repartition(7, "fid"), 4000, 3).toPandas().sort_values(["shape_id", "pid"], ignore_index=True)
    assert got.equals(again) and got.groupby("shape_id").pid.nunique().to_dict() == {1: 4000, 2: 4000}
    for k, corners in ((1, v), (2, v * [3, 1, 1])):
        a, b, c = (corners[f[:, n]] for n in range(3))
        cross = np.cross(b - a, c - a)
        size = np.linalg.norm(cross, axis=1)
        mine = got[got.shape_id == k]
        expected = 4000 * size / size.sum()
        chi = ((np.bincount(mine.fid, minlength=len(f)) - expected) ** 2 / expected).sum()
        assert abs(chi - len(f)) < 5 * np.sqrt(2 * len(f))
        assert np.allclose(mine[["nx", "ny", "nz"]], (cross / size[:, None])[mine.fid])
        # points lie in their faces: three small areas are the whole
        p = mine[["x", "y", "z"]].to_numpy()
        part = sum(np.linalg.norm(np.cross(q[mine.fid] - p, r[mine.fid] - p), axis=1) for q, r in ((a, b), (b, c), (c, a)))
        assert np.allclose(part, size[mine.fid])
        # inside a face the first barycentric coordinate has mean 1/3
        share = np.linalg.norm(np.cross(b[mine.fid] - p, c[mine.fid] - p), axis=1) / size[mine.fid]
        assert abs(share.mean() - 1 / 3) < 0.02
    assert scatter.sampled(tri.limit(0), 5).count() == 0 and scatter.sampled(tri, 0).count() == 0


def kept_in_turn(points, radius):
    keep = []
    for k, p in enumerate(points):
        if not keep or ((points[keep] - p) ** 2).sum(1).min() > radius**2:
            keep.append(k)
    return keep


def test_spread_points_equal_those_kept_in_turn(spark):
    r = np.random.default_rng(8)
    clouds = {1: (r.random((300, 3)), 0.2), 2: (r.random((200, 3)) * [1, 1, 0], 0.05), 3: (np.repeat(r.random((4, 3)), 60, 0), 0.01), 4: (r.random((20, 3)), 0.0), 5: (np.arange(12)[:, None] * [0.5, 0, 0], 0.5)}
    rows = [(k, i, *map(float, p), float(radius), "more") for k, (pts, radius) in clouds.items() for i, p in enumerate(pts)]
    rows += [(1, 900, None, 0.0, 0.0, 0.2, "x"), (None, 1, 0.0, 0.0, 0.0, 0.2, "x")]
    df = spark.createDataFrame(rows, "shape_id int, pid long, x double, y double, z double, radius double, key string").repartition(3)
    got = scatter.spread(df).toPandas()
    assert got.columns.tolist() == df.columns
    for k, (pts, radius) in clouds.items():
        assert sorted(got[got.shape_id == k].pid) == (kept_in_turn(pts, radius) if radius else list(range(len(pts)))), k
    assert len(got) == got[got.shape_id.notna()].shape[0] and scatter.spread(df.limit(0)).count() == 0


def test_points_of_small_shapes_are_taken_in_turn_in_one_task(spark, monkeypatch):
    r = np.random.default_rng(9)
    rows = [(k, i, *map(float, p), float(radius), f"{(i * 7919) % 600:03d}", {"n": i}) for k, (n, radius) in {"a": (600, 0.1), "b": (70, 0.3), "c": (1, 0.5), "d": (9, 0.0)}.items() for i, p in enumerate(r.random((n, 3)))]
    df = spark.createDataFrame(rows, "shape_id string, pid long, x double, y double, z double, radius double, at string, more map<string, int>").repartition(3)
    went, far = [], scatter._spread
    monkeypatch.setattr(scatter, "_spread", lambda *a: went.append({x.shape_id for x in a[0].select("shape_id").distinct().collect()}) or far(*a))
    got = lambda order: sorted(map(str, scatter.spread(df, order=order).collect()))
    here = {order: got(order) for order in ("pid", "at")}
    # no candidates by 125 cells are written for them
    assert went == [] and here["pid"] != here["at"] and len(here["at"]) < len(rows)
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 100)
    assert {order: got(order) for order in here} == here and went == [{"a"}] * 2


def test_clouds_of_small_shapes_are_drawn_in_one_task(spark, monkeypatch):
    v, f = sphere(6, 8)
    tri = table(spark, {1: (v, f), 2: (v * [3, 1, 1], f), 3: (v * 0, f), 4: (v[:3], np.array([[0, 1, 2]])), 5: sphere(3, 4)}).repartition(3, "fid")
    tri = tri.unionByName(tri.limit(1).withColumn("shape_id", F.lit(None).cast(tri.schema["shape_id"].dataType)))
    went = []
    for name in ("_sampled", "_cloud"):
        one = getattr(scatter, name)
        monkeypatch.setattr(scatter, name, lambda *a, one=one, name=name: went.append((name, {x.shape_id for x in a[0].select("shape_id").distinct().collect()})) or one(*a))
    order = lambda d: sorted(map(tuple, d.collect()))
    every = lambda: (order(scatter.sampled(tri, 30, 3)), order(scatter.cloud(tri, 20, 4)))
    monkeypatch.setattr(scatter, "AT_ONCE", 70)
    here = every()
    # no ranges, buckets or joins of points are needed
    assert went == [] and {r[0] for r in here[0]} == {r[0] for r in here[1]} == {1, 2, 4, 5} and [len(x) for x in here] == [120, 80]
    assert scatter.sampled(tri, 0).count() == scatter.cloud(tri.limit(0), 5).count() == 0
    went.clear()
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 62)
    assert every() == here and went[:2] == [("_sampled", {1, 2}), ("_cloud", {1, 2})]


def test_a_cloud_has_n_points(spark):
    v, f = sphere(6, 8)
    got = scatter.cloud(table(spark, {1: (v, f), 2: (v * 5, f)}), 100, 1).toPandas()
    for _, g in got.groupby("shape_id"):
        assert sorted(g.pid) == list(range(100)) and 50 < g.even.sum() <= 100 and g.loc[g.pid < g.even.sum(), "even"].all()


def in_order(values, least, patience):
    best, stale, out = float("inf"), 0, []
    for v in values:
        best, stale = (v, 0) if v < best - least else (best, stale + 1)
        out.append((best, stale, stale >= patience))
    return out


@pytest.mark.parametrize("parts", [1, 7])
def test_the_running_best_equals_the_fold(spark, parts):
    r = np.random.default_rng(2)
    runs = {f"r{k}": r.normal(size=int(r.integers(1, 40))) for k in range(20)}
    runs |= {"falling": np.linspace(1, 0, 500), "long": 1 / np.arange(1, 3000) + r.normal(size=2999) * 0.05, "flat": np.ones(30), "nan": np.where(r.random(50) < 0.5, np.nan, r.random(50)), "low": np.array([2.0, -np.inf, 1.0, -np.inf])}
    rows = [(k, i, None if np.isnan(v) and i % 2 else float(v)) for k, values in runs.items() for i, v in enumerate(values)]
    df = spark.createDataFrame(rows, "run string, step long, val_bce double").repartition(4)
    for least in (0.0, 0.01):
        got = scans.running_best(df, least=least, patience=5, parts=parts).toPandas().sort_values(["run", "step"])
        for k, values in runs.items():
            mine = got[got.run == k]
            assert list(zip(mine.best, mine.stale, mine.stopped)) == in_order(values, least, 5), (k, least)


def test_maps_of_ranges_compose(spark):
    r = np.random.default_rng(0)
    for least in (0.0, 0.05, 0.5):
        for _ in range(200):
            v = r.normal(size=int(r.integers(1, 30))).round(1)
            best, stale = float(r.normal()) if r.random() < 0.8 else np.inf, int(r.integers(0, 5))
            b, s = best, stale
            for x in v:
                b, s = (x, 0) if x < b - least else (b, s + 1)
            low, end, since = scans.range_map(v, least)
            hit = [k for k in range(len(low)) if low[k] < best - least]
            assert ((end[hit[0]], since[hit[0]]) if hit else (best, stale + len(v))) == (b, s)


def test_an_empty_log_has_no_best(spark):
    assert scans.running_best(spark.createDataFrame([], "run string, step long, val_bce double")).count() == 0
