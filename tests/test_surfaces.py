"""Relational geometry against brute force: union-find, separating axes, all solid angles and all distances."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.functions import mesh
from shapeloom.operators import rounds, surfaces


def table(spark, shapes: dict):
    """shapes: key -> (vertices, faces)."""
    rows = [(k, [float(x) for x in np.ravel(v)], [int(x) for x in np.ravel(f)]) for k, (v, f) in shapes.items()]
    return surfaces.triangles(spark.createDataFrame(rows, "shape_id int, xyz array<double>, tri array<int>")).repartition(3)


def sphere(n: int, m: int, radius=1.0, at=(0.0, 0.0, 0.0)):
    """n rings of m squares, closed at the poles."""
    v = [(0, 0, 1)] + [(np.sin(np.pi * i / n) * np.cos(2 * np.pi * j / m), np.sin(np.pi * i / n) * np.sin(2 * np.pi * j / m), np.cos(np.pi * i / n)) for i in range(1, n) for j in range(m)] + [(0, 0, -1)]
    at_ring = lambda i, j: 1 + (i - 1) * m + j % m
    f = [(0, at_ring(1, j), at_ring(1, j + 1)) for j in range(m)]
    for i in range(1, n - 1):
        for j in range(m):
            f += [(at_ring(i, j), at_ring(i + 1, j), at_ring(i + 1, j + 1)), (at_ring(i, j), at_ring(i + 1, j + 1), at_ring(i, j + 1))]
    f += [(len(v) - 1, at_ring(n - 1, j + 1), at_ring(n - 1, j)) for j in range(m)]
    return np.array(v) * radius + np.array(at), np.array(f)


def joined(*parts):
    v, f, n = [], [], 0
    for a, b in parts:
        v.append(a)
        f.append(b + n)
        n += len(a)
    return np.concatenate(v), np.concatenate(f)


def test_components_equal_union_find(spark):
    r = random.Random(4)
    rows, links = [(k, v) for k in (1, 2, None) for v in range(300)], [(k, r.randrange(300), r.randrange(300)) for k in (1, 2) for _ in range(200)]
    got = rounds.components(spark.createDataFrame(rows, "s int, v int"), spark.createDataFrame(links, "s int, a int, b int"), "s").collect()
    up = {(k, v): v for k in (1, 2) for v in range(300)}

    def root(k, v):
        while up[k, v] != v:
            v = up[k, v]
        return v

    for k, a, b in links:
        a, b = root(k, a), root(k, b)
        up[k, max(a, b)] = min(a, b)
    assert {(x.s, x.v): x.label for x in got} == {(k, v): root(k, v) for k in (1, 2) for v in range(300)}


def test_a_long_strip_is_one_component_and_a_cut_makes_two(spark):
    n = 600
    v = np.array([(i // 2, i % 2, 0) for i in range(n + 2)], float)
    f = np.array([(i, i + 1, i + 2) for i in range(n)])
    order = np.random.default_rng(1).permutation(n)  # fids along the strip in no order
    got = surfaces.face_components(table(spark, {1: (v, f[order]), 2: (v, np.delete(f, 300, 0))}))
    counts = {(r.shape_id, r.label): r["count"] for r in got.groupBy("shape_id", "label").count().collect()}
    assert counts == {(1, 0): n, (2, 0): 300, (2, 300): n - 301}


def test_reports_and_shells_equal_the_kernels(spark):
    inner, outer = sphere(6, 8, 0.3), sphere(6, 8)
    open_ = (outer[0], outer[1][:-1])
    flipped = (outer[0], np.vstack([outer[1][:1, ::-1], outer[1][1:]]))
    fin = (np.vstack([outer[0], [[0, 0, 3]]]), np.vstack([outer[1], [[0, 1, len(outer[0])]]]))  # an edge of three faces
    shapes = {1: outer, 2: joined(outer, inner), 3: open_, 4: flipped, 5: fin, 6: joined(outer, sphere(6, 8, 0.2, (3, 0, 0)), sphere(5, 7, 0.02, (0, 4, 0))), 7: joined(outer, inner, sphere(6, 8, 0.1))}
    tri = table(spark, shapes)
    for r in surfaces.described(tri).collect():
        v, f = shapes[r.shape_id]
        assert (r.n_vertices, r.n_faces, r.is_watertight, r.is_winding_consistent, r.euler_number, r.n_components) == (len(np.unique(f)), len(f), mesh.is_watertight(f), mesh.is_consistent(f), mesh.euler_number(f), mesh.components(f).max() + 1)
        assert r.volume == pytest.approx(mesh.volume(v, f)) and r.area == pytest.approx(mesh.areas(v, f).sum())
    for r in surfaces.shell_report(tri).collect():
        want = mesh.shells(*shapes[r.shape_id])
        assert (r.n_shells, r.n_nested, bool(r.all_watertight)) == (want["n_shells"], want["n_nested"], want["all_watertight"]), r
        assert r.reference_volume == pytest.approx(want["reference_volume"])
    kept = {r.shape_id: r["count"] for r in surfaces.without_floaters(tri, 0.001).groupBy("shape_id").count().collect()}
    assert kept == {k: len(mesh.without_floaters(v, f, 0.001)[1]) for k, (v, f) in shapes.items()}


def apart(p, q, slack=1e-12) -> bool:
    """Separating axes of two triangles: normals, products of edges and, where they are in one plane, normals within it."""
    e, g = [p[(i + 1) % 3] - p[i] for i in range(3)], [q[(i + 1) % 3] - q[i] for i in range(3)]
    n, m = np.cross(e[0], e[1]), np.cross(g[0], g[1])
    axes = [n, m, *(np.cross(a, b) for a in e for b in g), *(np.cross(n, a) for a in e), *(np.cross(m, b) for b in g)]
    for a in axes:
        if np.linalg.norm(a) < 1e-9:
            continue
        u, w = p @ a, q @ a
        if u.min() > w.max() + slack or w.min() > u.max() + slack:
            return True
    return False


def test_overlaps_equal_separating_axes(spark):
    rng = np.random.default_rng(3)
    pairs = [rng.integers(0, 4, (2, 3, 3)).astype(float) for _ in range(500)] + [rng.normal(size=(2, 3, 3)) for _ in range(500)]
    flat = [rng.integers(0, 5, (2, 3, 3)).astype(float) for _ in range(300)]
    for k, x in enumerate(flat):
        x[:, :, k % 3] = 1.0  # one plane
    pairs += flat
    pairs = [x for x in pairs if all(np.linalg.norm(np.cross(t[1] - t[0], t[2] - t[0])) > 1e-9 for t in x)]
    names = [f"{t}{n}_{a}" for t in "ab" for n in range(3) for a in "xyz"]
    df = spark.createDataFrame([(i, *map(float, np.ravel(x))) for i, x in enumerate(pairs)], "id int, " + ", ".join(f"{n} double" for n in names))
    got = {r.id for r in surfaces.overlapping(df, ["id"]).collect()}
    want = {i for i, x in enumerate(pairs) if not apart(*x)}
    assert got == want and len(want) > 200


def test_crossing_counts_of_whole_meshes(spark):
    shapes = {1: sphere(6, 9), 2: joined(sphere(6, 9), sphere(7, 8, 0.9, (0.37, 0.21, 0.113))), 3: joined(sphere(6, 9), sphere(6, 9, 0.3))}
    got = {r.shape_id: r.n_intersections for r in surfaces.crossing_counts(table(spark, shapes)).collect()}
    for k, (v, f) in shapes.items():
        t = v[f]
        n = sum(not set(f[i]) & set(f[j]) and not apart(t[i], t[j]) for i in range(len(f)) for j in range(i))
        assert got[k] == n == mesh.self_intersections(v, f)
    assert got[1] == got[3] == 0 < got[2]


def test_winding_by_cells_equals_all_faces(spark):
    shapes = {1: joined(sphere(24, 40), sphere(20, 30, 0.5, (2.2, 0.3, 0))), 2: sphere(3, 4), 3: (sphere(16, 24)[0], sphere(16, 24)[1][:-60])}
    rng = np.random.default_rng(2)
    points = [(k, i, *map(float, p)) for k in shapes for i, p in enumerate(rng.uniform(-1.5, 2.7, (700, 3)))] + [(9, 0, 0.0, 0.0, 0.0), (1, None, 0.0, 0.0, 0.0), (2, 9000, None, 0.0, 0.0)]
    rows = surfaces.winding(spark.createDataFrame(points, "shape_id int, pid int, x double, y double, z double"), table(spark, shapes), leaf=16).collect()
    assert len(rows) == 2100
    for k, (v, f) in shapes.items():
        at = np.array([p[2:] for p in points if p[0] == k and None not in p])
        exact, got = mesh.winding(at, v, f), dict((r.pid, r.winding) for r in rows if r.shape_id == k)
        got = np.array([got[i] for i in range(700)])
        assert np.abs(got - exact).max() < 0.02 and ((got > 0.5) == (exact > 0.5))[np.abs(exact - 0.5) > 0.02].all()


def test_small_shapes_need_no_tree_for_closest_faces(spark, monkeypatch):
    rng = np.random.default_rng(6)
    v, f = sphere(6, 9)
    shapes = {1: (v, f), 2: (v * [1, 3, 1], f), 3: sphere(3, 4), 4: (np.array([[0, 0, 0], [1, 0, 0], [2, 0, 0], [0, 1, 0]], float), np.array([[0, 1, 2], [0, 1, 1], [0, 1, 3]]))}
    points = [(k, p, *map(float, x)) for k in (1, 2, 3, 4, 9) for p, x in enumerate(rng.normal(size=(20, 3)))] + [(1, 3, 0.0, 0.0, 0.0), (2, 77, None, 0.0, 0.0)] + [(1, 100 + n, *map(float, v[n])) for n in range(9)]
    points = spark.createDataFrame([p for k, p in enumerate(points) if k != 3], "shape_id int, pid int, x double, y double, z double")
    went, tree = [], surfaces._by_tree
    monkeypatch.setattr(surfaces, "_by_tree", lambda *a: went.append({r.shape_id for r in a[0].select("shape_id").distinct().collect()}) or tree(*a))
    rows = lambda: sorted(map(tuple, surfaces.closest(points, table(spark, shapes), leaf=8).select("shape_id", "pid", "fid", "d2").collect()))
    here = rows()
    # no level of cells is written for them
    assert went == [] and len(here) == 89
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 50)
    assert rows() == here and went == [{1, 2}]
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 10_000)
    monkeypatch.setattr(surfaces, "MOST_PAIRS", 100)
    monkeypatch.setattr(mesh, "PAIRS", 100)
    assert rows() == here and went[1] == {1, 2, 3}


def test_closest_faces_equal_all_distances(spark):
    shapes = {1: joined(sphere(20, 30), sphere(12, 16, 0.4, (5, 0, 0))), 2: (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [2, 0, 0]], float), np.array([[0, 1, 2], [0, 1, 3]]))}  # the second has a face without area
    rng = np.random.default_rng(6)
    points = [(k, i, *map(float, p)) for k in shapes for i, p in enumerate(np.vstack([rng.uniform(-2, 6, (900, 3)), rng.uniform(-500, 500, (100, 3))]))]
    rows = surfaces.closest(spark.createDataFrame(points, "shape_id int, pid int, x double, y double, z double"), table(spark, shapes), leaf=8).collect()
    assert len(rows) == 2000
    for k, (v, f) in shapes.items():
        at = np.array([p[2:] for p in points if p[0] == k])
        got = {r.pid: r.d2 for r in rows if r.shape_id == k}
        assert np.allclose(np.sqrt([got[i] for i in range(1000)]), mesh.distances(at, v, f), rtol=1e-9, atol=1e-9)


def test_empty_and_null_meshes(spark):
    none = spark.createDataFrame([(1, None, None), (2, [], []), (None, [0.0] * 9, [0, 1, 2]), (3, [0.0] * 9, [0, 1, 7])], "shape_id int, xyz array<double>, tri array<int>")
    tri = surfaces.triangles(none)
    assert tri.count() == 0
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "shape_id int, pid int, x double, y double, z double")
    for out in (surfaces.described(tri), surfaces.shell_report(tri), surfaces.crossing_counts(tri), surfaces.winding(points, tri), surfaces.closest(points, tri), surfaces.without_floaters(tri)):
        assert out.count() == 0


def test_scratch_tables_go(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(rounds, "folder", lambda spark: f"file://{tmp_path}")
    tri = table(spark, {1: sphere(8, 12)})
    surfaces.face_components(tri)
    points = spark.createDataFrame([(1, 1, 0.0, 0.0, 0.0)], "shape_id int, pid int, x double, y double, z double")
    assert surfaces.winding(points, tri, leaf=16).first().winding == pytest.approx(1, abs=0.01)
    assert len(list(tmp_path.glob("round-*"))) == 2  # the two results
