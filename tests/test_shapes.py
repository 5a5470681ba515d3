"""Kernels of shapes against closed forms, brute force and round trips."""

import io

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.functions import levelset, mesh, sampling, simplify
from shapeloom.functions.seeds import stable_seed
from shapeloom.operators import shapes
from shapeloom.plans import solids
from shapeloom.sources import shapes as files
from tests.test_surfaces import sphere

SF = "/root/testdata/sf0.001"


def ball(res=20, radius=0.7):
    g = levelset.grid((-1,) * 3, (1,) * 3, res)
    return levelset.surface((radius - np.linalg.norm(g, axis=1)).reshape(res, res, res), (-1,) * 3, (1,) * 3)


def test_random_fields_give_closed_consistent_surfaces():
    rng = np.random.default_rng(0)
    for _ in range(20):
        field = np.full((9, 8, 7), -5.0)
        field[1:-1, 1:-1, 1:-1] = rng.normal(size=(7, 6, 5))
        v, f = levelset.surface(field, (0, 0, 0), (1, 1, 1))
        assert mesh.is_watertight(f) and mesh.is_consistent(f) and mesh.volume(v, f) > 0
    assert len(levelset.surface(np.zeros((3, 3, 3)), (0,) * 3, (1,) * 3)[1]) == 0


def test_simplified_ball_stays_sound():
    v, f = ball()
    (w, g), failure = simplify.remeshed(v, f, 200)
    assert failure is None and len(g) == 200 and mesh.is_watertight(g) and mesh.is_consistent(g) and mesh.euler_number(g) == 2
    assert abs(mesh.volume(w, g) / mesh.volume(v, f) - 1) < 0.03 and mesh.self_intersections(w, g) == 0
    assert simplify.decimated(v, f, len(f))[1] is f


def test_broken_input_and_a_breaking_step_give_the_input_back(monkeypatch):
    v, f = ball(10)
    (_, g), failure = simplify.remeshed(v, f[1:], 50)
    assert failure["step"] == "input" and len(g) == len(f) - 1
    monkeypatch.setitem(simplify.STEPS, "process", lambda v, f, target: (v, f[1:]))
    (_, g), failure = simplify.remeshed(v, f, 50)
    assert (failure["step"], failure["reason"], len(g)) == ("process", "not watertight", len(f))


def test_overlap_equals_segments_through_triangles():
    rng = np.random.default_rng(1)
    a, b = rng.normal(size=(500, 3, 3)), rng.normal(size=(500, 3, 3))

    def meets(p, q, t):
        x = np.linalg.solve(np.stack([q - p, t[0] - t[1], t[0] - t[2]], 1), t[0] - p)
        return 0 <= x[0] <= 1 and x[1] >= 0 and x[2] >= 0 and x[1] + x[2] <= 1

    want = [any(meets(s[i], s[(i + 1) % 3], t) for s, t in ((x, y), (y, x)) for i in range(3)) for x, y in zip(a, b)]
    assert mesh.overlap(a, b).tolist() == want
    flat = np.array([[[0, 0, 0], [2, 0, 0], [0, 2, 0]]], float)
    assert mesh.overlap(flat, flat * 0.1 + [0.1, 0.1, 0])[0] and mesh.overlap(flat, flat + [2, 0, 0])[0] and not mesh.overlap(flat, flat + [2.1, 0, 0])[0] and not mesh.overlap(flat, flat + [0, 0, 1])[0]


def test_distances_to_a_square():
    v, f = np.array([[0, 0, 0], [1, 0, 0], [1, 1, 0], [0, 1, 0]], float), np.array([[0, 1, 2], [0, 2, 3]])
    assert np.allclose(mesh.distances(np.array([[0.3, 0.4, 2], [2, 0.5, 0], [2, 2, 0], [0.5, 0.5, 0]]), v, f), [2, 1, 2**0.5, 0])


def test_clouds_are_exact_in_number_and_on_the_surface():
    v, f = ball(12)
    points, even, more = sampling.cloud(v, f, 300, 5)
    assert len(points) == 300 == even + more and mesh.distances(points[:, :3], v, f).max() < 1e-12 and np.allclose(np.linalg.norm(points[:, 3:], axis=1), 1)
    assert (points == sampling.cloud(v, f, 300, 5)[0]).all()


@pytest.mark.parametrize("mode", ["so3", "yaw_tilt", "none"])
def test_rotations(mode):
    rng = np.random.default_rng(2)
    for _ in range(50):
        r = sampling.rotation(mode, rng)
        assert np.allclose(r @ r.T, np.eye(3)) and np.isclose(np.linalg.det(r), 1)
        assert mode == "so3" or r[2, 2] >= np.cos(np.radians(15)) - 1e-12
    with pytest.raises(ValueError):
        sampling.rotation("yaw-tilt", rng)


def test_dropout_keeps_rows_together():
    rows = np.random.default_rng(3).normal(size=(1000, 6))
    got = sampling.dropped_and_padded(rows, 0.85, 1.0, np.random.default_rng(4))
    assert len(got) == 1000 and {tuple(r) for r in got} <= {tuple(r) for r in rows} and 850 <= len(np.unique(got, axis=0)) <= 1000


def test_seed_is_the_hash_of_the_name():
    assert stable_seed("a", 1 << 20) == int("86f7e437faa5a7fc", 16) % (1 << 20)


def test_stl_round_trip(spark, tmp_path):
    want = {r.name: r for r in shapes.described(solids.solids(spark, SF).withColumn("name", F.concat("folder", F.lit("/s"), "shape_id", F.lit(".STL")))).collect()}
    rows = files.as_stl(solids.solids(spark, SF)).withColumn("name", F.concat("folder", F.lit("/s"), "shape_id", F.lit(".STL")))
    assert files.write_files(rows, str(tmp_path), "name", "stl").count() == len(want)
    (tmp_path / "bad.stl").write_bytes(b"nonsense")
    (tmp_path / "text.stl").write_text("solid t\nfacet normal 0 0 1\nouter loop\nvertex 0 0 0\nvertex 1 0 0\nvertex 0 1 0\nendloop\nendfacet\nendsolid t\n")
    read = files.read_stl(spark, str(tmp_path))
    got = {f"{r.folder}/{r.stem}.STL": r for r in shapes.described(read.where("error is null")).collect()}
    assert set(got) == set(want) | {"./text.STL"} and got["./text.STL"].n_faces == 1
    for name, r in want.items():
        g = got[name]
        assert (g.n_vertices, g.n_faces, g.is_watertight, g.euler_number) == (r.n_vertices, r.n_faces, r.is_watertight, r.euler_number) and abs(g.volume - r.volume) < 1e-4 * r.volume
    assert read.where("error is not null").select("stem").collect() == [("bad",)] and files.collisions(read).count() == 0


def test_cloud_files(spark, tmp_path):
    for name, a in (("a", np.arange(12.0).reshape(2, 6)), ("b", np.zeros((3, 4))), ("c", np.zeros(3))):
        np.save(tmp_path / f"{name}.npy", a)
    got = {r.stem: r for r in files.read_clouds(spark, str(tmp_path)).collect()}
    assert got["a"].width == 6 and got["a"].points == list(range(12)) and got["b"].width == 3 and len(got["b"].points) == 9 and got["c"].error


def test_odd_rows_keep_their_place(spark):
    rows = spark.createDataFrame([(1, None, None, "x"), (2, [], [], "x"), (3, [0.0] * 9, [0, 1, 2], "x"), (4, [0.0, 1.0, 2.0], [0, 1, 7], "x"), (None, [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0], [0, 1, 2], "x")], "shape_id int, xyz array<double>, tri array<int>, error string")
    for op in (shapes.described, shapes.normalized, shapes.repaired, shapes.shelled, shapes.intersections, shapes.without_floaters, shapes.remeshed, lambda d: shapes.sampled(d, 8)):
        got = {r.shape_id: r for r in op(rows).collect()}
        assert len(got) == 5 and got[1].error and got[4].error and got[None].error is None
        assert op(rows.limit(0)).count() == 0


def test_vtu_holds_what_was_given():
    out = files.encode_vtu(np.zeros((4, 3)), np.array([[0, 1, 2, 3]]))
    assert b'NumberOfPoints="4" NumberOfCells="1"' in out and io.BytesIO(out).read().endswith(b"</VTKFile>")


def test_network_goes_from_clouds_to_scores(spark, tmp_path):
    from shapeloom.functions.network import Network, fourier, gelu
    from shapeloom.operators import inference

    assert np.allclose(gelu(np.array([-1.0, 0.0, 2.0])), [-0.15865525, 0, 1.95449974], atol=1e-6)
    assert np.allclose(fourier(np.array([[0.25, 0, 0, 9.0]]), 2, 2)[0], [1, 0, 0, -1, 0, 0, 1, 1, 0, 0, 1, 1, 9], atol=1e-12)
    size = {"d_model": 16, "n_heads": 2, "n_layers": 1, "n_freq": 3, "n_centers": 8, "max_freq": 4}
    net = Network.fresh(size, 1)
    inference.saved(spark, net, str(tmp_path / "net"))
    same = inference.loaded(spark, str(tmp_path / "net"))
    assert same.size == net.size and same.n_parameters() == net.n_parameters() and all((same.w[k] == v).all() for k, v in net.w.items())
    rng = np.random.default_rng(0)
    clouds = spark.createDataFrame([(k, rng.normal(size=(40, 6)).ravel().tolist()) for k in range(3)] + [(9, None)], "shape_id int, points array<double>")
    chunks = inference.decoded(inference.encoded(clouds, net), net, 7, (-1,) * 3, (1,) * 3, 100)
    got = {r.shape_id: r.field for r in inference.fields(chunks).collect()}
    for r in clouds.where("points is not null").collect():
        want = net.decode(net.encode(np.array(r.points).reshape(-1, 6)), levelset.grid((-1,) * 3, (1,) * 3, 7))
        assert np.allclose(got[r.shape_id], want, atol=1e-5)
    with pytest.raises(ValueError):
        net.encode(np.zeros((5, 3)))
    made = inference.meshes(clouds, net, 7, chunk=100)
    assert {r.shape_id for r in made.collect()} == {0, 1, 2}


def test_scores_of_a_shape_against_itself_and_of_a_missing_one(spark):
    from shapeloom.operators import inference

    v, f = ball(10, 0.4)
    rows = [(k, "a", v.ravel().tolist(), f.ravel().tolist()) for k in (1, 2)]
    truth = spark.createDataFrame(rows, "shape_id int, folder string, xyz array<double>, tri array<int>")
    got = {r.shape_id: r for r in inference.scored(truth.where("shape_id = 1"), truth, 200, 12).collect()}
    assert got[1].iou == 1 and got[1].chamfer_l2_x1e3 == 0 and abs(got[1].normal_consistency - 1) < 1e-9 and got[1].watertight == got[1].euler_match == 1 and got[1].error is None
    assert got[2].iou == 0 and np.isnan(got[2].chamfer_l2_x1e3) and got[2].watertight == 0 and got[2].n_components is None and got[2].error


def collapsed_in_turn(v, f, target):
    """As simplify.decimated, with all edges offered again after each collapse."""
    place, face = [tuple(x) for x in v.tolist()], {k: list(t) for k, t in enumerate(f.tolist())}
    n = np.cross(v[f[:, 1]] - v[f[:, 0]], v[f[:, 2]] - v[f[:, 0]])
    size = np.linalg.norm(n, axis=1)
    plane = np.hstack([n / size[:, None], -((n / size[:, None]) * v[f[:, 0]]).sum(1, keepdims=True)])
    q = np.zeros((len(v), 4, 4))
    np.add.at(q, f.ravel(), np.repeat((size / 2)[:, None, None] * plane[:, :, None] * plane[:, None], 3, 0))
    cross = lambda p: np.cross(p[1] - p[0], p[2] - p[0])
    while len(face) > target:
        best = None
        for a, b in sorted({(min(x, y), max(x, y)) for t in face.values() for x, y in zip(t, t[1:] + t[:1])}):
            p, r, m = np.array(place[a]), np.array(place[b]), q[a] + q[b]
            options, long2 = [p, r, (p + r) / 2], ((p - r) ** 2).sum()
            if abs(np.linalg.det(m[:3, :3])) > 1e-9 * max(m[0, 0], m[1, 1], m[2, 2]) ** 3:
                low = np.linalg.solve(m[:3, :3], -m[:3, 3])
                options += [low] if ((low - options[2]) ** 2).sum() <= 4 * long2 else []
            cost, to = min((max(float(np.append(x, 1) @ m @ np.append(x, 1)), 0.0) + 1e-12 * long2, tuple(x)) for x in options)
            near = [{x for t in face.values() if c in t for x in t} for c in (a, b)]
            touched = {k: t for k, t in face.items() if (a in t) != (b in t)}
            if (best and cost >= best[0]) or sum(a in t and b in t for t in face.values()) != 2 or len(near[0] & near[1]) != 4:
                continue
            turn = [(cross(np.array([place[x] for x in t])), cross(np.array([to if x in (a, b) else place[x] for x in t]))) for t in touched.values()]
            if all(x @ y > 0.1 * np.linalg.norm(x) * np.linalg.norm(y) for x, y in turn):
                best = (cost, a, b, to)
        if best is None:
            break
        _, a, b, to = best
        face = {k: [a if x == b else x for x in t] for k, t in face.items() if not (a in t and b in t)}
        place[a], q[a] = to, q[a] + q[b]
    return np.array(place), np.array(list(face.values()))


def test_edges_are_offered_together_and_the_cheapest_goes_first(monkeypatch):
    rng, offered, many = np.random.default_rng(2), [], simplify._offers
    monkeypatch.setattr(simplify, "_offers", lambda q, *ends: offered.append(q.shape[1]) or many(q, *ends))
    v, f = sphere(5, 7)
    v = v + rng.normal(size=v.shape) * 0.03
    for target in (50, 30):
        w, g = simplify.decimated(v, f, target)
        x, y = collapsed_in_turn(v, f, target)
        assert np.allclose(sorted(map(tuple, w[g].reshape(-1, 9).round(7))), sorted(map(tuple, x[y].reshape(-1, 9).round(7)))) and len(g) == target
    assert offered == [3 * len(f) // 2] * 2
