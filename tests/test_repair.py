"""Repair by joins against the kernel of packed meshes, and shapes that cannot be mended."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.functions import mesh
from shapeloom.operators import repair, surfaces
from tests.test_surfaces import joined, sphere, table


def arrays(df, key):
    rows = df.where(F.col("shape_id") == key).toPandas()
    ids, place = np.unique(rows[["i", "j", "k"]].to_numpy(), return_inverse=True)
    corners = rows[[f"{a}{n}" for n in range(3) for a in "xyz"]].to_numpy().reshape(-1, 3)
    v = np.zeros((len(ids), 3))
    v[place.ravel()] = corners
    return v, place.reshape(-1, 3)


def test_holes_and_turned_faces_as_by_the_kernel(spark):
    r = np.random.default_rng(3)
    v, f = sphere(6, 8)
    turned = f.copy()
    some = r.random(len(f)) < 0.5
    turned[some] = turned[some][:, ::-1]
    shapes = {
        1: (v, f), 2: (v, turned), 3: (v, f[:, ::-1]), 4: (v, f[1:]), 5: (v, np.delete(f, [20, 21], 0)), 6: (v, np.delete(turned, [20, 21, 50], 0)),
        # a rim of eight edges stays open, and so do two rims that touch
        7: (v, f[8:]), 8: (v, np.delete(f, [8, 9, 26], 0)), 9: joined((v, turned), (v * 0.3 + 5, f[:, ::-1])), 10: (v[:3], f[:1]),
    }
    faces, report = repair.repaired(table(spark, shapes))
    got = {x.shape_id: (x.repaired, x.ok) for x in report.collect()}
    assert faces.groupBy("shape_id", "fid").count().where("count > 1").isEmpty()
    for k, (v0, f0) in shapes.items():
        kv, kf, changed, ok = mesh.repaired(np.asarray(v0, float), f0)
        assert got[k] == (int(changed), int(ok)), k
        mv, mf = arrays(faces, k)
        assert len(mf) == len(kf) and mesh.is_consistent(mf) == mesh.is_consistent(kf) and mesh.volume(mv, mf) == pytest.approx(mesh.volume(kv, kf), abs=1e-9), k
    assert got[1] == (0, 1) and got[6] == (1, 1) and got[7] == (1, 0)


def test_a_moebius_strip_stays_and_a_long_strip_agrees(spark):
    n = 20
    ring = np.array([[np.cos(2 * np.pi * k / n), np.sin(2 * np.pi * k / n), z] for k in range(n) for z in (0, 1)])
    strip = [t for k in range(n - 1) for t in ((2 * k, 2 * k + 1, 2 * k + 2), (2 * k + 1, 2 * k + 3, 2 * k + 2))]
    moebius = [*strip, (2 * n - 2, 2 * n - 1, 1), (2 * n - 1, 0, 1)]
    half = np.array(strip)
    half[::2] = half[::2][:, ::-1]
    tri = table(spark, {1: (ring, np.array(moebius)), 2: (ring, half)})
    got = repair.oriented(tri)
    assert sorted(map(tuple, got.where("shape_id = 1").select("i", "j", "k").collect())) in (sorted(moebius), sorted((c, b, a) for a, b, c in moebius))
    assert mesh.is_consistent(arrays(got, 2)[1])


def test_nothing_and_more_columns(spark):
    v, f = sphere(4, 5)
    tri = table(spark, {1: (v, f[1:])})
    faces, report = repair.repaired(tri.limit(0))
    assert faces.count() == 0 and report.count() == 0
    faces, report = repair.repaired(tri.withColumn("n", F.lit("x")).withColumn("a", F.lit(1)))
    assert faces.columns[-2:] == ["n", "a"] and faces.where("fid < 0").select("n").collect()[0].n is None and report.collect()[0].ok == 1
