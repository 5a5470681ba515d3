"""Simplification in rounds: counts, soundness, shape and rims."""

import numpy as np
from pyspark.sql import functions as F

from shapeloom.functions import mesh, simplify
from shapeloom.operators import collapse, rounds, surfaces
from tests.test_surfaces import joined, sphere, table


def test_meshes_stay_sound_and_keep_their_shape(spark):
    v, f = sphere(8, 10)
    tetra = (np.array([[0, 0, 0], [1, 0, 0], [0, 1, 0], [0, 0, 1]], float), np.array([[0, 2, 1], [0, 1, 3], [1, 2, 3], [0, 3, 2]]))
    shapes = {1: (v, f), 2: joined((v * [1, 2, 1], f), (v + 9, f)), 3: tetra, 4: sphere(3, 4), 5: (v, f[10:])}
    tri = table(spark, shapes)
    small = collapse.simplified(tri, 60)
    got, before = ({r.shape_id: r for r in surfaces.described(t).collect()} for t in (small, tri))
    assert {k: r.n_faces for k, r in got.items() if k < 5} == {1: 60, 2: 60, 3: 4, 4: 16}
    for k in (1, 2, 3, 4):
        r, b = got[k], before[k]
        assert (r.is_watertight, r.is_winding_consistent, r.euler_number, r.n_components) == (1, 1, b.euler_number, b.n_components), k
        # a mesh of so few faces loses volume; no more than a tenth beyond collapses in turn
        in_turn = mesh.volume(*simplify.decimated(*shapes[k], 60)[:2])
        assert abs(r.volume - b.volume) <= 1.1 * abs(in_turn - b.volume) + 1e-9, k
    # the rim of the open one stays as it was
    rim = lambda t: {(e.lo, e.hi) for e in surfaces.edges(t.where("shape_id = 5")).groupBy("shape_id", "lo", "hi").count().where("count = 1").collect()}
    assert rim(small) == rim(tri) != set() and got[5].n_faces < 100 and got[5].is_winding_consistent == 1
    assert collapse.simplified(tri.limit(0), 10).count() == 0


def test_small_shapes_go_through_the_same_rounds_in_one_task(spark, monkeypatch):
    rng = np.random.default_rng(5)
    shapes = {k: (v + rng.normal(size=v.shape) * 0.02, f) for k, (v, f) in enumerate((sphere(8, 10), sphere(5, 9), sphere(7, 7), sphere(3, 4)))}
    v, f = shapes[0]
    # one open, one with an edge of three faces, a face without area and a repeated corner
    shapes |= {7: (v, f[9:]), 8: (np.vstack([v, v[:1]]), np.vstack([f, [f[20][0], f[20][1], len(v)], [3, 3, 4]]))}
    tri = table(spark, shapes)
    tri = tri.unionByName(tri.limit(1).withColumn("shape_id", F.lit(None).cast(tri.schema["shape_id"].dataType)))
    went, spread = [], collapse._spread
    monkeypatch.setattr(collapse, "_spread", lambda *a: went.append({r.shape_id for r in a[0].select("shape_id").distinct().collect()}) or spread(*a))
    rows = lambda: sorted((r.shape_id, r.fid, r.i, r.j, r.k, *(round(r[c], 7) for c in surfaces.CORNERS)) for r in collapse.simplified(tri, 50).collect())
    monkeypatch.setattr(collapse, "AT_ONCE", 150)
    here = rows()
    # a round's tables and shuffles are for large shapes only
    assert went == [] and {r[0] for r in here} == set(shapes)
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 100)
    assert rows() == here and went == [{0, 7, 8}]


def test_hashes_are_those_of_spark(spark):
    pairs = [(0, 0), (1, 2), (-5, 7), (2**62, -(2**63))]
    got = [r.h for r in spark.createDataFrame(pairs, "a long, b long").select(F.xxhash64("a", "b").alias("h")).collect()]
    assert simplify._hash(*np.array(pairs).T).tolist() == got
