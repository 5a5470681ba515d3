"""What keeps work spread and off the driver as tables grow: joins of written tables, dealt rows, lookups."""

from __future__ import annotations

import contextlib
import io

import numpy as np
import pandas as pd
from pyspark.sql import functions as F

from shapeloom.functions import mesh, sampling
from shapeloom.operators import frames, rounds, shapes
from shapeloom.plans import solids, surfaces


def plan(d) -> str:
    with contextlib.redirect_stdout(out := io.StringIO()):
        d.explain()
    return out.getvalue()


def test_joins_of_written_tables_do_not_go_through_the_driver(spark):
    made = rounds.Tables(spark)
    # 200,000 equal rows are a few kB as a file
    long = made.kept(spark.range(200_000).select((F.col("id") % 2).alias("k"), F.lit(1.0).alias("x")))
    keys = made.kept(spark.range(2).select(F.col("id").alias("k")))
    for d in (keys.join(long, "k"), keys.join(long.select("k", F.explode(F.sequence(F.lit(0), F.lit(9)))), "k"), keys.join(long.groupBy("k", "x").count(), "k")):
        assert "Broadcast" not in plan(d)
    assert "BroadcastHashJoin" in plan(long.join(rounds.lookup(keys), "k"))
    made.drop()


def test_a_lookup_of_many_keys_is_shuffled(spark, monkeypatch):
    monkeypatch.setattr(rounds, "FEW_KEYS", 1)
    made = rounds.Tables(spark)
    keys = made.kept(spark.range(2).select(F.col("id").alias("k")))
    assert "Broadcast" not in plan(spark.range(9).select(F.col("id").alias("k")).join(rounds.lookup(keys), "k"))
    made.drop()


def test_rows_that_become_many_are_dealt(spark):
    assert rounds.dealt(spark.range(100), "id", 10).rdd.getNumPartitions() == 10
    assert rounds.dealt(spark.range(100), "id").rdd.getNumPartitions() == spark.sparkContext.defaultParallelism
    assert surfaces.blocks(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_boxes_are_scaled_from_one(spark):
    tri = surfaces.blocks(spark, "/root/testdata/sf0.001")
    # a row's corners are a few products, which the JVM compiles, and the rows of a box stay where they are
    assert "CASE" not in plan(tri) and "BroadcastNestedLoopJoin" in plan(tri)
    assert plan(tri.groupBy("shape_id").count()).count("Exchange hashpartitioning") == 1
    d = tri.where("shape_id = 4")
    assert d.count() == 432 and {r.x0 for r in d.select("x0").collect()} == {k / 6 * 5 for k in range(7)}


def test_fields_are_dealt_before_they_are_made(spark):
    assert solids.spheres(spark, "/root/testdata/sf0.001").rdd.getNumPartitions() >= spark.sparkContext.defaultParallelism


def test_results_of_few_shapes_are_held_at_once(spark, monkeypatch):
    held = {}
    monkeypatch.setattr(type(spark.range(1)), "mapInPandas", lambda self, run, schema: held.update(run=run))
    done = []
    shapes.each(spark.range(1), "n long", lambda row: done.append(row["id"]) or {"n": row["id"]})
    out = held["run"](iter([pd.DataFrame({"id": range(1000)}), pd.DataFrame({"id": []}), pd.DataFrame({"id": range(1000, 1003)})]))
    first = next(out)
    assert len(done) == len(first) == shapes.AT_ONCE
    assert [*first.n, *(n for d in out for n in d.n)] == [*range(1003)]


def test_small_clouds_are_thinned_as_in_turn():
    rng = np.random.default_rng(3)
    for n, radius, most in ((0, 0.1, None), (1, 0.1, None), (192, 0.15, None), (192, 0.15, 40), (sampling.FEW_POINTS, 0.05, None), (sampling.FEW_POINTS + 1, 0.1, 50), (130, 0.0, 7)):
        points, keep = rng.random((n, 3)), []
        points[n // 2 :] = points[: n - n // 2]
        for k in range(n):
            if radius == 0 or all(((points[j] - points[k]) ** 2).sum() > radius**2 for j in keep):
                keep.append(k)
        assert sampling.thinned(points, radius, most).tolist() == keep[:most]


def test_distances_of_many_small_meshes_are_those_of_each(monkeypatch):
    rng, calls = np.random.default_rng(4), []
    every = [(rng.normal(size=(n, 3)), rng.normal(size=(8, 3)), rng.integers(0, 8, (m, 3))) for n, m in ((5, 7), (64, 24), (64, 24), (0, 3), (3, 0), (64, 24), (5, 7))]
    alone = [mesh.distances(*x) for x in every]
    one = mesh._distances
    monkeypatch.setattr(mesh, "_distances", lambda points, t: calls.append(len(points)) or one(points, t))
    assert all(np.array_equal(a, b) for a, b in zip(mesh.distances_of(every), alone))
    # meshes of one size go together
    assert sorted(calls) == [1, 1, 2, 3]


def test_a_broken_cloud_among_many_keeps_its_row(spark):
    corner = [0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 1.0, 0.0]
    rows = [(1, [0.0] * 3, [0, 1, 2], [0.2, 0.2, 0.5]), (2, None, None, [0.0] * 3), (3, corner, [0, 1, 2], [0.2, 0.2, 0.5]), (4, corner, [0, 1, 2], [])]
    got = {r.shape_id: r for r in shapes.cloud_distances(spark.createDataFrame(rows, "shape_id int, xyz array<double>, tri array<int>, points array<double>"), width=3).collect()}
    assert got[3].mean_d == got[3].p99_d == 0.5 and got[3].frame_flag == 1 and got[3].error is None
    assert all(got[k].mean_d is None and got[k].error for k in (1, 2, 4))


def joined(d) -> int:
    """Most rows that a join of d has given out, once d has run."""
    most, todo = 0, [d._jdf.queryExecution().executedPlan()]
    while todo:
        node = todo.pop()
        name, children = node.nodeName(), node.children()
        if name == "AdaptiveSparkPlan":
            todo.append(node.executedPlan())
        elif "QueryStage" in name:
            todo.append(node.plan())
        elif "Join" in name:
            most = max(most, node.metrics().get("numOutputRows").get().value())
        todo += [children.apply(k) for k in range(children.size())]
    return most


def test_nearest_points_of_dense_places_and_copies_meet_few(spark):
    rng = np.random.default_rng(7)
    # a dense ball in a wide box, and points that are mostly copies of two
    dense = lambda n: np.concatenate([rng.normal(size=(n, 3)) * 1e-3, rng.random((20, 3)) * 100])
    copies = lambda n: np.concatenate([np.repeat([[1.0, 1.0, 1.0], [1.0, 1.0, 1.0 + 1e-7]], n // 2, 0), rng.random((20, 3)) * 100])
    for make, n in ((dense, 1500), (copies, 1500)):
        a, b = make(n), make(n)
        rows = lambda p: spark.createDataFrame([(1, k, *map(float, x)) for k, x in enumerate(p)], "shape_id int, pid long, x double, y double, z double")
        d = frames.nearest(rows(a), rows(b))
        got = {r.pid: (r.near, r.d2) for r in d.collect()}
        d2 = ((a[:, None] - b[None]) ** 2).sum(2)
        assert len(got) == len(a) and all(got[k] == (int(d2[k].argmin()), d2[k].min()) for k in range(len(a)))
        assert joined(d) < 40 * n


def test_components_in_one_task_and_in_rounds_agree(spark, monkeypatch):
    rng = np.random.default_rng(8)
    nodes = [(k, int(v)) for k, n in (("a", 400), ("b", 5), ("c", 60), (None, 3)) for v in rng.permutation(n) * 1_000_003 - 7] + [("b", -7)]
    of = {k: [v for x, v in nodes if x == k] for k in "abc"}
    links = [(k, *map(int, rng.choice(of[k], 2))) for k, n in (("a", 250), ("b", 2), ("c", 50)) for _ in range(n)]
    n, e = spark.createDataFrame(nodes, "s string, v long"), spark.createDataFrame(links, "s string, a long, b long")
    rows = lambda: sorted(tuple(r) for r in rounds.components(n, e, "s").collect())
    went, spread = [], rounds._in_rounds
    monkeypatch.setattr(rounds, "_in_rounds", lambda *a: went.append({r.s for r in a[0].collect()}) or spread(*a))
    here = rows()
    # small keys are not spread, so they take one shuffle instead of some for each round
    assert went == [] and len(here) == 465
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 100)
    assert rows() == here and went == [{"a"}]
    monkeypatch.setattr(rounds, "IN_ONE_TASK", 0)
    assert rows() == here and went[1:] == [{"a", "b", "c"}]
    assert rounds.components(n.limit(0), e, "s").count() == 0
