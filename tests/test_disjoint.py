"""Pairs of faces without a common vertex, by counts of common vertices."""

from __future__ import annotations

import itertools

import numpy as np

from shapeloom.operators import frames


def test_pairs_equal_all_pairs_with_repeated_and_unknown_vertices(spark):
    rng = np.random.default_rng(3)
    rows = [(s, f, *(None if x == 6 else int(x) for x in rng.integers(0, 7, 3))) for s in (1, 2) for f in range(40)]
    got = {r.shape_id: r.disjoint_pairs for r in frames.disjoint_pairs(spark.createDataFrame(rows, "shape_id long, fid long, i int, j int, k int")).collect()}
    for s in (1, 2):
        sets = [{*r[2:]} - {None} for r in rows if r[0] == s]
        assert got[s] == sum(not a & b for a, b in itertools.combinations(sets, 2))


def test_many_faces_at_one_vertex_are_counted_not_paired(spark):
    n = 200_000
    fan = spark.range(n).selectExpr("1 as shape_id", "id as fid", "0L as i", "2 * id + 1 as j", "2 * id + 2 as k").union(spark.sql("select 1, 1000000L, -1L, -2L, -3L"))
    assert [r.disjoint_pairs for r in frames.disjoint_pairs(fan).collect()] == [n]
