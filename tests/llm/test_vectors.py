import hashlib
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from shapeloom.llm import facts, vectors

P = vectors.Codes()


def by_hand(rows, p=P):
    kept = sorted(((i, lab, [int(np.floor(p.scale * float(x))) for x in v]) for i, lab, v in rows if v and all(x is not None and np.isfinite(x) for x in v)), key=lambda r: (r[0] is None, r[0] or 0, r[2]))
    width = len(kept[0][2]) // p.parts
    part = lambda v, k: v[k * width : (k + 1) * width]
    books = [[part(v, k) for _, _, v in kept[: p.entries]] for k in range(p.parts)]
    far = lambda a, b: sum((x - y) ** 2 for x, y in zip(a, b))
    pick = lambda v, k: min(range(len(books[k])), key=lambda e: (far(part(v, k), books[k][e]), e))
    for _ in range(p.rounds):
        groups = {}
        for _, _, v in kept:
            for k in range(p.parts):
                groups.setdefault((k, pick(v, k)), []).append(part(v, k))
        for (k, e), own in groups.items():
            books[k][e] = [sum(c) // len(own) for c in zip(*own)]
    out = []
    for i, lab, v in kept:
        at = [pick(v, k) for k in range(p.parts)]
        out.append((i, lab, "".join(f"{e:02x}" for e in at), sum(far(part(v, k), books[k][e]) for k, e in enumerate(at))))
    return out, hashlib.sha256(",".join(str(x) for b in books for e in b for x in e).encode()).hexdigest()


def rows_of(n, dim, seed):
    rnd = random.Random(seed)
    rows = [(i, rnd.choice([None, 1, 2]), [rnd.choice([-0.5, 0.0, 0.25]) + rnd.gauss(0, 0.1) for _ in range(dim)]) for i in range(n)]
    rows += [(n, 1, None), (n + 1, 1, [0.5] * (dim - 1) + [None]), (n + 2, 1, [float("nan")] * dim), (n + 3, 2, [float("inf")] + [0.0] * (dim - 1)), (n + 4, 2, [])]
    return rows + [rows[3], rows[3], (None, None, rows[5][2])]


@pytest.mark.parametrize("dim", [8, 16, 24, 64])
def test_codes_equal_all_distances(spark, dim):
    rows = rows_of(120, dim, dim)
    got, books = vectors.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>").repartition(3))
    want, sha = by_hand(rows)
    key = lambda r: tuple(map(str, r))
    assert sorted(map(tuple, got.collect()), key=key) == sorted(want, key=key)
    assert vectors.digest(books) == sha


def test_bounds_never_lose_the_nearest_entry():
    rng = np.random.default_rng(7)
    for width in (1, 2, 3, 8, 12, 16):
        for spread in (3, 5000, 1 << 27):
            x, book = rng.integers(-spread, spread + 1, (500, width)), rng.integers(-spread, spread + 1, (16, width))
            book[5], x[:16] = book[3], book  # ties and exact hits
            entry, d, _ = vectors.nearest(x, book)
            every = ((x[:, None] - book[None]) ** 2).sum(-1)
            assert (entry == every.argmin(1)).all() and (d == every.min(1)).all()


def test_bounds_spare_distances_where_vectors_cluster():
    rng = np.random.default_rng(8)
    book = rng.integers(-4096, 4097, (16, 8))
    x = book[rng.integers(0, 16, 2000)] + rng.integers(-500, 501, (2000, 8))
    assert vectors.nearest(x, book)[2] < 0.4 * len(x) * len(book)


def test_few_rows_none_and_what_does_not_fit(spark):
    t = lambda rows: spark.createDataFrame(rows, "vec_id long, label int, embedding array<float>, code string")
    got, books = vectors.compressed(t([(1, 1, [0.5] * 8, "x")]))
    assert [tuple(r) for r in got.collect()] == [(1, 1, "00" * 8, 0)] and len(books) == 8
    got, books = vectors.compressed(t([]))
    assert got.count() == 0 and books == []
    with pytest.raises(ValueError):
        vectors.compressed(t([(1, 1, [0.5] * 9, "x")]))
    with pytest.raises(ValueError):
        vectors.compressed(t([(1, 1, [1e30] * 8, "x")]))


def test_decoded_vectors_have_the_errors(spark):
    rows = rows_of(60, 16, 1)
    codes, books = vectors.compressed(spark.createDataFrame(rows, "vec_id long, label int, embedding array<double>"))
    source = {r[0]: [int(np.floor(4096 * x)) for x in r[2]] for r in rows[:60]}
    for r in vectors.decoded(codes, books).where("vec_id < 60").collect():
        assert sum((a - b) ** 2 for a, b in zip(source[r.vec_id], r.v)) == r.error


@pytest.mark.parametrize("few", [0, 1000])
def test_facts_of_hot_keys(spark, few):
    rows = [(None if i % 5 == 0 else i % 7, i) for i in range(400)] + [(100 + i, -i) for i in range(3000)]
    df = spark.createDataFrame(rows, "k int, x int")
    of = df.groupBy("k").count().withColumnRenamed("count", "n").withColumn("fact", F.hash("k"))
    got = facts.with_facts(df, of, ["k"], "n", few=few)
    want = {r.k: r.fact for r in of.collect()}
    assert sorted((r.x, r.fact) for r in got.collect()) == sorted((x, want[k]) for k, x in rows)
