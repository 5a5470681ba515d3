"""Similarity classes in blocks of few nodes and with shuffle joins, against brute force."""

import random

import pytest
from shapeloom.llm import flat, graph, jaccard_join
from shapeloom.llm.similar import Similarity


def texts():
    """Tight groups, a chain whose ends are unlike, two clusters with a bridge, copies, and unlike texts."""
    r = random.Random(11)
    word = lambda: "".join(r.choice("abcdefghij") for _ in range(6))
    out = []

    def changed(w, n):
        w = list(w)
        for k in r.sample(range(len(w)), n):
            w[k] = word()
        return w

    for size, n in ((25, 1), (14, 2)):
        base = [word() for _ in range(120)]
        out += [" ".join(changed(base, r.randint(0, n))) for _ in range(size)]
    chain = [word() for _ in range(150)]
    for k in range(20):
        chain = changed(chain, 2)
        out.append(" ".join(chain))
    out += [" ".join(word() for _ in range(90)) for _ in range(10)] + out[:6] + out[:2] + ["", " ", None]
    return out


def brute(rows):
    sh, to = flat.shingles(*flat.words(rows), 5)
    sets = [set(sh[to[i] : to[i + 1]].tolist()) for i in range(len(rows))]
    root, links = list(range(len(rows))), [0] * len(rows)
    for i in range(len(rows)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n) - 1e-9:
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    return root, links


@pytest.mark.parametrize("how", [{}, {"block": 4}, {"block": 4, "broadcast_rows": 0}, {"broadcast_rows": 0}])
def test_classes_equal_brute_force(spark, how):
    rows = texts()
    root, links = brute(rows)
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    got = jaccard_join.near_classes(docs, Similarity(**how)).toPandas().sort_values("doc_id")
    assert got.n_links.tolist() == links and got.class_id.tolist() == root
    assert max(links) > 20 and len(set(root)) < len(rows) - 50
    kept = jaccard_join.one_of_each(docs, Similarity(**how)).toPandas().doc_id.tolist()
    assert sorted(kept) == sorted(set(root))


def test_components_with_hubs(spark, monkeypatch):
    monkeypatch.setattr(graph, "HOT", 3)
    edges = [(1, k) for k in range(2, 12)] + [(20, 21), (21, 22), (22, 23), (23, 24), (24, 11), (30, 31), (40, 40), (None, 2)]
    got = {r.v: r.label for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {k: 1 for k in [*range(1, 12), *range(20, 25)]} | {30: 30, 31: 30}
    assert graph.components(spark.createDataFrame([], "a long, b long")).count() == 0
