import math
import random
import re

import numpy as np

from shapeloom.llm import search

_TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def terms(text):
    return _TERM.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or ""))


def by_hand(docs, items, k=10):
    held = [(i, terms(t)) for i, t in docs if terms(t)]
    n_docs, length = len(held), sum(len(t) for _, t in held)
    out = []
    for item, text in set(items):
        scored = []
        for doc, own in held:
            m = 100 - 90 + (90 * len(own) * n_docs) // length
            s = 0
            for t in set(terms(text)):
                df, tf = sum(t in o for _, o in held), own.count(t)
                s += math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df + 1))) * ((1000000000 * tf) // (1000 * tf + 8 * m))
            if s > 0:
                scored.append((-s, doc is None, doc or 0, doc))
        out += [(item, r + 1, x[3], -x[0]) for r, x in enumerate(sorted(scored)[:k])]
    return sorted(out, key=str)


def table(spark, rows, key):
    return spark.createDataFrame([(i, t, "x", 1) for i, t in rows], f"{key} long, text string, rank string, score int").repartition(3)


def test_ranks_equal_all_pairs(spark):
    rnd = random.Random(3)
    words = [f"w{i}" for i in range(40)] + ["Straße", "ÀB", "a-b", "the", "THE"]
    docs = [(i, " ".join(rnd.choices(words, k=rnd.randint(0, 60)))) for i in range(150)]
    docs += [(200, None), (201, ""), (202, "!!"), (None, "the w1 w2"), (203, docs[4][1]), (204, docs[4][1]), (204, docs[4][1]), (205, "w3 " * 5000)]
    items = [(i, " ".join(rnd.choices(words, k=rnd.randint(1, 12)))) for i in range(30)] + [(50, None), (51, ""), (52, "unheard"), (None, "w1 w1 w7"), (53, "w5"), (53, "w5")]
    d, b = table(spark, docs, "doc_id"), table(spark, items, "item_id")
    want = by_hand(docs, items)
    for p in (search.Impacts(), search.Impacts(chunk=50), search.Impacts(block_items=7), search.Impacts(salts=1)):
        assert sorted(map(tuple, search.ranked(d, b, p).collect()), key=str) == want


def test_fewer_than_k_and_text_ids(spark):
    docs = spark.createDataFrame([("b", "red cat"), ("a", "red cat"), ("c", "blue")], "doc_id string, text string")
    items = spark.createDataFrame([("q", "cat")], "item_id string, text string")
    got = sorted(search.ranked(docs, items, search.Impacts(k=1)).collect())
    assert [(r.item_id, r["rank"], r.doc_id) for r in got] == [("q", 1, "a")]
    assert [r.doc_id for r in sorted(search.ranked(docs, items).collect(), key=lambda r: r["rank"])] == ["a", "b"]


def test_empty_tables(spark):
    docs, items = table(spark, [(1, "a b")], "doc_id"), table(spark, [(1, "a")], "item_id")
    assert search.ranked(docs.limit(0), items).count() == 0
    none = search.ranked(docs, items.limit(0))
    assert none.count() == 0 and none.columns == ["item_id", "rank", "doc_id", "score"]


def test_radix_order_is_stable():
    key = np.random.default_rng(1).integers(0, 1 << 32, 5000, dtype=np.uint64) & np.uint64(0xF000F)
    assert (search.radix_order(key) == np.argsort(key, kind="stable")).all()
