"""Overlaps with the benchmark against brute force over all diagonals, with ids of any type, and by join."""

import itertools
import random
import time

import numpy as np
import pandas as pd
import pytest
from shapeloom.llm import decontamination as d
from shapeloom.llm import flat

SF = "/root/testdata/sf0.001"


def found(rows):
    return {(r.doc_id, r.item_id): (r.n_equal, r.n_compared, r.first_word) for r in rows}


@pytest.fixture(scope="module")
def expected():
    docs, items = pd.read_parquet(f"{SF}/documents.parquet"), pd.read_parquet(f"{SF}/benchmark.parquet")
    out, seeds = {}, d.Seeds()
    parts = [(r.item_id, flat.words([r.text])[0]) for r in items.itertuples()]
    for r in docs.itertuples():
        word, at = flat.words([r.text])
        for item_id, item in parts:
            if not len(item) or not len(word):
                continue
            i, j = np.nonzero(word[:, None] == item[None, :])
            n = np.bincount(i - j + len(item), minlength=1)
            some = np.flatnonzero(n >= seeds.need(np.array([len(item)]))[0]) - len(item)
            got = d.best(word, 0, len(word), item, some, seeds)
            if got:
                out[r.doc_id, item_id] = got
    return out


@pytest.mark.parametrize("how", [{}, {"block_bytes": 0}, {"block_bytes": 0, "bits": 12, "broadcast_keys": 0}])
def test_overlaps_equal_brute_force(spark, expected, how):
    seeds = d.Seeds(**how)
    docs, bench = spark.read.parquet(f"{SF}/documents.parquet"), spark.read.parquet(f"{SF}/benchmark.parquet")
    got = found(d.overlaps(docs, bench, seeds).collect())
    assert set(got) <= set(expected) and len(got) >= 0.98 * len(expected) > 0
    assert sum(got[k] == expected[k] for k in got) >= 0.98 * len(got)
    left = {r.doc_id for r in d.without_leaks(docs, bench, seeds).select("doc_id").collect()}
    assert left == {r.doc_id for r in docs.select("doc_id").collect()} - {k for k, _ in got}


def test_masks_find_every_pattern_of_substitutions_in_short_items():
    seeds = d.Seeds()
    for size in (*range(2, 17), 20):
        masks = [m for m, least, most in seeds.laid() if least <= size <= most]
        masks = [int(m, 2) << k for m in masks for k in range(size - len(m) + 1)]
        for gone in itertools.combinations(range(size), size - int(np.ceil(0.8 * size)) if size < 15 else size // 5):
            left = ~sum(1 << k for k in gone)
            assert any(m & left == m for m in masks), (size, gone)


@pytest.mark.parametrize("kind, ids", [("string", ["a", "b", None]), ("int", [1, 2, None]), ("decimal(9,0)", None)])
def test_ids_of_any_type(spark, kind, ids):
    from decimal import Decimal

    ids = ids or [Decimal(1), Decimal(2), None]
    r = random.Random(1)
    items = [" ".join("".join(r.choice("abcdef") for _ in range(6)) for _ in range(30)) for _ in ids]
    docs = spark.createDataFrame([(str(k), f"x {t} y") for k, t in enumerate(items)], "doc_id string, text string")
    bench = spark.createDataFrame(list(zip(ids, items)), f"item_id {kind}, text string")
    for how in ({}, {"block_bytes": 0}):
        assert {(x.doc_id, x.item_id) for x in d.overlaps(docs, bench, d.Seeds(**how)).collect()} == {(str(k), i) for k, i in enumerate(ids)}


def runs_by_hand(text: list[str], item: list[str]) -> int:
    """Most equal words of any run on any diagonal of which four fifths are equal, or 0 where the item needs more."""
    best = 0
    for d in range(-len(item) + 1, len(text)):
        equal = [0 <= d + k < len(text) and text[d + k] == item[k] for k in range(len(item))]
        for a in range(len(item)):
            n = 0
            for b in range(a, len(item)):
                n += equal[b]
                if 5 * n >= 4 * (b + 1 - a) and 0 <= d + a and d + b < len(text):
                    best = max(best, n)
    return best if best >= min(12, -(-4 * len(item) // 5)) else 0


@pytest.mark.parametrize("size", range(2, 21))
def test_every_pattern_of_substitutions_is_reported(size):
    """All patterns (300 of them, where there are more) that leave four fifths of an item, each in a text of its own."""
    r = random.Random(size)
    item = [f"i{k}" for k in range(size)]
    most = size - -(-4 * size // 5)
    patterns = list(itertools.combinations(range(size), most))
    patterns = r.sample(patterns, 300) if len(patterns) > 300 else patterns
    index = d.Index(["item"], [" ".join(item)], d.Seeds())
    texts = [" ".join([f"b{r.random()}"[:8] for _ in range(7)] + [f"s{k}" if k in p else w for k, w in enumerate(item)] + ["after", "words"]) for p in patterns]
    got = index.matches(*flat.words(texts))
    assert [g[0] for g in got] == list(range(len(texts)))
    for g, p in zip(got, patterns):
        assert g[2] == size - most


def test_runs_equal_all_runs_by_hand():
    r = random.Random(5)
    for _ in range(120):
        words = [f"w{k}" for k in range(r.choice([2, 5, 40]))]
        item = [r.choice(words) for _ in range(r.randint(5, 30))]
        text = [r.choice(words) for _ in range(r.randint(0, 10))] + [r.choice(words) if r.random() < 0.2 else w for w in item[r.randint(0, 3) :]] + [r.choice(words) for _ in range(r.randint(0, 10))]
        got = d.Index([1], [" ".join(item)], d.Seeds()).matches(*flat.words([" ".join(text)]))
        want = runs_by_hand(text, item)
        if not want:
            assert not got, (item, text)
        else:  # seeds may miss a run that is spread thinly; every one that is found has its exact count
            assert not got or got[0][2] <= want
            best = [d.best(flat.words([" ".join(text)])[0], 0, len(text), flat.words([" ".join(item)])[0], range(-len(item), len(text)), d.Seeds())]
            assert best[0][0] == want


def test_a_long_run_of_one_word_is_quick():
    index = d.Index(list(range(50)), ["spam " * (40 + k) for k in range(50)] + [], d.Seeds())
    began = time.time()
    got = index.matches(*flat.words(["spam " * 300_000]))
    took = time.time() - began
    assert [g[2] for g in got] == [40 + k for k in range(50)] and took < 5


def test_runs_of_one_word_give_what_all_diagonals_give():
    r = random.Random(11)
    for _ in range(60):
        make = lambda n: [w for _ in range(n) for w in [r.choice("ab")] * r.randint(1, 30)]
        item, text = make(3)[:60], make(r.randint(1, 12))
        got = d.Index([1], [" ".join(item)], d.Seeds()).matches(*flat.words([" ".join(text)]))
        want = d.best(flat.words([" ".join(text)])[0], 0, len(text), flat.words([" ".join(item)])[0], range(-len(item), len(text)), d.Seeds())
        assert (got[0][2] if got else 0) == (want[0] if want else 0)


def test_repeated_words_are_bounded():
    index = d.Index([1, 2], ["spam " * 3000, "spam ham " * 20], d.Seeds())
    began = time.time()
    got = index.matches(*flat.words(["spam " * 30_000, "ham spam " * 500, "other words"]))
    assert {(g[0], g[1]) for g in got} == {(0, 0), (1, 1)} and time.time() - began < 20
