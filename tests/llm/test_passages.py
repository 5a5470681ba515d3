"""Repeats of over 50 words inside longer lines, across line ends, and in lines of few words."""

import random
from collections import defaultdict

import pandas as pd
import pytest
from shapeloom.llm import flat, paragraphs, passages, registry

SF = "/root/testdata/sf0.001"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def wrapped(text, n, head=0):
    w = text.split()
    return "\n".join([*([" ".join(w[:head])] if head else []), *(" ".join(w[i : i + n]) for i in range(head, len(w), n))])


@pytest.fixture(scope="module")
def docs(spark):
    inside, across, short = words(60, 1), words(51, 2), words(160, 3)
    rows = [
        (1, f"{words(500, 10)} {inside} {words(300, 11)}"), (2, f"{words(200, 12)} {inside}, {words(90, 13)}"),
        (3, f"{words(30, 14)}\n{wrapped(across, 30)} {words(40, 15)}"), (4, f"{words(70, 16)} {across} {words(25, 17)}"),
        (5, wrapped(short, 16)), (6, f"{words(8, 18)}\n{wrapped(short, 16, 5)}\n{words(9, 19)}"),
        (7, f"{words(40, 20)} {words(49, 21)} {words(40, 22)}"), (8, f"{words(44, 23)} {words(49, 21)} {words(31, 24)}"), (None, None), (9, ""), (10, words(200, 25)),
    ]
    return spark.createDataFrame(rows, "doc_id long, text string")


EXPECTED = {1: (500, 60, False), 2: (200, 60, True), 3: (30, 51, False), 4: (70, 51, True), 5: (0, 160, False), 6: (8, 160, True)}


@pytest.mark.parametrize("how", [{}, {"hot": 0}, {"broadcast_seeds": 0}])
def test_passages_inside_and_across_lines(docs, how):
    got = passages.repeated_passages(docs, passages.Windows(**how)).collect()
    assert {r.doc_id: (r.first_word, r.n_words, r.removed) for r in got} == EXPECTED and len(got) == 6
    assert {(r.doc_id, r.class_doc, r.class_word) for r in got if r.removed} == {(2, 1, 500), (4, 3, 30), (6, 5, 0)}


def test_passages_are_cut(docs):
    was = {r.doc_id: r.text for r in docs.collect()}
    got = {r.doc_id: r.text for r in paragraphs.without_repeats(docs).collect()}
    assert got[2] == f"{words(200, 12)} , {words(90, 13)}" and got[4] == f"{words(70, 16)}  {words(25, 17)}" and got[6] == f"{words(8, 18)}\n\n{words(9, 19)}"
    assert all(got[k] == was[k] for k in (1, 3, 5, 7, 8, 9, 10, None))


@pytest.mark.parametrize("hot", [0, 4096])
def test_passages_equal_brute_force(spark, hot):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    table = docs.select("doc_id", "text").toPandas().dropna()
    word, at = flat.words(table.text.tolist())
    where = defaultdict(set)
    ids = table.doc_id.tolist()
    for i, d in enumerate(ids):
        own = word[at[i] : at[i + 1]].tolist()
        for k in range(len(own) - 49):
            where[tuple(own[k : k + 50])].add((d, k))
    expected = {(d, k, d != min(at)[0]) for at in where.values() if len({d for d, _ in at}) > 1 for d, k in at}
    got = passages.repeated_passages(docs, passages.Windows(hot=hot)).collect()
    assert {(r.doc_id, k, r.removed) for r in got for k in range(r.first_word, r.first_word + r.n_words - 49)} == expected and expected


def test_query_finds_both_units(spark, docs, tmp_path):
    docs.write.parquet(f"{tmp_path}/documents.parquet")
    got = registry.queries()["op9_substring_dedup"](spark, str(tmp_path)).toPandas()
    assert {2, 4, 6} == set(got[got.removed].doc_id) and not pd.isna(got.first_word).all()
