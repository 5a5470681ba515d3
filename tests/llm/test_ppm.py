import math
import zlib
from collections import Counter, defaultdict

import pytest
from pyspark.sql import functions as F

from shapeloom.llm import ppm

TEXTS = ["The cat sat on the mat.", "the cat ate the rat", "Ein Hund läuft über die Straße", "the the the\nthe", "", None, "x", "a cat sat on a rat\u0000 and ran", "zzz unseen Ωmega words", "the cat sat on the mat."]


def by_hand(taught: list[str], text: str, order: int) -> float:
    """PPM with escapes by method C and full exclusion, from a dictionary of every context."""
    trie = defaultdict(Counter)
    steps = lambda t: [(bytes([255]) * order + t.encode().lower() + b"\xff", i) for i in range(order, order + len(t.encode()) + 1)]
    for t in taught:
        for data, i in steps(t):
            for j in range(order + 1):
                trie[data[i - j : i]][data[i]] += 1
    out = 0.0
    for data, i in steps(text):
        gone = set()
        for j in range(order, -1, -1):
            seen = {s: c for s, c in trie.get(data[i - j : i], {}).items() if s not in gone}
            if data[i] in seen:
                out += math.log10(seen[data[i]] / (sum(seen.values()) + len(seen)))
                break
            if seen:
                out += math.log10(len(seen) / (sum(seen.values()) + len(seen)))
            gone |= seen.keys()
        else:
            out -= math.log10(256 - len(gone))
    return out


def base_by_hand(taught: list[list[str]], tokens: list[str]) -> tuple[int, float]:
    c = Counter(w for t in taught for w in t)
    n, v = sum(c.values()), len(c)
    return sum(c[w] > 0 for w in tokens), sum(math.log10((c[w] + 1) / (n + v + 1)) for w in tokens)


def tokens(text):
    lower = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text or "")
    return [w for w in lower.replace("\n", " ").split(" ") if w] + ["</s>"]


@pytest.mark.parametrize("order", [3, 5])
@pytest.mark.parametrize("most", [10**6, 20, 0])
def test_scores_equal_tries_made_by_hand(spark, order, most):
    docs = spark.createDataFrame([(i, t, i % 3 != 1, "clash") for i, t in enumerate(TEXTS)], "doc_id long, text string, learn boolean, score string").repartition(3)
    got = {r.doc_id: r for r in ppm.scored(docs, F.col("learn"), p=ppm.Trie(order=order, head=most)).collect()}
    taught = [t or "" for i, t in enumerate(TEXTS) if i % 3 != 1]
    assert len(got) == len(TEXTS)
    for i, t in enumerate(TEXTS):
        assert got[i].score == pytest.approx(by_hand(taught, t or "", order), abs=1e-9), t
        known, base = base_by_hand([tokens(x) for x in taught], tokens(t))
        assert (got[i].n_tokens, got[i].n_known, got[i].train_tokens) == (len(tokens(t)), known, sum(len(tokens(x)) for x in taught))
        assert got[i].base_score == pytest.approx(base, abs=1e-9)


def test_what_another_corpus_taught(spark):
    other = spark.createDataFrame([(t,) for t in TEXTS[:4]], "text string")
    docs = spark.createDataFrame([(t,) for t in TEXTS], "text string")
    got = ppm.scored(docs, trained=ppm.counts(other, F.lit(True))).collect()
    assert [r.score for r in sorted(got, key=lambda r: str(r.text))] == pytest.approx([by_hand(TEXTS[:4], t or "", 5) for t in sorted(TEXTS, key=str)], abs=1e-9)


def test_nothing_learned_and_empty_tables(spark):
    docs = spark.createDataFrame([(1, "abc"), (2, None)], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.scored(docs).collect()}
    assert got[1].score == pytest.approx(-4 * math.log10(256)) and got[2].score == pytest.approx(-math.log10(256))
    assert (got[1].n_tokens, got[1].n_known, got[1].train_tokens, got[1].base_score) == (2, 0, 0, 0.0)
    assert ppm.scored(docs.limit(0), F.lit(True)).count() == 0


def test_adaptive_scores_learn_as_they_go(spark):
    text = "abracadabra " * 30
    rows = ppm.adaptively_scored(spark.createDataFrame([(1, text), (2, "abracadabra "), (3, None)], "doc_id long, text string")).collect()
    got = {r.doc_id: r.score for r in rows}
    assert got[1] > 3 * got[2] and got[3] == pytest.approx(-math.log10(256))
    assert ppm.adaptive("aa", 3) == pytest.approx(-math.log10(256) + by_hand_after("a", "a") + by_hand_after("aa", "\xff"))


def by_hand_after(before: str, symbol: str) -> float:
    """Second and third symbol of "aa" with contexts of three bytes: the first has contexts that are new but the empty one."""
    if before == "a":  # empty context: a once, so 1 of 2
        return math.log10(1 / 2)
    # context "a" knows a (escape 1 of 2), the empty context a only (excluded), then one of 255 others
    return math.log10(1 / 2) - math.log10(255)


def test_held_out_by_crc(spark):
    rows = spark.range(200).select(F.col("id"), ppm.held_out(F.col("id")).alias("h")).collect()
    assert all(r.h == (zlib.crc32(str(r.id).encode()) % 7 == 2) for r in rows)


def test_query_predicts_texts_it_did_not_learn(spark):
    sf = "/root/testdata/sf0.001"
    rows = ppm.op11_lm_scoring(spark, sf).collect()
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    assert len(rows) == len(docs)
    out = [r for r in rows if r.held_out and len((docs[r.doc_id] or "")) > 50]
    bits = sum(-r.score for r in out) * math.log2(10) / sum(len(docs[r.doc_id].encode()) + 1 for r in out)
    assert 0.2 < bits < 3.5  # 8 without a model


def test_a_long_text(spark):
    docs = spark.createDataFrame([(1, "lorem ipsum dolor " * 200_000), (2, "lorem")], "doc_id long, text string")
    got = {r.doc_id: r for r in ppm.scored(docs, F.lit(True)).collect()}
    assert got[1].n_tokens == 600_001 and -1e4 < got[1].score < 0
