"""Brute-force versions, round trips and edge cases of the operators."""

import base64
import collections
import hashlib
import random
import re
import zlib

import numpy as np
import pandas as pd
import pytest
from shapeloom.llm import decontamination, flat, html, jaccard_join, language, licenses, mixing, paragraphs, quality, registry, tokens, warc

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, label string, fp string"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


@pytest.fixture(scope="module")
def odd(spark):
    """Nulls, empty and very long texts, copies, ties, repeated rows, and columns whose names clash."""
    base, long = words(80, 1), words(30_000, 2)
    near = base.replace(base.split()[40], "changed")
    rows = [(1, base), (2, base), (2, base), (3, near), (4, None), (5, ""), (None, base), (None, None), (6, long), (7, "x"), (8, "!!! ..."), (9, f"{words(30, 3)}\n{base}\n{words(30, 4)}"), (10, words(60, 5))]
    return spark.createDataFrame([(i, t, "en" if (i or 0) % 2 else None, "s" if (i or 0) % 3 else None, len(t or ""), "l", "f") for i, t in rows], DOCS)


def test_jaccard_join_on_odd_rows(odd):
    got = jaccard_join.near_classes(odd).toPandas()
    assert len(got) == 13
    one = got[got.doc_id.isin([1, 2, 3])]
    assert set(one.class_id) == {1} and (one.n_links == 4).all()
    assert (got[got.doc_id.isin([4, 5, 6, 7, 8, 9, 10])].n_links == 0).all()


def test_jaccard_join_equals_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet")
    sh, to = flat.shingles(*flat.words(docs.text.tolist()), 5)
    sets = [set(sh[to[i] : to[i + 1]].tolist()) for i in range(len(docs))]
    root, links = list(range(len(docs))), [0] * len(docs)
    for i in range(len(docs)):
        for j in range(i):
            n = len(sets[i] & sets[j])
            if n and n >= 0.8 * (len(sets[i]) + len(sets[j]) - n):
                links[i] += 1
                links[j] += 1
                a, b = sorted((root[i], root[j]))
                root = [a if x == b else x for x in root]
    got = registry.queries()["op4_ngram_jaccard_join"](spark, SF).toPandas().sort_values("doc_id")
    assert got.n_links.tolist() == links and got.class_id.tolist() == docs.doc_id[root].tolist()


def test_paragraphs(odd):
    got = paragraphs.repeated_paragraphs(odd).toPandas()
    assert set(got[got.removed].doc_id.dropna()) == {2, 3, 9} and got[~got.removed].doc_id.tolist() == [1]
    kept = {r.doc_id: r.text for r in paragraphs.without_repeats(odd).where("doc_id is not null").collect()}
    assert kept[1] == words(80, 1) and 2 not in kept and kept[9] == f"{words(30, 3)}\n{words(30, 4)}" and kept[10] == words(60, 5) and kept[7] == "x"


def test_decontamination_tolerates_substitutions(spark, odd):
    item = words(40, 9).split()
    changed = list(item)
    for k in (7, 19, 31):
        changed[k] = "other"
    docs = odd.unionByName(spark.createDataFrame([(20, f"{words(9, 6)} {' '.join(changed)} {words(9, 7)}", "en", "s", 0, "l", "f"), (21, f"AB {words(5, 8)}, tail", "en", "s", 0, "l", "f")], DOCS))
    bench = spark.createDataFrame([(1, " ".join(item)), (2, None), (3, ""), (4, words(5, 8))], "item_id long, text string")
    got = {(r.doc_id, r.item_id): r for r in decontamination.overlaps(docs, bench).collect()}
    assert set(got) == {(20, 1), (21, 4)} and got[20, 1].n_equal == 37 and got[20, 1].first_word == 9
    assert {r.doc_id for r in decontamination.without_leaks(docs, bench).collect()} == {r.doc_id for r in odd.collect()}
    assert decontamination.overlaps(docs, bench.limit(0)).count() == 0


def test_language_held_out_accuracy(spark):
    got = registry.queries()["op10_language_id"](spark, SF).toPandas().set_index("doc_id").join(pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id"))
    assert all((zlib.crc32(str(i).encode()) % 4 == 2) == x for i, x in got.held_out.items())
    out = got[got.held_out]
    assert (out.lang_pred == out.lang).mean() > 0.95 and got.score.between(0, 1).all()


def test_language_on_odd_rows(odd):
    got = {r.text: r.lang_pred for r in language.identify(odd, language.prototypes(odd)).collect()}
    assert got[None] == got[""] == got["!!! ..."] == "und" and got["x"] == "en"
    assert {r.lang_pred for r in language.identify(odd, language.prototypes(odd.limit(0))).collect()} == {"und"}


def test_token_counts_at_every_prefix(spark, odd):
    import public_tokenizers as P
    from tokenizers import Tokenizer

    path = P.path("byte_bpe_50k.json")
    lib, counter, r = Tokenizer.from_file(path), tokens.PrefixCounter(path), random.Random(3)
    count = lambda s: len(lib.encode(s, add_special_tokens=False).ids)
    parts = ["a", "'", "r", "re", "'ll", " ", "  ", "\n", "x1", "é", "日本", "<|endoftext|>", "the ", "🙂", "<|endo", " ", "L", "don't", "\t", "!!", "\x1c", "\x85"]
    for _ in range(300):
        s = "".join(r.choice(parts) for _ in range(r.randint(0, 14)))
        p = counter.prefixes(s)
        assert p.tolist() == [count(s[: i + 1]) for i in range(len(s))]
        fit = counter.longest_within(p, 5)
        assert count(s[:fit]) <= 5 and all(count(s[:k]) > 5 for k in range(fit + 1, len(s) + 1))
    for _ in range(300):
        s = "".join(chr(r.choice((r.randrange(256), r.randrange(256), 32, 39, 97, 0xE9))) for _ in range(r.randint(0, 30)))
        assert counter.latin.findall(s) == counter.pieces.findall(s) and counter.prefixes(s)[-1:].tolist() == [count(s)][: len(s)]
    assert all(bool(counter.latin.fullmatch(c * 2)) == bool(counter.pieces.fullmatch(c * 2)) and counter.latin.findall(f"a{c}1 {c}") == counter.pieces.findall(f"a{c}1 {c}") for c in map(chr, range(256)))
    small = tokens.PrefixCounter(path, most_pieces=3)
    for s in ("the cat sat on the mat and the dog", "le café était fermé hier", "the cat") * 3:
        assert small.prefixes(s).tolist() == [count(s[: i + 1]) for i in range(len(s))] and len(small.memo) <= 5
    got = tokens.token_counts(odd, path, budgets=(10,), tables=True).collect()
    assert len(got) == 13 and all(x.n_tokens == count(x.text or "") and x.n_bytes == len((x.text or "").encode()) and len(x.prefix_tokens) == len(x.text or "") for x in got)


def test_mixing(spark, odd):
    got = mixing.mixed(odd).toPandas()
    assert len(got) == 13 and (got.taken <= 2 * got["size"]).all()
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) < 3
    assert got.sort_values(["doc_id", "taken"]).taken.tolist() == mixing.mixed(odd.repartition(5)).toPandas().sort_values(["doc_id", "taken"]).taken.tolist()
    assert mixing.mixed(odd.limit(0)).count() == 0


@pytest.mark.parametrize("sizes", [[10, 10, 10], [1, 100, 5, 7], [0, 4], [3], [1000, 1, 1, 1, 1, 1]])
def test_targets_by_iteration(spark, sizes):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([(f"s{k}", n) for k, n in enumerate(sizes)], "source string, source_size long")).collect()}
    left, open_, out = 1.5 * sum(sizes), set(range(len(sizes))), {}
    while open_:
        level = left / sum((3, 1, 2)[k % 3] for k in open_)
        full = {k for k in open_ if (3, 1, 2)[k % 3] * level > 2 * sizes[k]}
        if not full:
            out |= {k: (3, 1, 2)[k % 3] * level for k in open_}
            break
        for k in full:
            out[k] = 2 * sizes[k]
            left -= out[k]
        open_ -= full
    assert all(abs(got[f"s{k}"] - v) < 1e-6 for k, v in out.items())


def test_quality_rules_equal_brute_force(spark):
    docs = pd.read_parquet(f"{SF}/documents.parquet").set_index("doc_id").text
    for r in registry.queries()["op5_quality_rules"](spark, SF).collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", docs[r.doc_id])
        grams = [tuple(w[i : i + 8]) for i in range(len(w) - 7)]
        often = collections.Counter(grams)
        cover = {k for i, g in enumerate(grams) if often[g] > 1 for k in range(i, i + 8)}
        lines = [x for x in docs[r.doc_id].split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", docs[r.doc_id])), len(lines) - len(set(lines)), len(cover))
        assert r.base_failed == (len(w) < 20 or 100 * len(cover) > 30 * len(w)) and not (r.kept and r.base_failed)


def test_quality_ratio_equals_brute_force(spark, odd):
    rules = quality.Rules(buckets=1 << 10)
    got = quality.ratios(odd, odd.where("doc_id in (1, 10)").select("doc_id"), rules)
    raw, target = np.ones(1 << 10), np.ones(1 << 10)
    for r in odd.collect():
        bucket, _, _, _ = quality._grams([r.text], rules)
        np.add.at(raw, bucket, 1)
        if r.doc_id in (1, 10):
            np.add.at(target, bucket, 1)
    assert np.allclose(got, np.log(target / target.sum()) - np.log(raw / raw.sum()))
    assert quality.judged(odd, got, rules).count() == 13


def test_license_scan_on_odd_rows(spark, odd):
    docs = odd.unionByName(spark.createDataFrame([(30, "MIT License. The\tGNU\nGeneral--Public license; mit license", "en", "s", 0, "l", "f"), (31, "Licensed under the Apache License, Version 2.0", "en", "s", 0, "l", "f")], DOCS))
    got = {r.doc_id: r for r in licenses.scan(docs).collect()}
    assert (got[30].n_base, got[30].first_word, got[30].last_word, got[30].base_labels, got[30].n_words) == (3, 0, 7, "gpl,mit", 9)
    assert got[31].labels == "apache,apache-2.0" and got[4].n_words == 0 and got[1].first_word is None and got[1].score == 0


def test_warc_round_trip(spark, tmp_path):
    rows = [(1, "http://a/", "<p>x"), (2, None, "<p>x"), (2, "http://b/", "<p>x"), (3, "u\r\nWARC-Type: fake", None), (4, "u", ""), (None, "u", "<p>x"), (5, "u", "é" * 300_000)]
    warc.archive(spark.createDataFrame(rows, "page_id long, url string, html string"), f"file://{tmp_path}/w")
    got = spark.read.format("warc").load(f"file://{tmp_path}/w").toPandas()
    assert len(got) == 7 and sorted(got.record_type) == ["response"] * 4 + ["revisit"] * 3
    for r in got.itertuples():
        if r.record_type == "response":
            assert r.payload_digest == base64.b32encode(hashlib.sha1(r.payload).digest()).decode() and len(r.payload) == r.payload_length
    some = spark.read.format("warc").option("payload", "false").load(f"file://{tmp_path}/w").where("record_type = 'revisit'")
    assert set(some.toPandas().refers_to) == {"<urn:page:2>", "<urn:page:4>"}


def test_html_wrappers(spark):
    page = "<html><body><div class='top-nav'>x</div><div id=content><div class=cookie-notice>we</div><h1>T &eacute;</h1><p>A <i>b</i>\n c<p>D<ul><li>one<li>two</ul><form>f<input></form></div><section id=comments><p>hey</section></body>"
    rows = [(1, "http://h/1", page), (2, "http://h/2", None), (3, None, ""), (4, "odd", "<p>a&amp;b<p"), (5, "http://h/1", page)]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "T é\n\nA b c\n\nD\n\none\n\ntwo", 2: "", 3: "", 4: "a&b", 5: "T é\n\nA b c\n\nD\n\none\n\ntwo"}
    one, two = (html.folded(html.tree(x)) for x in ("<ul><li>a<li>b</ul><b>t</b>", "<ul><li>c</ul>"))
    assert html.expression(html.merge(one, two)) == "(<>(<ul>(<li>(#)</li>)+</ul>)(<b>(text)</b>)?</>)"


def test_pipeline_keeps_clean_documents(spark):
    import corpus_pipeline

    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = corpus_pipeline.run(spark, SF).toPandas()
    assert set(docs.columns) <= set(out.columns) and 0 < len(out) <= docs.count() and out.doc_id.is_unique
    assert (out.taken > 0).all()
