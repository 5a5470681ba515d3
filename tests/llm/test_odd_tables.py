"""Every registered query on empty tables, and on nulls, ties, repeated rows and extra columns with clashing names."""

import pytest
from shapeloom.llm import registry

LONG = " ".join(f"w{k % 5003}x{k % 7}" for k in range(40_000))
TEXT = "the quick brown fox jumps over the lazy dog while seven wise men watch the moon rise above a silent harbour town tonight again"
DOCS = "doc_id long, text string, lang string, source string, n_chars long, fp string, size long, key string, label string, other string, target double, h long, w string, n long, bucket int, pos int, own int"
MORE = ("f", 1, "k", "l", "o", 1.0, 2, "w", 3, 4, 5, 6)
ROWS = [(1, TEXT, "en", "a"), (1, TEXT, "en", "a"), (1, TEXT + " more", "en", "a"), (2, TEXT, None, None), (3, None, "en", "a"), (4, "", "de", ""), (None, TEXT, "de", "b"), (None, None, None, None), (5, LONG, "fr", "c"), (6, "\x00\x01   ퟿ 🙂", "en", "c"), (-7, "!!!", "en", "a")]
PAGES = [(1, "http://a/1", f"<html><body><article><p>{TEXT}</article></body></html>"), (1, "http://a/1", f"<html><body><article><p>{TEXT}</article></body></html>"), (2, None, None), (None, "x", ""), (3, "", "<p" * 3000), (4, "http://a/2", f"<div>{LONG}"), (5, "http://a/3", "<div>" * 5000)]
BENCH = [(1, TEXT), (1, TEXT), (None, TEXT), (2, None), (3, "")]
LABELS = [(1, 1, 0), (1, 1, 0), (None, None, None), (2, 0, 1), (99, 1, 1)]
VECTORS = [(1, [0.5] * 16, 1), (1, [0.5] * 16, 1), (2, [0.25, -0.5] * 8, None), (None, [0.1] * 16, None), (3, [-1.0] * 16, 2)]
NO_VECTORS = [(4, None, 1), (5, [], 1), (6, [0.5] * 15 + [None], 2), (7, [float("nan")] * 16, 2), (8, [float("inf")] * 16, 2), (9, [0.5] * 8, 2)]


def tables(spark, path, rows):
    keep = slice(None) if rows else slice(0)
    spark.createDataFrame([(*r, len(r[1] or ""), *MORE) for r in ROWS][keep], DOCS).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(*r, "t", "h") for r in PAGES][keep], "page_id long, url string, html string, text string, host string").write.parquet(f"{path}/pages.parquet")
    spark.createDataFrame([(*r, 7, "s") for r in BENCH][keep], "item_id long, text string, doc_id long, source string").write.parquet(f"{path}/benchmark.parquet")
    spark.createDataFrame([(*r, "t", "s") for r in LABELS][keep], "doc_id long, quality int, toxic int, text string, source string").write.parquet(f"{path}/labels.parquet")
    spark.createDataFrame([(*r, "v", 1, "c") for r in VECTORS + NO_VECTORS][keep], "vec_id long, embedding array<float>, label int, v string, n int, code string").write.parquet(f"{path}/embeddings.parquet")
    return str(path)


@pytest.fixture(scope="module")
def places(spark, tmp_path_factory):
    return {rows: tables(spark, tmp_path_factory.mktemp("odd"), rows) for rows in (True, False)}


EXACT = {"op1_license_scan": ROWS, "op3_html_extraction": PAGES, "op4_ngram_jaccard_join": ROWS, "op5_quality_rules": ROWS, "op6_token_counts": ROWS, "op7_mixing": ROWS, "op8_warc": PAGES, "op10_language_id": ROWS, "op11_lm_scoring": ROWS, "op12_vector_codes": VECTORS}


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_odd_rows(spark, places, name):
    got = registry.queries()[name](spark, places[True]).toPandas()
    if name in EXACT:
        ids = sorted(r[0] if r[0] is not None else -1 for r in EXACT[name])
        assert sorted(got.iloc[:, 0].fillna(-1).astype(int)) == ids


@pytest.mark.parametrize("name", sorted(registry.queries()))
def test_empty_tables(spark, places, name):
    got = registry.queries()[name](spark, places[False])
    assert got.count() == 0 and len(got.columns) > 1


@pytest.mark.parametrize("rows", [True, False])
def test_pipeline(spark, places, rows):
    import corpus_pipeline

    got = corpus_pipeline.run(spark, places[rows]).toPandas()
    assert (len(got) > 0) == rows


def test_deeply_nested_pages(spark):
    from shapeloom.llm import html

    deep = lambda t: f"<div class=top>{'<div>' * 3000}<article><p>{t}</article>{'</div>' * 3000}<nav>m</nav></div>"
    rows = [(1, "http://d/1", deep("one")), (2, "http://d/2", deep("two")), (3, "http://d/3", "<article><p>three</article>")]
    got = {r.page_id: r.text for r in html.main_text(spark.createDataFrame(rows, "page_id long, url string, html string")).collect()}
    assert got == {1: "one", 2: "two", 3: "three"}
