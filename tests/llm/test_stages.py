"""Each stage of the pipeline on small documents, and the whole against the stages' rules."""

import random

import corpus_pipeline
import pytest
from pyspark.sql import functions as F

SF = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def words(n, seed):
    r = random.Random(seed)
    return " ".join("".join(r.choice("abcdefghij") for _ in range(6)) for _ in range(n))


def docs(spark, texts):
    return spark.createDataFrame([(k, t, "en", f"s{k % 2}", len(t or "")) for k, t in enumerate(texts)], DOCS)


def test_passages_go_from_all_but_the_first(spark):
    shared = words(70, 1)
    texts = [f"{words(30, 2)} {shared} {words(20, 3)}", words(60, 4), f"{words(25, 5)} {shared}", shared]
    got = {r.doc_id: r for r in corpus_pipeline.substring_dedup(spark, docs(spark, texts), SF).collect()}
    assert got[0].text == texts[0] and got[1].text == texts[1] and got[2].text.strip() == words(25, 5) and 3 not in got
    assert all(r.n_chars == len(r.text) for r in got.values())


def test_leaks_go(spark):
    item = spark.read.parquet(f"{SF}/benchmark.parquet").where(F.length("text") > 80).first().text
    texts = [words(50, 1), f"{words(10, 2)} {item} {words(5, 3)}", None, ""]
    assert {r.doc_id for r in corpus_pipeline.decontamination(spark, docs(spark, texts), SF).collect()} == {0, 2, 3}


def test_mix_takes_words_near_the_target(spark):
    got = corpus_pipeline.mixing(spark, docs(spark, [words(k + 5, k) for k in range(40)]), SF).toPandas()
    for _, g in got.groupby("source"):
        assert abs(g.taken.sum() - g.target.iloc[0]) < 2 and (g.taken <= 2 * g["size"]).all()


@pytest.mark.parametrize("stage", corpus_pipeline.STAGES[:-1])
def test_stages_return_the_columns_of_documents(spark, stage):
    table = spark.read.parquet(f"{SF}/documents.parquet")
    assert stage[1](spark, table, SF).columns == table.columns
