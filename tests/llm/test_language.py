"""Rejection by language, and learning that depends on texts only."""

import random

import pytest
from pyspark.sql import functions as F
from shapeloom.llm import language

SF = "/root/testdata/sf0.001"


def test_texts_of_no_learned_language_are_rejected(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text", "lang")
    learned = language.prototypes(docs)
    r = random.Random(2)
    noise = " ".join("".join(chr(r.randrange(0x4E00, 0x9000)) for _ in range(5)) for _ in range(200))
    odd = spark.createDataFrame([(-1, noise, "en"), (-2, "123 !!", "en"), (-3, None, None), (-4, "", None), (-5, "Zq.", None)], docs.schema)
    kept = {x.doc_id for x in language.accepted(docs.unionByName(odd), learned).select("doc_id").collect()}
    clean = {x.doc_id for x in docs.join(spark.read.parquet(f"{SF}/labels.parquet").where("quality = 1"), "doc_id").collect()}
    assert clean <= kept and kept & {-1, -2, -3, -4, -5} == {-5}
    one = {x.lang for x in language.accepted(docs, learned, wanted=("en",)).collect()}
    assert "en" in one and len(one) <= 2


def test_an_unlabelled_corpus_passes(spark):
    import corpus_pipeline

    docs = spark.createDataFrame([(k, f"text {k} of a corpus", None, "s") for k in range(8)] + [(9, "--", None, "s")], "doc_id long, text string, lang string, source string")
    assert {x.doc_id for x in corpus_pipeline.language_id(spark, docs, SF).collect()} == set(range(8))


def test_ids_teach_nothing(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    p = language.Profiles(sample=20)
    one, two = (language.prototypes(d, p) for d in (docs, docs.withColumn("doc_id", F.col("doc_id") * 7 + 3)))
    assert all((a == b).all() for a, b in zip(one["vector"], two["vector"]))
    with pytest.raises(ValueError):
        language.prototypes(docs, language.Profiles(languages=1))
