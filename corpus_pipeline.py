"""A training corpus from `documents`: five stages, each written as Parquet and read again by the next."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from shapeloom.llm.decontamination import without_leaks
from shapeloom.llm.jaccard_join import one_of_each
from shapeloom.llm.language import accepted, prototypes
from shapeloom.llm.mixing import mixed
from shapeloom.llm.paragraphs import without_repeats
from shapeloom.llm.store import new_path, removed, scratch

#: Languages that stay; None: every one that is learned.
LANGUAGES = None


def language_id(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects texts without a letter, texts that are like no learned language, and those of languages that are not wanted. A corpus without any label passes as far as it has letters."""
    return accepted(docs, prototypes(docs.select("text", "lang")), wanted=LANGUAGES)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of each class, whatever ids are null or stand on several rows."""
    return one_of_each(docs)


def substring_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts paragraphs and passages that stand in an earlier document; n_chars follows the text."""
    out = without_repeats(docs)
    return out.withColumn("n_chars", F.length("text").cast(docs.schema["n_chars"].dataType)) if "n_chars" in docs.columns else out


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that overlap with the benchmark."""
    return without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the mix takes, with size, source_size, target and taken (words, repeats counted)."""
    return mixed(docs).where("taken > 0")


STAGES = [("language_id", language_id), ("ngram_jaccard_join", near_duplicates), ("substring_dedup", substring_dedup), ("benchmark_decontamination", decontamination), ("mixing", mixing)]

#: MinHash classes, wrappers of hashed words and vectors are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows. A stage's intermediate tables, and its input if a stage wrote it, go once its output is written."""
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), []
    for name, stage in STAGES:
        path = new_path(spark, f"stage-{name}")
        with scratch() as made:
            stage(spark, docs, sf_dir).write.parquet(path)
        removed(spark, made + before)
        docs, before = spark.read.parquet(path), [path]
    return docs
