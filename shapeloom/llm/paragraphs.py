"""Removal of passages that repeat across documents: alike paragraphs (MinHash bands, exact Jaccard, components), then equal windows of words wherever they begin."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .passages import repeated_passages, with_cuts, without_passages
from .similar import Similarity, by_set, classes
from .store import written

#: 8 bands of 3: two paragraphs at similarity 0.8 meet with probability 0.997, at 0.9 with 0.99999.
PRODUCTION = Similarity(bands=8, rows=3, step=8)
#: Words of the shortest paragraph that counts; headers and one-line notices are shorter.
MIN_WORDS = 20


def repeated_paragraphs(docs: DataFrame, min_words: int = MIN_WORDS, p: Similarity = PRODUCTION) -> DataFrame:
    """Every paragraph (line of at least min_words words) that is alike to another one.

    doc_id, text_key, pos (line, from 0), n_words, class_doc, class_pos (the class's first paragraph by doc_id, then
    text, then line: it stays), removed. Null and empty texts have no paragraphs; rows repeated with one doc_id and
    text share their positions and are kept or cut alike; a null doc_id sorts last. Other columns are ignored.
    """
    words = F.size(F.filter(F.split("text", r"[\x20\x09-\x0D]+"), lambda w: w != ""))
    lines = docs.select("doc_id", F.xxhash64("text").alias("text_key"), F.posexplode(F.split("text", "\n")).alias("pos", "text"))
    lines = lines.select("*", words.cast("long").alias("n_words")).where(F.col("n_words") >= min_words)
    t, nodes = classes(lines, p, ["doc_id", "text_key", "pos"])
    whole = nodes.groupBy("label").agg(F.min("least").alias("first"), F.sum("copies").alias("n")).where("n > 1")
    facts = nodes.join(whole, "label").select(F.col("fp").alias("__fp"), *[F.col(f"first.{c}").alias(f"class_{c}") for c in ("doc_id", "text_key", "pos")])
    found = by_set(t.drop("text", "__sig"), facts, p).where("class_pos is not null")
    same = F.col("doc_id").eqNullSafe(F.col("class_doc_id")) & (F.col("text_key") == F.col("class_text_key")) & (F.col("pos") == F.col("class_pos"))
    return found.select("doc_id", "text_key", "pos", "n_words", F.col("class_doc_id").alias("class_doc"), "class_pos", (~same).alias("removed"))


def without_repeats(docs: DataFrame, **how) -> DataFrame:
    """docs with the removed paragraphs cut from text, then the removed passages of what is left, so that one of each stays; a document that loses all its words goes, others keep all else as it was. Columns and other values stay."""
    cut = repeated_paragraphs(docs, **how).where("removed").groupBy("doc_id", "text_key").agg(F.collect_set("pos").alias("__cut"))
    x = with_cuts(docs, cut.select(F.col("doc_id").alias("__doc"), F.col("text_key").alias("__key"), "__cut"), "__cut")
    left = F.array_join(F.filter(F.transform(F.split("text", "\n"), lambda s, i: F.when(F.array_contains("__cut", i), F.lit(None)).otherwise(s)), lambda s: s.isNotNull()), "\n")
    x = x.withColumn("text", F.when(F.col("__cut").isNull(), F.col("text")).otherwise(left))
    return without_passages(written(x.where(F.col("__cut").isNull() | F.col("text").rlike(r"[^\x20\x09-\x0D]")).select(*[F.col(f"`{c}`") for c in docs.columns]), "paragraphs"))


def op9_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alike lines (pos, class_pos) and equal passages (first_word, class_word), both of the documents as they are."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    common, none = ["n_words", "class_doc", "removed"], F.lit(None).cast("long")
    lines = repeated_paragraphs(docs).select("doc_id", "pos", *common, "class_pos", none.alias("first_word"), none.alias("class_word"))
    passages = repeated_passages(docs).select("doc_id", F.lit(None).cast("int").alias("pos"), *common, F.lit(None).cast("int").alias("class_pos"), "first_word", "class_word")
    return lines.unionByName(passages).select("doc_id", "pos", "n_words", "class_doc", "class_pos", "removed", "first_word", "class_word")
