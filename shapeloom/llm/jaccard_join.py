"""N-gram Jaccard join of documents with Bayesian candidate pruning."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .similar import Similarity, by_set, classes

PRODUCTION = Similarity()


def near_classes(docs: DataFrame, p: Similarity = PRODUCTION) -> DataFrame:
    """doc_id, class_id, n_links for every row of docs(doc_id, text, ...).

    class_id is the least doc_id of the row's component under links of similarity >= threshold; n_links counts the
    other rows that are similar to it, copies included. A row without words links to nothing and is its own class.
    Repeated rows are copies. A null doc_id takes part; its class_id is null only if no row of the class has an id.
    Other columns are ignored; an empty table gives an empty result.
    """
    t, nodes = classes(docs.select("doc_id", "text"), p, ["doc_id"])
    # a row that is alone in its class needs no facts
    size = nodes.groupBy("label").agg(F.min(F.col("least.doc_id")).alias("class_id"), F.sum("copies").alias("n")).where("n > 1")
    known = nodes.join(size, "label").select(F.col("fp").alias("__fp"), "class_id", (F.col("links") + F.col("copies") - 1).alias("n_links"))
    out = by_set(t.select("doc_id", "__row", "__fp"), known, p)
    return out.select("doc_id", F.when(F.col("n_links").isNull(), F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"))


def one_of_each(docs: DataFrame, p: Similarity = PRODUCTION) -> DataFrame:
    """docs with one row of each class: the least doc_id (nulls last); of equal ones any. Rows without words are classes of their own and all stay."""
    t, nodes = classes(docs, p, ["doc_id"])
    size = nodes.groupBy("label").agg(F.min("least").alias("first"), F.sum("copies").alias("n")).where("n > 1")
    keep = nodes.join(size, "label").select(F.col("fp").alias("__fp"), F.col("first.row").alias("__keep"))
    return by_set(t, keep, p).where("__keep is null or __keep = __row").select(*[F.col(f"`{c}`") for c in docs.columns])


def op4_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_classes(spark.read.parquet(f"{sf_dir}/documents.parquet"))
