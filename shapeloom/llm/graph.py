"""Connected components by minimum labels with pointer jumping; every round is a written table."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .store import removed, written

#: Rows of one key beyond which the key's facts are broadcast. There are at most as many such keys as rows / HOT.
HOT = 100_000


def _facts(rows: DataFrame, facts: DataFrame, key: str, hot: list, how: str = "inner") -> DataFrame:
    """rows joined with facts (one row a key); rows of hot keys stay where they are."""
    if not hot:
        return rows.join(facts, key, how)
    keys = F.broadcast(rows.sparkSession.createDataFrame([(h,) for h in hot], rows.select(key).schema))
    calm = rows.join(keys, key, "left_anti").join(facts, key, how)
    return calm.unionByName(rows.join(F.broadcast(facts.join(keys, key)), key))


def components(edges: DataFrame, made: list[str] | None = None) -> DataFrame:
    """(v, label): label is the smallest node of v's component. edges: (a, b), any order, repeated or not; nulls and loops add nothing. The result is a written table, listed in made if that is given; those of earlier rounds are removed."""
    spark = edges.sparkSession
    own: list[str] = []
    both = edges.where("a is not null and b is not null and a <> b")
    both = written(both.unionByName(both.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges", own)
    hubs = [r.b for r in both.groupBy("b").count().where(F.col("count") > HOT).collect()]
    # one row: whether a label moved, and the labels that many nodes have
    state = lambda t: t.groupBy("label").agg(F.max("moved").alias("moved"), F.count(F.lit(1)).alias("n")).agg(F.max("moved").alias("moved"), F.collect_list(F.when(F.col("n") > HOT, F.col("label"))).alias("hot")).first()
    last: list[str] = []
    label = written(both.groupBy(F.col("a").alias("v")).agg(F.min("b").alias("m")).select("v", F.least("v", "m").alias("label")), "labels", last)
    hot = state(label.withColumn("moved", F.lit(True))).hot
    while True:
        near = _facts(both, label.select(F.col("v").alias("b"), F.col("label").alias("m")), "b", hubs).groupBy(F.col("a").alias("v")).agg(F.min("m").alias("m"))
        # a label is itself a node whose own label may be smaller by now
        jump = label.select(F.col("v").alias("label"), F.col("label").alias("up"))
        low = _facts(label, jump, "label", hot).join(near, "v")
        now: list[str] = []
        new = written(low.select("v", F.least("label", "up", "m").alias("new"), "label").select("v", F.col("new").alias("label"), (F.col("new") != F.col("label")).alias("moved")), "labels", now)
        removed(spark, last)
        is_ = state(new)
        label, last, hot = new.select("v", "label"), now, is_.hot
        if not is_.moved:
            removed(spark, own)
            if made is not None:
                made += last
            return label
