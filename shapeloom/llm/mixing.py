"""Mixing sources to target weights: Efraimidis-Spirakis keys, prefix sums to word budgets, complete epochs first."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .store import written

#: Weights of the sources in their order, repeating.
WEIGHTS = (3, 1, 2)
SHARE = 1.5
MOST = 2.0
#: Rows of a plan (some 100 bytes each) up to which it is broadcast; beyond, the join shuffles.
BROADCAST_SOURCES = 50_000
#: Levels of 4,096 parts each by which a source's keys are searched for the place where its budget ends.
LEVELS = 4


def n_words(text: Column) -> Column:
    """Words [^\\x20\\x09-\\x0D]+ of a text; 0 for null."""
    return F.coalesce(F.regexp_count(text, F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")


def quality(text: Column) -> Column:
    """The default weight of a document, from 0.1 to 1: the share of its characters that are not symbols, digits or capitals."""
    n = F.length(F.coalesce(text, F.lit("")))
    marked = F.coalesce(F.regexp_count(text, F.lit(r"[#*$%&|<>!0-9A-Z]")), F.lit(0))
    return F.when(n == 0, F.lit(0.1)).otherwise(F.greatest(F.lit(0.1), (n - marked) / n))


def targets(sizes: DataFrame, share: float = SHARE, most: float = MOST, weights=WEIGHTS) -> DataFrame:
    """source, source_size, target from (source, source_size).

    Water filling in closed form: with sources in order of cap/weight, those whose cap lies below the level that the
    rest of the mix would reach are full, and the others share what is left by weight. One row per source.
    """
    w = sizes.withColumn("rn", F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())))
    w = w.select("source", "source_size", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.col("rn") - 1, F.lit(len(weights))) + 1).cast("int")).alias("w"), "rn")
    w = w.withColumn("cap", F.col("source_size") * F.lit(most))
    up = Window.orderBy(F.col("cap") / F.col("w"), "rn")
    whole = Window.partitionBy()
    w = w.select("*", F.coalesce(F.sum("cap").over(up.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0)).alias("full"), F.sum("w").over(up.rowsBetween(0, Window.unboundedFollowing)).alias("open_w"), (F.sum("source_size").over(whole) * F.lit(share)).alias("total"))
    # at the first source that does not fill, this is the level
    w = w.withColumn("level", F.when(F.col("cap") * F.col("open_w") > F.col("w") * (F.col("total") - F.col("full")), (F.col("total") - F.col("full")) / F.col("open_w")))
    # later ones, that count earlier open sources as full, get lower values
    w = w.withColumn("level", F.max("level").over(whole))
    return w.select("source", F.col("source_size").cast("long").alias("source_size"), F.coalesce(F.least("cap", F.col("w") * F.col("level")), "cap").alias("target"))


def _with(rows: DataFrame, plan: DataFrame, few: bool) -> DataFrame:
    """rows(source, __h, ...) joined with plan(__source, ...): by broadcast of few sources, else with rows of a source spread by salts."""
    on = F.col("source").eqNullSafe(F.col("__source"))
    if few:
        return rows.join(F.broadcast(plan), on)
    plan = plan.withColumn("__salt", F.explode(F.sequence(F.lit(0), F.lit(31))))
    return rows.join(plan, on & (F.pmod(F.xxhash64("__h"), F.lit(32)) == F.col("__salt"))).drop("__salt")


def mixed(docs: DataFrame, weight=quality, seed: str = "mix", carry: list[str] | None = None, **shares) -> DataFrame:
    """docs (of them the columns of carry, if given) with size, source_size, target and taken.

    Each source gives floor(target / source_size) complete epochs; of the rest, documents are taken whole in order of
    the key -ln(u) / weight (u from a hash of id and text) until the budget is used up, the last one in part, by its
    first words. Rows of one id and text have one key: where the budget ends at them, they share what is left evenly
    (rounded down). A null text has size 0; an empty source gets target 0. Existing columns of these names are
    replaced.

    Where a budget ends is searched by sums over 4,096 parts of the key's range, then over 4,096 parts of that part and
    so on, so a task holds the sums of a source's parts and never its documents, whatever their number and weights.
    """
    names = ("size", "source_size", "target", "taken")
    kept = [c for c in (docs.columns if carry is None else carry) if c not in names]
    h = F.md5(F.concat_ws("\x01", F.lit(seed), F.coalesce(F.col("doc_id").cast("string"), F.lit("")), F.md5(F.coalesce("text", F.lit("")))).cast("binary"))
    u = (F.conv(F.substring("__h", 1, 13), 16, 10).cast("double") + 0.5) / float(1 << 52)
    x = docs.select(*[F.col(f"`{c}`") for c in kept], *([] if "source" in kept else ["source"]), n_words(F.col("text")).alias("size"), weight(F.col("text")).alias("__w"), h.alias("__h"))
    x = x.withColumn("__key", -F.log(u) / F.col("__w"))
    # 1 - exp(-key) rises with the key, so whole numbers of it keep the order, but for ties that the key breaks
    place = F.least(F.floor(-F.expm1(-F.col("__key")) * float(1 << 48)), F.lit((1 << 48) - 1)).cast("long")
    x = written(x.withColumn("__place", place).drop("__w"), "keyed")
    narrow = x.select("source", "size", "__place", "__key", "__h")
    plan = targets(narrow.groupBy("source").agg(F.sum("size").alias("source_size")), **shares)
    plan = plan.withColumn("epochs", F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long"))
    plan = plan.withColumn("left", F.floor(F.col("target") - F.col("epochs") * F.col("source_size") + 0.5).cast("long"))
    plan = written(plan.withColumnRenamed("source", "__source").withColumn("whole", F.col("left") >= F.col("source_size")), "plan")
    few = plan.count() <= BROADCAST_SOURCES
    # edge: of each source the part of its keys in which the budget ends (low), and what is left of it there
    edge = plan.where(~F.col("whole")).select("__source", F.lit(0).cast("long").alias("low"), "left")
    for level in range(LEVELS):
        shift = 36 - 12 * level
        here = _with(narrow.select("source", "size", "__place", *([] if few else ["__h"])), edge, few).where(F.shiftright("__place", shift + 12) == F.col("low"))
        sums = here.groupBy("__source", "low", "left", F.shiftright("__place", shift).alias("part")).agg(F.sum("size").alias("n"))
        before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        sums = sums.withColumn("before", before).where("before <= left and left < before + n")
        edge = written(sums.groupBy("__source").agg(F.max("part").alias("low"), F.max(F.col("left") - F.col("before")).alias("left")), "edge")
    # keys that agree in 48 bits are few; they are told apart by key and hash
    last = _with(narrow, edge, few).where(F.col("__place") == F.col("low")).groupBy("__source", "left", "__key", "__h").agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("rows"))
    before = F.coalesce(F.sum("n").over(Window.partitionBy("__source").orderBy("__key", "__h").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    last = last.withColumn("before", before).where("before <= left and left < before + n")
    last = last.groupBy("__source").agg(F.max(F.struct("__key", "__h")).alias("at"), F.max(F.floor((F.col("left") - F.col("before")) / F.col("rows"))).cast("long").alias("rest"))
    plan = plan.join(last, plan["__source"].eqNullSafe(last["__source"]), "left").select(plan["__source"], "source_size", "target", "epochs", "whole", "at", "rest")
    x = _with(x, written(plan, "ends"), few)
    mine = F.struct("__key", "__h")
    part = F.when(F.col("whole") | (mine < F.col("at")), F.col("size")).when(mine == F.col("at"), F.least("size", "rest")).otherwise(0)
    return x.select(*[F.col(f"`{c}`") for c in kept], "size", "source_size", "target", (F.col("epochs") * F.col("size") + part).cast("long").alias("taken"))


def op7_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    return mixed(docs, carry=["doc_id"]).select("doc_id", "size", "source_size", "target", "taken")
