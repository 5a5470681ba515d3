"""Work in rounds on tables: each round's rows are written to a shared folder, which cuts lineage and outlives lost executors."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.mesh import least_linked


def folder(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir; where it is unset, a folder of the warehouse, which all machines share."""
    path = spark.conf.get("spark.checkpoint.dir", None)
    return path.rstrip("/") if path else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shapeloom-scratch"


#: Rows of a task before they are made into many; see dealt.
AT_ONCE = 10_000


def dealt(rows: DataFrame, key: str, at_once: int = AT_ONCE) -> DataFrame:
    """rows spread by the key, some at_once a task and a task a core at least: where much is derived from a narrow row, the bytes of a file say nothing of the work, and a row group is not divided."""
    return rows.repartition(max(rows.sparkSession.sparkContext.defaultParallelism, -(-rows.count() // at_once)), key)


def shuffled(df: DataFrame) -> DataFrame:
    """df, to be joined by shuffles. The planner takes a table for as large as its compressed files, and exploded rows for as many as there were before; it would broadcast both through the driver."""
    return df.hint("merge")


#: Rows of a table of one row a key that are sent to every task.
FEW_KEYS = 100_000


def lookup(table: DataFrame) -> DataFrame:
    """A written table of one row a key, to be joined by it: broadcast where its keys are few, so that a large key's rows stay spread."""
    return F.broadcast(table) if table.count() <= FEW_KEYS else table


class Tables:
    """Written tables of one computation; drop() removes them but those it is told to keep."""

    def __init__(self, spark: SparkSession):
        self.spark, self.paths = spark, []

    def kept(self, df: DataFrame) -> DataFrame:
        path = f"{folder(self.spark)}/round-{uuid.uuid4().hex}"
        df.write.option("compression", "zstd").parquet(path)
        self.paths.append(path)
        return shuffled(self.spark.read.schema(df.schema).parquet(path))

    def last(self, df: DataFrame) -> DataFrame:
        """df as a written table, when the others go."""
        out = self.kept(df)
        self.drop(1)
        return out

    def drop(self, but: int = 0) -> None:
        """Removes all tables but the last `but`."""
        conf = self.spark.sparkContext._jsc.hadoopConfiguration()
        for path in self.paths[: len(self.paths) - but]:
            where = self.spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
            where.getFileSystem(conf).delete(where, True)
        self.paths = self.paths[len(self.paths) - but :]


def same(a: str, b: str, keys: list[str]) -> Column:
    """Equal keys of two aliased tables."""
    out = F.lit(True)
    for k in keys:
        out = out & (F.col(f"{a}.{k}") == F.col(f"{b}.{k}"))
    return out


#: Nodes of a key that are labelled in one task; larger keys are spread and go in rounds.
IN_ONE_TASK = 10_000


def larger(rows: DataFrame, made: Tables, by: str) -> DataFrame | None:
    """The keys of more than IN_ONE_TASK rows as a written table; none where there are none."""
    large = made.kept(rows.groupBy(by).agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > IN_ONE_TASK).select(by))
    return None if large.isEmpty() else lookup(large)


def gathered(rows: DataFrame, by: str) -> DataFrame:
    """__key and e, its rows as an array of structs; where rows are dealt by the key already, nothing is shuffled."""
    return rows.groupBy(by).agg(F.collect_list(F.struct(*[c for c in rows.columns if c != by])).alias("e")).select(F.col(by).alias("__key"), "e")


def _labelled_at_once(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(key, pairs a, b; a node as a pair of itself) to (key, pairs v, label), all keys of a batch together."""
    for batch in batches:
        pairs = batch.column(1)
        a, b = (x.to_numpy(zero_copy_only=False) for x in pairs.flatten().flatten())
        key = np.repeat(np.arange(len(pairs)), np.diff(pairs.offsets.to_numpy()))
        # nodes of all keys in one order, by key and then by number
        names, at = np.unique(np.concatenate([a, b]), return_inverse=True)
        a, b = key * len(names) + at[: len(a)], key * len(names) + at[len(a) :]
        nodes = np.unique(a[a == b])
        known = (a != b) & np.isin(a, nodes) & np.isin(b, nodes)
        a, b = (np.searchsorted(nodes, x[known]) for x in (a, b))
        label = least_linked(len(nodes), a, b)
        held = np.bincount(nodes // max(1, len(names)), minlength=len(pairs))
        out = pa.StructArray.from_arrays([pa.array(names[x % max(1, len(names))]) for x in (nodes, nodes[label])], ["v", "label"])
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.ListArray.from_arrays(pa.array(np.concatenate([[0], held.cumsum()]), pa.int32()), out)], ["k", "e"])


def components(nodes: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """by, v, label: the least node of each node's component. nodes: by, v; links: by, a, b (any order, repeated or not; both ends are nodes).

    Keys of IN_ONE_TASK nodes or fewer are gathered once and labelled where they are; whole numbers only. The others are
    spread over tasks and go in rounds. Null keys have no component. The result is a written table.
    """
    spark, made = nodes.sparkSession, Tables(nodes.sparkSession)
    nodes, links = nodes.where(F.col(by).isNotNull() & F.col("v").isNotNull()).select(by, "v"), links.where(F.col(by).isNotNull() & (F.col("a") != F.col("b"))).select(by, "a", "b")
    of = nodes.schema["v"].dataType
    if not isinstance(of, T.IntegralType):
        return _in_rounds(nodes, links, by)
    large = made.kept(nodes.groupBy(by).count().where(F.col("count") > IN_ONE_TASK).select(by))
    some = not large.isEmpty()
    less = lambda d, how: d.join(lookup(large), by, how) if some else d
    pairs = less(nodes, "left_anti").select(by, F.col("v").alias("a"), F.col("v").alias("b")).unionByName(less(links, "left_anti"))
    packed = pairs.groupBy(by).agg(F.collect_list(F.struct(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b"))).alias("e")).select(F.col(by).alias("k"), "e")
    schema = T.StructType([T.StructField("k", packed.schema["k"].dataType), *T.StructType.fromDDL("e array<struct<v: bigint, label: bigint>>").fields])
    out = packed.mapInArrow(_labelled_at_once, schema).select(F.col("k").alias(by), F.explode("e").alias("e")).select(by, F.col("e.v").cast(of).alias("v"), F.col("e.label").cast(of).alias("label"))
    if some:
        out = out.unionByName(_in_rounds(less(nodes, "left_semi"), less(links, "left_semi"), by))
    return made.last(out)


def _in_rounds(nodes: DataFrame, links: DataFrame, by: str) -> DataFrame:
    """As components, for keys of any size.

    Each round a node takes the least label among its own, its neighbours' and its label's own, and the node that its
    label names takes the least that any member has found; it ends when none has changed.
    """
    spark = nodes.sparkSession
    fixed, state = Tables(spark), Tables(spark)
    both = fixed.kept(links.unionByName(links.select(by, F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    near = both.groupBy(by, "a").agg(F.min("b").alias("m"))
    start = nodes.distinct().alias("n")
    label = start.join(near.alias("m"), (F.col(f"n.{by}") == F.col(f"m.{by}")) & (F.col("n.v") == F.col("m.a")), "left")
    label = state.kept(label.select(F.col(f"n.{by}").alias(by), "v", F.least("v", "m").alias("label")))
    while True:
        step = both.alias("e").join(label.alias("l"), (F.col(f"e.{by}") == F.col(f"l.{by}")) & (F.col("e.b") == F.col("l.v")))
        step = step.groupBy(F.col(f"e.{by}").alias(by), F.col("e.a").alias("v")).agg(F.min("label").alias("m"))
        up = label.alias("l").join(label.alias("u"), (F.col(f"l.{by}") == F.col(f"u.{by}")) & (F.col("l.label") == F.col("u.v")))
        up = up.select(F.col(f"l.{by}").alias(by), F.col("l.v").alias("v"), F.col("l.label").alias("label"), F.col("u.label").alias("up"))
        now = up.alias("p").join(step.alias("s"), same("p", "s", [by, "v"]), "left")
        now = now.select(F.col(f"p.{by}").alias(by), F.col("p.v").alias("v"), F.least("label", "up", "m").alias("new"), "label")
        # what a member has found goes to the node that its label names, so whole trees move at once
        told = now.where("new < label").groupBy(by, "label").agg(F.min("new").alias("told"))
        now = now.alias("p").join(told.alias("t"), (F.col(f"p.{by}") == F.col(f"t.{by}")) & (F.col("p.v") == F.col("t.label")), "left")
        now = state.kept(now.select(F.col(f"p.{by}").alias(by), F.col("p.v").alias("v"), F.least("new", "told").alias("new"), F.col("p.label").alias("label")))
        state.drop(1)
        moved = not now.where("new <> label").isEmpty()
        label = now.select(by, "v", F.col("new").alias("label"))
        if not moved:
            fixed.drop()
            return label
