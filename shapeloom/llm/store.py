"""Intermediate tables in the shared folder of spark.checkpoint.dir: they cut lineage and outlive a lost executor."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


def bounded(spark: SparkSession) -> None:
    """Arrow batches of bounded bytes, whatever the texts' lengths. The session keeps these bounds, as its later queries are lazy; no setting is loosened."""
    for key, most in (("spark.sql.execution.arrow.maxRecordsPerBatch", 2000), ("spark.sql.execution.arrow.maxBytesPerBatch", 8 << 20)):
        try:
            now = int(spark.conf.get(key).removesuffix("b"))
        except Exception as e:  # a version of Spark without the setting, or a value with a unit
            if "SQL_CONF_NOT_FOUND" in str(e):
                continue
            now = 0
        if now <= 0 or now > most:
            spark.conf.set(key, most)


def shared_dir(spark: SparkSession) -> str:
    """The session's spark.checkpoint.dir. Where it is unset: a folder of the warehouse, which all machines share, or on a single machine (master local) a temporary one."""
    bounded(spark)
    path = spark.conf.get("spark.checkpoint.dir", None)
    if not path:
        local = spark.sparkContext.master.startswith("local") and not spark.sparkContext.master.startswith("local-cluster")
        path = "file://" + tempfile.mkdtemp(prefix="shapeloom-") if local else f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/shapeloom-scratch"
        spark.conf.set("spark.checkpoint.dir", path)
    return path.rstrip("/")


_scratch: list[list[str]] = []


@contextlib.contextmanager
def scratch():
    """A list of all paths that are given out inside, so that a caller who has written its result can remove them."""
    made: list[str] = []
    _scratch.append(made)
    try:
        yield made
    finally:
        _scratch[:] = [x for x in _scratch if x is not made]


def new_path(spark: SparkSession, name: str) -> str:
    path = f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"
    for made in _scratch:
        made.append(path)
    return path


def written(df: DataFrame, name: str, made: list[str] | None = None) -> DataFrame:
    """The same rows, read from a table that was written just now; its path is added to made."""
    path = new_path(df.sparkSession, name)
    df.write.option("compression", "zstd").parquet(path)
    if made is not None:
        made.append(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def removed(spark: SparkSession, made: list[str]) -> None:
    """Deletes tables that nothing reads any more, wherever they are stored."""
    conf = spark.sparkContext._jsc.hadoopConfiguration()
    for path in made:
        where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
        where.getFileSystem(conf).delete(where, True)
    made.clear()
