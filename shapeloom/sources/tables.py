"""Tables as CSV, summaries and lists as JSON, settings as YAML.

Parquet is the form between stages; these are for people and other programs. One file each: rows are few (a shape or
less each), and readers expect a single file.
"""

from __future__ import annotations

import dataclasses
import json
import uuid
from typing import Any

from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType, StructField, StructType


def _place(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path if "://" in path or path.startswith("file:") else f"file://{path}")


def write_text(path: str, text: str) -> None:
    """A file that appears whole, by a rename."""
    store, where = _place(path)
    store.create_dir(where.rsplit("/", 1)[0], recursive=True)
    part = f"{where}.{uuid.uuid4().hex}"
    with store.open_output_stream(part, compression=None) as f:
        f.write(text.encode())
    store.move(part, where)


def read_text(path: str) -> str:
    store, where = _place(path)
    with store.open_input_stream(where, compression=None) as f:
        return f.read().decode()


def exists(spark: SparkSession, path: str) -> bool:
    """Whether something stands there, wherever Spark itself would read it."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where)


def write_csv(rows: DataFrame, path: str, fields: list[str], order: list[str] = ()) -> None:
    """A folder with one CSV file: the fields in this order under a header, null as blank, flags as 0 and 1, rows in order; columns that are not fields are left out."""
    out = rows.select(*[F.col(c).cast("int").alias(c) if isinstance(rows.schema[c].dataType, BooleanType) else F.col(c) for c in fields])
    out = out.orderBy(*order) if order else out
    out.coalesce(1).write.mode("overwrite").option("header", True).option("escape", "\"").option("nullValue", "").option("emptyValue", "").csv(path)


def read_csv(spark: SparkSession, path: str, schema: StructType | str | None = None) -> DataFrame:
    """A CSV with a header by the names of its columns: strings, or the given types, where a blank or a value of another type is null. Columns that the file lacks are null."""
    raw = spark.read.option("header", True).option("escape", '"').option("nullValue", "").csv(path)
    if schema is None:
        return raw
    fields = (StructType.fromDDL(schema) if isinstance(schema, str) else schema).fields
    return raw.select(*[F.col(f"`{f.name}`").try_cast(f.dataType).alias(f.name) if f.name in raw.columns else F.lit(None).cast(f.dataType).alias(f.name) for f in fields])


def write_summary(row: DataFrame, path: str) -> None:
    """One row as a JSON object; arrays, structs and maps keep their form, null fields stay."""
    got = row.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(2).collect()
    if len(got) != 1:
        raise ValueError(f"a summary of {'no' if not got else 'more than one'} row")
    write_text(path, json.dumps(json.loads(got[0].j), indent=1))


def folders_of(split: DataFrame) -> DataFrame:
    """One row: train, val (sorted names) and by_folder, a map of such; from rows shape_id, folder, side. A split's names are listed whole, as its JSON form has them."""
    side = lambda s: F.sort_array(F.collect_list(F.when(F.col("side") == s, F.col("shape_id")))).alias(s)
    each = split.groupBy("folder").agg(side("train"), side("val"))
    return each.agg(F.sort_array(F.flatten(F.collect_list("train"))).alias("train"), F.sort_array(F.flatten(F.collect_list("val"))).alias("val"), F.map_from_entries(F.sort_array(F.collect_list(F.struct("folder", F.struct("train", "val"))))).alias("by_folder"))


def read_names(path: str, side: str = "val") -> list[str]:
    """Names from JSON: a bare list, or an object that has them under `side`."""
    got = json.loads(read_text(path))
    got = got.get(side) if isinstance(got, dict) else got
    if not isinstance(got, list):
        raise ValueError(f"{path}: neither a list nor an object with {side!r}")
    return [str(x) for x in got]


def read_bounds(spark: SparkSession, path: str) -> DataFrame:
    """One row low, high from JSON {min, max}."""
    got = json.loads(read_text(path))
    return spark.createDataFrame([([float(x) for x in got["min"]], [float(x) for x in got["max"]])], "low array<double>, high array<double>")


def write_bounds(bounds: DataFrame, path: str, note: str = "") -> None:
    r = bounds.select("low", "high").first()
    write_text(path, json.dumps({"min": list(r.low), "max": list(r.high), "note": note}, indent=1))


@dataclasses.dataclass(frozen=True)
class Settings:
    """Nested settings by name: settings.a.b. A missing name is an AttributeError that lists what there is."""

    values: dict

    def __getattr__(self, name: str) -> Any:
        values = object.__getattribute__(self, "values")
        if name not in values:
            raise AttributeError(f"no setting {name!r} among {', '.join(sorted(map(str, values)))}")
        return Settings(values[name]) if isinstance(values[name], dict) else values[name]


def read_settings(path: str) -> Settings:
    """Settings from YAML or JSON."""
    text = read_text(path)
    if path.lower().endswith(".json"):
        return Settings(json.loads(text))
    import yaml

    return Settings(yaml.safe_load(text) or {})


def resolved(path: str, base: str) -> str:
    """A path of a settings file: as it is if absolute or remote, else below the folder of that file."""
    return path if path.startswith("/") or "://" in path else f"{base.rsplit('/', 1)[0] if '/' in base else '.'}/{path}"


def first_given(*options: Any) -> Any:
    """The first that is not None: a flag before a network's own value before that of the data."""
    return next((x for x in options if x is not None), None)


def by_folder(spark: SparkSession, path: str) -> DataFrame:
    """A Parquet table that is partitioned by folder; folders stay text, also where they look like numbers."""
    schema = spark.read.parquet(path).schema
    return spark.read.schema(StructType([StructField(f.name, StringType()) if f.name == "folder" else f for f in schema])).parquet(path)


def refreshed(table: str, wanted: DataFrame, make, key: str = "shape_id", mark: str = "sha1", everything: bool = False) -> DataFrame:
    """Brings a table that is partitioned by folder up to date: rows of `wanted` (folder, key, mark, ...) that it lacks, or has under another mark, are made and written; the rest is not touched.

    make: DataFrame -> DataFrame of the rows to write, with folder, key and mark. Folders that hold a changed row are
    written anew with their other rows as they are, by dynamic partition overwrite; new rows of other folders are
    appended. Rows whose key is not wanted any more stay. With everything, or where the table has no marks, all is made anew. A folder's rows are written in one commit, so a run that fails
    leaves each folder old or new.
    """
    spark = wanted.sparkSession
    if everything or not exists(spark, table) or not {"folder", mark} <= set(spark.read.parquet(table).columns):
        make(wanted).write.mode("overwrite").option("partitionOverwriteMode", "static").partitionBy("folder").parquet(table)
        return by_folder(spark, table)
    have = by_folder(spark, table)
    same = (F.col(f"w.{key}") == F.col(f"h.{key}")) & (F.col("w.folder") == F.col("h.folder"))
    changed = wanted.alias("w").join(have.alias("h"), same & ~F.col(f"w.{mark}").eqNullSafe(F.col(f"h.{mark}")), "left_semi")
    places = changed.select("folder").distinct()
    if not changed.isEmpty():
        fresh = wanted.alias("w").join(have.alias("h"), same & F.col(f"w.{mark}").eqNullSafe(F.col(f"h.{mark}")), "left_anti").join(places, "folder", "left_semi")
        rest = have.join(places, "folder", "left_semi").join(changed.select("folder", key), ["folder", key], "left_anti")
        made = make(fresh)
        made.unionByName(rest.select(made.columns)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("folder").parquet(table)
        have = by_folder(spark, table)
    new = wanted.alias("w").join(have.alias("h"), same, "left_anti")
    if not new.isEmpty():
        make(new).write.mode("append").partitionBy("folder").parquet(table)
    return by_folder(spark, table)
