"""The mix against its SQL, with odd rows, low weights, ties at the budget's end, and many sources."""

import duckdb
import pandas as pd
import pytest
from pyspark.sql import functions as F
from shapeloom.llm import mixing, registry

SF = "/root/testdata/sf0.001"


def same(spark, path, **how):
    got = mixing.mixed(spark.read.parquet(f"{path}/documents.parquet"), **how).select("doc_id", "size", "source_size", "target", "taken").toPandas()
    con = duckdb.connect()
    con.sql(f"create view documents as from read_parquet('{path}/documents.parquet{'/*.parquet' if path != SF else ''}')")
    want = con.sql(registry.oracle_sql()["op7_mixing"]).df()
    key = lambda d: sorted((-1 if pd.isna(r.doc_id) else int(r.doc_id), int(r.size), int(r.source_size), round(r.target, 6), int(r.taken)) for r in d.rename(columns={"size": "size"}).itertuples(index=False))
    assert key(got) == key(want)
    return got


@pytest.mark.parametrize("sources", [50_000, 0])
def test_equals_sql(spark, monkeypatch, sources):
    monkeypatch.setattr(mixing, "BROADCAST_SOURCES", sources)
    got = same(spark, SF)
    assert abs(got.taken.sum() - 1.5 * got["size"].sum()) < 50


def test_ties_low_weights_and_odd_rows(spark, tmp_path):
    rows = [(1, "one two three", "a")] * 9 + [(k, "#" * 30 + f" x{k} 123 A", "b") for k in range(40)] + [(None, None, None), (None, "w " * 50, None), (7, "", "c"), (8, "z", "d"), (8, "z", "d")]
    spark.createDataFrame(rows, "doc_id long, text string, source string").write.parquet(f"{tmp_path}/documents.parquet")
    same(spark, str(tmp_path))


def test_carried_columns(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").withColumn("size", F.lit("x"))
    out = mixing.mixed(docs)
    assert out.columns == ["doc_id", "text", "lang", "source", "n_chars", "size", "source_size", "target", "taken"] and out.count() == docs.count()
