"""Queries against the same rows in DuckDB, and closed forms of the proxy solids."""

import math

import duckdb
import pandas as pd
import pytest

from shapeloom.functions.dialect import TABLES
from shapeloom.plans import catalog

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.sql(f"create view {t} as from '{SF}/{t}.parquet'")
    return con


def rows(df: pd.DataFrame):
    df = df[sorted(df.columns)]
    clean = lambda v: None if v is None or (not isinstance(v, str) and pd.isna(v)) else round(float(v), 5) + 0.0 if isinstance(v, (int, float)) or hasattr(v, "dtype") else v
    return sorted((tuple(map(clean, r)) for r in df.itertuples(index=False)), key=repr)


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query_equals_oracle(spark, duck, name):
    assert rows(catalog.queries()[name](spark, SF).toPandas()) == rows(duck.sql(catalog.oracle_sql()[name]).df())


def test_closed_boxes_have_euler_number_two_and_winding_zero_or_one(spark):
    euler = catalog.queries()["euler_number"](spark, SF).toPandas()
    assert (euler[euler.shape_id % 11 != 0].euler == 2).all() and (euler[euler.shape_id % 11 == 0].euler == 1).all()
    w = catalog.queries()["winding_number"](spark, SF).toPandas()
    assert (w[w.qid < 2].winding == 1).all() and (w[w.qid >= 2].winding.abs() < 1e-3).all()


def test_unknown_values_fail_gates_and_errors_stay_in_the_denominator(spark):
    got = catalog.queries()["gates_overall_and_folder"](spark, SF).toPandas().set_index(["scope", "gate"])
    n = spark.read.parquet(f"{SF}/lineitem.parquet").count()
    assert got.loc[("*", "watertight"), "n"] == n and got.loc[("*", "chamfer_l2_x1e3"), "n_missing"] > 0
    assert not math.isnan(got.loc[("*", "chamfer_l2_x1e3"), "value"])
