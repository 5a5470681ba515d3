"""Folds over a whole log, worked out in ranges whose effect is a small map."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .rounds import Tables


def _records(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(places, values, next) of the strict prefix minima; next is the first record lower by more than `least`, or their number.

    Whatever the best before a range, the first entry that improves on it is a record, and so are all that follow.
    """
    v = np.where(np.isnan(values), np.inf, values)
    before = np.concatenate([[np.inf], np.minimum.accumulate(v)[:-1]]) if len(v) else v
    at = np.flatnonzero(v < before)
    rec = v[at]
    return at, rec, np.searchsorted(-rec, -(rec - least), "right")


def range_map(values: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(lowest, best, stale) of a range: a best b before it becomes the first best whose lowest < b - least, stale entries before the end; where there is none, b stays. Records that end alike are one row."""
    at, rec, following = _records(values, least)
    m = len(rec)
    end = np.append(following, m)
    last = np.arange(m + 1)
    last[:m] = np.where(following < m, following, last[:m])
    while not np.array_equal(last[last], last):
        last = last[last]
    last = last[:m]
    keep = np.flatnonzero(np.append(last[1:] != last[:-1], True)) if m else end[:0]
    return rec[keep], rec[last[keep]], len(values) - 1 - at[last[keep]]


def folded(values: np.ndarray, least: float, best: float, stale: int) -> tuple[np.ndarray, np.ndarray]:
    """(best, stale) after every entry of a range, from those before it."""
    at, rec, following = _records(values, least)
    k, changes = int(np.searchsorted(-rec, -(best - least), "right")), []
    while k < len(rec):
        changes.append(k)
        k = int(following[k])
    place = np.arange(len(values))
    since = np.searchsorted(at[changes], place, "right") if changes else np.zeros(len(values), np.int64)
    bests = np.concatenate([[best], rec[changes]])[since]
    starts = np.concatenate([[-1 - stale], at[changes]])[since]
    return bests, (place - starts).astype(np.int64)


def running_best(log: DataFrame, step: str = "step", value: str = "val_bce", least: float = 1e-6, patience: int = 10, by: str = "run", parts: int = 0) -> DataFrame:
    """run, step, value, best, stale, stopped of each entry: the best value changes only where one is lower by more than `least` (0 or more); stale counts entries since; stopped where stale reaches the patience.

    The log is cut into ranges of (run, step). What a range does to the best before it is a map of few rows (at most the
    entries of the range within `least` of its lowest, one an outcome); a run's maps are applied in turn, one row set a
    range, and every range is then folded from its own start. So one long run is not one task. Equal steps are taken by
    value; unknown values (null, NaN) never improve; rows with a null step come first, null runs are one run. The result is a written table.
    """
    spark = log.sparkSession
    made = Tables(spark)
    x = log.select(F.col(by).alias("run"), F.col(step).cast("long").alias("step"), F.coalesce(F.col(value).cast("double"), F.lit(float("nan"))).alias("value"))
    x = made.kept(x.repartitionByRange(parts or int(spark.conf.get("spark.sql.shuffle.partitions")), "run", "step").withColumn("part", F.spark_partition_id()))
    kind = x.schema["run"].dataType.simpleString()

    def ordered(pdf: pd.DataFrame) -> pd.DataFrame:
        return pdf.sort_values(["step", "value"], kind="stable", na_position="first")

    def mapped(pdf: pd.DataFrame) -> pd.DataFrame:
        low, best, stale = range_map(ordered(pdf)["value"].to_numpy(float), least)
        # the last row stands for no change
        return pd.DataFrame({"run": [pdf["run"].iloc[0]] * (len(low) + 1), "part": pdf["part"].iloc[0], "low": [*low, np.nan], "best": [*best, np.nan], "stale": [*stale, len(pdf)]})

    def started(pdf: pd.DataFrame) -> pd.DataFrame:
        best, stale, rows = np.inf, 0, []
        for part, m in pdf.sort_values("part", kind="stable").groupby("part", sort=True):
            rows.append((pdf["run"].iloc[0], part, best, stale))
            hit = m[m["low"] < best - least].sort_values("low", ascending=False)
            best, stale = (hit["best"].iloc[0], int(hit["stale"].iloc[0])) if len(hit) else (best, stale + int(m.loc[m["low"].isna(), "stale"].iloc[0]))
        return pd.DataFrame(rows, columns=["run", "part", "best", "stale"])

    def finished(pdf: pd.DataFrame, start: pd.DataFrame) -> pd.DataFrame:
        pdf = ordered(pdf)
        best, stale = folded(pdf["value"].to_numpy(float), least, float(start["best"].iloc[0]), int(start["stale"].iloc[0]))
        return pdf[["run", "step", "value"]].assign(best=best, stale=stale, stopped=stale >= patience)

    maps = made.kept(x.groupBy("run", "part").applyInPandas(mapped, f"run {kind}, part int, low double, best double, stale long"))
    starts = made.kept(maps.groupBy("run").applyInPandas(started, f"run {kind}, part int, best double, stale long"))
    out = x.groupBy("run", "part").cogroup(starts.groupBy("run", "part")).applyInPandas(finished, f"run {kind}, step long, value double, best double, stale long, stopped boolean")
    return made.last(out)
