"""Training of the occupancy network: batches are drawn and differentiated in tasks, weights step on the driver.

A step is one job over the batch's shapes. What comes to the driver is one gradient (the size of the network) for each
partition; partitions are at most `tasks`, however many shapes there are.
"""

from __future__ import annotations

import json
import time
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sampling
from ..functions.backprop import AdamW, Pass, bce, gradients, learning_rate
from ..functions.network import Network
from ..functions.seeds import stable_seed
from ..sources import tables
from . import inference


def augmented(cloud: np.ndarray, positions: np.ndarray, rng: np.random.Generator, rotate: str = "yaw_tilt", scale: tuple[float, float] = (0.9, 1.1), keep: tuple[float, float] = (0.85, 1.0)) -> tuple[np.ndarray, np.ndarray]:
    """Cloud and positions under one random scale for each axis and one rotation; normals by the inverse scale, of unit length; then rows of the cloud dropped and drawn again."""
    s, r = rng.uniform(*scale, 3), sampling.rotation(rotate, rng)
    out = cloud.copy()
    out[:, :3] = (cloud[:, :3] * s) @ r.T
    if cloud.shape[1] >= 6:
        n = (cloud[:, 3:6] / s) @ r.T
        out[:, 3:6] = n / np.maximum(np.linalg.norm(n, axis=1, keepdims=True), 1e-12)
    return sampling.dropped_and_padded(out, *keep, rng), (positions * s) @ r.T


def drawn(row: dict, n: int, seed: str, near_share: float = 0.75, augment: bool = True, **how) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(cloud, positions, occ) of one shape for one step: n positions with replacement, round(n * near_share) (half to even) from the near ones that come first. The seed names the step and the shape, so batches do not depend on tasks."""
    rng = np.random.default_rng(stable_seed(f"{seed}/{row['shape_id']}"))
    cloud, positions, occ = np.asarray(row["points"], np.float64).reshape(-1, 6), np.asarray(row["query"], np.float64).reshape(-1, 3), np.asarray(row["occ"], np.float64)
    n_near, k = int(row["n_near"]), round(n * near_share)
    k = n if n_near == len(occ) else 0 if n_near == 0 else k
    at = np.concatenate([rng.integers(0, max(1, n_near), k), rng.integers(min(n_near, len(occ) - 1), len(occ), n - k)])
    positions, occ = positions[at], occ[at]
    if augment:
        cloud, positions = augmented(cloud, positions, rng, **how)
    return cloud, positions, occ


def order_of_epoch(shapes: DataFrame, size: int, epoch: int, seed: int) -> list[list]:
    """Batches of names in an order by hash; a short tail is dropped, unless it is all there is. Names alone come to the driver."""
    names = [r.shape_id for r in shapes.select("shape_id").orderBy(F.sha1(F.concat_ws("/", F.lit(f"{seed}/{epoch}"), F.col("shape_id").cast("string"))), "shape_id").collect()]
    whole = [names[k : k + size] for k in range(0, len(names) - size + 1, size)]
    return whole or ([names] if names else [])


def _summed(rows: DataFrame, held, seed: str, n: int, augment: bool, tasks: int) -> tuple[float, dict[str, np.ndarray], int]:
    """(sum of losses, sum of gradients, shapes) of one step, from one row a partition and weight."""

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        net, total, loss, count = held.value, {}, 0.0, 0
        for b in parts:
            for row in b.to_dict("records"):
                one, g = gradients(net, *drawn(row, n, seed, augment=augment))
                loss, count = loss + one, count + 1
                for k, v in g.items():
                    total[k] = total[k] + v if k in total else v
        if count:
            yield pd.DataFrame({"name": [*total, ""], "data": [*(v.ravel() for v in total.values()), np.array([loss, count])]})

    out: dict[str, np.ndarray] = {}
    for r in rows.coalesce(tasks).mapInPandas(run, "name string, data array<double>").toLocalIterator():
        out[r.name] = out[r.name] + np.array(r.data) if r.name in out else np.array(r.data)
    loss, count = out.pop("", np.zeros(2))
    return float(loss), {k: v.reshape(held.value.w[k].shape) for k, v in out.items()}, int(count)


def validated(rows: DataFrame, net: Network, n: int, batches: int, seed: int) -> tuple[float, float]:
    """(binary cross-entropy, accuracy) over fixed draws without augmentation, weighted by their number."""
    held = rows.sparkSession.sparkContext.broadcast(net)

    def run(parts: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in parts:
            out = []
            for row in b.to_dict("records"):
                for k in range(batches):
                    cloud, positions, occ = drawn(row, n, f"{seed + 1}/val/{k}", augment=False)
                    logits = Pass(held.value).logits(cloud, positions)[0]
                    out.append((bce(logits, occ) * len(occ), int(((logits > 0) == (occ > 0.5)).sum()), len(occ)))
            yield pd.DataFrame(out, columns=["loss", "right", "n"])

    r = rows.mapInPandas(run, "loss double, right long, n long").agg(F.sum("loss") / F.sum("n"), F.sum("right") / F.sum("n")).first()
    held.unpersist()
    return (float(r[0]), float(r[1])) if r[0] is not None else (float("nan"), float("nan"))


def train(spark: SparkSession, data: str, out: str, steps: int = 1000, batch: int = 32, n: int = 2048, every: int = 100, patience: int = 15, seed: int = 0, size: dict | None = None, base: float = 1e-3, warm: int = 300, augment: bool = True, smoke: int = 0, tasks: int = 64) -> dict:
    """Trains on the prepared tables below data and returns {steps, best, step_of_best}.

    Writes below out: config.json, last_run.txt, log (one row appended at each evaluation), best and last (networks, with the data's box if it has one).
    The best one changes where the validation loss falls by more than 1e-6, and training ends early after `patience`
    evaluations without that. smoke: train and validate on the first so many shapes by name only.
    """
    split = spark.read.parquet(f"{data}/split")
    rows = spark.read.parquet(f"{data}/clouds").where("error is null").select("shape_id", "points").join(spark.read.parquet(f"{data}/queries").where("error is null").select("shape_id", "query", "occ", "n_near"), "shape_id")
    if smoke:
        first = rows.select("shape_id").orderBy("shape_id").limit(smoke)
        fit = val = rows.join(F.broadcast(first), "shape_id", "left_semi")
    else:
        fit, val = (rows.join(split.where(F.col("side") == s).select("shape_id"), "shape_id", "left_semi") for s in ("train", "val"))
    fit, val = fit.persist(), val.persist()
    net, adam = Network.fresh(size or {}, seed), AdamW()
    box = spark.read.parquet(f"{data}/bounds").select("low", "high").first() if tables.exists(spark, f"{data}/bounds") else None
    config = {"data": data, "steps": steps, "batch": batch, "n": n, "every": every, "patience": patience, "seed": seed, "size": net.size, "base": base, "warm": warm, "augment": augment, "smoke": smoke}
    tables.write_text(f"{out}/config.json", json.dumps(config, indent=1))
    tables.write_text(f"{out}/last_run.txt", out)
    best, at, stale, step, epoch, began, seen = float("inf"), 0, 0, 0, 0, time.time(), []
    while step < steps and stale < patience:
        groups = order_of_epoch(fit, batch, epoch, seed)
        if not groups:
            raise ValueError("no shape to train on")
        epoch += 1
        for names in groups:
            if step >= steps or stale >= patience:
                break
            held = spark.sparkContext.broadcast(net)
            loss, g, count = _summed(fit.where(F.col("shape_id").isin(names)), held, f"{seed}/{step}", n, augment, tasks)
            held.destroy()
            rate = learning_rate(step, steps, base, warm=min(warm, steps))
            adam.step(net.w, {k: v / count for k, v in g.items()}, rate)
            seen.append(loss / count)
            step += 1
            if step % every == 0 or step == steps:
                value, right = validated(val, net, n, 1, seed)
                stale = 0 if value < best - 1e-6 else stale + 1
                if not stale:
                    best, at = value, step
                    inference.saved(spark, net, f"{out}/best", box)
                entry = (step, time.time() - began, rate, float(np.mean(seen)), value, right, best)
                spark.createDataFrame([entry], "step long, wall_s double, lr double, train_bce double, val_bce double, val_acc double, best_val_bce double").coalesce(1).write.mode("append").parquet(f"{out}/log")
                seen = []
    inference.saved(spark, net, f"{out}/last", box)
    fit.unpersist()
    val.unpersist()
    return {"steps": step, "best": best, "step_of_best": at}
