"""Gradients against differences, the schedule, the optimizer's step, augmentation, and a short run."""

import json

import numpy as np
import pytest

from shapeloom.cli import main
from shapeloom.functions import backprop, levelset
from shapeloom.functions.network import Network
from shapeloom.operators import inference, training
from shapeloom.sources.shapes import encode_stl

SIZE = {"d_model": 8, "n_heads": 2, "n_layers": 1, "n_freq": 2, "n_centers": 5, "max_freq": 2, "mlp_ratio": 2}


def test_gradients_equal_differences():
    rng = np.random.default_rng(0)
    net = Network.fresh(SIZE, 1)
    net.w = {k: v + rng.normal(size=v.shape) * 0.1 for k, v in net.w.items()}
    cloud, positions, occ = rng.normal(size=(12, 6)), rng.normal(size=(9, 3)), (rng.random(9) > 0.5).astype(float)
    loss, g = backprop.gradients(net, cloud, positions, occ)
    value = lambda: backprop.bce(net.decode(net.encode(cloud), positions), occ)
    assert loss == pytest.approx(value(), abs=1e-9) and set(g) == set(net.w)
    for k, v in net.w.items():
        for _ in range(2):
            at = tuple(rng.integers(0, s) for s in v.shape)
            was, h = v[at], 1e-4
            v[at] = was + h
            up = value()
            v[at] = was - h
            down = value()
            v[at] = was
            assert g[k][at] == pytest.approx((up - down) / (2 * h), abs=2e-5), k


def test_schedule_and_step():
    rates = [backprop.learning_rate(k, 1000, warm=100, hold=200) for k in range(1001)]
    assert rates[0] == pytest.approx(1e-5) and rates[99] == rates[250] == 1e-3 and rates[1000] == pytest.approx(1e-5) and all(a >= b for a, b in zip(rates[300:], rates[301:]))
    w, adam = {"x": np.array([1.0, -1.0])}, backprop.AdamW(decay=0.1, clip=1.0)
    assert adam.step(w, {"x": np.array([30.0, -40.0])}, 0.01) == 50
    assert np.allclose(w["x"], [1 - 0.001 - 0.01, -1 + 0.001 + 0.01])


def test_augmentation_moves_cloud_and_positions_together():
    rng = np.random.default_rng(5)
    p = rng.normal(size=(400, 3))
    p /= np.linalg.norm(p, axis=1, keepdims=True)
    cloud, moved = training.augmented(np.hstack([p, p]), p, rng, "so3", keep=(1.0, 1.0))
    assert {tuple(r) for r in np.round(cloud[:, :3], 9)} == {tuple(r) for r in np.round(moved, 9)}
    assert np.allclose(np.linalg.norm(cloud[:, 3:], axis=1), 1)
    # normals stay normal: neighbours on the moved surface lie in the plane
    for k in range(20):
        near = moved[((moved - cloud[k, :3]) ** 2).sum(1) < 0.02] - cloud[k, :3]
        assert np.abs(near @ cloud[k, 3:]).max() < 0.03


def test_a_short_run(spark, tmp_path):
    (tmp_path / "src" / "f").mkdir(parents=True)
    g = levelset.grid((-1,) * 3, (1,) * 3, 10)
    for k in range(3):
        v, f = levelset.surface((0.4 + k / 10 - np.linalg.norm(g, axis=1)).reshape(10, 10, 10), (-1,) * 3, (1,) * 3)
        (tmp_path / "src" / "f" / f"s{k}.stl").write_bytes(encode_stl(v, f))
    data, out = str(tmp_path / "data"), str(tmp_path / "run")
    assert main(["prepare", str(tmp_path / "src"), data, "--n-points", "40", "--n-queries", "200"], spark) == 0
    got = training.train(spark, data, out, steps=8, batch=2, n=64, every=4, size=SIZE, base=0.02, warm=2, augment=False, tasks=2)
    log = spark.read.parquet(f"{out}/log").orderBy("step").collect()
    assert got["steps"] == 8 and [r.step for r in log] == [4, 8] and log[1].best_val_bce == min(r.val_bce for r in log) == got["best"]
    assert log[1].train_bce < log[0].train_bce and json.loads((tmp_path / "run" / "config.json").read_text())["steps"] == 8
    assert inference.loaded(spark, f"{out}/last").n_parameters() == inference.loaded(spark, f"{out}/best").n_parameters()
    assert main(["train", data, str(tmp_path / "smoke"), "--steps", "2", "--smoke", "2", "--batch", "2", "--n", "16", "--smoke-bce", "0.0001", "--size", json.dumps(SIZE)], spark) == 1
    one, two = (training.drawn({"shape_id": "a", "points": np.zeros(12), "query": np.arange(30.0), "occ": np.arange(10), "n_near": 6}, 8, s, augment=False) for s in ("0/1", "0/2"))
    assert (one[2][:6] < 6).all() and (one[2][6:] >= 6).all() and not (one[2] == two[2]).all()
