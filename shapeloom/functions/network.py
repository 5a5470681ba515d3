"""The occupancy network in NumPy: farthest-point centers attend over the cloud, positions attend over the code."""

from __future__ import annotations

import math

import numpy as np

from .sampling import farthest

#: The rational approximation of the error function (error below 1.5e-7).
_ERF = (0.254829592, -0.284496736, 1.421413741, -1.453152027, 1.061405429)


def gelu(x: np.ndarray) -> np.ndarray:
    z = np.abs(x) / math.sqrt(2)
    t = 1 / (1 + 0.3275911 * z)
    poly = t * (_ERF[0] + t * (_ERF[1] + t * (_ERF[2] + t * (_ERF[3] + t * _ERF[4]))))
    return x * (1 + np.sign(x) * (1 - poly * np.exp(-(z**2)))) / 2


def fourier(x: np.ndarray, n: int, largest: float) -> np.ndarray:
    """Of each axis n sines, then n cosines, at frequencies from 1 to largest in equal ratios; channels past the third follow as they are."""
    angle = x[..., :3, None] * (2 * np.pi * 2.0 ** np.linspace(0, math.log2(largest), n))
    out = np.concatenate([np.sin(angle), np.cos(angle)], -1).reshape(*x.shape[:-1], 6 * n)
    return np.concatenate([out, x[..., 3:]], -1)


class Network:
    """size: d_model, n_heads, mlp_ratio, n_layers, n_freq, max_freq, n_centers, normals (0/1). weights: name -> array."""

    SIZE = {"d_model": 256, "n_heads": 8, "mlp_ratio": 4, "n_layers": 6, "n_freq": 16, "max_freq": 64, "n_centers": 256, "normals": 1}

    def __init__(self, size: dict, weights: dict[str, np.ndarray]):
        self.size, self.w = {**self.SIZE, **size}, weights

    @classmethod
    def shapes_of(cls, size: dict) -> dict[str, tuple]:
        s = {**cls.SIZE, **size}
        d, h = s["d_model"], s["d_model"] * s["mlp_ratio"]
        out = {"encoder.embed": (6 * s["n_freq"] + 3 * s["normals"], d), "decoder.embed": (6 * s["n_freq"], d), "decoder.head": (d, 1)}
        for block in ("encoder.cross", "decoder.cross", *(f"encoder.{k}.self" for k in range(s["n_layers"]))):
            out |= {f"{block}.{x}": (d, d) for x in ("query", "key", "value", "out")}
        for block in ("decoder", *(f"encoder.{k}" for k in range(s["n_layers"]))):
            out |= {f"{block}.up": (d, h), f"{block}.down": (h, d)}
        norms = ["encoder.cross.query", "encoder.cross.key", "decoder.cross.query", "decoder.cross.key", "decoder.mlp", "encoder.last", "decoder.last"]
        norms += [f"encoder.{k}.{x}" for k in range(s["n_layers"]) for x in ("self", "mlp")]
        return {f"{k}.w": v for k, v in out.items()} | {f"{k}.b": v[1:] for k, v in out.items()} | {f"{k}.norm.{x}": (d,) for k in norms for x in ("gain", "shift")}

    @classmethod
    def fresh(cls, size: dict, seed: int = 0) -> Network:
        rng = np.random.default_rng(seed)
        return cls(size, {k: np.ones(v) if k.endswith(".gain") else np.zeros(v) if len(v) == 1 else rng.uniform(-1, 1, v) / math.sqrt(v[0]) for k, v in cls.shapes_of(size).items()})

    def n_parameters(self) -> int:
        return sum(x.size for x in self.w.values())

    def _linear(self, name: str, x: np.ndarray) -> np.ndarray:
        return x @ self.w[f"{name}.w"] + self.w[f"{name}.b"]

    def _norm(self, name: str, x: np.ndarray) -> np.ndarray:
        x = x - x.mean(-1, keepdims=True)
        return x / np.sqrt((x**2).mean(-1, keepdims=True) + 1e-5) * self.w[f"{name}.norm.gain"] + self.w[f"{name}.norm.shift"]

    def _attend(self, name: str, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        heads = self.size["n_heads"]
        split = lambda x: x.reshape(len(x), heads, -1).transpose(1, 0, 2)
        a, b, c = split(self._linear(f"{name}.query", q)), split(self._linear(f"{name}.key", k)), split(self._linear(f"{name}.value", k))
        score = a @ b.transpose(0, 2, 1) / math.sqrt(a.shape[-1])
        score = np.exp(score - score.max(-1, keepdims=True))
        out = (score / score.sum(-1, keepdims=True)) @ c
        return self._linear(f"{name}.out", out.transpose(1, 0, 2).reshape(len(q), -1))

    def _cross(self, name: str, q: np.ndarray, k: np.ndarray) -> np.ndarray:
        return q + self._attend(name, self._norm(f"{name}.query", q), self._norm(f"{name}.key", k))

    def _mlp(self, block: str, norm: str, x: np.ndarray) -> np.ndarray:
        return x + self._linear(f"{block}.down", gelu(self._linear(f"{block}.up", self._norm(norm, x))))

    def _embed(self, side: str, x: np.ndarray) -> np.ndarray:
        return self._linear(f"{side}.embed", fourier(x, self.size["n_freq"], self.size["max_freq"]))

    def encode(self, cloud: np.ndarray) -> np.ndarray:
        """Code (centers x d_model) of a cloud; one with the wrong channels is an error."""
        width = 6 if self.size["normals"] else 3
        if cloud.shape[1] < width:
            raise ValueError(f"a cloud of {cloud.shape[1]} channels for a network of {width}")
        cloud = cloud[:, :width]
        h = self._cross("encoder.cross", self._embed("encoder", cloud[farthest(cloud[:, :3], self.size["n_centers"])]), self._embed("encoder", cloud))
        for k in range(self.size["n_layers"]):
            x = self._norm(f"encoder.{k}.self", h)
            h = self._mlp(f"encoder.{k}", f"encoder.{k}.mlp", h + self._attend(f"encoder.{k}.self", x, x))
        return self._norm("encoder.last", h)

    def decode(self, code: np.ndarray, positions: np.ndarray, chunk: int = 4096) -> np.ndarray:
        """Logits of positions, in chunks of bounded size."""
        out = np.zeros(len(positions))
        for k in range(0, len(positions), chunk):
            h = self._cross("decoder.cross", self._embed("decoder", positions[k : k + chunk]), code)
            out[k : k + chunk] = self._linear("decoder.head", self._norm("decoder.last", self._mlp("decoder", "decoder.mlp", h)))[:, 0]
        return out
