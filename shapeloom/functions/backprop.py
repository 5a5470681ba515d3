"""Gradients of the occupancy network and the steps of its training, in NumPy.

Each layer returns its output and a function that takes the output's gradient, adds those of its weights to `g` and
returns those of its inputs.
"""

from __future__ import annotations

import math

import numpy as np

from .network import Network, fourier, gelu
from .sampling import farthest


def bce(logits: np.ndarray, occ: np.ndarray) -> float:
    return float((np.log1p(np.exp(-np.abs(logits))) + np.maximum(logits, 0) - logits * occ).mean())


class Pass:
    """One shape's forward pass; gradients are summed in g."""

    def __init__(self, net: Network):
        self.net, self.w, self.g = net, net.w, {}

    def _add(self, name: str, x: np.ndarray) -> None:
        self.g[name] = self.g[name] + x if name in self.g else x

    def linear(self, name: str, x: np.ndarray):
        w = self.w[f"{name}.w"]

        def back(d):
            self._add(f"{name}.w", x.T @ d)
            self._add(f"{name}.b", d.sum(0))
            return d @ w.T

        return x @ w + self.w[f"{name}.b"], back

    def norm(self, name: str, x: np.ndarray):
        gain = self.w[f"{name}.norm.gain"]
        c = x - x.mean(-1, keepdims=True)
        s = np.sqrt((c**2).mean(-1, keepdims=True) + 1e-5)
        z = c / s

        def back(d):
            self._add(f"{name}.norm.gain", (d * z).sum(0))
            self._add(f"{name}.norm.shift", d.sum(0))
            d = d * gain
            return (d - d.mean(-1, keepdims=True) - z * (d * z).mean(-1, keepdims=True)) / s

        return z * gain + self.w[f"{name}.norm.shift"], back

    def attend(self, name: str, q: np.ndarray, k: np.ndarray):
        heads = self.net.size["n_heads"]
        split = lambda x: x.reshape(len(x), heads, -1).transpose(1, 0, 2)
        join = lambda x: x.transpose(1, 0, 2).reshape(x.shape[1], -1)
        (a, back_a), (b, back_b), (c, back_c) = self.linear(f"{name}.query", q), self.linear(f"{name}.key", k), self.linear(f"{name}.value", k)
        a, b, c = split(a), split(b), split(c)
        scale = 1 / math.sqrt(a.shape[-1])
        p = a @ b.transpose(0, 2, 1) * scale
        p = np.exp(p - p.max(-1, keepdims=True))
        p /= p.sum(-1, keepdims=True)
        out, back_out = self.linear(f"{name}.out", join(p @ c))

        def back(d):
            d = split(back_out(d))
            dp = d @ c.transpose(0, 2, 1)
            ds = p * (dp - (dp * p).sum(-1, keepdims=True)) * scale
            return back_a(join(ds @ b)), back_b(join(ds.transpose(0, 2, 1) @ a)) + back_c(join(p.transpose(0, 2, 1) @ d))

        return out, back

    def cross(self, name: str, q: np.ndarray, k: np.ndarray):
        (a, back_q), (b, back_k) = self.norm(f"{name}.query", q), self.norm(f"{name}.key", k)
        out, back_o = self.attend(name, a, b)

        def back(d):
            da, db = back_o(d)
            return d + back_q(da), back_k(db)

        return q + out, back

    def mlp(self, block: str, norm: str, x: np.ndarray):
        a, back_a = self.norm(norm, x)
        u, back_u = self.linear(f"{block}.up", a)
        out, back_o = self.linear(f"{block}.down", gelu(u))
        slope = gelu(u) / np.where(u == 0, 1, u) + u * np.exp(-(u**2) / 2) / math.sqrt(2 * math.pi)
        slope = np.where(u == 0, 0.5, slope)
        return x + out, lambda d: d + back_a(back_u(back_o(d) * slope))

    def own(self, block: str, x: np.ndarray):
        a, back_a = self.norm(f"{block}.self", x)
        out, back_o = self.attend(f"{block}.self", a, a)
        return x + out, lambda d: d + back_a(sum(back_o(d)))

    def logits(self, cloud: np.ndarray, positions: np.ndarray):
        size = self.net.size
        embed = lambda side, x: self.linear(f"{side}.embed", fourier(x, size["n_freq"], size["max_freq"]))
        cloud = cloud[:, : 6 if size["normals"] else 3]
        (few, back_few), (every, back_every) = embed("encoder", cloud[farthest(cloud[:, :3], size["n_centers"])]), embed("encoder", cloud)
        h, back_cross = self.cross("encoder.cross", few, every)
        backs = []
        for k in range(size["n_layers"]):
            h, back = self.own(f"encoder.{k}", h)
            backs.append(back)
            h, back = self.mlp(f"encoder.{k}", f"encoder.{k}.mlp", h)
            backs.append(back)
        code, back_last = self.norm("encoder.last", h)
        at, back_at = embed("decoder", positions)
        x, back_x = self.cross("decoder.cross", at, code)
        x, back_mlp = self.mlp("decoder", "decoder.mlp", x)
        x, back_norm = self.norm("decoder.last", x)
        out, back_head = self.linear("decoder.head", x)

        def back(d):
            d, dc = back_x(back_mlp(back_norm(back_head(d[:, None]))))
            back_at(d)
            d = back_last(dc)
            for b in reversed(backs):
                d = b(d)
            d, dk = back_cross(d)
            back_few(d)
            back_every(dk)

        return out[:, 0], back


def gradients(net: Network, cloud: np.ndarray, positions: np.ndarray, occ: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
    """(mean binary cross-entropy, its gradient by weight) of one shape's positions."""
    p = Pass(net)
    logits, back = p.logits(cloud, positions)
    back((1 / (1 + np.exp(-logits)) - occ) / len(occ))
    return bce(logits, occ), p.g


def learning_rate(step: int, total: int, base: float = 1e-3, least: float = 1e-5, warm: int = 300, hold: int = 0) -> float:
    """Linear warm-up, a plateau of `hold` steps, then half a cosine down to `least` at the total."""
    if step < warm:
        return base * (step + 1) / warm
    if step < warm + hold:
        return base
    done = min(1.0, (step - warm - hold) / max(1, total - warm - hold))
    return least + (base - least) * (1 + math.cos(math.pi * done)) / 2


class AdamW:
    """Adam with decay of weight matrices apart from the gradient; gradients are clipped to a norm of `clip` together."""

    def __init__(self, decay: float = 0.01, clip: float = 1.0, betas: tuple[float, float] = (0.9, 0.999), eps: float = 1e-8):
        self.decay, self.clip, self.betas, self.eps = decay, clip, betas, eps
        self.mean, self.square, self.n = {}, {}, 0

    def step(self, w: dict[str, np.ndarray], g: dict[str, np.ndarray], rate: float) -> float:
        """Changes w in place; returns the norm of the gradients before they are clipped."""
        size = math.sqrt(sum(float((x**2).sum()) for x in g.values()))
        shrink = min(1.0, self.clip / size) if size > 0 else 1.0
        self.n += 1
        (a, b), n = self.betas, self.n
        for k, x in g.items():
            x = x * shrink
            self.mean[k] = a * self.mean.get(k, 0.0) + (1 - a) * x
            self.square[k] = b * self.square.get(k, 0.0) + (1 - b) * x**2
            w[k] = w[k] * (1 - rate * self.decay) - rate * (self.mean[k] / (1 - a**n)) / (np.sqrt(self.square[k] / (1 - b**n)) + self.eps)
        return size
