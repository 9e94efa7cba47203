"""A bidirectional LSTM tagger in numpy: forward, backward through time, Adam."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class BiLstm:
    """P(label = 1) for each step of padded sequences x (steps, batch, features) with mask (steps, batch)."""

    def __init__(self, features: int, hidden: int, seed: int):
        random = np.random.default_rng(seed)
        self.hidden = hidden
        self.p: dict[str, np.ndarray] = {}
        for d in "fb":
            self.p[f"x{d}"] = random.normal(0, 1 / np.sqrt(features), (features, 4 * hidden))
            self.p[f"h{d}"] = random.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
            self.p[f"c{d}"] = np.r_[np.zeros(hidden), np.ones(hidden), np.zeros(2 * hidden)]  # open forget gates
        self.p["out"] = random.normal(0, 1 / np.sqrt(2 * hidden), 2 * hidden)
        self.p["skip"] = np.zeros(features)
        self.p["bias"] = np.zeros(1)

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str, keep: bool, start: tuple | None = None) -> tuple[np.ndarray, list, tuple]:
        n, (steps, batch) = self.hidden, mask.shape
        h, c = start or (np.zeros((batch, n)), np.zeros((batch, n)))
        inputs, states, kept = x @ self.p[f"x{d}"] + self.p[f"c{d}"], np.zeros((steps, batch, n)), []
        for t in range(steps) if d == "f" else range(steps - 1, -1, -1):
            z = inputs[t] + h @ self.p[f"h{d}"]
            gates = sigmoid(z[:, : 3 * n])
            i, f, o, g = gates[:, :n], gates[:, n : 2 * n], gates[:, 2 * n :], np.tanh(z[:, 3 * n :])
            on = mask[t][:, None]
            new = f * c + i * g
            squashed = np.tanh(new)
            if keep:
                kept.append((t, h, c, i, f, o, g, squashed, on))
            c, h = np.where(on, new, c), np.where(on, o * squashed, h)
            states[t] = h
        return states, kept, (h, c)

    def predict(self, x: np.ndarray, mask: np.ndarray) -> np.ndarray:
        both = np.concatenate([self._run(x, mask, d, False)[0] for d in "fb"], axis=2)
        return sigmoid(both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"])

    def predict_long(self, part: Callable[[int, int], np.ndarray], steps: int, size: int) -> np.ndarray:
        """As predict for one sequence, whose features part(low, high) gives, in pieces of ``size`` steps.

        The state is carried from piece to piece in both directions; what is kept of a step is one number.
        """
        score, n = np.zeros(steps), self.hidden
        pieces = [(low, min(low + size, steps)) for low in range(0, steps, size)]
        for k, d in enumerate("fb"):
            state = None
            for low, high in pieces if d == "f" else reversed(pieces):
                x = part(low, high)[:, None].astype(float)
                states, _, state = self._run(x, np.ones((high - low, 1), bool), d, False, state)
                score[low:high] += states[:, 0] @ self.p["out"][k * n : (k + 1) * n]
                if d == "f":
                    score[low:high] += x[:, 0] @ self.p["skip"] + self.p["bias"]
        return sigmoid(score)

    def gradients(self, x: np.ndarray, mask: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        n, runs = self.hidden, {d: self._run(x, mask, d, True) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], axis=2)
        p = sigmoid(both @ self.p["out"] + x @ self.p["skip"] + self.p["bias"])
        total = mask.sum()
        loss = -(np.where(y, np.log(p + 1e-12), np.log(1 - p + 1e-12)) * mask).sum() / total
        error = (p - y) * mask / total
        g = {"out": np.einsum("tb,tbh->h", error, both), "skip": np.einsum("tb,tbf->f", error, x), "bias": np.array([error.sum()])}
        for part, d in enumerate("fb"):
            g[f"x{d}"], g[f"h{d}"], g[f"c{d}"] = (np.zeros_like(self.p[f"{k}{d}"]) for k in "xhc")
            dh, dc = np.zeros((mask.shape[1], n)), np.zeros((mask.shape[1], n))
            for t, h, c, i, f, o, gg, squashed, on in reversed(runs[d][1]):
                dh = dh + error[t][:, None] * self.p["out"][part * n : (part + 1) * n]
                inside = np.where(on, dh, 0)
                dnew = np.where(on, dc, 0) + inside * o * (1 - squashed**2)
                dz = np.concatenate([dnew * gg * i * (1 - i), dnew * c * f * (1 - f), inside * squashed * o * (1 - o), dnew * i * (1 - gg**2)], axis=1)
                g[f"x{d}"] += x[t].T @ dz
                g[f"h{d}"] += h.T @ dz
                g[f"c{d}"] += dz.sum(0)
                dh = np.where(on, dz @ self.p[f"h{d}"].T, dh)
                dc = np.where(on, dnew * f, dc)
        return loss, g

    def fit(self, batches: list[tuple[np.ndarray, np.ndarray, np.ndarray]], epochs: int, rate: float, seed: int) -> float:
        random, m, v, step, loss = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0, 0.0
        for _ in range(epochs):
            for at in random.permutation(len(batches)):
                loss, g = self.gradients(*batches[at])
                step += 1
                scale = min(1.0, 5.0 / (np.sqrt(sum((x * x).sum() for x in g.values())) + 1e-9))
                for k in self.p:
                    grad = g[k] * scale
                    m[k], v[k] = 0.9 * m[k] + 0.1 * grad, 0.999 * v[k] + 0.001 * grad * grad
                    self.p[k] = self.p[k] - rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.999**step)) + 1e-8)
        return loss
