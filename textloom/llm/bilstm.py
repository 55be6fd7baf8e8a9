"""A character-level bidirectional LSTM with CRF transitions, in numpy."""

from __future__ import annotations

import numpy as np


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


def _logsumexp(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


class Tagger:
    """Emissions for windows of character classes, (windows, length) -> (windows, length, tags), and decoding."""

    def __init__(self, classes: int, tags: int, hidden: int = 16, seed: int = 5):
        rng = np.random.default_rng(seed)
        self.hidden, self.tags = hidden, tags
        self.p: dict[str, np.ndarray] = {}
        for way in "fb":
            self.p["e" + way] = rng.normal(0, 0.3, (classes, 4 * hidden))
            self.p["e" + way][:, hidden : 2 * hidden] += 0.5  # gates start out remembering
            self.p["u" + way] = rng.normal(0, 1 / np.sqrt(hidden), (hidden, 4 * hidden))
        self.p["w"] = rng.normal(0, 0.3, (2 * hidden, tags))
        self.p["b"] = np.zeros(tags)
        self.p["t"] = np.zeros((tags, tags))

    def lean(self) -> Tagger:
        """Single precision, for use after training."""
        self.p = {k: v.astype(np.float32) for k, v in self.p.items()}
        return self

    def _run(self, x: np.ndarray, way: str, keep: bool) -> tuple[np.ndarray, list]:
        n, length = x.shape
        h = self.hidden
        table, u = self.p["e" + way], self.p["u" + way]
        out = np.zeros((n, length, h), table.dtype)
        state, cell, kept = np.zeros((n, h), table.dtype), np.zeros((n, h), table.dtype), []
        for t in range(length) if way == "f" else range(length - 1, -1, -1):
            z = table[x[:, t]] + state @ u
            gates = _sigmoid(z[:, : 3 * h])
            i, f, o = gates[:, :h], gates[:, h : 2 * h], gates[:, 2 * h :]
            g = np.tanh(z[:, 3 * h :])
            new = f * cell + i * g
            squashed = np.tanh(new)
            if keep:
                kept.append((t, i, f, o, g, cell, squashed, state))
            cell, state = new, o * squashed
            out[:, t] = state
        return out, kept

    def emissions(self, x: np.ndarray) -> np.ndarray:
        return np.concatenate([self._run(x, way, False)[0] for way in "fb"], 2) @ self.p["w"] + self.p["b"]

    def _crf(self, em: np.ndarray, y: np.ndarray) -> tuple[float, np.ndarray, np.ndarray]:
        """Mean loss of the true paths, and its gradients by emissions and transitions."""
        n, length, _ = em.shape
        t = self.p["t"]
        a, b = np.zeros_like(em), np.zeros_like(em)
        a[:, 0] = em[:, 0]
        for k in range(1, length):
            a[:, k] = em[:, k] + _logsumexp(a[:, k - 1][:, :, None] + t[None], 1)
        for k in range(length - 2, -1, -1):
            b[:, k] = _logsumexp(t[None] + (em[:, k + 1] + b[:, k + 1])[:, None, :], 2)
        z = _logsumexp(a[:, -1], 1)
        rows = np.arange(n)[:, None], np.arange(length)[None]
        score = em[rows[0], rows[1], y].sum(1) + t[y[:, :-1], y[:, 1:]].sum(1)
        d_em = np.exp(a + b - z[:, None, None])
        d_t = np.exp(a[:, :-1, :, None] + t + (em + b)[:, 1:, None, :] - z[:, None, None, None]).sum((0, 1))
        d_em[rows[0], rows[1], y] -= 1
        np.subtract.at(d_t, (y[:, :-1].ravel(), y[:, 1:].ravel()), 1)
        return float((z - score).mean()), d_em / n, d_t / n

    def _gradients(self, x: np.ndarray, y: np.ndarray) -> tuple[float, dict[str, np.ndarray]]:
        runs = {way: self._run(x, way, True) for way in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0]], 2)
        loss, d_em, d_t = self._crf(both @ self.p["w"] + self.p["b"], y)
        flat = d_em.reshape(-1, self.tags)
        grads = {"w": both.reshape(len(flat), -1).T @ flat, "b": flat.sum(0), "t": d_t}
        d_both = d_em @ self.p["w"].T
        h = self.hidden
        for k, way in enumerate("fb"):
            d_out, u = d_both[:, :, k * h : (k + 1) * h], self.p["u" + way]
            d_table, d_u = np.zeros_like(self.p["e" + way]), np.zeros_like(u)
            d_state, d_cell = np.zeros((len(x), h)), np.zeros((len(x), h))
            for t, i, f, o, g, cell, squashed, state in reversed(runs[way][1]):
                d_h = d_out[:, t] + d_state
                d_c = d_cell + d_h * o * (1 - squashed**2)
                d_z = np.concatenate([d_c * g * i * (1 - i), d_c * cell * f * (1 - f), d_h * squashed * o * (1 - o), d_c * i * (1 - g**2)], 1)
                d_u += state.T @ d_z
                np.add.at(d_table, x[:, t], d_z)
                d_state, d_cell = d_z @ u.T, d_c * f
            grads["e" + way], grads["u" + way] = d_table, d_u
        return loss, grads

    def fit(self, x: np.ndarray, y: np.ndarray, steps: int = 400, batch: int = 64, rate: float = 0.02, seed: int = 6) -> list[float]:
        """Adam over random batches of labelled windows."""
        rng = np.random.default_rng(seed)
        m, v, losses = {k: np.zeros_like(p) for k, p in self.p.items()}, {k: np.zeros_like(p) for k, p in self.p.items()}, []
        for step in range(1, steps + 1):
            pick = rng.integers(0, len(x), batch)
            loss, grads = self._gradients(x[pick], y[pick])
            losses.append(loss)
            norm = np.sqrt(sum((g**2).sum() for g in grads.values()))
            now = rate * min(1.0, 2 * (1 - step / (steps + 1)))
            for k, g in grads.items():
                g = g * min(1.0, 5 / max(norm, 1e-12))
                m[k] += 0.1 * (g - m[k])
                v[k] += 0.01 * (g**2 - v[k])
                self.p[k] = self.p[k] - now * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-8)
        return losses

    def decode(self, em: np.ndarray) -> np.ndarray:
        """Best paths of (sequences, length, tags)."""
        n, length, _ = em.shape
        t = self.p["t"]
        best, back = em[:, 0], np.zeros(em.shape, np.int8)
        for k in range(1, length):
            all_ = best[:, :, None] + t[None]
            back[:, k] = all_.argmax(1)
            best = all_.max(1) + em[:, k]
        path = np.zeros((n, length), np.int8)
        path[:, -1] = best.argmax(1)
        for k in range(length - 1, 0, -1):
            path[:, k - 1] = back[np.arange(n), k, path[:, k]]
        return path
