"""A gated recurrent layer in numpy: forward, backpropagation through time, and the optimiser.

Arrays are feature-major, ``(features, batch)``, so every slice of a gate is contiguous. The input is a symbol; its
contribution to the three gates (update, reset, candidate) is a column of ``table``, which holds the biases too.
"""

from __future__ import annotations

import numpy as np


def initial(symbols: int, hidden: int, rng: np.random.Generator) -> dict[str, np.ndarray]:
    return {
        "table": (rng.normal(size=(3 * hidden, symbols)) * 0.3).astype(np.float32),
        "back": (rng.normal(size=(3 * hidden, hidden)) / np.sqrt(hidden)).astype(np.float32),
    }


def forward(layer: dict[str, np.ndarray], symbols: np.ndarray, state: np.ndarray, keep: bool = False):
    """States ``(T, hidden, batch)`` after each of the ``symbols (T, batch)``; with ``keep`` also what backward needs."""
    table, back = layer["table"], layer["back"]
    steps, h = len(symbols), state.shape[0]
    out = np.empty((steps, h, state.shape[1]), np.float32)
    kept = []
    for t in range(steps):
        gates = table.take(symbols[t], axis=1)
        own = back @ state
        gates[: 2 * h] += own[: 2 * h]
        zr = gates[: 2 * h]
        zr *= 0.5
        np.tanh(zr, out=zr)
        zr += 1.0
        zr *= 0.5
        z, r, cand = gates[:h], gates[h : 2 * h], gates[2 * h :]
        cand += r * own[2 * h :]
        np.tanh(cand, out=cand)
        if keep:
            kept.append((state, z, r, cand, own[2 * h :]))
        new = out[t]
        np.subtract(state, cand, out=new)
        new *= z
        new += cand
        state = new
    return (out, kept) if keep else out


def backward(layer: dict[str, np.ndarray], symbols: np.ndarray, kept: list, d_out: np.ndarray) -> dict[str, np.ndarray]:
    """Gradients of ``table`` and ``back`` from those of the states; the state before the first step is a constant."""
    back = layer["back"]
    h = back.shape[1]
    d_gates = np.empty((len(symbols), 3 * h, symbols.shape[1]), np.float32)
    d_back = np.zeros_like(back)
    d_state = np.zeros_like(d_out[0])
    for t in range(len(symbols) - 1, -1, -1):
        state, z, r, cand, own = kept[t]
        d = d_out[t] + d_state
        d_cand = d * (1 - z) * (1 - cand * cand)
        d_own = np.empty((3 * h, d.shape[1]), np.float32)
        d_own[:h] = d * (state - cand) * z * (1 - z)
        d_own[h : 2 * h] = d_cand * own * r * (1 - r)
        d_own[2 * h :] = d_cand * r
        d_gates[t, : 2 * h] = d_own[: 2 * h]
        d_gates[t, 2 * h :] = d_cand
        d_back += d_own @ state.T
        d_state = d * z + back.T @ d_own
    # cells of one symbol are brought together and added up
    flat = symbols.ravel()
    n = layer["table"].shape[1]
    order = np.argsort(flat.astype(np.int16) if n < 1 << 15 else flat, kind="stable")
    begins = np.flatnonzero(np.diff(flat[order], prepend=-1))
    cells = np.ascontiguousarray(d_gates.transpose(0, 2, 1)).reshape(-1, 3 * h)[order]
    d_table = np.zeros((n, 3 * h), np.float32)
    if len(flat):
        d_table[flat[order[begins]]] = np.add.reduceat(cells, begins, axis=0)
    d_table = d_table.T
    return {"table": d_table, "back": d_back}


class Adam:
    """Adam over a dict of arrays, in place, with the gradient's norm clipped."""

    def __init__(self, weights: dict[str, np.ndarray], rate: float, clip: float = 1.0):
        self.weights, self.rate, self.clip, self.step = weights, rate, clip, 0
        self.held: dict[str, np.ndarray] = {}
        self.held_size = 0
        self.mean = {k: np.zeros_like(v) for k, v in weights.items()}
        self.square = {k: np.zeros_like(v) for k, v in weights.items()}

    def update(self, grads: dict[str, np.ndarray], share: float = 1.0) -> None:
        """One step, or a ``share`` of it."""
        self.step += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads.values()))
        scale = np.float32(min(1.0, self.clip / max(norm, 1e-12)))
        rate = share * self.rate * np.sqrt(1 - 0.999**self.step) / (1 - 0.9**self.step)
        for k, g in grads.items():
            g = g * scale
            m, s = self.mean[k], self.square[k]
            m += 0.1 * (g - m)
            s += 0.001 * (g * g - s)
            self.weights[k] -= (rate * m / (np.sqrt(s) + 1e-8)).astype(np.float32)

    def gather(self, grads: dict[str, np.ndarray], size: int, least: int) -> None:
        """Add up mean gradients of ``size`` examples and update once ``least`` examples are held, so that few examples
        never make a whole step."""
        for k, g in grads.items():
            if k in self.held:
                self.held[k] += g * np.float32(size)
            else:
                self.held[k] = g * np.float32(size)
        self.held_size += size
        if self.held_size >= least:
            self.flush(least)

    def flush(self, least: int) -> None:
        """Update with what is held, by a step as much smaller as there are fewer than ``least`` examples."""
        if self.held_size:
            self.update({k: g / np.float32(self.held_size) for k, g in self.held.items()}, min(1.0, self.held_size / least))
            self.held, self.held_size = {}, 0
