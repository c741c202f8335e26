"""Gated recurrent layers in numpy, forward and backward, batched over sequences."""

from __future__ import annotations

import numpy as np

F32 = np.float32


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def init(rng: np.random.Generator, inputs: int, hidden: int) -> dict[str, np.ndarray]:
    """Weights of one direction; gate order: reset, update, candidate."""
    w = rng.normal(0, inputs**-0.5, (inputs, 3 * hidden))
    u = rng.normal(0, hidden**-0.5, (hidden, 3 * hidden))
    return {"w": w.astype(F32), "u": u.astype(F32), "b": np.zeros(3 * hidden, F32)}


def forward(projected: list[np.ndarray], u: np.ndarray, tape: list | None = None) -> list[np.ndarray]:
    """States after each step; projected holds x @ w + b of each step, for a batch.

    The batch may shrink from step to step: the first rows go on, the others have ended.
    """
    hidden = u.shape[0]
    h = np.zeros((len(projected[0]) if projected else 0, hidden), F32)
    states = []
    for x in projected:
        h = h[: len(x)]
        g = h @ u
        gates = sigmoid(x[:, : 2 * hidden] + g[:, : 2 * hidden])
        r, z = gates[:, :hidden], gates[:, hidden:]
        n = np.tanh(x[:, 2 * hidden :] + r * g[:, 2 * hidden :])
        if tape is not None:
            tape.append((h, r, z, n, g[:, 2 * hidden :]))
        h = n + z * (h - n)
        states.append(h)
    return states


def backward(tape: list, u: np.ndarray, grads: list[np.ndarray]) -> tuple[list[np.ndarray], np.ndarray]:
    """Gradients by projected input and by u, given those by the states."""
    du, out = np.zeros_like(u), [None] * len(tape)
    carry = np.zeros((0, u.shape[0]), F32)
    for t in range(len(tape) - 1, -1, -1):
        h, r, z, n, gn = tape[t]
        d = grads[t].copy()
        d[: len(carry)] += carry
        dn = d * (1 - z) * (1 - n * n)
        dz = d * (h - n) * z * (1 - z)
        dr = dn * gn * r * (1 - r)
        out[t] = np.concatenate([dr, dz, dn], axis=1)
        dg = np.concatenate([dr, dz, dn * r], axis=1)
        du += h.T @ dg
        carry = d * z + dg @ u.T
    return out, du


class Adam:
    def __init__(self, params: dict[str, np.ndarray], rate: float) -> None:
        self.params, self.rate, self.t = params, rate, 0
        self.m = {k: np.zeros_like(v) for k, v in params.items()}
        self.v = {k: np.zeros_like(v) for k, v in params.items()}

    def step(self, grads: dict[str, np.ndarray]) -> None:
        self.t += 1
        for k, g in grads.items():
            self.m[k] += 0.1 * (g - self.m[k])
            self.v[k] += 0.01 * (g * g - self.v[k])
            self.params[k] -= self.rate * (self.m[k] / (1 - 0.9**self.t)) / (np.sqrt(self.v[k] / (1 - 0.99**self.t)) + 1e-6)
