"""Bidirectional gated recurrent network in numpy: forward pass, backpropagation through time, Adam."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return np.tanh(x * np.float32(0.5)) * np.float32(0.5) + np.float32(0.5)


def hard_sigmoid(x: np.ndarray) -> np.ndarray:
    """The straight line that meets the sigmoid in 0, held between 0 and 1."""
    return np.clip(x * np.float32(0.25) + np.float32(0.5), 0, 1)


def forward(inputs, steps: int, u: np.ndarray, reverse: bool, keep: bool = False, hard: bool = False):
    """States [steps, batch, hidden] of one direction. inputs(t): the step's projected input [batch, 3 * hidden] for update, reset and new state. hard: gates by hard_sigmoid."""
    hidden = u.shape[0]
    h = out = None
    tape = []
    for t in range(steps - 1, -1, -1) if reverse else range(steps):
        x = inputs(t)
        if out is None:
            h = np.zeros((len(x), hidden), np.float32)
            out = np.empty((steps, len(x), hidden), np.float32)
        a = h @ u
        gates = (hard_sigmoid if hard else sigmoid)(x[:, : 2 * hidden] + a[:, : 2 * hidden])
        z, r = gates[:, :hidden], gates[:, hidden:]
        n = np.tanh(x[:, 2 * hidden :] + r * a[:, 2 * hidden :])
        if keep:
            tape.append((t, h, z, r, n, a[:, 2 * hidden :]))
        h = n + z * (h - n)
        out[t] = h
    return out, tape


def backward(d_out: np.ndarray, tape, u: np.ndarray, hard: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """Gradients of the projected inputs [steps, batch, 3 * hidden] and of u."""
    steps, batch, hidden = d_out.shape
    d_in = np.empty((steps, batch, 3 * hidden), np.float32)
    d_u = np.zeros_like(u)
    d_h = np.zeros((batch, hidden), np.float32)
    slope = (lambda g: ((g > 0) & (g < 1)) * np.float32(0.25)) if hard else (lambda g: g * (1 - g))
    for t, before, z, r, n, a in reversed(tape):
        d_h = d_h + d_out[t]
        d_n = d_h * (1 - z) * (1 - n * n)
        d_z = d_h * (before - n) * slope(z)
        d_r = d_n * a * slope(r)
        d_in[t] = np.concatenate((d_z, d_r, d_n), axis=1)
        d_a = np.concatenate((d_z, d_r, d_n * r), axis=1)
        d_u += before.T @ d_a
        d_h = d_h * z + d_a @ u.T
    return d_in, d_u


def weights(rng: np.random.Generator, *shape: int, scale: float | None = None) -> np.ndarray:
    return (rng.standard_normal(shape) * (scale or 1 / np.sqrt(shape[0]))).astype(np.float32)


class Adam:
    """Of a dict of arrays; clips the gradients' norm."""

    def __init__(self, parameters: dict[str, np.ndarray], rate: float = 0.01, clip: float = 5.0):
        self.p, self.rate, self.clip, self.t = parameters, rate, clip, 0
        self.m = {k: np.zeros_like(v) for k, v in parameters.items()}
        self.v = {k: np.zeros_like(v) for k, v in parameters.items()}

    def step(self, gradients: dict[str, np.ndarray]) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in gradients.values()))
        by = min(1.0, self.clip / (norm + 1e-9))
        for k, g in gradients.items():
            g = g * np.float32(by)
            self.m[k] = 0.9 * self.m[k] + np.float32(0.1) * g
            self.v[k] = 0.999 * self.v[k] + np.float32(0.001) * g * g
            m, v = self.m[k] / (1 - 0.9**self.t), self.v[k] / (1 - 0.999**self.t)
            self.p[k] -= (self.rate * m / (np.sqrt(v) + 1e-7)).astype(np.float32)
