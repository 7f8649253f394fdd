"""A bidirectional gated recurrent layer in numpy, trained by backpropagation through time.

Arrays keep the batch last, (direction, unit, batch), so every elementwise step runs over contiguous memory. Direction 0
reads a sequence from its start, direction 1 from its end. Gates and candidates use the softsign x / (1 + |x|), scaled
to (0, 1) for gates. There are no biases besides those in the inputs: where inputs are 0 the state stays 0, so padding
before the first element leaves no trace.
"""

from __future__ import annotations

import ctypes
from contextlib import contextmanager
from functools import cache
from pathlib import Path

import numpy as np


@cache
def _blas() -> list[tuple]:
    found = []
    for path in Path(np.__file__).parent.parent.glob("numpy.libs/*openblas*"):
        lib = ctypes.CDLL(str(path))
        for name in ("scipy_openblas_{}_num_threads64_", "scipy_openblas_{}_num_threads", "openblas_{}_num_threads64_", "openblas_{}_num_threads"):
            if hasattr(lib, name.format("set")) and hasattr(lib, name.format("get")):
                found.append((getattr(lib, name.format("get")), getattr(lib, name.format("set"))))
                break
    return found


@contextmanager
def one_thread():
    """The matrices here are too small for BLAS threads, which would only wait for one another."""
    before = [get() for get, _ in _blas()]
    for _, put in _blas():
        put(1)
    try:
        yield
    finally:
        for (_, put), n in zip(_blas(), before, strict=True):
            put(n)


class BiGRU:
    def __init__(self, hidden: int, rng: np.random.Generator):
        self.h = hidden
        self.u = (rng.standard_normal((2, 3 * hidden, hidden)) / np.sqrt(hidden) * 0.7).astype(np.float32)

    def run(self, inputs, steps: int, batch: int) -> np.ndarray:
        """States (step, direction, unit, batch). ``inputs(t, out)`` writes the t-th inputs (direction, 3 * unit,
        batch); step t of direction 1 is the t-th from the end."""
        k, out = self.h, np.empty((steps, 2, self.h, batch), np.float32)
        h, x, g, m = np.zeros((2, k, batch), np.float32), *(np.empty((2, 3 * k, batch), np.float32) for _ in range(3))
        for t in range(steps):
            inputs(t, x)
            np.matmul(self.u, h, out=g)
            a, n, gn = x[:, : 2 * k], x[:, 2 * k :], g[:, 2 * k :]
            a += g[:, : 2 * k]
            self._softsign(a, m[:, : 2 * k])
            a *= 0.5
            a += 0.5
            gn *= a[:, k:]
            n += gn
            self._softsign(n, m[:, 2 * k :])
            n -= h
            n *= a[:, :k]
            np.add(h, n, out=out[t])
            h = out[t]
        return out

    @staticmethod
    def _softsign(a: np.ndarray, room: np.ndarray) -> None:
        np.abs(a, out=room)
        room += 1
        a /= room

    def train_run(self, x: np.ndarray):
        """As run() over all inputs (step, direction, 3 * unit, batch), with what backward() needs."""
        steps, k, batch = len(x), self.h, x.shape[-1]
        hs, kept = np.zeros((steps + 1, 2, k, batch), np.float32), []
        for t in range(steps):
            g = self.u @ hs[t]
            a = x[t, :, : 2 * k] + g[:, : 2 * k]
            a = a / (1 + np.abs(a)) * 0.5 + 0.5
            n = x[t, :, 2 * k :] + a[:, k:] * g[:, 2 * k :]
            n /= 1 + np.abs(n)
            hs[t + 1] = hs[t] + a[:, :k] * (n - hs[t])
            kept.append((a, n, g[:, 2 * k :]))
        return hs, kept

    def backward(self, hs: np.ndarray, kept: list, dout: np.ndarray):
        """Gradients of the inputs and of u, from those of the states (step, direction, unit, batch)."""
        steps, k = len(dout), self.h
        dx, du, dh = np.empty((steps, 2, 3 * k, dout.shape[-1]), np.float32), np.zeros_like(self.u), np.zeros_like(hs[0])
        for t in reversed(range(steps)):
            a, n, g = kept[t]
            z, r = a[:, :k], a[:, k:]
            dh = dh + dout[t]
            dn = dh * z * (1 - np.abs(n)) ** 2
            dgate = np.concatenate([dh * (n - hs[t]), dn * g], 1) * 0.5 * (1 - np.abs(2 * a - 1)) ** 2
            dx[t] = np.concatenate([dgate, dn], 1)
            dg = np.concatenate([dgate, dn * r], 1)
            du += dg @ hs[t].transpose(0, 2, 1)
            dh = dh * (1 - z) + self.u.transpose(0, 2, 1) @ dg
        return dx, du


class Adam:
    def __init__(self, params: list[np.ndarray], rate: float):
        self.params, self.rate, self.t = params, rate, 0
        self.m, self.v = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]

    def step(self, grads: list[np.ndarray], scale: float = 1.0) -> None:
        self.t += 1
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        clip = min(1.0, 1.0 / (norm + 1e-9))
        for p, g, m, v in zip(self.params, grads, self.m, self.v, strict=True):
            g = g * clip
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= self.rate * scale * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.99**self.t)) + 1e-7)
