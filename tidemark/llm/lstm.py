"""A bidirectional LSTM with its gradients, and Adam, in numpy."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


class Lstm:
    """One direction. Sequences are rows of equal length; ``inside`` stops the state at the end of each."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator) -> None:
        self.h = hidden
        self.wx = (rng.normal(size=(inputs, 4 * hidden)) / np.sqrt(inputs)).astype(np.float32)
        self.wh = (rng.normal(size=(hidden, 4 * hidden)) / np.sqrt(hidden)).astype(np.float32)
        self.b = np.zeros(4 * hidden, np.float32)
        self.b[hidden : 2 * hidden] = 1  # remember at first

    def forward(self, xw: np.ndarray, keep: bool) -> np.ndarray:
        """``xw``: inputs times ``wx``, steps x rows x 4 hidden. Gates stand as input, forget, output, candidate."""
        steps, rows, h = xw.shape[0], xw.shape[1], self.h
        out = np.empty((steps, rows, h), np.float32)
        gates = np.empty((steps, rows, 4 * h), np.float32) if keep else None
        cells = np.empty((steps, rows, h), np.float32) if keep else None
        state, cell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        for t in range(steps):
            z = state @ self.wh
            z += xw[t]
            z += self.b
            np.tanh(z[:, 3 * h :], out=z[:, 3 * h :])
            s = z[:, : 3 * h]
            s *= 0.5
            np.tanh(s, out=s)
            s += 1
            s *= 0.5
            cell = z[:, h : 2 * h] * cell + z[:, :h] * z[:, 3 * h :]
            state = z[:, 2 * h : 3 * h] * np.tanh(cell)
            out[t] = state
            if keep:
                gates[t], cells[t] = z, cell
        if keep:
            self.saved = gates, cells, out
        return out

    def backward(self, dout: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Gradients of ``xw``, ``wh`` and ``b``."""
        gates, cells, out = self.saved
        steps, rows, h = out.shape
        dxw, dwh = np.empty_like(gates), np.zeros_like(self.wh)
        dstate, dcell = np.zeros((rows, h), np.float32), np.zeros((rows, h), np.float32)
        for t in range(steps - 1, -1, -1):
            z, c = gates[t], np.tanh(cells[t])
            i, f, o, g = z[:, :h], z[:, h : 2 * h], z[:, 2 * h : 3 * h], z[:, 3 * h :]
            ds = dout[t] + dstate
            dc = dcell + ds * o * (1 - c * c)
            d = dxw[t]
            d[:, :h] = dc * g * i * (1 - i)
            d[:, h : 2 * h] = dc * cells[t - 1] * f * (1 - f) if t else 0
            d[:, 2 * h : 3 * h] = ds * c * o * (1 - o)
            d[:, 3 * h :] = dc * i * (1 - g * g)
            dcell, dstate = dc * f, d @ self.wh.T
            if t:
                dwh += out[t - 1].T @ d
        return dxw, dwh, dxw.sum(axis=(0, 1))


def _flipped(x: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Each row's own part reversed in place, the padding behind it kept; ``x`` is rows x steps x anything."""
    at = np.arange(x.shape[1])[None, :]
    at = np.where(at < lengths[:, None], lengths[:, None] - 1 - at, at)
    return np.take_along_axis(x, at[:, :, None], axis=1)


class BiLstm:
    """Both directions over padded sequences; outputs stand side by side."""

    def __init__(self, inputs: int, hidden: int, rng: np.random.Generator) -> None:
        self.ahead, self.back = Lstm(inputs, hidden, rng), Lstm(inputs, hidden, rng)

    def parameters(self) -> list[np.ndarray]:
        return [x for d in (self.ahead, self.back) for x in (d.wx, d.wh, d.b)]

    def forward(self, x: np.ndarray, lengths: np.ndarray, keep: bool = True) -> np.ndarray:
        """rows x steps x inputs to rows x steps x 2 hidden."""
        turned = _flipped(x, lengths)
        if keep:
            self.x, self.turned, self.lengths = x, turned, lengths
        one = self.ahead.forward((x @ self.ahead.wx).transpose(1, 0, 2), keep).transpose(1, 0, 2)
        two = self.back.forward((turned @ self.back.wx).transpose(1, 0, 2), keep).transpose(1, 0, 2)
        return np.concatenate([one, _flipped(two, lengths)], axis=2)

    def backward(self, dout: np.ndarray) -> list[np.ndarray]:
        """Gradients in the order of ``parameters``; ``dout`` is zero in the padding."""
        h, grads = self.ahead.h, []
        halves = (self.ahead, self.x, dout[:, :, :h]), (self.back, self.turned, _flipped(dout[:, :, h:], self.lengths))
        for way, x, d in halves:
            dxw, dwh, db = way.backward(np.ascontiguousarray(d.transpose(1, 0, 2)))
            dxw = dxw.transpose(1, 0, 2).reshape(-1, 4 * h)
            grads += [x.reshape(-1, x.shape[2]).T @ dxw, dwh, db]
        return grads


class Adam:
    """Updates parameters in place."""

    def __init__(self, rate: float) -> None:
        self.rate, self.t = rate, 0
        self.m: list[np.ndarray] = []
        self.v: list[np.ndarray] = []

    def step(self, parameters: list[np.ndarray], grads: list[np.ndarray]) -> None:
        if not self.m:
            self.m, self.v = [np.zeros_like(p) for p in parameters], [np.zeros_like(p) for p in parameters]
        self.t += 1
        norm = float(np.sqrt(sum(float(np.square(g).sum()) for g in grads)))
        scale = min(1.0, 5.0 / (norm + 1e-9))
        for p, g, m, v in zip(parameters, grads, self.m, self.v):
            g = np.asarray(g, np.float32).reshape(p.shape) * scale
            m += 0.1 * (g - m)
            v += 0.001 * (g * g - v)
            p -= self.rate * (m / (1 - 0.9**self.t)) / (np.sqrt(v / (1 - 0.999**self.t)) + 1e-8)
