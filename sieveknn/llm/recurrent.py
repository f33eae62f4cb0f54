"""A bidirectional gated recurrent network over bytes, with training by backpropagation through time; numpy."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

WINDOW = 64  # bytes; the state starts anew in each window
_f = np.float32


def windows(text: bytes, size: int = WINDOW) -> tuple[np.ndarray, np.ndarray]:
    """All bytes of a text as rows of ``size`` bytes, the last one padded, and the rows' lengths."""
    n = -(-len(text) // size)
    rows = np.zeros((n, size), np.uint8)
    rows.reshape(-1)[: len(text)] = np.frombuffer(text, np.uint8)
    lengths = np.full(n, size, np.int32)
    if n:
        lengths[-1] = len(text) - (n - 1) * size
    return rows, lengths


def _sigmoid(x: np.ndarray) -> np.ndarray:
    np.negative(x, out=x)
    np.exp(x, out=x)
    x += 1
    return np.reciprocal(x, out=x)


@dataclass
class Network:
    """Weights: ``inputs`` (256, 3H) and ``state`` (H, 3H) for each direction; gates update, reset, candidate."""

    labels: list[str]
    inputs: list[np.ndarray]
    state: list[np.ndarray]
    bias: list[np.ndarray]
    output: np.ndarray
    output_bias: np.ndarray

    @classmethod
    def fresh(cls, labels: list[str], hidden: int, seed: int = 7) -> Network:
        rng = np.random.default_rng(seed)
        pair = lambda *shape: [rng.normal(0, 0.3, shape).astype(_f) for _ in range(2)]
        return cls(
            labels, pair(256, 3 * hidden), pair(hidden, 3 * hidden), [np.zeros(3 * hidden, _f) for _ in range(2)],
            rng.normal(0, 0.3, (2 * hidden, len(labels))).astype(_f), np.zeros(len(labels), _f),
        )

    def parameters(self) -> list[np.ndarray]:
        return [*self.inputs, *self.state, *self.bias, self.output, self.output_bias]

    def _run(self, rows: np.ndarray, valid: np.ndarray | None, keep: bool):
        """Hidden states (T, B, 2H) and, for training, what each step made."""
        size, n, hidden = rows.shape[1], len(rows), len(self.state[0])
        states = np.empty((size, n, 2 * hidden), _f)
        tape: list = [[None] * size, [None] * size]
        for side in (0, 1):
            table = self.inputs[side] + self.bias[side]
            weights = self.state[side]
            h = np.zeros((n, hidden), _f)
            for t in range(size) if side == 0 else range(size - 1, -1, -1):
                x = table[rows[:, t]]
                u = h @ weights
                gates = _sigmoid(x[:, : 2 * hidden] + u[:, : 2 * hidden])
                z, r = gates[:, :hidden], gates[:, hidden:]
                c = np.tanh(x[:, 2 * hidden :] + r * u[:, 2 * hidden :])
                new = c + z * (h - c)
                if valid is not None:
                    new *= valid[:, t, None]
                if keep:
                    tape[side][t] = (h, z, r, c, u[:, 2 * hidden :])
                h = new
                states[t, :, side * hidden : (side + 1) * hidden] = h
        return states, tape

    def position_probabilities(self, rows: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """(B, T, labels): the label probabilities of every position, 0 where there is no byte."""
        valid = None if (lengths == rows.shape[1]).all() else (np.arange(rows.shape[1]) < lengths[:, None]).astype(_f)
        states, _ = self._run(rows, valid, False)
        p = states @ self.output
        p += self.output_bias
        p -= p.max(axis=2, keepdims=True)
        np.exp(p, out=p)
        p /= p.sum(axis=2, keepdims=True)
        p = p.transpose(1, 0, 2)
        return p if valid is None else p * valid[:, :, None]

    def document_probabilities(self, texts: list[bytes], batch: int = 4096) -> np.ndarray:
        """The mean of the probabilities at all positions of each text; zeros for an empty one."""
        total = np.zeros((len(texts), len(self.labels)))
        cut = [windows(t) for t in texts]
        owner = np.repeat(np.arange(len(texts)), [len(r) for r, _ in cut])
        if not len(owner):
            return total
        rows, lengths = np.concatenate([r for r, _ in cut]), np.concatenate([n for _, n in cut])
        # Whole windows first: they need no mask.
        order = np.argsort(lengths != WINDOW, kind="stable")
        for at in range(0, len(order), batch):
            part = order[at : at + batch]
            np.add.at(total, owner[part], self.position_probabilities(rows[part], lengths[part]).sum(axis=1))
        return total / np.maximum(1, np.bincount(owner, lengths, len(texts)))[:, None]

    def gradients(self, rows: np.ndarray, lengths: np.ndarray, label: np.ndarray) -> tuple[float, list[np.ndarray]]:
        """Mean cross-entropy over all positions and its gradients, backwards through every step."""
        size, n, hidden = rows.shape[1], len(rows), len(self.state[0])
        valid = (np.arange(size) < lengths[:, None]).astype(_f)
        states, tape = self._run(rows, valid, True)
        logits = states @ self.output + self.output_bias
        logits -= logits.max(axis=2, keepdims=True)
        p = np.exp(logits)
        p /= p.sum(axis=2, keepdims=True)
        count = max(1.0, float(valid.sum()))
        weight = valid.T / count
        right = p[:, np.arange(n), label]
        loss = float(-(np.log(right + 1e-9) * weight).sum())
        p[:, np.arange(n), label] -= 1
        p *= weight[:, :, None]
        d_output = np.einsum("tbh,tbl->hl", states, p, optimize=True)
        d_states = p @ self.output.T
        out: list[list[np.ndarray]] = [[], [], []]
        for side in (0, 1):
            weights = self.state[side]
            d_in, d_state = np.zeros_like(self.inputs[side]), np.zeros_like(weights)
            dh = np.zeros((n, hidden), _f)
            for t in range(size - 1, -1, -1) if side == 0 else range(size):
                h, z, r, c, un = tape[side][t]
                dh = (dh + d_states[t, :, side * hidden : (side + 1) * hidden]) * valid[:, t, None]
                dc = dh * (1 - z) * (1 - c * c)
                dz = dh * (h - c) * z * (1 - z)
                dr = dc * un * r * (1 - r)
                du = np.concatenate([dz, dr, dc * r], axis=1)
                dx = np.concatenate([dz, dr, dc], axis=1)
                np.add.at(d_in, rows[:, t], dx)
                d_state += h.T @ du
                dh = dh * z + du @ weights.T
            out[0].append(d_in)
            out[1].append(d_state)
            out[2].append(d_in.sum(axis=0))
        return loss, [*out[0], *out[1], *out[2], d_output, p.sum(axis=(0, 1))]


def train(labels: list[str], rows: np.ndarray, lengths: np.ndarray, target: np.ndarray, hidden: int, steps: int, batch: int = 256, rate: float = 0.02) -> Network:
    """Adam on batches that hold every label equally often."""
    net = Network.fresh(labels, hidden)
    rng = np.random.default_rng(11)
    by_label = [np.flatnonzero(target == k) for k in range(len(labels))]
    moments = [(np.zeros_like(p), np.zeros_like(p)) for p in net.parameters()]
    for step in range(1, steps + 1):
        pick = np.concatenate([rng.choice(rows_of, max(1, batch // len(labels))) for rows_of in by_label if len(rows_of)])
        _, grads = net.gradients(rows[pick], lengths[pick], target[pick])
        norm = np.sqrt(sum(float((g * g).sum()) for g in grads))
        scale = min(1.0, 1.0 / (norm + 1e-9))
        speed = rate * (1 - 0.9 * step / steps)
        for p, g, (m, v) in zip(net.parameters(), grads, moments, strict=True):
            g = (g * scale).astype(_f)
            m += 0.1 * (g - m)
            v += 0.01 * (g * g - v)
            p -= speed * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
    return net
