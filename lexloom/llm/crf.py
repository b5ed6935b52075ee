"""A linear-chain conditional random field over dense features, for ragged batches in numpy.

All sequences of a batch advance together, longest first, so a step costs a few array
operations whatever the number of sequences.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class ChainCRF:
    weight: np.ndarray  # labels x features, the last feature is constant
    move: np.ndarray  # labels x labels
    mean: np.ndarray
    scale: np.ndarray

    def _emit(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weight[:, :-1].T + self.weight[:, -1]

    def marginals(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each position's label probabilities."""
        return _forward_backward(self._emit(x), self.move, offsets)[0]

    def viterbi(self, x: np.ndarray, offsets: np.ndarray) -> np.ndarray:
        """Each position's label on its sequence's best path; ties go to the lower label."""
        emit = self._emit(x)
        steps = _steps(offsets)
        best, back = emit.copy(), np.zeros(emit.shape, np.int64)
        for before, here in steps[1:]:
            options = best[before][:, :, None] + self.move[None]
            back[here] = options.argmax(1)
            best[here] = options.max(1) + emit[here]
        out = np.zeros(len(x), np.int64)
        lengths = np.diff(offsets)
        last = offsets[1:][lengths > 0] - 1
        out[last] = best[last].argmax(1)
        for before, here in reversed(steps[1:]):
            out[before] = back[here, out[here]]
        return out


def _steps(offsets: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For each place t the positions at t-1 and t of all sequences longer than t."""
    lengths = np.diff(offsets)
    order = np.argsort(-lengths, kind="stable")
    starts, lengths = offsets[:-1][order], lengths[order]
    out = []
    for t in range(int(lengths[0]) if len(lengths) else 0):
        n = int(np.searchsorted(-lengths, -t, "left"))
        out.append((starts[:n] + t - 1, starts[:n] + t))
    return out


def _forward_backward(emit: np.ndarray, move: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, float]:
    """Label marginals, summed pair marginals and the log likelihood's normaliser."""
    top = emit.max(1, keepdims=True) if len(emit) else emit
    psi, step = np.exp(emit - top), np.exp(move)
    alpha, norm = psi.copy(), np.ones(len(emit))
    steps = _steps(offsets)
    for t, (before, here) in enumerate(steps):
        a = psi[here] if t == 0 else (alpha[before] @ step) * psi[here]
        norm[here] = a.sum(1)
        alpha[here] = a / norm[here][:, None]
    beta, pairs = np.ones(emit.shape), np.zeros(move.shape)
    for before, here in reversed(steps[1:]):
        b = beta[here] * psi[here]
        beta[before] = (b @ step.T) / norm[here][:, None]
        pairs += np.einsum("ni,ij,nj->ij", alpha[before], step, b / norm[here][:, None])
    both = alpha * beta
    return both / both.sum(1, keepdims=True) if len(emit) else both, pairs, float(np.log(norm).sum() + top.sum())


def fit(x: np.ndarray, y: np.ndarray, offsets: np.ndarray, labels: int = 2, l2: float = 1e-3, rounds: int = 200, rate: float = 0.1) -> ChainCRF:
    """Maximum likelihood with a ridge by Adam over the whole sample; the same sample gives the same model."""
    mean, scale = x.mean(0), x.std(0)
    scale = np.where(scale > 1e-6, scale, 1.0)
    z = np.c_[(x - mean) / scale, np.ones(len(x))]
    hot = np.eye(labels)[y]
    inner = np.ones(len(y), bool)
    inner[offsets[:-1][np.diff(offsets) > 0]] = False
    at = np.flatnonzero(inner)
    seen = np.zeros((labels, labels))
    np.add.at(seen, (y[at - 1], y[at]), 1)
    params = [np.zeros((labels, z.shape[1])), np.zeros((labels, labels))]
    first, second = [np.zeros_like(p) for p in params], [np.zeros_like(p) for p in params]
    for r in range(1, rounds + 1):
        share, pairs, _ = _forward_backward(z @ params[0].T, params[1], offsets)
        grads = [(share - hot).T @ z / len(y) + l2 * params[0], (pairs - seen) / len(y) + l2 * params[1]]
        for k, g in enumerate(grads):
            first[k] = 0.9 * first[k] + 0.1 * g
            second[k] = 0.999 * second[k] + 0.001 * g * g
            params[k] = params[k] - rate * (first[k] / (1 - 0.9**r)) / (np.sqrt(second[k] / (1 - 0.999**r)) + 1e-8)
    return ChainCRF(params[0], params[1], mean, scale)
