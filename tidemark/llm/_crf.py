"""Linear-chain conditional random fields in numpy: Viterbi and gradients over many chains at once.

A chain is a first position and a length in arrays of positions; all chains advance together, longest first."""

from __future__ import annotations

import numpy as np


def viterbi(emit: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """Best label of every position."""
    out = np.zeros(len(emit), np.int8)
    if not len(first):
        return out
    order = np.argsort(-size, kind="stable")
    first, size = first[order], size[order]
    live = np.searchsorted(-size, -np.arange(1, size[0] + 1), "right")  # chains longer than t
    score = emit[first] + begin
    back = np.zeros(emit.shape, np.int8)  # by position, so that a long chain costs no more than short ones
    for t in range(1, int(size[0])):
        n = live[t]
        old = score[:n]
        best, who = old[:, :1] + step[0], np.zeros((n, emit.shape[1]), np.int8)
        for p in range(1, emit.shape[1]):
            other = old[:, p : p + 1] + step[p]
            better = other > best
            best = np.where(better, other, best)
            who[better] = p
        back[first[:n] + t] = who
        score[:n] = best + emit[first[:n] + t]
    state = score.argmax(1)
    for t in range(int(size[0]) - 1, -1, -1):
        n = live[t]
        out[first[:n] + t] = state[:n]
        if t:
            state[:n] = back[first[:n] + t, state[:n]]
    return out


def viterbi_apart(emit: np.ndarray, first: np.ndarray, size: np.ndarray, step: np.ndarray, begin: np.ndarray) -> np.ndarray:
    """The labels of `viterbi`, faster where most positions have label 0.  A position where 0 leads every other label
    by more than any two neighbours (or ends) can give back has label 0 in every best path; chains are cut behind such
    positions, and the next piece starts from label 0.  Chains follow each other and cover all positions."""
    if not len(first):
        return np.zeros(len(emit), np.int8)
    before = np.maximum((step - step[:, :1]).max(0), begin - begin[0])
    after = np.maximum((step - step[0]).max(1), 0)
    sure = (emit[:, :1] - emit[:, 1:] > (before + after)[1:] + 1e-6).all(1)
    start = np.zeros(len(emit) + 1, bool)
    start[1:] = sure
    start[first] = False
    inner = np.flatnonzero(start[:-1])
    emit = emit.copy()
    emit[inner] += step[0] - begin
    emit[sure, 1:] = -np.inf
    start[first] = True
    piece = np.flatnonzero(start[:-1])
    return viterbi(emit, piece, np.diff(np.concatenate([piece, [len(emit)]])), step, begin)


def _lse(x: np.ndarray, axis: int) -> np.ndarray:
    top = x.max(axis, keepdims=True)
    return np.squeeze(top, axis) + np.log(np.exp(x - top).sum(axis))


def gradient(emit, first, size, step, begin, gold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Gradients of the log likelihood of gold labels by emission, transition and start, by forward-backward."""
    top, k, n = int(size.max()), emit.shape[1], len(first)
    at = np.minimum(first[:, None] + np.arange(top), len(emit) - 1)
    real = np.arange(top) < size[:, None]
    a = np.empty((top, n, k))
    a[0] = emit[at[:, 0]] + begin
    for t in range(1, top):
        a[t] = np.where(real[:, t, None], _lse(a[t - 1][:, :, None] + step, 1) + emit[at[:, t]], a[t - 1])
    z = _lse(a[-1], 1)
    b = np.zeros((top, n, k))
    d_step, d_begin, delta = np.zeros((k, k)), np.zeros(k), np.zeros((len(emit), k))
    for t in range(top - 2, -1, -1):
        inner = step + (emit[at[:, t + 1]] + b[t + 1])[:, None, :]
        b[t] = np.where(real[:, t + 1, None], _lse(inner, 2), b[t + 1])
        d_step -= (np.exp(a[t][:, :, None] + inner - z[:, None, None]) * real[:, t + 1, None, None]).sum(0)
    node = np.exp(a + b - z[:, None]).transpose(1, 0, 2)
    delta[at[real]] = -node[real]
    d_begin -= node[:, 0].sum(0)
    where = at[real]
    delta[where, gold[where]] += 1
    np.add.at(d_begin, gold[first], 1)
    inside = np.zeros(len(emit), bool)
    inside[where] = True
    inside[first] = False
    here = np.flatnonzero(inside)
    np.add.at(d_step, (gold[here - 1], gold[here]), 1)
    return delta, d_step, d_begin


def adam(theta: dict[str, np.ndarray], grads, steps: int, rate: float) -> None:
    """Ascend in place; grads() gives gradients under the same names."""
    m, v = ({p: np.zeros_like(x) for p, x in theta.items()} for _ in range(2))
    for it in range(1, steps + 1):
        for p, g in grads().items():
            m[p], v[p] = 0.9 * m[p] + 0.1 * g, 0.99 * v[p] + 0.01 * g * g
            theta[p] += rate * (1 - it / (steps + 1)) * (m[p] / (1 - 0.9**it)) / (np.sqrt(v[p] / (1 - 0.99**it)) + 1e-8)
