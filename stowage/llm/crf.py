"""A two-label linear-chain conditional random field over many sequences at once.

Only the difference of the two labels' scores matters, so a position carries one number: its emission (label 1 minus
label 0). All sequences of a batch take a step together, longest first; a step is a few NumPy calls over those that are
still running. Messages are log-ratios, exact and safe from overflow for sequences of any length.
"""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np

_CAP = 30.0


@dataclass
class Chain:
    """move[i, j]: score of label j after label i; begin: label 1 minus label 0 at the first position."""

    move: np.ndarray = field(default_factory=lambda: np.zeros((2, 2)))
    begin: float = 0.0


def _steps(at: np.ndarray):
    """The order of sequences, longest first, and for each step how many are still running."""
    n = np.diff(at)
    order = np.argsort(-n, kind="stable")
    longest = int(n.max()) if len(n) else 0
    active = np.searchsorted(-n[order], -np.arange(longest), side="left")
    return at[:-1][order], n[order], active


def _turn(a: np.ndarray, m00: float, m01: float, m10: float, m11: float) -> np.ndarray:
    """log((m01 + m11 r) / (m00 + m10 r)) for r = exp(a)."""
    r = np.exp(np.clip(a, -_CAP, _CAP))
    return np.log((m01 + m11 * r) / (m00 + m10 * r))


def forward(e: np.ndarray, at: np.ndarray, c: Chain) -> np.ndarray:
    """log(alpha(1) / alpha(0)) at each position."""
    first, _, active = _steps(at)
    (m00, m01), (m10, m11) = np.exp(c.move)
    out, a = np.empty(len(e)), None
    for t, k in enumerate(active.tolist()):
        i = first[:k] + t
        a = e[i] + (c.begin if t == 0 else _turn(a[:k], m00, m01, m10, m11))
        out[i] = a
    return out


def backward(e: np.ndarray, at: np.ndarray, c: Chain) -> np.ndarray:
    """log(beta(1) / beta(0)) at each position."""
    first, n, active = _steps(at)
    (m00, m01), (m10, m11) = np.exp(c.move)
    last = first + n - 1
    out, b = np.empty(len(e)), None
    for t, k in enumerate(active.tolist()):
        i = last[:k] - t
        b = np.zeros(k) if t == 0 else _turn(b[:k] + e[i + 1], m00, m10, m01, m11)
        out[i] = b
    return out


def marginals(e: np.ndarray, at: np.ndarray, c: Chain) -> np.ndarray:
    """The probability of label 1 at each position, by forward-backward."""
    return 1 / (1 + np.exp(-np.clip(forward(e, at, c) + backward(e, at, c), -_CAP, _CAP)))


def viterbi(e: np.ndarray, at: np.ndarray, c: Chain) -> np.ndarray:
    """The most likely labels of each sequence; ties go to label 0."""
    first, n, active = _steps(at)
    (m00, m01), (m10, m11) = c.move
    from0, from1 = np.zeros(len(e), np.bool_), np.zeros(len(e), np.bool_)  # whether the best way to label 0 or 1 comes from label 1
    label = np.zeros(len(e), np.bool_)
    v = None
    for t, k in enumerate(active.tolist()):
        i = first[:k] + t
        if t == 0:
            v = e[i] + c.begin
        else:
            v = v[:k]
            from0[i], from1[i] = v + m10 > m00, v + m11 > m01
            v = e[i] + np.maximum(m01, v + m11) - np.maximum(m00, v + m10)
        ends = n[:k] == t + 1
        label[i[ends]] = v[ends] > 0
    for t in range(len(active) - 1, 0, -1):
        i = first[: active[t]] + t
        label[i - 1] = np.where(label[i], from1[i], from0[i])
    return label


def fit(features: list[np.ndarray], size: int, at: np.ndarray, y: np.ndarray, weight: np.ndarray | None = None, rounds: int = 120, rate: float = 0.3, ridge: float = 1e-4):
    """Weights and chain that maximise the likelihood of labels y.

    features: arrays of one feature number for each position (a position's emission is the sum of their weights; the
    number `size` stands for no feature).
    weight: of each position's gradient. Adam over the whole sample.
    """
    n = len(y)
    w, chain = np.zeros(size), Chain()
    given = np.ones(n) if weight is None else weight
    head = np.zeros(n, np.bool_)
    head[at[:-1][np.diff(at) > 0]] = True
    later = np.flatnonzero(~head)
    params = np.zeros(size + 5)
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, rounds + 1):
        w, chain = params[:size], Chain(params[size : size + 4].reshape(2, 2), float(params[-1]))
        padded = np.append(w, 0.0)
        e = sum(padded[f] for f in features)
        a, b = forward(e, at, chain), backward(e, at, chain)
        p = 1 / (1 + np.exp(-np.clip(a + b, -_CAP, _CAP)))
        miss = (y - p) * given
        g = np.zeros_like(params)
        for f in features:
            g[:size] += np.bincount(f, miss, size + 1)[:size]
        if len(later):
            prev, nxt = a[later - 1], e[later] + b[later]
            s = np.stack([np.full(len(later), chain.move[0, 0]), chain.move[0, 1] + nxt, prev + chain.move[1, 0], prev + chain.move[1, 1] + nxt])
            s = np.exp(s - s.max(0))
            s = s / s.sum(0)
            seen = np.bincount((y[later - 1] * 2 + y[later]).astype(np.int64), given[later], 4)
            g[size : size + 4] += seen - (s * given[later]).sum(1)
        g[-1] += miss[head].sum()
        g = g / given.sum() - ridge * params
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params + rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    return params[:size], Chain(params[size : size + 4].reshape(2, 2), float(params[-1]))
