"""A linear-chain conditional random field over lines: content or boilerplate.

Trained in numpy by gradient ascent on the regularised likelihood (forward-backward), decoded with
Viterbi; both run over many documents at once, one line position at a time.
"""

from __future__ import annotations

import numpy as np

BOILERPLATE, CONTENT = 0, 1


def _log_sum(a: np.ndarray, axis: int) -> np.ndarray:
    top = a.max(axis=axis, keepdims=True)
    return (top + np.log(np.exp(a - top).sum(axis=axis, keepdims=True))).squeeze(axis)


def padded(features: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Documents' line features as (documents, lines, features), and their numbers of lines."""
    sizes = np.array([len(f) for f in features], np.int64)
    width = features[0].shape[1] if features else 0
    x = np.zeros((len(features), int(sizes.max(initial=0)), width))
    for i, f in enumerate(features):
        x[i, : len(f)] = f
    return x, sizes


def train(features: list[np.ndarray], labels: list[np.ndarray], steps: int = 200, rate: float = 0.1, decay: float = 1e-3) -> dict[str, np.ndarray]:
    """Weights (features, 2), transitions (2, 2) and start scores (2,), by Adam on the mean log-likelihood of a line."""
    x, sizes = padded(features)
    n, t, width = x.shape
    y = np.zeros((n, t), np.int64)
    for i, v in enumerate(labels):
        y[i, : len(v)] = v
    live = np.arange(t)[None, :] < sizes[:, None]
    total = max(1, int(sizes.sum()))
    p = {"w": np.zeros((width, 2)), "a": np.zeros((2, 2)), "s": np.zeros(2)}
    m, v = {k: np.zeros_like(q) for k, q in p.items()}, {k: np.zeros_like(q) for k, q in p.items()}
    hot = np.eye(2)[y] * live[:, :, None]
    seen = {"w": np.einsum("ntf,ntk->fk", x, hot), "a": np.einsum("nti,ntj->ij", hot[:, :-1], hot[:, 1:]), "s": hot[:, 0].sum(0)}
    for step in range(1, steps + 1):
        emit = x @ p["w"]
        alpha, beta = np.zeros((n, t, 2)), np.zeros((n, t, 2))
        alpha[:, 0] = p["s"] + emit[:, 0]
        for k in range(1, t):
            ahead = _log_sum(alpha[:, k - 1, :, None] + p["a"][None], 1) + emit[:, k]
            alpha[:, k] = np.where(live[:, k, None], ahead, alpha[:, k - 1])
        for k in range(t - 2, -1, -1):
            back = _log_sum(p["a"][None] + (emit[:, k + 1] + beta[:, k + 1])[:, None, :], 2)
            beta[:, k] = np.where(live[:, k + 1, None], back, 0)
        z = _log_sum(alpha[:, -1], 1)
        node = np.exp(alpha + beta - z[:, None, None]) * live[:, :, None]
        edge = np.exp(alpha[:, :-1, :, None] + p["a"] + (emit + beta)[:, 1:, None, :] - z[:, None, None, None]) * live[:, 1:, None, None]
        want = {"w": np.einsum("ntf,ntk->fk", x, node), "a": edge.sum((0, 1)), "s": node[:, 0].sum(0)}
        for key, q in p.items():
            g = (seen[key] - want[key]) / total - decay * q
            m[key] = 0.9 * m[key] + 0.1 * g
            v[key] = 0.999 * v[key] + 0.001 * g * g
            q += rate * (m[key] / (1 - 0.9**step)) / (np.sqrt(v[key] / (1 - 0.999**step)) + 1e-8)
    return p


def viterbi(model: dict[str, np.ndarray], features: list[np.ndarray]) -> list[np.ndarray]:
    """The best label sequence of each document; of equal ones, content."""
    if not features:
        return []
    sizes = np.array([len(f) for f in features])
    order = np.argsort(-sizes, kind="stable")
    starts = np.concatenate([[0], np.cumsum(sizes)])
    emit = np.concatenate(features) @ model["w"]
    back = np.zeros((len(emit), 2), np.int8)
    best = np.zeros((len(features), 2))
    for k in range(int(sizes.max(initial=0))):
        at = order[: np.searchsorted(-sizes[order], -k, side="left")]  # documents with more than k lines
        rows = starts[at] + k
        if k == 0:
            best[at] = model["s"] + emit[rows]
            continue
        step = best[at][:, :, None] + model["a"][None]
        from_content = step[:, 1] >= step[:, 0]
        back[rows] = from_content
        best[at] = np.where(from_content, step[:, 1], step[:, 0]) + emit[rows]
    out = []
    for i, n in enumerate(sizes):
        labels = np.zeros(n, np.int8)
        state = int(best[i, 1] >= best[i, 0]) if n else 0
        for k in range(n - 1, -1, -1):
            labels[k] = state
            state = int(back[starts[i] + k, state])
        out.append(labels)
    return out
