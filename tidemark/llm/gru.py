"""A bidirectional gated recurrent network with attention pooling, in numpy.

A word enters as its own vector (if the vocabulary has it) beside the mean vector of its hashed character
trigrams and the mean vector of its hashed beginnings. Two gated recurrences read a window of words in both directions, attention pools their states, and
one logit comes out. Gradients are written out by hand; Adam trains all parts.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np

BUCKETS = 4096
F32 = np.float32


def _spread(x: np.ndarray) -> np.ndarray:
    return ((x * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(52)).astype(np.int64)


class Lists:
    """Lists of bucket numbers end to end: ``flat`` and the size of each (at least one) list."""

    def __init__(self, flat: np.ndarray, sizes: np.ndarray):
        self.flat, self.sizes, self.starts = flat, sizes, np.cumsum(sizes) - sizes

    def take(self, rows: np.ndarray) -> Lists:
        sizes = self.sizes[rows]
        at = np.repeat(self.starts[rows] - (np.cumsum(sizes) - sizes), sizes) + np.arange(sizes.sum())
        return Lists(self.flat[at], sizes)


def characters(words: list[str], longest: int = 9) -> tuple[Lists, Lists]:
    """Of each word, the buckets of its character trigrams between marks of its ends, and of its first 2 to ``longest``
    characters (of a shorter word, its only beginning)."""
    codes = np.frombuffer("".join(f"^{w}$" for w in words).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    sizes = np.array([len(w) for w in words], np.int64) + 2
    starts = np.cumsum(sizes) - sizes
    # A trigram begins at every place but a word's last two; an empty word's one list entry is its pair of marks.
    n_tri = np.maximum(1, sizes - 2)
    at = np.repeat(starts - (np.cumsum(n_tri) - n_tri), n_tri) + np.arange(n_tri.sum())
    padded = np.concatenate([codes, np.zeros(2, np.uint64)])
    three = (padded[at] * np.uint64(2654435761) ^ padded[at + 1] * np.uint64(40503)) * np.uint64(31) + padded[at + 2]
    short = np.repeat(sizes, n_tri) < 3
    three[short] = 0
    power = np.cumprod(np.full(longest, 0x100000001B3, np.uint64), dtype=np.uint64)
    n_begin = np.maximum(1, np.minimum(longest, sizes - 2) - 1)
    owner = np.repeat(np.arange(len(words)), n_begin)
    upto = np.arange(n_begin.sum()) - np.repeat(np.cumsum(n_begin) - n_begin, n_begin) + 2
    table = np.zeros((len(words), longest), np.uint64)
    for i in range(longest):
        has = sizes - 2 > i
        table[has, i] = padded[starts[has] + 1 + i] * power[i]
    sums = np.cumsum(table, axis=1, dtype=np.uint64)
    begin = sums[owner, np.minimum(upto, longest) - 1] + np.minimum(upto, np.maximum(sizes - 2, 1)[owner]).astype(np.uint64)
    return Lists(_spread(three), n_tri), Lists(_spread(begin), n_begin)


def fresh(vocabulary: int, hidden: int = 10, word_dim: int = 10, char_dim: int = 8, seed: int = 7) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    wide = word_dim + 2 * char_dim

    def normal(*shape, scale):
        return (rng.standard_normal(shape) * scale).astype(F32)

    p = {"Ew": normal(vocabulary + 1, word_dim, scale=0.1), "Ec": normal(BUCKETS, char_dim, scale=0.3), "Eb": normal(BUCKETS, char_dim, scale=0.3)}
    for d in "fb":
        p |= {f"W{d}": normal(wide, 3 * hidden, scale=wide**-0.5), f"U{d}": normal(hidden, 3 * hidden, scale=hidden**-0.5), f"c{d}": np.zeros(3 * hidden, F32)}
    p |= {"A": normal(2 * hidden, hidden, scale=(2 * hidden) ** -0.5), "v": normal(hidden, scale=0.5), "o": normal(2 * hidden, scale=0.3), "b": np.zeros(1, F32)}
    p["Ew"][0] = 0
    return p


def _means(table: np.ndarray, lists: Lists) -> np.ndarray:
    """Mean vector of each list of rows."""
    if not len(lists.sizes):
        return np.zeros((0, table.shape[1]), F32)
    return np.add.reduceat(table[lists.flat], lists.starts, axis=0) / lists.sizes[:, None].astype(F32)


def _gathered_sums(n: int, index: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Sums of the values with each index below ``n``."""
    order = np.argsort(index, kind="stable")
    ordered = index[order]
    starts = np.flatnonzero(np.append(True, ordered[1:] != ordered[:-1]))
    out = np.zeros((n, values.shape[1]), values.dtype)
    out[ordered[starts]] = np.add.reduceat(values[order], starts, axis=0)
    return out


def inputs(p: dict, word_ids: np.ndarray, chars: tuple[Lists, Lists]) -> np.ndarray:
    """Input vectors of word types."""
    return np.concatenate([p["Ew"][word_ids], _means(p["Ec"], chars[0]), _means(p["Eb"], chars[1])], 1)


def _gates(g: np.ndarray, h: np.ndarray, u: np.ndarray, k: int):
    a = h @ u
    zr = np.tanh((g[:, : 2 * k] + a[:, : 2 * k]) * F32(0.5)) * F32(0.5) + F32(0.5)
    z, r = zr[:, :k], zr[:, k:]
    n = np.tanh(g[:, 2 * k :] + r * a[:, 2 * k :])
    return z, r, n, a[:, 2 * k :]


def forward(p: dict, gx: dict[str, np.ndarray], idx: np.ndarray, mask: np.ndarray, keep: bool = False):
    """Logits of windows. ``gx``: projected inputs by word type for each direction; ``idx`` (windows, steps) names types."""
    b, steps = idx.shape
    k = p["v"].shape[0]
    states = np.empty((steps, b, 2 * k), F32)
    tape = {"f": [None] * steps, "b": [None] * steps}
    for d, order in (("f", range(steps)), ("b", range(steps - 1, -1, -1))):
        h, at = np.zeros((b, k), F32), slice(0, k) if d == "f" else slice(k, 2 * k)
        for t in order:
            z, r, n, un = _gates(gx[d][idx[:, t]], h, p[f"U{d}"], k)
            before = h
            h = n + z * (h - n)
            if d == "b":  # padding is behind the words: their state must not move
                h *= mask[:, t, None]
            states[t, :, at] = h
            if keep:
                tape[d][t] = (before, z, r, n, un)
    q = np.tanh(states @ p["A"])
    e = np.where(mask.T > 0, q @ p["v"], F32(-1e9))
    e = np.exp(e - e.max(0))
    alpha = e / e.sum(0)
    pooled = (alpha[:, :, None] * states).sum(0)
    logit = pooled @ p["o"] + p["b"][0]
    return (logit, (states, tape, q, alpha, pooled)) if keep else logit


def backward(p: dict, gx: dict, idx: np.ndarray, mask: np.ndarray, saved, dlogit: np.ndarray) -> tuple[dict, dict]:
    """Gradients of the parameters above the inputs, and of ``gx``."""
    states, tape, q, alpha, pooled = saved
    steps, b, kk = states.shape
    k = kk // 2
    g = {"o": pooled.T @ dlogit, "b": dlogit.sum(keepdims=True)}
    dpool = dlogit[:, None] * p["o"]
    dstates = alpha[:, :, None] * dpool
    dalpha = (states * dpool).sum(2)
    de = alpha * (dalpha - (alpha * dalpha).sum(0))
    g["v"] = (q * de[:, :, None]).sum((0, 1))
    dq = de[:, :, None] * p["v"] * (1 - q * q)
    g["A"] = np.einsum("tbi,tbj->ij", states, dq, optimize=True)
    dstates = dstates + dq @ p["A"].T
    dgx = {}
    for d, order in (("f", range(steps - 1, -1, -1)), ("b", range(steps))):
        at, u = slice(0, k) if d == "f" else slice(k, 2 * k), p[f"U{d}"]
        du, dh, dg = np.zeros_like(u), np.zeros((b, k), F32), np.empty((b, steps, 3 * k), F32)
        for t in order:
            before, z, r, n, un = tape[d][t]
            dh = dh + dstates[t, :, at]
            if d == "b":
                dh = dh * mask[:, t, None]
            dn = dh * (1 - z) * (1 - n * n)
            dz = dh * (before - n) * z * (1 - z)
            dr = dn * un * r * (1 - r)
            da = np.concatenate([dz, dr, dn * r], 1)
            du += before.T @ da
            dg[:, t] = np.concatenate([dz, dr, dn], 1)
            dh = dh * z + da @ u.T
        g[f"U{d}"], dgx[d] = du, _gathered_sums(len(gx[d]), idx.ravel(), dg.reshape(b * steps, 3 * k))
    return g, dgx


class Adam:
    def __init__(self, p: dict, rate: float):
        self.p, self.rate, self.n = p, rate, 0
        self.m, self.v = {k: np.zeros_like(x) for k, x in p.items()}, {k: np.zeros_like(x) for k, x in p.items()}

    def step(self, g: dict) -> None:
        self.n += 1
        for k, x in g.items():
            self.m[k] += F32(0.1) * (x - self.m[k])
            self.v[k] += F32(0.01) * (x * x - self.v[k])
            self.p[k] -= F32(self.rate) * (self.m[k] / F32(1 - 0.9**self.n)) / (np.sqrt(self.v[k] / F32(1 - 0.99**self.n)) + F32(1e-7))


def windows(lengths: np.ndarray, size: int, stride: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All overlapping windows: document number, first word (over all documents), number of words. Every word is in one."""
    lengths = np.asarray(lengths, np.int64)
    per = np.where(lengths > 0, np.maximum(0, -(-(lengths - size) // stride)) + 1, 0)
    doc = np.repeat(np.arange(len(lengths)), per)
    order = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per)
    first = order * stride
    return doc, first + np.repeat(np.cumsum(lengths) - lengths, per), np.minimum(size, lengths[doc] - first)


def gathered(types: np.ndarray, first: np.ndarray, count: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(windows, size) word types, type 0 behind the words, and the mask."""
    steps = np.arange(size)
    mask = steps[None, :] < count[:, None]
    at = np.minimum(first[:, None] + steps, max(0, len(types) - 1))
    return np.where(mask, types[at], 0), mask.astype(F32)


def epochs(p: dict, word_ids: np.ndarray, chars: tuple[Lists, Lists], idx: np.ndarray, mask: np.ndarray, y: np.ndarray, weight: np.ndarray, n: int, rate: float, batch: int = 128, drop: float = 0.1, seed: int = 3) -> Iterator[float]:
    """Train on windows for ``n`` epochs; yields the mean loss of each."""
    rng, adam = np.random.default_rng(seed), Adam(p, rate)
    for _ in range(n):
        order, total = rng.permutation(len(idx)), 0.0
        for at in range(0, len(order), batch):
            rows = order[at : at + batch]
            types, local = np.unique(idx[rows], return_inverse=True)
            local, m, w = local.reshape(len(rows), -1), mask[rows], weight[rows]
            ids = np.where(rng.random(len(types)) < drop, 0, word_ids[types])  # at times a word has its characters alone
            lists = [c.take(types) for c in chars]
            x = inputs(p, ids, lists)
            gx = {d: x @ p[f"W{d}"] + p[f"c{d}"] for d in "fb"}
            logit, saved = forward(p, gx, local, m, keep=True)
            prob = 1 / (1 + np.exp(-logit))
            total += float((w * (np.logaddexp(0, logit) - y[rows] * logit)).sum())
            g, dgx = backward(p, gx, local, m, saved, ((prob - y[rows]) * w / len(rows)).astype(F32))
            dx = sum(dgx[d] @ p[f"W{d}"].T for d in "fb")
            for d in "fb":
                g[f"W{d}"], g[f"c{d}"] = x.T @ dgx[d], dgx[d].sum(0)
            wide = p["Ew"].shape[1]
            g["Ew"] = _gathered_sums(len(p["Ew"]), ids, np.ascontiguousarray(dx[:, :wide]))
            g["Ew"][0] = 0
            for i, k in enumerate(("Ec", "Eb")):
                at_k = wide + i * p[k].shape[1]
                share = dx[:, at_k : at_k + p[k].shape[1]] / lists[i].sizes[:, None].astype(F32)
                g[k] = _gathered_sums(len(p[k]), lists[i].flat, np.repeat(share, lists[i].sizes, axis=0))
            for k in ("Ew", "Ec", "Eb"):
                g[k] += F32(1e-5) * p[k]
            adam.step(g)
        yield total / max(1, len(order))
