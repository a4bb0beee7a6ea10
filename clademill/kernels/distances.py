"""Pairwise distances, neighbour joining and resistance distances."""

from __future__ import annotations

import math

import numpy as np

from clademill.sources.parsers import quote

_CODE = np.full(256, 4, np.int64)
for _k, _b in enumerate("ACGT"):
    _CODE[ord(_b)] = _CODE[ord(_b.lower())] = _k
_CODE[ord("U")] = _CODE[ord("u")] = 3


def base_shares(seqs: list[str]) -> np.ndarray:
    """Shares of A, C, G, T over all resolved places of all sequences."""
    n = sum((np.bincount(_CODE[np.frombuffer(s.encode("latin-1", "replace"), np.uint8)], minlength=5)[:4] for s in seqs), np.zeros(4))
    return n / n.sum() if n.sum() else np.full(4, 0.25)


def tn93(one: str, two: str, pi: np.ndarray | None = None, floor: float = 0.02) -> float:
    """Tamura-Nei distance over places where both are resolved, with the base shares `pi` of the whole alignment (of this pair if None). The arguments of its logarithms are kept at `floor`
    or more, so diverged pairs have a large distance and not none; where a base is missing altogether, all bases count as equally frequent."""
    a, b = (_CODE[np.frombuffer(x.encode("latin-1"), np.uint8)] for x in (one, two))
    both = (a < 4) & (b < 4)
    n = int(both.sum())
    if not n:
        return 1.0
    table = np.bincount(a[both] * 4 + b[both], minlength=16).reshape(4, 4).astype(float)
    f = base_shares([one, two]) if pi is None else np.asarray(pi, float)
    if f.min() <= 1e-6:
        f = np.full(4, 0.25)
    p1, p2 = (table[0, 2] + table[2, 0]) / n, (table[1, 3] + table[3, 1]) / n
    q = 1 - np.trace(table) / n - p1 - p2
    r, y = f[0] + f[2], f[1] + f[3]
    k1, k2, k3 = 2 * f[0] * f[2] / r, 2 * f[1] * f[3] / y, 2 * (r * y - f[0] * f[2] * y / r - f[1] * f[3] * r / y)
    x1, x2, x3 = (max(floor, x) for x in (1 - p1 / k1 - q / (2 * r), 1 - p2 / k2 - q / (2 * y), 1 - q / (2 * r * y)))
    return max(0.0, -k1 * math.log(x1) - k2 * math.log(x2) - k3 * math.log(x3))


def hamming(one: str, two: str) -> float:
    a, b = (_CODE[np.frombuffer(x.encode("latin-1"), np.uint8)] for x in (one, two))
    both = (a < 4) & (b < 4)
    return float((a != b)[both].mean()) if both.any() else 0.0


def tn93_matrix(seqs: list[str]) -> np.ndarray:
    """All distances of an alignment, with the base shares of all its sequences."""
    n, pi = len(seqs), base_shares(seqs)
    out = np.zeros((n, n))
    for i in range(n):
        for j in range(i + 1, n):
            out[i, j] = out[j, i] = tn93(seqs[i], seqs[j], pi)
    return out


def neighbour_joining(d: np.ndarray, names: list[str]) -> str:
    """An unrooted tree as Newick; negative lengths become 0."""
    d = d.astype(float).copy()
    parts = [quote(n) for n in names]
    if len(parts) == 2:
        return f"({parts[0]}:{d[0, 1] / 2:.8g},{parts[1]}:{d[0, 1] / 2:.8g});"
    while len(parts) > 3:
        n = len(parts)
        sums = d.sum(axis=1)
        score = (n - 2) * d - sums[:, None] - sums[None, :]
        np.fill_diagonal(score, np.inf)
        i, j = sorted(divmod(int(np.argmin(score)), n))
        left = d[i, j] / 2 + (sums[i] - sums[j]) / (2 * (n - 2))
        joined = f"({parts[i]}:{max(0.0, left):.8g},{parts[j]}:{max(0.0, d[i, j] - left):.8g})"
        row = (d[i] + d[j] - d[i, j]) / 2
        keep = [k for k in range(n) if k not in (i, j)]
        grown = np.zeros((n - 1, n - 1))
        grown[:-1, :-1] = d[np.ix_(keep, keep)]
        grown[-1, :-1] = grown[:-1, -1] = row[keep]
        d, parts = grown, [parts[k] for k in keep] + [joined]
    x = [(d[0, 1] + d[0, 2] - d[1, 2]) / 2, (d[0, 1] + d[1, 2] - d[0, 2]) / 2, (d[0, 2] + d[1, 2] - d[0, 1]) / 2]
    return "(" + ",".join(f"{p}:{max(0.0, v):.8g}" for p, v in zip(parts, x, strict=True)) + ");"


def resistance(d: np.ndarray, scale: float | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Conductances exp(-d / scale) / (d + 1e-6), effective resistances, and the probability of each edge in a random spanning tree; those sum to n - 1."""
    n = len(d)
    pairs = d[np.triu_indices(n, 1)]
    scale = scale or float(np.median(pairs)) or 1.0
    w = np.exp(-d / scale) / (d + 1e-6)
    np.fill_diagonal(w, 0)
    inverse = np.linalg.pinv(np.diag(w.sum(axis=1)) - w)
    omega = np.diag(inverse)[:, None] + np.diag(inverse)[None, :] - 2 * inverse
    return w, omega, w * omega
