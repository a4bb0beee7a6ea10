"""Continuous-time Markov models on a tree, for many site patterns at once."""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache

import numpy as np

from clademill.kernels.optimise import brent, lbfgs
from clademill.model.codes import BASES, IUPAC, GeneticCode
from clademill.sources.parsers import Tree

SMALL = 1e-150


@dataclass
class Spectrum:
    """A reversible generator by its eigen-system: transition matrices of any length at the cost of a product."""

    values: np.ndarray
    left: np.ndarray
    right: np.ndarray

    @classmethod
    def of(cls, q: np.ndarray, pi: np.ndarray) -> Spectrum:
        root = np.sqrt(pi)
        values, vectors = np.linalg.eigh((root[:, None] * q / root[None, :] + (root[:, None] * q / root[None, :]).T) / 2)
        return cls(values, vectors / root[:, None], vectors.T * root[None, :])

    def transition(self, t: np.ndarray) -> np.ndarray:
        """[branch, from, to] for lengths t."""
        return np.maximum((self.left[None] * np.exp(np.multiply.outer(t, self.values))[:, None, :]) @ self.right, 0.0)

    def move(self, t: float, vectors: np.ndarray) -> np.ndarray:
        """A transition matrix times vectors, without the matrix: much cheaper for few patterns."""
        return np.maximum(self.left @ (np.exp(self.values * t)[:, None] * (self.right @ vectors)), 0.0)


def diagonal(q: np.ndarray) -> np.ndarray:
    np.fill_diagonal(q, 0.0)
    np.fill_diagonal(q, -q.sum(axis=1))
    return q


def gtr(rates: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """Rates AC, AG, AT, CG, CT, GT; scaled to one substitution a unit of time."""
    q = np.zeros((4, 4))
    q[np.triu_indices(4, 1)] = rates
    q = diagonal((q + q.T) * pi[None, :])
    return q / -(pi @ np.diag(q))


@lru_cache(8)
def _codon_pairs(code: GeneticCode) -> tuple[np.ndarray, ...]:
    """For one-base steps between sense codons: from, to, pair of bases (as in gtr), place and base gone to, and whether it is synonymous."""
    out = []
    order = {frozenset(p): k for k, p in enumerate((("A", "C"), ("A", "G"), ("A", "T"), ("C", "G"), ("C", "T"), ("G", "T")))}
    for i, x in enumerate(code.sense):
        for j, y in enumerate(code.sense):
            differ = [k for k in range(3) if x[k] != y[k]]
            if len(differ) == 1:
                k = differ[0]
                out.append((i, j, order[frozenset((x[k], y[k]))], k, BASES.index(y[k]), code.aa[i] == code.aa[j]))
    return tuple(np.array(c) for c in zip(*out, strict=True))


@lru_cache(8)
def codon_letters(code: GeneticCode) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bases of each sense codon by number, how many places each two differ in, and whether they have one amino acid."""
    letters = np.array([[BASES.index(b) for b in c] for c in code.sense])
    amino = np.array(list(code.aa))
    return letters, (letters[:, None, :] != letters[None, :, :]).sum(axis=2), amino[:, None] == amino[None, :]


@dataclass
class MG94:
    """Codon model of one-base steps: exchange rate x target frequency x alpha if synonymous, else beta."""

    code: GeneticCode
    rates: np.ndarray
    positions: np.ndarray
    pi: np.ndarray

    def parts(self) -> tuple[np.ndarray, np.ndarray]:
        """Generators of the synonymous and of the other steps, without diagonals."""
        i, j, pair, place, base, same = _codon_pairs(self.code)
        value = self.rates[pair] * self.positions[place, base]
        syn, non = np.zeros((2, self.code.size, self.code.size))
        syn[i[same], j[same]] = value[same]
        non[i[~same], j[~same]] = value[~same]
        return syn, non

    def generator(self, alpha: float, beta: float) -> np.ndarray:
        syn, non = self.parts()
        return diagonal(alpha * syn + beta * non)

    def multiple(self, alpha: float, beta: float, double: float = 0.0, triple: float = 0.0, pairs: np.ndarray | None = None) -> np.ndarray:
        """The generator with steps of two and three bases at once: the product of their one-base rates times `double` or `triple`. pairs: factors of single synonymous steps."""
        letters, places, same = codon_letters(self.code)
        exchange = np.ones((4, 4))
        exchange[np.triu_indices(4, 1)] = self.rates
        exchange = np.triu(exchange, 1) + np.triu(exchange, 1).T
        q = np.ones((self.code.size, self.code.size))
        for k in range(3):
            step = exchange * self.positions[k][None, :]
            np.fill_diagonal(step, 1.0)
            q *= step[letters[:, k][:, None], letters[:, k][None, :]]
        q *= np.array([0.0, 1.0, double, triple])[places] * np.where(same, alpha, beta)
        if pairs is not None:
            q *= np.where((places == 1) & same, pairs, 1.0)
        return diagonal(q)

    def scale(self, omega: float = 1.0) -> float:
        """Expected substitutions of a codon in a unit of time."""
        return float(-(self.pi @ np.diag(self.generator(1.0, omega))))

    def spectrum(self, alpha: float, beta: float) -> Spectrum:
        return Spectrum.of(self.generator(alpha, beta), self.pi)


def leaf_vectors(states: np.ndarray, masks: np.ndarray, size: int) -> np.ndarray:
    """[taxon, state, pattern] from resolved states, or from bit masks where a state is -1."""
    bits = (masks[:, None, :] >> np.arange(size, dtype=np.int64)[None, :, None]) & 1
    return np.where(states[:, None, :] >= 0, states[:, None, :] == np.arange(size)[None, :, None], bits).astype(float)


class Pruner:
    """The tree's order of work, and leaf vectors of all patterns."""

    def __init__(self, tree: Tree, names: list[str], leaves: np.ndarray) -> None:
        self.tree = tree
        number = {n: k for k, n in enumerate(names)} | {n.lower(): k for k, n in reversed(list(enumerate(names)))}
        self.leaf = {k: leaves[number[n] if (n := tree.nodes[k].name) in number else number[n.lower()]] for k in tree.leaves()}
        self.order = tree.postorder()
        self.patterns = leaves.shape[2]

    def below(self, p: np.ndarray) -> tuple[list[np.ndarray], np.ndarray]:
        """Conditional vectors of all nodes, and the logarithm of what was divided out. p: [node, from, to]."""
        down: list = [None] * len(self.tree.nodes)
        log = np.zeros(self.patterns)
        for k in self.order:
            n = self.tree.nodes[k]
            if n.leaf:
                down[k] = self.leaf[k]
                continue
            value = p[n.children[0]] @ down[n.children[0]]
            for c in n.children[1:]:
                value = value * (p[c] @ down[c])
            top = value.max(axis=0)
            if (top < SMALL).any():
                top = np.where((top > 0) & (top < SMALL), top, 1.0)
                value = value / top
                log += np.log(top)
            down[k] = value
        return down, log

    def lnl_by(self, move, pi: np.ndarray) -> np.ndarray:
        """Log-likelihoods with move(node, vectors) in the place of a matrix for each branch."""
        down: list = [None] * len(self.tree.nodes)
        log = np.zeros(self.patterns)
        for k in self.order:
            n = self.tree.nodes[k]
            if n.leaf:
                value = self.leaf[k]
            else:
                value = down[n.children[0]]
                for c in n.children[1:]:
                    value = value * down[c]
                top = value.max(axis=0)
                top = np.where(top > 0, top, 1.0)
                value = value / top
                log += np.log(top)
            down[k] = move(k, value) if k else value
        return np.log(np.maximum(pi @ down[0], 1e-300)) + log

    def log_likelihoods(self, p: np.ndarray, pi: np.ndarray) -> np.ndarray:
        down, log = self.below(p)
        return np.log(np.maximum(pi @ down[0], 1e-300)) + log

    def above(self, p: np.ndarray, down: list[np.ndarray], pi: np.ndarray) -> list[np.ndarray]:
        """For each branch, the vector at its upper end of all that isn't below it; scaled freely."""
        up: list = [None] * len(self.tree.nodes)
        outer: list = [None] * len(self.tree.nodes)
        outer[0] = np.repeat(pi[:, None], self.patterns, axis=1)
        for k in reversed(self.order):
            n = self.tree.nodes[k]
            for c in n.children:
                value = outer[k]
                for s in n.children:
                    if s != c:
                        value = value * (p[s] @ down[s])
                value = value / np.maximum(value.max(axis=0), 1e-300)
                up[c] = value
                outer[c] = p[c].T @ value
        return up


def total(values: np.ndarray, weights: np.ndarray) -> float:
    """Weighted sum in the patterns' order, without loss."""
    import math

    return math.fsum((values * weights).tolist())


def fit_lengths(pruner: Pruner, spectrum: Spectrum, q: np.ndarray, pi: np.ndarray, weights: np.ndarray, t: np.ndarray, steps: int = 60) -> tuple[np.ndarray, float]:
    """Branch lengths by L-BFGS on their logarithms, with exact gradients from the vectors below and above each branch."""
    n = len(pruner.tree.nodes)

    def value(x: np.ndarray) -> float:
        return -total(pruner.log_likelihoods(spectrum.transition(np.exp(x)), pi), weights)

    def slope(x: np.ndarray) -> np.ndarray:
        t = np.exp(x)
        p = spectrum.transition(t)
        down, _ = pruner.below(p)
        up = pruner.above(p, down, pi)
        out = np.zeros(n)
        for k in range(1, n):
            moved = p[k] @ down[k]
            out[k] = -t[k] * (((up[k] * (q @ moved)).sum(axis=0) / np.maximum((up[k] * moved).sum(axis=0), 1e-300)) @ weights)
        return out

    x, best = lbfgs(value, np.log(np.maximum(t, 1e-6)), np.full(n, np.log(1e-7)), np.full(n, np.log(20.0)), grad=slope, steps=steps)
    return np.exp(x), -best


@dataclass
class Fit:
    """A fitted model: what kernels get."""

    lnl: float
    rates: np.ndarray
    lengths: np.ndarray
    omega: float = 1.0
    model: MG94 | None = None


def nucleotide_leaves(seqs: list[str]) -> np.ndarray:
    table = np.ones((256, 4))
    for c, options in IUPAC.items():
        for x in (c, c.lower()):
            table[ord(x)] = [b in options for b in BASES]
    return table[np.frombuffer("".join(seqs).encode("latin-1", "replace"), np.uint8).reshape(len(seqs), -1)].transpose(0, 2, 1)


def _unique(leaves: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    flat = leaves.reshape(-1, leaves.shape[2])
    _, first, n = np.unique(flat, axis=1, return_index=True, return_counts=True)
    return leaves[:, :, np.sort(first)], n[np.argsort(first)].astype(float)


def fit_gtr(tree: Tree, names: list[str], seqs: list[str], pi: np.ndarray, turns: int = 6) -> Fit:
    """Exchange rates (AG fixed at 1) and branch lengths in turn."""
    leaves, weights = _unique(nucleotide_leaves(seqs))
    pruner = Pruner(tree, names, leaves)
    rates = np.array([0.5, 1, 0.3, 0.3, 1, 0.3])
    t = np.array([0.1 if n.length is None else max(n.length, 1e-4) for n in tree.nodes])
    free = [0, 2, 3, 4, 5]
    last = -np.inf
    lnl = last
    for _ in range(turns):
        q = gtr(rates, pi)
        t, lnl = fit_lengths(pruner, Spectrum.of(q, pi), q, pi, weights, t)

        def value(x: np.ndarray, t: np.ndarray = t) -> float:
            r = np.ones(6)
            r[free] = np.exp(x)
            return -total(pruner.log_likelihoods(Spectrum.of(gtr(r, pi), pi).transition(t), pi), weights)

        x, best = lbfgs(value, np.log(rates[free]), [-7] * 5, [5] * 5, steps=20)
        rates = np.ones(6)
        rates[free] = np.exp(x)
        lnl = -best
        if lnl - last < 1e-4:
            break
        last = lnl
    return Fit(lnl, rates, t)


def fit_mg94(tree: Tree, names: list[str], leaves: np.ndarray, weights: np.ndarray, model: MG94, t: np.ndarray, turns: int = 5) -> Fit:
    """One omega and the branch lengths (in the model's own time) in turn. t: nucleotide lengths to begin with."""
    pruner = Pruner(tree, names, leaves)
    t = t * 3 / model.scale()
    omega, lnl, last = 0.3, -np.inf, -np.inf
    for _ in range(turns):
        value = lambda x, t=t: -total(pruner.log_likelihoods(model.spectrum(1.0, x).transition(t), model.pi), weights)
        omega, _ = brent(value, 1e-4, 20.0, tol=1e-5, start=omega)
        q = model.generator(1.0, omega)
        t, lnl = fit_lengths(pruner, Spectrum.of(q, model.pi), q, model.pi, weights, t)
        if lnl - last < 1e-3:
            break
        last = lnl
    return Fit(lnl, model.rates, t, omega, model)
