"""BUSTED with all its parts: classes of omega on two sets of branches, synonymous rates that vary over sites, steps of several bases, and an error sink; for one gene, or for many side by side."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame

from clademill.analyses.dataset import Model, fit_model, read_gene
from clademill.analyses.genes import local_patterns
from clademill.analyses.gene_tests import shares_of
from clademill.functions import stats as S
from clademill.kernels.likelihood import Spectrum, total
from clademill.kernels.numeric import flux_shares
from clademill.kernels.optimise import lbfgs
from clademill.model.codes import code


@dataclass(frozen=True)
class Parts:
    """classes: of omega; rate_classes: of synonymous rates, 1 for none; hits: bases that change at once at most; sink: the largest share of errors, 0 for none."""

    classes: int = 3
    rate_classes: int = 1
    hits: int = 1
    sink: float = 0.0

    @property
    def count(self) -> int:
        """Free numbers beside the background model's."""
        return 2 * self.classes - 1 + 2 * (self.rate_classes - 1) + self.hits - 1 + (self.sink > 0)


@dataclass
class Point:
    """Where a likelihood is taken: a mixture for the tested branches and one for the others."""

    test: tuple[np.ndarray, np.ndarray]
    other: tuple[np.ndarray, np.ndarray]
    rates: np.ndarray = field(default_factory=lambda: np.ones(1))
    rate_shares: np.ndarray = field(default_factory=lambda: np.ones(1))
    double: float = 0.0
    triple: float = 0.0
    sink: float = 0.0


class GeneMixture:
    """The likelihood of one gene; its tree and branch lengths stay as the background model has them."""

    def __init__(self, model: Model, patterns: pd.DataFrame, parts: Parts, tested: list[bool] | None = None) -> None:
        self.model, self.parts, self.weights = model, parts, patterns["weight"].to_numpy(float)
        self.pruner, self.pi = model.pruner(patterns), model.mg94.pi
        self.tested = np.array(model.tested if tested is None else tested)
        self.split = not self.tested[1:].all()
        jump = np.repeat(self.pi[None, :], len(self.pi), axis=0)
        np.fill_diagonal(jump, 0.0)
        self.jump = jump / jump.sum(axis=1, keepdims=True)
        self.spectra: dict[tuple[float, float, float], Spectrum] = {}

    def spectrum(self, omega: float, double: float, triple: float) -> Spectrum:
        key = (round(float(omega), 9), round(float(double), 9), round(float(triple), 9))
        if key not in self.spectra:
            if len(self.spectra) > 200:
                self.spectra.clear()
            self.spectra[key] = Spectrum.of(self.model.mg94.multiple(1.0, key[0], key[1], key[2]), self.pi)
        return self.spectra[key]

    def transitions(self, x: Point, rate: float) -> np.ndarray:
        """Of all branches at one synonymous rate."""
        t = self.model.lengths * rate
        mixed = lambda omegas, shares: sum(s * self.spectrum(w, x.double, x.triple).transition(t) for w, s in zip(omegas, shares, strict=True))
        p = mixed(*x.test)
        if self.split:
            p = np.where(self.tested[:, None, None], p, mixed(*x.other))
        return (1 - x.sink) * p + x.sink * self.jump if x.sink > 0 else p

    def by_rate(self, x: Point) -> np.ndarray:
        """[rate class, pattern] log-likelihoods with the class's share."""
        return np.array([self.pruner.log_likelihoods(self.transitions(x, r), self.pi) + math.log(max(v, 1e-300)) for r, v in zip(x.rates, x.rate_shares, strict=True)])

    def site_lnl(self, x: Point) -> np.ndarray:
        each = self.by_rate(x)
        top = each.max(axis=0)
        return top + np.log(np.exp(each - top).sum(axis=0))

    def rate_posteriors(self, x: Point) -> np.ndarray:
        return np.exp(self.by_rate(x) - self.site_lnl(x))

    def lnl(self, x: Point) -> float:
        return total(self.site_lnl(x), self.weights)

    # The order of the free numbers: the tested branches' omegas and cuts, the others' (if there are any), rates and their cuts, several hits, the sink.

    def bounds(self) -> tuple[list[float], list[float], list[float]]:
        """Start, least and most."""
        k, m = self.parts.classes, self.parts.rate_classes
        start, low, high = [], [], []
        for _ in range(1 + self.split):
            start += [*np.linspace(0.05, 0.9, k - 1), 2.0, *[0.5] * (k - 1)]
            low += [*[1e-6] * (k - 1), 1.0, *[1e-4] * (k - 1)]
            high += [*[1.0] * (k - 1), 1000.0, *[1 - 1e-4] * (k - 1)]
        start += [*np.geomspace(0.3, 3.0, m)[: m - 1], *[1 / (m - j) for j in range(m - 1)]]
        low += [*[0.01] * (m - 1), *[1e-3] * (m - 1)]
        high += [*[100.0] * (m - 1), *[1 - 1e-3] * (m - 1)]
        start += [0.05] * (self.parts.hits - 1) + ([self.parts.sink / 4] if self.parts.sink else [])
        low += [0.0] * (self.parts.hits - 1 + (self.parts.sink > 0))
        high += [10.0] * (self.parts.hits - 1) + ([self.parts.sink] if self.parts.sink else [])
        return start, low, high

    def point(self, x: np.ndarray, test_one: bool = False, other_one: bool = False, shared: bool = False) -> Point:
        """test_one, other_one: the last class of that set has omega 1; shared: the others have the tested branches' mixture. The mean synonymous rate is 1."""
        k, m, at = self.parts.classes, self.parts.rate_classes, 0
        sets = []
        for one in (test_one, other_one)[: 1 + self.split]:
            omegas = np.array(x[at : at + k], float)
            if one:
                omegas[-1] = 1.0
            sets.append((omegas, shares_of(x[at + k : at + 2 * k - 1])))
            at += 2 * k - 1
        rates, cuts = np.array([*x[at : at + m - 1], 1.0]), shares_of(x[at + m - 1 : at + 2 * (m - 1)])
        at += 2 * (m - 1)
        hits = [*x[at : at + self.parts.hits - 1], 0.0, 0.0]
        at += self.parts.hits - 1
        sink = float(x[at]) if self.parts.sink else 0.0
        return Point(sets[0], sets[0] if shared else sets[-1], rates / float(rates @ cuts), cuts, float(hits[0]), float(hits[1]), sink)

    def fit(self, starts: list[np.ndarray] | None = None, steps: int = 40, **fixed: bool) -> tuple[np.ndarray, float]:
        first, low, high = self.bounds()
        tried = (lbfgs(lambda x: -self.lnl(self.point(x, **fixed)), s, low, high, steps=steps) for s in (starts or [np.array(first)]))
        x, worst = min(tried, key=lambda r: r[1])
        return x, -worst

    def aicc(self, lnl: float, sets: int, fixed: int = 0) -> float:
        """Fourteen for the background's rates and frequencies and one for its scale come to the mixture's own numbers."""
        k = 15 + self.parts.count + (sets - 1) * (2 * self.parts.classes - 1) - fixed
        n = int(self.weights.sum()) * len(self.model.names)
        return -2 * lnl + 2 * k + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf


def boundary_p(lrt: float) -> float:
    return 0.5 * math.exp(-lrt / 2) if lrt > 0 else 0.5


def busted(model: Model, patterns: pd.DataFrame, parts: Parts = Parts(), tested: list[bool] | None = None, steps: int = 40) -> dict:  # noqa: B008
    """Whether some site of some tested branch has omega above 1: all parts free against the last class at 1. The free fit also begins where the other one ended, so it is never worse."""
    g = GeneMixture(model, patterns, parts, tested)
    null, worse = g.fit(steps=steps, test_one=True)
    null[parts.classes - 1] = 1.0
    best, better = g.fit([np.array(g.bounds()[0]), null], steps)
    x, y = g.point(best), g.point(null, test_one=True)
    lrt = max(0.0, 2 * (better - worse))
    flux = [flux_shares(model.mg94.multiple(1.0, w, x.double, x.triple), g.pi, model.code) for w in x.test[0]]
    whole = sum(s * f["total"] for s, f in zip(x.test[1], flux, strict=True))
    share = lambda kind: float(sum(s * f[kind] for s, f in zip(x.test[1], flux, strict=True)) / whole) if whole > 0 else 0.0
    return {
        "lnl": better, "lnl_null": worse, "lrt": lrt, "p_value": boundary_p(lrt), "aicc": g.aicc(better, 1 + g.split), "aicc_null": g.aicc(worse, 1 + g.split, 1), "classes": parts.classes,
        "omegas": x.test[0].tolist(), "shares": x.test[1].tolist(), "rates": x.rates.tolist(), "rate_shares": x.rate_shares.tolist(), "delta": x.double, "psi": x.triple, "sink": x.sink,
        "share_double": share("double"), "share_triple": share("triple"), "evidence": np.exp(np.clip(g.site_lnl(x) - g.site_lnl(y), -700, 700)).tolist(), "rate_posteriors": g.rate_posteriors(x).T.tolist(),
    }


def busted_by_classes(model: Model, patterns: pd.DataFrame, parts: Parts, most: int = 4, tested: list[bool] | None = None, steps: int = 40) -> dict:
    """busted with two classes and then one more as long as AICc falls."""
    best = busted(model, patterns, Parts(2, parts.rate_classes, parts.hits, parts.sink), tested, steps)
    for k in range(3, most + 1):
        more = busted(model, patterns, Parts(k, parts.rate_classes, parts.hits, parts.sink), tested, steps)
        if more["aicc"] >= best["aicc"]:
            break
        best = more
    return best


def busted_ph(model: Model, patterns: pd.DataFrame, tested: list[bool], parts: Parts = Parts(), steps: int = 40) -> dict:  # noqa: B008
    """Whether selection goes with a phenotype: the tested branches against omega 1, the others against omega 1, and both with one mixture, each against two free mixtures.

    The union-intersection p is the larger of the test of the tested branches and that of two mixtures."""
    g = GeneMixture(model, patterns, parts, tested)
    if not g.split or not g.tested[1:].any():
        raise ValueError("both tested and other branches are needed")
    free, best = g.fit(steps=steps)
    nested = {name: g.fit([np.array(g.bounds()[0]), free], steps, **{name: True}) for name in ("test_one", "other_one", "shared")}
    begins = [np.array(free)]
    for name, (x, _) in nested.items():  # the same place among the free ones
        x = np.array(x)
        k = 2 * parts.classes - 1
        if name == "shared":
            x[k : 2 * k] = x[:k]
        else:
            x[parts.classes - 1 + (k if name == "other_one" else 0)] = 1.0
        begins.append(x)
    free, best = g.fit(begins, steps)
    lrt = {name: max(0.0, 2 * (best - lnl)) for name, (_, lnl) in nested.items()}
    p_test, p_other, p_shared = boundary_p(lrt["test_one"]), boundary_p(lrt["other_one"]), S.chi2_tail(lrt["shared"], 2 * parts.classes - 1)
    x = g.point(free)
    return {
        "lnl": best, "lrt": lrt["test_one"], "p_value": p_test, "background_lrt": lrt["other_one"], "background_p": p_other, "shared_lrt": lrt["shared"], "shared_p": p_shared, "union_p": max(p_test, p_shared),
        "omegas": x.test[0].tolist(), "shares": x.test[1].tolist(), "background_omegas": x.other[0].tolist(), "background_shares": x.other[1].tolist(),
    }


GENES = "dataset_id string, lnl double, lnl_null double, lrt double, p_value double, aicc double, aicc_null double, classes int, omegas array<double>, shares array<double>, rates array<double>, rate_shares array<double>, delta double, psi double, sink double, share_double double, share_triple double, error string"
PHENOTYPES = "dataset_id string, lnl double, lrt double, p_value double, background_lrt double, background_p double, shared_lrt double, shared_p double, union_p double, omegas array<double>, shares array<double>, background_omegas array<double>, background_shares array<double>, error string"


def each_gene(genes: DataFrame, test: Callable[[Model, pd.DataFrame], dict], schema: str, branches: str, genetic_code: str | int, quick: bool, tasks: int | None) -> DataFrame:
    names = [c.split()[0] for c in schema.split(", ")]

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                try:
                    taxa, seqs, tree = read_gene(row.alignment, row.tree)
                    genetic = code(genetic_code)
                    patterns = local_patterns(seqs, genetic)
                    model, _, _ = fit_model(tree, taxa, seqs, genetic, patterns, branches, quick=quick)
                    found = test(model, patterns)
                    yield pd.DataFrame([{n: row.dataset_id if n == "dataset_id" else found.get(n) for n in names}], dtype=object)
                except (ValueError, KeyError, ArithmeticError, np.linalg.LinAlgError, AttributeError) as error:
                    told = {"dataset_id": row.dataset_id, "error": f"{type(error).__name__}: {error}"}
                    yield pd.DataFrame([{n: told.get(n) for n in names}], dtype=object)

    dealt = genes.select("dataset_id", "alignment", "tree").repartition(tasks or genes.sparkSession.sparkContext.defaultParallelism * 3)
    return dealt.mapInPandas(run, schema)


def busted_genes(genes: DataFrame, parts: Parts = Parts(), *, most: int = 0, branches: str = "All", genetic_code: str | int = "Universal", quick: bool = False, steps: int = 40, tasks: int | None = None) -> DataFrame:  # noqa: B008
    """A row for each gene of (dataset_id, alignment, tree), with `most` classes at most by AICc, or parts.classes where it is 0. A gene that can't be fitted has its error."""
    test = (lambda m, p: busted_by_classes(m, p, parts, most, steps=steps)) if most else (lambda m, p: busted(m, p, parts, steps=steps))
    return each_gene(genes, test, GENES, branches, genetic_code, quick, tasks)


def phenotype_genes(genes: DataFrame, branches: str, parts: Parts = Parts(), *, genetic_code: str | int = "Universal", quick: bool = False, steps: int = 40, tasks: int | None = None) -> DataFrame:  # noqa: B008
    """busted_ph of each gene, with the branches that `branches` names as the tested ones."""
    return each_gene(genes, lambda m, p: busted_ph(m, p, m.tested, parts, steps), PHENOTYPES, branches, genetic_code, quick, tasks)
