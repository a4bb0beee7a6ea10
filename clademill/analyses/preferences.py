"""Models of one site each: the codon model informed by measured preferences, and forecasts from a site's own rates."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from clademill.analyses.dataset import Dataset, Model
from clademill.analyses.property_scan import AMINO, MOST, PROPERTIES, scaled
from clademill.functions import stats as S
from clademill.kernels.likelihood import MG94, Pruner, Spectrum, codon_letters, diagonal
from clademill.kernels.optimise import brent, lbfgs
from clademill.kernels.posteriors import node_posteriors
from clademill.model.codes import BASES, GeneticCode
from clademill.plans.helpers import with_model

# The ratios that a site is tried with.
OMEGAS = [0.001, 0.01, 0.05, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0, 1.2, 1.5, 2.0, 3.0, 5.0, 10.0, 100.0]
ALIKE = 1e-9


@dataclass
class Informed:
    """Mutation by base shares phi and kappa; fixation by a site's preferences to the power beta, and omega where the amino acid changes. Lengths are the tree's own."""

    model: Model
    phi: np.ndarray
    beta: float = 1.0
    omega: float = 1.0
    kappa: float = 2.0

    def spectrum(self, preferences: dict[str, float], omega: float | None = None) -> tuple[Spectrum, np.ndarray]:
        """Of one site, with its stationary shares."""
        c = self.model.code
        letters, places, same = codon_letters(c)
        # The base that a step of one base goes to, and whether it is a transition (A, C, G, T are 0 .. 3).
        moved = letters[:, None, :] != letters[None, :, :]
        to = (np.where(moved, self.phi[letters][None, :, :], 1.0)).prod(axis=2)
        transition = (moved & (np.abs(letters[:, None, :] - letters[None, :, :]) == 2)).any(axis=2)
        worth = self.beta * np.log(np.maximum([preferences[a] for a in c.aa], 1e-12))
        gain = worth[None, :] - worth[:, None]
        near = np.abs(gain) < ALIKE
        fixed = np.where(near, 1.0, gain / -np.expm1(-np.where(near, 1.0, np.clip(gain, -600, 600))))
        q = (places == 1) * to * np.where(transition, self.kappa, 1.0) * np.where(same, 1.0, (self.omega if omega is None else omega) * fixed)
        pi = np.exp(worth - worth.max()) * self.phi[letters].prod(axis=1)
        pi = np.maximum(pi / pi.sum(), 1e-15)
        return Spectrum.of(diagonal(q), pi), pi

    def lnl(self, pruner: Pruner, preferences: dict[str, float], omega: float | None = None, rate: float = 1.0) -> float:
        """Of the one pattern that the pruner has."""
        spectrum, pi = self.spectrum(preferences, omega)
        return float(pruner.lnl_by(lambda k, v: spectrum.move(self.model.lengths[k] * rate, v), pi)[0])


def _site_rows(data: Dataset, preferences: DataFrame) -> DataFrame:
    """(site, states, masks, preferences) for sites from 1, from rows of (site, preferences map)."""
    patterns = data.patterns()
    sites = patterns.select("states", "masks", F.explode("sites").alias("site")).withColumn("site", F.col("site") + 1)
    return sites.join(preferences.select("site", "preferences"), "site")


def fit_informed(data: Dataset, model: Model, preferences: DataFrame, *, beta: float | None = None, omega: float | None = None, kappa: float | None = None, steps: int = 30) -> tuple[Informed, float]:
    """beta, omega and kappa of one gene (those given stay fixed) and the log-likelihood. One gene's sites are on the driver for it; scan_informed has the sites in tasks."""
    rows = _site_rows(data, preferences).orderBy("site").toPandas()
    if len(rows) != min(map(len, data.seqs)) // 3:
        raise ValueError(f"preferences for {len(rows)} of {min(map(len, data.seqs)) // 3} sites")
    counts = np.array([sum(s.count(b) for s in data.seqs) for b in BASES], float)
    phi = np.maximum(counts / counts.sum(), 1e-8)
    pruners = [(model.pruner(rows.iloc[k : k + 1]), dict(p)) for k, p in enumerate(rows["preferences"])]
    given = [beta, omega, kappa]
    free = [k for k, v in enumerate(given) if v is None]

    def informed(x: np.ndarray) -> Informed:
        values = list(given)
        for k, v in zip(free, x, strict=True):
            values[k] = math.exp(v)
        return Informed(model, phi / phi.sum(), *values)

    def value(x: np.ndarray) -> float:
        m = informed(x)
        return -math.fsum(m.lnl(p, pref) for p, pref in pruners)

    if not free:
        return informed(np.array([])), -value(np.array([]))
    start = [math.log((1.0, 1.0, 2.0)[k]) for k in free]
    x, best = lbfgs(value, start, [math.log(1e-3)] * len(free), [math.log(100.0)] * len(free), steps=steps)
    return informed(x), -best


def _scan(informed: Informed, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for k in range(len(rows)):
        row = rows.iloc[k : k + 1]
        pruner, pref = informed.model.pruner(row), dict(row["preferences"].iloc[0])
        null = informed.lnl(pruner, pref, 1.0)
        each = [informed.lnl(pruner, pref, w) for w in OMEGAS]
        at = max(range(len(OMEGAS)), key=lambda j: (each[j], OMEGAS[j] == 1.0))
        omega, best = OMEGAS[at], each[at]
        if best > null + 1e-9:
            low, high = OMEGAS[max(at - 1, 0)], OMEGAS[min(at + 1, len(OMEGAS) - 1)]
            x, lost = brent(lambda v, pruner=pruner, pref=pref: -informed.lnl(pruner, pref, math.exp(v)), math.log(low), math.log(high), tol=1e-5, start=math.log(omega))
            if -lost > best:
                omega, best = math.exp(x), -lost
        else:
            omega, best = 1.0, null
        out.append((int(row["site"].iloc[0]), omega, best, null, max(0.0, 2 * (best - null))))
    return pd.DataFrame(out, columns=["site", "omega", "lnl", "lnl_null", "lrt"])


def scan_informed(data: Dataset, informed: Informed, preferences: DataFrame) -> DataFrame:
    """(site, omega, lnl, lnl_null, lrt, p_value, q_value): each site's omega given its preferences, from 20 ratios and then between the neighbours of the best, against 1. Sites are dealt over tasks."""
    tasks = data.spark.sparkContext.defaultParallelism * 3
    found = with_model(_site_rows(data, preferences), informed, _scan, "site int, omega double, lnl double, lnl_null double, lrt double", tasks)
    return S.benjamini_hochberg(found.withColumn("p_value", S.chi2_sf(F.col("lrt"), 1)), "p_value", [], ["site"], "q_value")


def tilted(mg94: MG94, alpha: float, beta: float, push: np.ndarray, phi: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(Q, stationary shares) of one site: non-synonymous steps are slowed by exp(-M tanh(push / M)) and turned towards amino acids of larger phi (of each codon) by the square root of their ratio.

    The shares are the model's times phi, and Q is reversible for them."""
    phi = np.maximum(phi, 1e-12)
    syn, non = mg94.parts()
    q = alpha * syn + beta * non * np.exp(-MOST * np.tanh(push / MOST)) * np.sqrt(phi[None, :] / phi[:, None])
    pi = np.maximum(mg94.pi, 1e-12) * phi
    return diagonal(q), pi / pi.sum()


@dataclass(frozen=True)
class Outlook:
    """horizon: expected substitutions of a codon under the gene's omega; the weights of the gene's omega in a site's, of background rates, of background shares among ancestors; the power that ancestors' shares turn rates with."""

    horizon: float = 0.05
    omega_weight: float = 0.05
    rate_weight: float = 0.02
    pseudo: float = 0.05
    power: float = 0.5


@dataclass
class _Ahead:
    model: Model
    outlook: Outlook
    focal: int | None
    tables: list[np.ndarray]
    names: list[str]


FORECAST = "site int, focal string, root string, effective_omega double, entropy double, changes double, dms array<double>, stationary array<double>, ancestral array<double>, rates array<double>, log_p array<double>"


def _by_amino(values: np.ndarray, c: GeneticCode) -> np.ndarray:
    out = np.zeros(len(AMINO))
    np.add.at(out, [AMINO.index(a) for a in c.aa], values)
    return out


def _forecast(a: _Ahead, rows: pd.DataFrame) -> pd.DataFrame:
    m, o, c = a.model, a.outlook, a.model.code
    kinds = np.array([AMINO.index(x) for x in c.aa])
    usual = np.maximum(_by_amino(m.mg94.pi, c), 1e-8)
    usual = usual / usual.sum()
    time = max(o.horizon, 0.0) / m.mg94.scale(m.omega)
    out = []
    for k in range(len(rows)):
        row = rows.iloc[k]
        alpha, beta, lambdas = float(row["alpha"]), float(row["beta"]), dict(row["lambdas"] or {})
        far = sum((lambdas.get(n, 0.0) * np.abs(t[:, None] - t[None, :]) for n, t in zip(a.names, a.tables, strict=True)), np.zeros((len(AMINO), len(AMINO))))
        push = far[kinds[:, None], kinds[None, :]]
        still = alpha == 0 and beta == 0
        q, pi = tilted(m.mg94, max(alpha, 1e-4), max(beta, 1e-4 * m.omega), push, np.ones(c.size))
        p = Spectrum.of(q, pi).transition(m.lengths * (1e-4 if still else 1.0))
        posts = node_posteriors(m.pruner(rows.iloc[k : k + 1]), p, pi)
        inner = [n for n in range(len(m.tree.nodes)) if not m.tree.nodes[n].leaf]
        ancestors = np.mean([posts[n][:, 0] for n in inner], axis=0)
        amino = _by_amino(ancestors, c)
        amino = amino / amino.sum()
        ratio = np.clip((amino + o.pseudo * usual) / (1 + o.pseudo) / usual, 1e-6, 1e6)
        phi = ratio**o.power if o.power > 0 else np.ones(len(AMINO))
        q, pi = tilted(m.mg94, alpha + o.rate_weight, beta + o.rate_weight * m.omega, push, phi[kinds])
        ahead = Spectrum.of(q, pi).transition(np.array([time]))[0]
        ahead = ahead / ahead.sum(axis=1, keepdims=True)
        seen = -1 if a.focal is None else int(row["states"][a.focal])
        focal = seen if seen >= 0 else int(np.argmax(ancestors))
        omega = (beta + o.omega_weight * m.omega) / (alpha + o.omega_weight)
        own = kinds[focal]
        dms = math.log(max(omega, 1e-12)) - MOST * np.tanh(far[own] / MOST) + 0.5 * np.log(np.maximum(phi, 1e-12) / max(phi[own], 1e-12))
        dms[own] = 0.0
        shares = _by_amino(pi, c)
        entropy = -float((shares * np.log(np.maximum(shares, 1e-15))).sum())
        rates = np.maximum(q[focal], 0.0)
        rates[focal] = 0.0
        log_p = np.log(np.maximum(ahead[focal], 1e-300))
        out.append((int(row["site"]), c.sense[focal], c.sense[int(np.argmax(posts[0][:, 0]))], omega, entropy, float(1 - ahead[focal, focal]), dms.tolist(), shares.tolist(), amino.tolist(), rates.tolist(), log_p.tolist()))
    return pd.DataFrame(out, columns=[f.split()[0] for f in FORECAST.split(", ")])


def forecast(data: Dataset, model: Model, sites: DataFrame, reference: str | None = None, outlook: Outlook = Outlook(), properties: dict[str, list[float]] = PROPERTIES) -> DataFrame:  # noqa: B008
    """What comes next at each site, from its rates: sites has (site from 1, alpha, beta, lambdas), as property_scan gives them.

    Of each: the codon it starts from (that of `reference`, or the likeliest ancestor's), the log-fitness of each amino acid against its own (`dms`, in the order of AMINO), the long-run and the ancestors' shares of amino
    acids, the rate to each codon and the log-probability of each codon at the horizon (in the order of the code's sense codons). Sites are dealt over tasks."""
    focal = None if reference is None else data.names.index(reference)
    names = sorted(properties)
    shared = _Ahead(model, outlook, focal, [scaled(properties[n]) for n in names], names)
    patterns = data.patterns()
    rows = patterns.select("states", "masks", F.explode("sites").alias("site")).withColumn("site", F.col("site") + 1).join(sites.select("site", "alpha", "beta", "lambdas"), "site")
    return with_model(rows, shared, _forecast, FORECAST, data.spark.sparkContext.defaultParallelism * 3)


def amino_rows(forecasts: DataFrame, column: str = "dms") -> DataFrame:
    """(site, aa, value) of one of the columns by amino acid."""
    names: Column = F.array(*map(F.lit, AMINO))
    return forecasts.select("site", F.explode(F.arrays_zip(names.alias("aa"), F.col(column).alias("value"))).alias("x")).select("site", "x.aa", "x.value")


def codon_rows(forecasts: DataFrame, genetic: GeneticCode, column: str = "log_p") -> DataFrame:
    """(site, codon, value) of one of the columns by codon."""
    names: Column = F.array(*map(F.lit, genetic.sense))
    return forecasts.select("site", F.explode(F.arrays_zip(names.alias("codon"), F.col(column).alias("value"))).alias("x")).select("site", "x.codon", "x.value")
