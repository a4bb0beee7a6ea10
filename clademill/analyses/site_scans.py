"""Site by site analyses: FEL, contrast-FEL, MEME, FUBAR, SLAC.

Each evaluates the distinct site patterns in parallel with the broadcast model and expands the results to sites."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.analyses.dataset import Dataset, Model, by_site
from clademill.functions import stats as S
from clademill.kernels.likelihood import Pruner, Spectrum, diagonal
from clademill.kernels.optimise import brent, nelder_mead
from clademill.operators.alignment import invariant
from clademill.plans.helpers import early_out, with_model

LOW, HIGH = 1e-4, 1000.0
# Where the two rates of a site start; a choice of our own.
STARTS = [(1.0, 1.0), (0.1, 0.1), (1.0, 0.1), (0.1, 1.0), (1.0, 3.0), (3.0, 1.0), (0.5, 0.25), (0.05, 0.01), (0.25, 2.0), (2.0, 0.05), (5.0, 5.0), (0.01, 0.5)]


class SiteRates:
    """Likelihood of one pattern under rates of its own; eigen-systems are kept for the ratio last seen."""

    def __init__(self, model: Model, pruner: Pruner) -> None:
        self.model, self.pruner = model, pruner
        self.syn, self.non = model.mg94.parts()
        self.seen: dict[float, Spectrum] = {}

    def spectrum(self, ratio: float) -> Spectrum:
        """For beta / alpha = ratio, with alpha 1; time is scaled by alpha."""
        if ratio not in self.seen:
            if len(self.seen) > 64:
                self.seen.clear()
            self.seen[ratio] = Spectrum.of(diagonal(self.syn + ratio * self.non), self.model.mg94.pi)
        return self.seen[ratio]

    def transitions(self, alpha: float, beta: float) -> np.ndarray:
        alpha = max(alpha, 1e-6)
        return self.spectrum(round(beta / alpha, 10)).transition(self.model.lengths * alpha)

    def mover(self, alpha: float, beta: float):
        alpha = max(alpha, 1e-6)
        spectrum, t = self.spectrum(round(beta / alpha, 10)), self.model.lengths * alpha
        return lambda k, v: spectrum.move(t[k], v)

    def lnl(self, alpha: float, beta: float, background: float | None = None) -> float:
        move = self.mover(alpha, beta)
        if background is not None:
            other, on, test = self.mover(alpha, background), self.model.tested, move
            move = lambda k, v: (test if on[k] else other)(k, v)
        return float(self.pruner.lnl_by(move, self.model.mg94.pi)[0])


FEL_SCHEMA = "pattern_id int, alpha double, beta double, beta_background double, alpha_null double, lnl double, lnl_null double, lrt double"


def _fel(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    split = not all(model.tested[1:])
    for _, row in rows.iterrows():
        site = SiteRates(model, model.pruner(pd.DataFrame([row])))
        starts = sorted(STARTS, key=lambda s, site=site: -site.lnl(s[0], s[1], s[1] if split else None))
        if split:
            (a, b, c), best = nelder_mead(lambda x: -site.lnl(x[0], x[1], x[2]), (*starts[0], starts[0][1]), [LOW] * 3, [HIGH] * 3)
            null = nelder_mead(lambda x: -site.lnl(x[0], x[0], x[1]), ((a + b) / 2, c), [LOW] * 2, [HIGH] * 2)
            shared, rest = null[0][0], null[1]
        else:
            (a, b), best = nelder_mead(lambda x: -site.lnl(x[0], x[1]), starts[0], [LOW] * 2, [HIGH] * 2)
            c = b
            begin = (min(a, 100) + 3 * min(b, 100)) / 4
            shared, rest = min((brent(lambda x: -site.lnl(x, x), LOW, 50.0, tol=1e-4, start=s) for s in (begin, 0.1, 1.0)), key=lambda r: r[1])
        out.append((int(row["pattern_id"]), a, b, c, shared, -best, -rest, max(0.0, 2 * (rest - best))))
    return pd.DataFrame(out, columns=[c.split()[0] for c in FEL_SCHEMA.split(", ")])


def fel(data: Dataset, model: Model, p: float = 0.1) -> DataFrame:
    """(site, alpha, beta, alpha_null, lrt, p_value, q_value, total_length, classification): whether a site's rates differ. Sites that never vary have no rates and p 1."""
    patterns = data.patterns().cache()
    zero = {c: F.lit(0.0) for c in ("alpha", "beta", "beta_background", "alpha_null", "lnl", "lnl_null", "lrt")}
    tasks = data.spark.sparkContext.defaultParallelism * 3
    found = early_out(patterns.select("pattern_id", "states", "masks"), invariant(), zero, lambda df: with_model(df, model, _fel, FEL_SCHEMA, tasks))
    sites = by_site(found, patterns).withColumn("p_value", S.chi2_sf(F.col("lrt"), 1))
    sites = S.benjamini_hochberg(sites, "p_value", [], ["site"], "q_value")
    label = F.when(F.col("p_value") > p, "neutral").when(F.col("beta") > F.col("alpha"), "diversifying").otherwise("purifying")
    baseline = float(model.lengths[1:].sum() * model.mg94.scale(model.omega) / 3)
    return sites.select("site", "alpha", "beta", "beta_background", "alpha_null", "lrt", "p_value", "q_value", (F.col("alpha_null") * baseline).alias("total_length"), label.alias("classification"))


MEME_SCHEMA = "pattern_id int, alpha double, beta_neg double, beta_pos double, p_pos double, lnl double, lnl_null double, lrt double, branch_ebf map<string,double>"


def _meme(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
    out = []
    for _, row in rows.iterrows():
        site = SiteRates(model, model.pruner(pd.DataFrame([row])))
        pi = model.mg94.pi

        def value(x: np.ndarray, cap: float | None, site=site) -> float:
            """x: alpha, the lower ratio, the upper ratio, the lower one's inverse share. Branches that aren't tested have the upper rate."""
            low, high = site.mover(x[0], x[1] * x[0]), site.mover(x[0], (x[2] if cap is None else min(cap, x[2])) * x[0])
            move = lambda k, v: (1 - x[3]) * low(k, v) + x[3] * high(k, v) if model.tested[k] else high(k, v)
            return -float(site.pruner.lnl_by(move, model.mg94.pi)[0])

        starts = [(1.0, 0.3, 2.0, 0.3), (0.5, 0.01, 20.0, 0.05)]
        best = min((nelder_mead(lambda x: value(x, None), s, [LOW, 0, 0, 1e-6], [100, 1, HIGH, 1 - 1e-6], steps=120) for s in starts), key=lambda r: r[1])
        x = best[0]
        null = min((nelder_mead(lambda y: value(y, 1.0), s, [LOW, 0, 0, 1e-6], [100, 1, 1, 1 - 1e-6], steps=80) for s in ((x[0], x[1], 1.0, x[3]), (1.0, 0.2, 1.0, 0.5))), key=lambda r: r[1])
        factors = {}
        if 2 * (null[1] - best[1]) > 0 and x[2] > 1:
            one, two = site.transitions(x[0], x[1] * x[0]), site.transitions(x[0], x[0] * x[2])
            p = np.where(np.array(model.tested)[:, None, None], (1 - x[3]) * one + x[3] * two, two)
            down, _ = site.pruner.below(p)
            up = site.pruner.above(p, down, pi)
            for k in range(1, len(model.tree.nodes)):
                if model.tested[k]:
                    a, b = (float((up[k][:, 0] * (m[k] @ down[k][:, 0])).sum()) for m in (two, one))
                    factors[model.tree.nodes[k].name or f"Node{k}"] = math.exp(min(50.0, max(-50.0, math.log(max(a, 1e-300)) - math.log(max(b, 1e-300)))))
        out.append((int(row["pattern_id"]), x[0], x[1] * x[0], x[0] * x[2], x[3], -best[1], -null[1], max(0.0, 2 * (null[1] - best[1])), factors))
    return pd.DataFrame(out, columns=[c.split()[0] for c in MEME_SCHEMA.split(", ")])


def meme(data: Dataset, model: Model, p: float = 0.1) -> DataFrame:
    """Episodic selection: two classes of branches at a site. (site, alpha, beta_neg, beta_pos, p_pos, lrt, p_value, q_value, branches, branch_ebf, classification)."""
    patterns = data.patterns().cache()
    const = {c: F.lit(0.0) for c in ("alpha", "beta_neg", "beta_pos", "p_pos", "lnl", "lnl_null", "lrt")} | {"branch_ebf": F.create_map().cast("map<string,double>")}
    tasks = data.spark.sparkContext.defaultParallelism * 3
    found = early_out(patterns.select("pattern_id", "states", "masks"), invariant(), const, lambda df: with_model(df, model, _meme, MEME_SCHEMA, tasks))
    fixed = patterns.select("pattern_id", invariant().alias("_fixed"))
    sites = by_site(found.join(fixed, "pattern_id"), patterns)
    value = F.when(F.col("_fixed"), 1.0).otherwise(S.mixture_p(F.col("lrt"), "meme"))  # 2 / 3 at a variable site whose ratio is 0
    sites = S.benjamini_hochberg(sites.withColumn("p_value", value), "p_value", [], ["site"], "q_value")
    strong = F.size(F.filter(F.map_values("branch_ebf"), lambda v: v >= 100)).alias("branches")
    return sites.select("site", "alpha", "beta_neg", "beta_pos", "p_pos", "lrt", "p_value", "q_value", strong, "branch_ebf", F.when(F.col("p_value") <= p, "episodic").otherwise("neutral").alias("classification"))


def fubar_grid(size: int = 20) -> list[tuple[float, float]]:
    """Rates 0 to 1 in even steps for seven tenths, then cubes up to 50; all pairs."""
    size = max(5, size)
    below = math.floor(size * 0.7 + 0.5)
    above = size - below
    step = 49 ** (1 / 3) / above
    rates = [k / below for k in range(below - 1)] + [1.0] + [1 + (step * k) ** 3 for k in range(1, above + 1)]
    return [(a, b) for a in rates for b in rates]


def _fubar(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
    pruner = model.pruner(rows)
    site = SiteRates(model, pruner)
    grid = fubar_grid()
    table = np.array([pruner.log_likelihoods(site.transitions(a, b), model.mg94.pi) for a, b in grid])
    return pd.DataFrame({"pattern_id": rows["pattern_id"].to_numpy(np.int32), "lnl": list(table.T)})


def variational_weights(conditional: np.ndarray, weights: np.ndarray, concentration: float = 0.5) -> np.ndarray:
    """Grid weights by the fixed point of counts: w <- c + the sites' expected shares, until the change is below 1e-8. conditional: [grid, pattern], relative likelihoods."""
    w = (conditional * weights).sum(axis=1)
    w /= w.sum()
    for _ in range(100_000):
        share = w[:, None] * conditional
        new = concentration + (share / share.sum(axis=0) * weights).sum(axis=1)
        new /= new.sum()
        moved, w = np.abs(new - w).sum(), new
        if moved < 1e-8:
            break
    return w


def fubar(data: Dataset, model: Model, posterior: float = 0.9) -> DataFrame:
    """Posterior rates over a grid with weights learnt from all sites. (site, alpha, beta, p_negative, p_positive, bayes_factor, classification)."""
    patterns = data.patterns().cache()
    found = with_model(patterns.select("pattern_id", "states", "masks"), model, _fubar, "pattern_id int, lnl array<double>", data.spark.sparkContext.defaultParallelism)
    rows = found.join(patterns.select("pattern_id", "weight"), "pattern_id").orderBy("pattern_id").toPandas()  # the grid by the patterns of one alignment
    table = np.array(rows["lnl"].tolist()).T
    conditional = np.exp(table - table.max(axis=0))
    w = variational_weights(conditional, rows["weight"].to_numpy(float))
    share = w[:, None] * conditional
    share /= share.sum(axis=0)
    a, b = np.array(fubar_grid()).T
    positive, negative = share[b > a].sum(axis=0), share[b < a].sum(axis=0)
    prior = w[b > a].sum()
    factor = np.where(positive >= 1, 1e6, positive / np.maximum(1 - positive, 1e-300) / (prior / max(1 - prior, 1e-300)))
    out = pd.DataFrame({"pattern_id": rows["pattern_id"], "alpha": a @ share, "beta": b @ share, "p_negative": negative, "p_positive": positive, "bayes_factor": factor})
    sites = by_site(data.spark.createDataFrame(out, "pattern_id int, alpha double, beta double, p_negative double, p_positive double, bayes_factor double"), patterns)
    label = F.when(F.col("p_positive") >= posterior, "diversifying").when(F.col("p_negative") >= posterior, "purifying").otherwise("neutral")
    return sites.select("site", "alpha", "beta", "p_negative", "p_positive", "bayes_factor", label.alias("classification"))


def codon_sites(model: Model) -> tuple[np.ndarray, np.ndarray]:
    """Expected synonymous and other one-base steps from each codon, of three."""
    code = model.code
    syn, non = np.zeros((2, code.size))
    for i, j, d, same in code.pairs():
        if d == 1:
            (syn if same else non)[i] += 1 / 3
    return syn, non


def _paths(model: Model, a: int, b: int) -> tuple[float, float]:
    """Synonymous and other steps between two codons: the mean over the shortest paths that meet no stop."""
    from itertools import permutations

    code = model.code
    x, y = code.sense[a], code.sense[b]
    where = [k for k in range(3) if x[k] != y[k]]
    found = []
    for order in permutations(where):
        here, s, n = x, 0, 0
        for k in order:
            to = here[:k] + y[k] + here[k + 1 :]
            if to not in code.state:
                break
            same = code.aa[code.state[to]] == code.aa[code.state[here]]
            s, n, here = s + same, n + (not same), to
        else:
            found.append((s, n))
    if not found:
        return 0.0, float(len(where))
    return tuple(float(v) for v in np.mean(found, axis=0))


def joint_states(model: Model, rows: pd.DataFrame) -> np.ndarray:
    """[node, pattern]: the most probable states of all nodes together."""
    pruner = model.pruner(rows)
    p = np.log(np.maximum(model.mg94.spectrum(1.0, model.omega).transition(model.lengths), 1e-300))
    score: list = [None] * len(model.tree.nodes)
    choice: list = [None] * len(model.tree.nodes)
    for k in pruner.order:
        n = model.tree.nodes[k]
        own = np.where(pruner.leaf[k] > 0, 0.0, -1e18) if n.leaf else sum(score[c] for c in n.children)
        if k:
            through = p[k][:, :, None] + own[None]
            choice[k], score[k] = through.argmax(axis=1), through.max(axis=1)
        else:
            score[0] = own + np.log(model.mg94.pi)[:, None]
    states = np.zeros((len(model.tree.nodes), pruner.patterns), np.int64)
    states[0] = score[0].argmax(axis=0)
    for k in reversed(pruner.order):
        for c in model.tree.nodes[k].children:
            states[c] = choice[c][states[k], np.arange(pruner.patterns)]
    return states


SLAC_SCHEMA = "pattern_id int, es double, en double, s double, n double, p_positive double, p_negative double"


def _slac(model: Model, rows: pd.DataFrame) -> pd.DataFrame:
    if not len(rows):
        return pd.DataFrame({c.split()[0]: [] for c in SLAC_SCHEMA.split(", ")})
    states = joint_states(model, rows)
    syn, non = codon_sites(model)
    length = model.lengths / model.lengths[1:].sum()
    cache: dict[tuple[int, int], tuple[float, float]] = {}
    out = []
    for j, pattern in enumerate(rows["pattern_id"]):
        es = en = s = n = weight = 0.0
        for k in range(1, len(model.tree.nodes)):
            if not model.tested[k]:
                continue
            a, b = int(states[model.tree.nodes[k].parent, j]), int(states[k, j])
            es += length[k] * (syn[a] + syn[b]) / 2
            en += length[k] * (non[a] + non[b]) / 2
            weight += length[k]
            if a != b:
                if (a, b) not in cache:
                    cache[a, b] = _paths(model, a, b)
                s, n = s + cache[a, b][0], n + cache[a, b][1]
        es, en = es * 3 / max(weight, 1e-12), en * 3 / max(weight, 1e-12)
        share = es / max(es + en, 1e-12)
        out.append((int(pattern), es, en, s, n, S.binomial_left(s + n, share, s) if s + n else 1.0, 1 - S.binomial_left(s + n, share, max(0.0, s - 1)) if s > 0 else 1.0))
    return pd.DataFrame(out, columns=[c.split()[0] for c in SLAC_SCHEMA.split(", ")])


def slac(data: Dataset, model: Model, p: float = 0.1) -> DataFrame:
    """Counts of changes on the most probable history against the sites that could change. (site, es, en, s, n, ds, dn, dn_minus_ds, p_positive, p_negative, classification)."""
    patterns = data.patterns().cache()
    found = with_model(patterns.select("pattern_id", "states", "masks"), model, _slac, SLAC_SCHEMA, data.spark.sparkContext.defaultParallelism)
    length = float(sum(t for t, on in zip(model.lengths, model.tested, strict=True) if on)) or 1.0
    ds, dn = F.when(F.col("es") > 0, F.col("s") / F.col("es")).otherwise(0.0), F.when(F.col("en") > 0, F.col("n") / F.col("en")).otherwise(0.0)
    label = F.when(F.col("p_positive") <= p, "diversifying").when(F.col("p_negative") <= p, "purifying").otherwise("neutral")
    return by_site(found, patterns).select("site", "es", "en", "s", "n", ds.alias("ds"), dn.alias("dn"), ((dn - ds) / length).alias("dn_minus_ds"), "p_positive", "p_negative", label.alias("classification"))


def contrast_fel(data: Dataset, model: Model, groups: dict[str, list[bool]], p: float = 0.05, ridge: float = 0.1) -> DataFrame:
    """(site, alpha, betas, lrt, p_value, q_value, different): whether non-synonymous rates differ between groups of branches; branches in none share a rate of their own."""
    names = sorted(groups)
    rest = [not any(groups[g][k] for g in names) for k in range(len(model.tree.nodes))]
    sets = [np.array(groups[g]) for g in names] + ([np.array(rest)] if any(rest[1:]) else [])
    size = len(names)

    def kernel(m: Model, rows: pd.DataFrame) -> pd.DataFrame:
        out = []
        for _, row in rows.iterrows():
            site = SiteRates(m, m.pruner(pd.DataFrame([row])))

            def value(x: np.ndarray, shared: bool, site=site) -> float:
                betas = [x[1]] * size if shared else list(x[1 : 1 + size])
                if len(sets) > size:
                    betas.append(x[-1])
                p = np.zeros((len(m.tree.nodes), m.code.size, m.code.size))
                for on, b in zip(sets, betas, strict=True):
                    p[on] = site.transitions(x[0], b)[on]
                logs = np.log(np.maximum(np.array(betas[:size]), 1e-5))
                return -float(site.pruner.log_likelihoods(p, m.mg94.pi)[0]) + ridge / 2 * float(((logs - logs.mean()) ** 2).sum())

            extra = len(sets) - size
            null = nelder_mead(lambda x: value(x, True), [1.0, 0.5] + [0.5] * extra, [LOW] * (2 + extra), [HIGH] * (2 + extra), steps=150)
            start = [null[0][0], *[null[0][1]] * size, *null[0][2:]]
            best = nelder_mead(lambda x: value(x, False), start, [LOW] * len(start), [HIGH] * len(start), steps=250)
            out.append((int(row["pattern_id"]), best[0][0], dict(zip(names, map(float, best[0][1 : 1 + size]), strict=True)), max(0.0, 2 * (null[1] - best[1]))))
        return pd.DataFrame(out, columns=["pattern_id", "alpha", "betas", "lrt"])

    patterns = data.patterns().cache()
    const = {"alpha": F.lit(0.0), "betas": F.create_map(*(F.lit(x) for g in names for x in (g, 0.0))), "lrt": F.lit(0.0)}
    tasks = data.spark.sparkContext.defaultParallelism * 3
    found = early_out(patterns.select("pattern_id", "states", "masks"), invariant(), const, lambda df: with_model(df, model, kernel, "pattern_id int, alpha double, betas map<string,double>, lrt double", tasks))
    sites = by_site(found, patterns).withColumn("p_value", S.chi2_sf(F.col("lrt"), size - 1))
    return S.benjamini_hochberg(sites, "p_value", [], ["site"], "q_value").select("site", "alpha", "betas", "lrt", "p_value", "q_value", (F.col("q_value") <= p).alias("different"))
