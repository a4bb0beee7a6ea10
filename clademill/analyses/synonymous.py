"""Synonymous rates by classes of codon pairs: how fast each class is, and whether the classes differ at all."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.analyses.dataset import Model
from clademill.analyses.mixtures import each_gene
from clademill.functions import stats as S
from clademill.kernels.likelihood import Spectrum, total
from clademill.kernels.optimise import lbfgs
from clademill.model.codes import GeneticCode

Pairs = list[tuple[str, str, str, float | None]]
NEUTRAL = {"NEUTRAL", "WITHIN_NEUTRAL"}


@dataclass
class Classes:
    """Class of each ordered pair of codons (-1: none), their names, the one whose rate is 1 if there is such, and factors that are known beforehand."""

    names: list[str]
    of: np.ndarray
    neutral: int
    known: np.ndarray | None

    @classmethod
    def read(cls, partition: Pairs, genetic: GeneticCode, neutral: str | None = None) -> Classes:
        """From rows as sources.tables.parse_partition gives them. The neutral class is the one named, or one whose name says so."""
        place = {c: k for k, c in enumerate(genetic.sense)}
        names = sorted({name for _, _, name, _ in partition})
        of = np.full((genetic.size, genetic.size), -1)
        known = np.ones(of.shape) if all(rate is not None for *_, rate in partition) else None
        for a, b, name, rate in partition:
            i, j = place[a], place[b]
            of[i, j] = of[j, i] = names.index(name)
            if known is not None:
                known[i, j] = known[j, i] = rate
        if neutral is not None and neutral.upper() not in {n.upper() for n in names}:
            raise ValueError(f"no class {neutral}")
        asked = {neutral.upper()} if neutral is not None else NEUTRAL
        return cls(names, of, next((k for k, n in enumerate(names) if n.upper() in asked), -1), known)

    def factors(self, rates: np.ndarray) -> np.ndarray:
        return np.where(self.of >= 0, rates[self.of], 1.0)

    def scaled(self, free: np.ndarray) -> np.ndarray:
        """Rates of all classes from those of all but one: the neutral class has 1, or the mean over pairs is 1."""
        rates = np.insert(free, max(self.neutral, 0), 1.0)
        if self.neutral < 0:
            n = np.bincount(self.of[self.of >= 0], minlength=len(self.names))
            rates = rates / (rates @ n / n.sum())
        return rates


def fit_classes(model: Model, patterns: pd.DataFrame, partition: Pairs, neutral: str | None = None, steps: int = 60) -> dict:
    """Rates of the classes with the gene's omega and the tree's scale, against one rate for all. With known factors there is nothing to fit but omega and scale, and no test."""
    classes = Classes.read(partition, model.code, neutral)
    pruner, weights, pi = model.pruner(patterns), patterns["weight"].to_numpy(float), model.mg94.pi
    free = 0 if classes.known is not None else len(classes.names) - 1

    def lnl(factors: np.ndarray | None, omega: float, scale: float) -> float:
        spectrum = Spectrum.of(model.mg94.multiple(1.0, omega, pairs=factors), pi)
        return total(pruner.log_likelihoods(spectrum.transition(model.lengths * scale), pi), weights)

    def parts(x: np.ndarray) -> tuple[np.ndarray, float, float]:
        e = np.exp(x)
        return (classes.known if classes.known is not None else classes.factors(classes.scaled(e[2:]))), float(e[0]), float(e[1])

    low, high = [math.log(1e-4), math.log(0.05)], [math.log(50.0), math.log(20.0)]
    start = [math.log(max(model.omega, 1e-3)), 0.0]
    null, worse = lbfgs(lambda x: -lnl(None, math.exp(x[0]), math.exp(x[1])), start, low, high, steps=steps)
    x, best = lbfgs(lambda x: -lnl(*parts(x)), [*null, *[0.0] * free], [*low, *[math.log(1e-3)] * free], [*high, *[math.log(100.0)] * free], steps=steps)
    rates = classes.scaled(np.exp(x[2:])) if classes.known is None else np.array([float(classes.known[classes.of == k].mean()) for k in range(len(classes.names))])
    k, n = 16 + free, int(weights.sum()) * len(model.names)
    lrt = max(0.0, 2 * (worse - best))
    return {
        "lnl": -best, "lnl_null": -worse, "lrt": lrt, "df": free, "p_value": S.chi2_tail(lrt, free) if free else None, "omega": float(np.exp(x[0])), "scale": float(np.exp(x[1])),
        "aicc": 2 * best + 2 * k + 2 * k * (k + 1) / (n - k - 1) if n > k + 1 else math.inf, "rates": dict(zip(classes.names, map(float, rates), strict=True)),
    }


RESULT = "dataset_id string, lnl double, lnl_null double, lrt double, df int, p_value double, omega double, scale double, aicc double, rates map<string,double>, error string"


def class_genes(genes: DataFrame, partition: Pairs, *, neutral: str | None = None, genetic_code: str | int = "Universal", quick: bool = False, steps: int = 60, tasks: int | None = None) -> DataFrame:
    """fit_classes of every gene of (dataset_id, alignment, tree), each in the task that has it."""
    return each_gene(genes, lambda m, p: fit_classes(m, p, partition, neutral, steps), RESULT, "All", genetic_code, quick, tasks)


def rates_over_genes(found: DataFrame) -> DataFrame:
    """(class, genes, median, mean_log): the classes' rates over all genes that were fitted."""
    each = found.where("error is null").select(F.explode("rates").alias("class", "rate"))
    return each.groupBy("class").agg(F.count(F.lit(1)).alias("genes"), F.percentile("rate", 0.5).alias("median"), F.avg(F.log("rate")).alias("mean_log"))
