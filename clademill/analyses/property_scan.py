"""Conservation of amino-acid properties at sites: exchange rates that depend on how far a change moves each property."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clademill.analyses.dataset import Dataset, Model, by_site
from clademill.functions import stats as S
from clademill.kernels.likelihood import Spectrum, diagonal
from clademill.kernels.optimise import nelder_mead
from clademill.operators.alignment import invariant
from clademill.plans.helpers import early_out, with_model

AMINO = "ACDEFGHIKLMNPQRSTVWY"
# Kyte-Doolittle hydropathy, Zamyatnin volume in cubic angstrom and net charge at pH 7, in the order of AMINO.
PROPERTIES = {
    "hydropathy": [1.8, 2.5, -3.5, -3.5, 2.8, -0.4, -3.2, 4.5, -3.9, 3.8, 1.9, -3.5, -1.6, -3.5, -4.5, -0.8, -0.7, 4.2, -0.9, -1.3],
    "volume": [88.6, 108.5, 111.1, 138.4, 189.9, 60.1, 153.2, 166.7, 168.6, 166.7, 162.9, 114.1, 112.7, 143.8, 173.4, 89.0, 116.1, 140.0, 227.8, 193.6],
    "charge": [0, 0, -1, -1, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0, 1, 0, 0, 0, 0, 0],
}
#: The most that the properties together change a rate by, as an exponent, and the ridge on their weights.
MOST, RIDGE = 8.0, 0.1


def scaled(values: list[float]) -> np.ndarray:
    """z-scores with the population standard deviation."""
    x = np.array(values, float)
    return (x - x.mean()) / x.std()


def property_scan(data: Dataset, model: Model, properties: dict[str, list[float]] = PROPERTIES, p: float = 0.1) -> DataFrame:
    """(site, alpha, beta, lambdas, lrt, p_value, q_value, property_p, classes): beta exp(-M tanh(sum lambda distance / M)) for non-synonymous steps against all lambda 0.

    The omnibus test has as many degrees of freedom as properties and goes through Benjamini-Hochberg over sites; single properties are dropped one at a time and go through Holm within a site.
    A positive lambda is Conserved, a negative one Changing."""
    names = sorted(properties)
    tables = [scaled(properties[n]) for n in names]
    kinds = [AMINO.index(a) for a in model.code.aa]
    far = np.array([np.abs(t[kinds][:, None] - t[kinds][None, :]) for t in tables])
    k = len(names)

    def kernel(m: Model, rows: pd.DataFrame) -> pd.DataFrame:
        syn, non = m.mg94.parts()
        out = []
        for _, row in rows.iterrows():
            pruner = m.pruner(pd.DataFrame([row]))

            def value(x: np.ndarray, used: list[int], pruner=pruner) -> float:
                push = sum(x[2 + j] * far[u] for j, u in enumerate(used)) if used else 0.0
                spectrum = Spectrum.of(diagonal(x[0] * syn + x[1] * non * np.exp(-MOST * np.tanh(push / MOST))), m.mg94.pi)
                return -float(pruner.lnl_by(lambda n, v: spectrum.move(m.lengths[n], v), m.mg94.pi)[0]) + RIDGE / 2 * float((x[2:] ** 2).sum())

            def best(used: list[int], start: list[float], value=value) -> tuple[np.ndarray, float]:
                size = len(used)
                return nelder_mead(lambda x: value(x, used), start, [1e-4, 1e-4, *[-5.0] * size], [100.0, 100.0, *[5.0] * size], steps=60 + 40 * size)

            null = best([], [1.0, 0.5])
            full = best(list(range(k)), [*null[0], *[0.1] * k])
            singles = {}
            for j, name in enumerate(names):
                rest = [u for u in range(k) if u != j]
                worse = best(rest, [full[0][0], full[0][1], *(full[0][2 + u] for u in rest)])
                singles[name] = S.chi2_tail(2 * (worse[1] - full[1]), 1)
            out.append((int(row["pattern_id"]), full[0][0], full[0][1], dict(zip(names, map(float, full[0][2:]), strict=True)), max(0.0, 2 * (null[1] - full[1])), singles))
        return pd.DataFrame(out, columns=["pattern_id", "alpha", "beta", "lambdas", "lrt", "property_p"])

    patterns = data.patterns().cache()
    none = lambda v: F.create_map(*(F.lit(x) for n in names for x in (n, v)))
    const = {"alpha": F.lit(0.0), "beta": F.lit(0.0), "lambdas": none(0.0), "lrt": F.lit(0.0), "property_p": none(1.0)}
    schema = "pattern_id int, alpha double, beta double, lambdas map<string,double>, lrt double, property_p map<string,double>"
    tasks = data.spark.sparkContext.defaultParallelism * 3
    found = early_out(patterns.select("pattern_id", "states", "masks"), invariant(), const, lambda df: with_model(df, model, kernel, schema, tasks))
    sites = by_site(found, patterns).withColumn("p_value", S.chi2_sf(F.col("lrt"), k))
    sites = S.benjamini_hochberg(sites, "p_value", [], ["site"], "q_value")
    # A property counts at a site that counts itself, at a level that the share of such sites scales.
    level = p * F.avg((F.col("q_value") <= p).cast("double")).over(Window.partitionBy())
    singles = S.holm(sites.select("site", F.explode("property_p").alias("property", "single")), "single", ["site"], ["property"], "adjusted")
    adjusted = singles.groupBy("site").agg(F.map_from_entries(F.collect_list(F.struct("property", "adjusted"))).alias("adjusted"))
    sites = sites.withColumn("_level", level).join(adjusted, "site")
    classes = F.transform_values("adjusted", lambda n, v: F.when((F.col("q_value") > p) | (v > F.col("_level")), "neutral").when(F.col("lambdas")[n] > 0, "Conserved").otherwise("Changing"))
    return sites.select("site", "alpha", "beta", "lambdas", "lrt", "p_value", "q_value", F.col("adjusted").alias("property_p"), classes.alias("classes"))
