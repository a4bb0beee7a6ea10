"""Stretches of sites: silent islands, error sinks along a branch, segments with trees of their own."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clademill.functions import stats as S

LONGEST, SHORTEST = 24, 11
SILENT, MOST_RATE = 0.15, 5.0


def silent_spans(sites: DataFrame, keys: list[str], site: str = "site", alpha: str = "alpha", gap: str = "gap_fraction") -> DataFrame:
    """(keys, site, last, span, mean_alpha, gene_mean, z, p, adjusted): for each place where a stretch may begin, the one of 11 (a third of a short gene) to 24 sites whose synonymous rates are the least likely.

    Rates above 5 count as 5, nulls as 0. A stretch has a mean of at most 0.35 of its gene's and at most a fifth of gaps; its p is the smaller of the normal tail of its mean and the binomial tail of its silent sites.
    Genes of fewer than 25 sites have none. What a row looks at is its own 24 sites, so nothing grows with the gene."""
    gene = Window.partitionBy(*keys)
    a, g = F.least(F.lit(MOST_RATE), F.coalesce(F.col(alpha), F.lit(0.0))), F.coalesce(F.col(gap), F.lit(0.0))
    plain = sites.select(*keys, F.col(site).alias("site"), a.alias("_a"), g.alias("_g"), (a <= SILENT).cast("int").alias("_s"))
    stats = plain.withColumns({
        "_n": F.count(F.lit(1)).over(gene),
        "_mean": F.greatest(F.lit(0.15), F.avg("_a").over(gene)),
        "_square": F.avg(F.col("_a") * F.col("_a")).over(gene),
        "_share": F.avg(((F.col("_s") == 1) & (F.col("_g") <= 0.25)).cast("double")).over(gene),
        "_ahead": F.collect_list(F.struct("_a", "_g", "_s", "site")).over(gene.orderBy("site").rowsBetween(0, LONGEST - 1)),
    }).where("_n >= 25")
    sd = F.sqrt(F.greatest(F.lit(0.04), F.col("_square") - F.col("_mean") ** 2))
    least = F.least(F.lit(SHORTEST), F.floor(F.col("_n") / 3)).cast("int")
    begun = stats.where(F.size("_ahead") >= least).withColumns({"_sd": sd, "_share": F.greatest(F.lit(0.05), F.least(F.lit(0.90), F.col("_share")))})
    each = begun.withColumn("span", F.explode(F.sequence(least, F.size("_ahead"))))
    part = F.slice("_ahead", F.lit(1), F.col("span"))
    total = lambda c: F.aggregate(part, F.lit(0.0), lambda acc, x: acc + x[c].cast("double"))
    each = each.withColumns({"mean_alpha": total("_a") / F.col("span"), "_gaps": total("_g") / F.col("span"), "_k": total("_s"), "last": F.element_at("_ahead", F.col("span"))["site"]})
    each = each.where((F.col("_gaps") <= 0.20) & (F.col("mean_alpha") <= 0.35 * F.col("_mean")))
    each = each.withColumn("_z", (F.col("_mean") - F.col("mean_alpha")) / (F.col("_sd") / F.sqrt("span")))
    normal = 0.5 * S.erfc(F.col("_z") / math.sqrt(2.0))
    binomial = F.when(F.col("_k") == 0, 1.0).otherwise(F.least(F.lit(1.0), S.binomial_upper(F.col("_k"), F.col("span").cast("double"), F.col("_share"))))
    each = each.withColumn("p", F.least(normal, binomial)).where("p < 1")
    fields = F.struct("last", "span", "mean_alpha", F.col("_mean").alias("gene_mean"), "_z", "p", "_n")
    best = each.groupBy(*keys, "site").agg(F.min_by(fields, F.struct("p", "span")).alias("b")).select(*keys, "site", "b.*")
    z = F.greatest("_z", F.sqrt(-2 * F.log(F.greatest(F.lit(1e-16), F.col("p")))))
    adjusted = F.least(F.lit(1.0), F.col("p") * F.greatest(F.lit(1), F.floor(F.col("_n") / 12)))
    return best.select(*keys, "site", "last", "span", "mean_alpha", "gene_mean", z.alias("z"), "p", adjusted.alias("adjusted"))


def silent_islands(sites: DataFrame, keys: list[str], site: str = "site", alpha: str = "alpha", gap: str = "gap_fraction") -> DataFrame:
    """(keys, first, last, mean_alpha, gene_mean, suppression, z, p_value): from the left, the stretches of silent_spans with p at most 0.01 and at most 0.12 after correction that don't overlap one taken before.

    Only stretches that pass are folded, and only with those they touch: a run of overlapping ones is a group of its own."""
    good = silent_spans(sites, keys, site, alpha, gap).where("p <= 0.01 and adjusted <= 0.12")
    order = Window.partitionBy(*keys).orderBy("site")
    before = F.max("last").over(order.rowsBetween(Window.unboundedPreceding, -1))
    runs = good.withColumn("_new", F.coalesce((F.col("site") > before).cast("int"), F.lit(1)))
    runs = runs.withColumn("_run", F.sum("_new").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    rows = runs.groupBy(*keys, "_run").agg(F.array_sort(F.collect_list(F.struct("site", "last", "mean_alpha", "gene_mean", "z", "adjusted"))).alias("_c"))
    first = F.slice("_c", 1, 1)
    take = lambda kept, x: F.when(x["site"] > F.element_at(kept, -1)["last"], F.concat(kept, F.array(x))).otherwise(kept)
    kept = rows.select(*keys, F.explode(F.aggregate(F.slice("_c", F.lit(2), F.size("_c")), first, take)).alias("k"))
    return kept.select(*keys, F.col("k.site").alias("first"), "k.last", "k.mean_alpha", "k.gene_mean", (F.col("k.mean_alpha") / F.col("k.gene_mean")).alias("suppression"), "k.z", F.col("k.adjusted").alias("p_value"))


def sink_chain(enter: float, stay: float) -> np.ndarray:
    """States: in order, then the first, second and any further site in error; an error lasts three sites at least."""
    t = np.zeros((4, 4))
    t[0, 0], t[0, 1] = 1 - enter, enter
    t[1, 2] = t[2, 3] = 1.0
    t[3, 0], t[3, 3] = 1 - stay, stay
    return t


def sink_posterior(odds: np.ndarray, branches: int, turns: int = 8) -> tuple[np.ndarray, float, bool]:
    """(probability of error at each site, log-likelihood ratio against no error, whether it is enough) of one branch. odds: of each site, error against biology.

    The chain's two rates are fitted by expectation and maximisation; a chain begins and ends in order or at an error's end, and counts if 2 log Z exceeds 2 ln(branches x sites) and half a site is in error."""
    n = len(odds)
    if n < 3:
        return np.zeros(n), 0.0, False
    emit = np.ones((n, 4))
    emit[:, 1:] = np.minimum(np.maximum(odds, 1e-15), math.exp(8.0))[:, None]
    enter, stay = 1.0 / max(100, n), 0.75
    end = np.array([1.0, 0.0, 0.0, 1.0])
    for _ in range(turns):
        t = sink_chain(enter, stay)
        ahead, back, scale = np.zeros((n, 4)), np.zeros((n, 4)), np.zeros(n)
        state = t[0] * emit[0]
        for k in range(n):
            if k:
                state = (state @ t) * emit[k]
            scale[k] = state.sum()
            state = ahead[k] = state / scale[k]
        back[-1] = end
        for k in range(n - 2, -1, -1):
            back[k] = t @ (emit[k + 1] * back[k + 1]) / scale[k + 1]
        z = float(ahead[-1] @ end)
        log_z = float(np.log(scale).sum() + math.log(z))
        seen = ahead * back / z
        moved = lambda i, j: float((ahead[:-1, i] * t[i, j] * emit[1:, j] * back[1:, j] / scale[1:]).sum() / z)  # noqa: B023, E731
        into, kept = moved(0, 1), moved(3, 3)
        enter = min(max(into / max(1.0, float(seen[:-1, 0].sum())), 1.0 / max(100, branches * n)), 0.05)
        if (inside := float(seen[:-1, 3].sum())) > 1e-4:
            stay = min(max(kept / inside, 0.25), 1.0 - 1.0 / n)
    error = np.clip(seen[:, 1:].sum(axis=1), 0.0, 1.0)
    enough = 2 * log_z > 2 * math.log(max(2, branches * n)) and float(error.sum()) >= 0.5
    return (error if enough else np.zeros(n)), log_z, enough


def error_sinks(odds: DataFrame, keys: list[str], branch: str = "branch", site: str = "site", value: str = "odds") -> DataFrame:
    """(keys, branch, site, error, log_z, flagged): sink_posterior of every branch of every gene, a branch (the sites of one gene) in one task at a time."""
    counts = odds.groupBy(*keys).agg(F.count_distinct(branch).cast("int").alias("_b"))
    rows = odds.select(*keys, branch, site, F.col(value).cast("double").alias("_o")).join(counts, keys)
    kinds = {f.name: f.dataType.simpleString() for f in rows.schema.fields}
    schema = ", ".join([*(f"{c} {kinds[c]}" for c in (*keys, branch, site)), "error double", "log_z double", "flagged boolean"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(site)
        error, log_z, enough = sink_posterior(group["_o"].fillna(0.0).to_numpy(float), int(group["_b"].iloc[0]))
        return group[[*keys, branch, site]].assign(error=error, log_z=log_z, flagged=enough)

    return rows.groupBy(*keys, branch).applyInPandas(run, schema)


def route_segments(segments: list[tuple[int, int, float]], sites: int) -> tuple[list[bool], np.ndarray]:
    """Whether each of (first, last, gain), in order, gets a tree of its own: not if more than half of it is covered by ones taken before that gain as much; and for each site the number of the segment whose tree it has, or -1."""
    gain, owner, taken = np.full(sites, -np.inf), np.full(sites, -1), []
    for k, (first, last, score) in enumerate(segments):
        here = slice(first, last + 1)
        fits = 2 * int((gain[here] >= score).sum()) <= last - first + 1
        taken.append(fits)
        if fits:
            better = gain[here] < score
            gain[here], owner[here] = np.where(better, score, gain[here]), np.where(better, k, owner[here])
    return taken, owner


def routed(segments: DataFrame, keys: list[str], order: str = "order", first: str = "first", last: str = "last", gain: str = "gain") -> DataFrame:
    """The segments of each gene with `routed` as route_segments has it; the segments of one gene are one task's."""
    schema = ", ".join([*(f"{f.name} {f.dataType.simpleString()}" for f in segments.schema.fields), "routed boolean"])

    def run(group: pd.DataFrame) -> pd.DataFrame:
        group = group.sort_values(order)
        low = int(group[first].min())
        spans = [(int(a) - low, int(b) - low, float(g)) for a, b, g in zip(group[first], group[last], group[gain], strict=True)]
        return group.assign(routed=route_segments(spans, int(group[last].max()) - low + 1)[0])

    return segments.groupBy(*keys).applyInPandas(run, schema)
