"""Aggregations over sites, branches, patterns and events."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators.graph import checkpointed


def numbered(df: DataFrame, order: list[str], out: str, parts: int = 64) -> DataFrame:
    """Numbers all rows from 0 in order, without one task that sorts them all: sampled splitters deal them out, and each partition begins where the ones before it end. The order must be total."""
    rows = checkpointed(df.repartitionByRange(parts, *order).withColumn("_part", F.spark_partition_id()))
    sizes = rows.groupBy("_part").agg(F.count(F.lit(1)).alias("_n"))  # a row for each partition
    before = sizes.select("_part", F.coalesce(F.sum("_n").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"))
    within = F.row_number().over(Window.partitionBy("_part").orderBy(*order)) - 1
    return rows.join(F.broadcast(before), "_part").withColumn(out, F.col("_before") + within).drop("_part", "_before")


def compress_patterns(df: DataFrame, states: list[str], site: str) -> DataFrame:
    """Distinct columns with weights: (states, weight, first_site, pattern_id), numbered in the order of their first sites. Which sites a pattern has is in `df` itself: expand_patterns joins it back."""
    return numbered(df.groupBy(*states).agg(F.count(F.lit(1)).alias("weight"), F.min(site).alias("first_site")), ["first_site"], "pattern_id")


def expand_patterns(results: DataFrame, patterns: DataFrame, df: DataFrame, states: list[str], site: str) -> DataFrame:
    """Results by pattern -> results by site, by the states of each site; nulls are states like others."""
    found = patterns.select("pattern_id", *(F.col(c).alias(f"_{c}") for c in states)).join(results, "pattern_id")
    same = reduce(lambda a, b: a & b, (F.col(c).eqNullSafe(F.col(f"_{c}")) for c in states))
    return df.select(F.col(site).alias("site"), *states).join(found, same).drop(*states, *(f"_{c}" for c in states))


def gini_weights(df: DataFrame, site: str, state: str) -> DataFrame:
    """(site, h, weight): 1 / sqrt(H + 0.05) with H the site's Gini diversity, scaled to a mean of 1."""
    cells = df.groupBy(site, state).agg(F.count(F.lit(1)).alias("c"))
    h = cells.groupBy(site).agg((1 - F.sum(F.col("c") * F.col("c")) / (F.sum("c") * F.sum("c"))).alias("h"))
    raw = h.withColumn("_w", 1 / F.sqrt(F.col("h") + 0.05))
    mean = raw.agg(F.avg("_w").alias("_mean"))
    return raw.crossJoin(F.broadcast(mean)).select(site, "h", (F.col("_w") / F.col("_mean")).alias("weight"))  # one row broadcast


def convergence(df: DataFrame, keys: list[str], chain: str, value: str) -> DataFrame:
    """Potential scale reduction and effective size from chains of draws; (0, 0) where a variance vanishes."""
    each = df.groupBy(*keys, chain).agg(F.avg(value).alias("m"), F.var_samp(value).alias("v"), F.count(F.lit(1)).alias("n"))
    both = each.groupBy(*keys).agg(F.avg("n").alias("n"), F.var_samp("m").alias("vm"), F.avg("v").alias("w"), F.count(F.lit(1)).alias("chains"))
    b = F.col("n") * F.col("vm")
    var = (F.col("n") - 1) / F.col("n") * F.col("w") + b / F.col("n")
    flat = (b <= 1e-16) | (F.col("w") <= 1e-16) | b.isNull() | F.col("w").isNull()
    return both.select(*keys, "chains", F.when(flat, 0.0).otherwise(F.sqrt(var / F.col("w"))).alias("psrf"), F.when(flat, 0.0).otherwise(F.col("chains") * F.col("n") * var / b).alias("neff"))


def posterior_summary(df: DataFrame, keys: list[str], a: str, b: str, weight: str) -> DataFrame:
    """Posterior means over a weighted grid and the mass on b > a."""
    total = F.sum(weight)
    return df.groupBy(*keys).agg(
        (F.sum(F.col(weight) * F.col(a)) / total).alias("mean_a"),
        (F.sum(F.col(weight) * F.col(b)) / total).alias("mean_b"),
        (F.sum(F.when(F.col(b) > F.col(a), F.col(weight)).otherwise(0.0)) / total).alias("p_greater"),
    )


def class_counts(df: DataFrame, label: str, classes: list[str]) -> DataFrame:
    return df.agg(*(F.count_if(F.col(label) == c).alias(c) for c in classes), F.count(F.lit(1)).alias("total"))


def consensus(df: DataFrame, keys: list[str], state: str) -> DataFrame:
    """The most frequent state of each group, the smallest of equals, with its share."""
    cells = df.groupBy(*keys, state).agg(F.count(F.lit(1)).alias("c"))
    return cells.groupBy(*keys).agg(F.min_by(state, F.struct(-F.col("c"), F.col(state))).alias("consensus"), (F.max("c") / F.sum("c")).alias("share"))


def quantile_summary(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    q = F.percentile(value, F.array(F.lit(0.025), F.lit(0.5), F.lit(0.975)))
    return df.groupBy(*keys).agg(q.alias("q")).select(*keys, F.col("q")[0].alias("lower"), F.col("q")[1].alias("median"), F.col("q")[2].alias("upper"))


def motif_enrichment(df: DataFrame, keys: list[str], text: Column, motif: str, background: str) -> DataFrame:
    """Counts of two patterns by group and the G statistic of the motif's share against the share over all rows."""
    each = df.groupBy(*keys).agg(F.sum(F.regexp_count(text, F.lit(motif))).cast("double").alias("hits"), F.sum(F.regexp_count(text, F.lit(background))).cast("double").alias("places"))
    whole = each.agg((F.sum("hits") / F.sum("places")).alias("share"))
    g = lambda o, e: F.when((o > 0) & (e > 0), 2 * o * F.log(o / e)).otherwise(0.0)
    miss = F.col("places") - F.col("hits")
    return each.crossJoin(F.broadcast(whole)).withColumn("g", g(F.col("hits"), F.col("places") * F.col("share")) + g(miss, F.col("places") * (1 - F.col("share")))).drop("share")  # one row broadcast
