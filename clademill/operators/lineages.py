"""Substitutions counted by site and branch: constrained sites, branches that lost the constraint, sites that change together."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from clademill.functions import stats as S

INVADED, CHANGED = 0.60, 0.45


def core_sites(atlas: DataFrame, counts: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, site): sites under strong constraint. atlas: keys, site, alpha, beta, p_value, gap_fraction, alphabet; counts: keys, site, branch, u (non-synonymous substitutions, rows of 0 may be left out).

    A site with at most a quarter of gaps is one by its test (p and beta / alpha at most 0.1), by its rates (alpha 0.8 or more, ratio at most 0.05), or, in trees of ten branches or more, by few amino acids and
    next to no change outside the tenth of the branches that change it most. A gene with too few has the quarter of its sites with the least ratio instead."""
    n_branches = counts.groupBy(*keys).agg(F.count_distinct("branch").alias("_b"))
    order = Window.partitionBy(*keys, "site").orderBy(F.desc("u"), "branch")
    trimmed = counts.withColumn("_r", F.row_number().over(order)).join(n_branches, keys)
    trimmed = trimmed.where(F.col("_r") > F.greatest(F.lit(1), F.floor(F.col("_b") / 10))).groupBy(*keys, "site").agg(F.sum("u").alias("_rest"))
    rows = atlas.join(n_branches, keys, "left").join(trimmed, [*keys, "site"], "left").na.fill(0, ["_b", "_rest"])
    ratio = F.col("beta") / F.greatest(F.lit(0.05), F.col("alpha"))
    low_gap = F.col("gap_fraction") <= 0.25
    few = (F.col("_b") >= 10) & (F.col("alphabet") <= 2.2) & (F.col("_w") <= 0.35) & (F.col("alpha") >= 0.25) & (F.col("_rest") <= 0.25)
    core = low_gap & (((F.col("p_value") <= 0.10) & (F.col("_w") <= 0.10)) | ((F.col("alpha") >= 0.8) & (F.col("_w") <= 0.05)) | few)
    gene = Window.partitionBy(*keys)
    usable = low_gap & (F.col("alpha") > 0.10)
    rows = rows.withColumn("_w", ratio).withColumns({"_core": F.coalesce(core, F.lit(False)), "_usable": F.coalesce(usable, F.lit(False))})
    rows = rows.withColumns({"_n": F.count(F.lit(1)).over(gene), "_found": F.sum(F.col("_core").cast("int")).over(gene), "_rank": F.row_number().over(gene.orderBy(F.desc("_usable"), "_w", "site"))})
    enough = F.col("_found") >= F.least(F.lit(8), F.floor(F.col("_n") / 5))
    instead = F.col("_usable") & (F.col("_rank") <= F.greatest(F.lit(5), F.floor(F.col("_n") / 4)))
    return rows.where(F.when(enough, F.col("_core")).otherwise(instead)).select(*keys, "site")


def constraint_loss(counts: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, branch, observed, expected, invaded, log_bf, lrt, p_value, flagged): branches with more changes at constrained sites than the others.

    counts: keys, branch, site, u of the constrained sites; branches: keys, branch, length (substitutions a site), sites (of the gene). Expected is the density of the other branches, without the 15 % that change most, on
    this one's length, and 0.25 at least. Flagged: a Bayes factor of 25, p below 0.05 over the number of branches, and three sites invaded."""
    per = counts.groupBy(*keys, "branch").agg(F.sum("u").alias("observed"), F.count_if(F.col("u") >= INVADED).alias("invaded"))
    core = counts.groupBy(*keys).agg(F.count_distinct("site").alias("_core"))
    rows = branches.join(per, [*keys, "branch"], "left").na.fill(0, ["observed", "invaded"]).join(core, keys)
    eff = F.greatest(F.lit(1e-5), F.greatest(F.lit(1e-5), F.col("length")) - F.greatest(F.lit(0.0), F.col("observed") - 1.0) / F.col("sites"))
    gene = Window.partitionBy(*keys)
    rows = rows.withColumn("_eff", eff)
    rows = rows.withColumns({"_rank": F.row_number().over(gene.orderBy(F.col("observed") / F.col("_eff"), "branch")), "_b": F.count(F.lit(1)).over(gene)})
    rows = rows.withColumn("_in", (F.col("_rank") <= F.greatest(F.lit(1), F.floor(F.col("_b") * 85 / 100))).cast("double"))
    others = lambda c: F.sum(F.col("_in") * F.col(c)).over(gene) - F.col("_in") * F.col(c)
    rows = rows.withColumns({"_changes": others("observed"), "_lengths": others("_eff")})
    density = F.when(F.col("_lengths") > 1e-5, F.col("_changes") / F.col("_lengths")).otherwise(0.0)
    rows = rows.withColumn("expected", F.greatest(F.lit(0.25), density * F.col("_eff")))
    o, e = F.col("observed"), F.col("expected")
    neutral = F.greatest(e * 3, F.col("length") * F.col("_core") * 0.75)
    rate = F.greatest(e * 2, F.least(o, neutral))
    tested = (o > 2 * e) & (F.col("invaded") >= 2) & (o >= 2.5)
    rows = rows.withColumns({
        "log_bf": F.when(tested, F.greatest(F.lit(-20.0), F.least(F.lit(20.0), o * F.log(rate / e) - (rate - e)))),
        "lrt": F.when(tested, F.greatest(F.lit(0.0), 2 * (o * F.log(o / e) - (o - e)))),
    })
    rows = rows.withColumn("p_value", F.when(tested, S.chi2_sf(F.col("lrt"), 1)).otherwise(1.0))
    flag = (F.col("log_bf") >= math.log(25.0)) & (F.col("p_value") * F.col("_b") <= 0.05) & (F.col("invaded") >= 3)
    return rows.select(*keys, "branch", "observed", "expected", "invaded", "log_bf", "lrt", "p_value", F.coalesce(flag, F.lit(False)).alias("flagged"))


def branch_loads(counts: DataFrame, branches: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, branch, load, share, pool): a quarter of a branch's length plus all its substitutions, its share of all, and the gene's effective number of branches (one over the sum of squared shares)."""
    per = counts.groupBy(*keys, "branch").agg(F.sum("u").alias("_u"))
    gene = Window.partitionBy(*keys)
    rows = branches.join(per, [*keys, "branch"], "left").na.fill(0, ["_u"])
    rows = rows.withColumn("load", F.greatest(F.lit(1e-4), 0.25 * F.greatest(F.lit(1e-4), F.col("length")) + F.col("_u")))
    rows = rows.withColumn("share", F.col("load") / F.sum("load").over(gene))
    return rows.withColumn("pool", 1 / F.sum(F.col("share") * F.col("share")).over(gene)).select(*keys, "branch", "load", "share", "pool")


def changing_together(counts: DataFrame, branches: DataFrame, keys: list[str], near: int = 2) -> DataFrame:
    """(keys, a, b, together, shared, weight, cosine, expected): pairs of sites more than `near` apart that change on the same branches.

    counts: keys, site, branch, u with a row for each u above 0. A site counts if it changes (u of 0.45 or more) on two branches and 1.1 times in all. cosine is that of the sites' changes without what the branches' loads
    explain: the dot product of two sites runs over their common branches only, the rest follows from one sum a site. A pair needs two common branches, a cosine above 0.45 and half as many again as by chance.

    Pairs come from the branches that both sites change on, and one gene's sites bound them."""
    loads = branch_loads(counts, branches, keys)
    whole = loads.groupBy(*keys).agg(F.sum(F.col("load") ** 2).alias("_ll"), F.sum("load").alias("_l"), F.count(F.lit(1)).alias("_b"))
    u = counts.where("u > 0").join(loads.select(*keys, "branch", "load", "share"), [*keys, "branch"])
    sites = u.groupBy(*keys, "site").agg(F.sum("u").alias("_m"), F.sum(F.col("u") * F.col("load")).alias("_ul"), F.sum(F.col("u") ** 2).alias("_uu"), F.count_if(F.col("u") >= CHANGED).alias("_n"))
    sites = sites.where("_n >= 2 and _m >= 1.1").join(whole, keys)
    sites = sites.withColumn("_d", F.col("_ul") / F.col("_ll"))
    sites = sites.withColumn("_c", (F.col("_m") - F.col("_d") * F.col("_l")) / F.col("_b"))
    norm = F.sqrt(F.greatest(F.lit(0.0), F.col("_uu") - F.col("_d") ** 2 * F.col("_ll") - F.col("_b") * F.col("_c") ** 2))
    sites = sites.withColumn("_norm", norm).where("_norm > 1e-6").select(*keys, "site", "_n", "_d", "_c", "_norm", "_ll", "_b")
    active = u.join(sites.select(*keys, "site"), [*keys, "site"]).select(*keys, "branch", "site", "u", "share")
    one, two = active.withColumnsRenamed({"site": "a", "u": "_x"}), active.select(*keys, "branch", F.col("site").alias("b"), F.col("u").alias("_y"))
    both = (F.col("_x") >= CHANGED) & (F.col("_y") >= CHANGED)
    pairs = one.join(two, [*keys, "branch"]).where(F.col("b") > F.col("a") + near).groupBy(*keys, "a", "b").agg(
        F.sum(F.col("_x") * F.col("_y")).alias("_dot"), F.count_if(both).alias("together"), F.sum(F.when(both, F.least(F.lit(1.0), "_x", "_y"))).alias("shared"), F.sum(F.when(both, F.col("share"))).alias("weight")
    ).where("together >= 2 and shared >= 1.1")
    left = sites.withColumnsRenamed({"site": "a", "_n": "_n1", "_d": "_d1", "_c": "_c1", "_norm": "_norm1"})
    right = sites.select(*keys, F.col("site").alias("b"), F.col("_n").alias("_n2"), F.col("_d").alias("_d2"), F.col("_c").alias("_c2"), F.col("_norm").alias("_norm2"))
    found = pairs.join(left, [*keys, "a"]).join(right, [*keys, "b"])
    dot = F.col("_dot") - F.col("_d1") * F.col("_d2") * F.col("_ll") - F.col("_b") * F.col("_c1") * F.col("_c2")
    found = found.withColumn("cosine", dot / (F.col("_norm1") * F.col("_norm2"))).where("cosine > 0.45")
    # Chance depends on the two sites' numbers of branches alone: one sum over the branches for each two numbers that occur.
    numbers = found.select(*keys, "_n1", "_n2").distinct()
    p = lambda n: F.least(F.lit(1.0), F.col(n) * F.col("share"))
    chance = numbers.join(loads, keys).groupBy(*keys, "_n1", "_n2").agg(F.greatest(F.lit(0.02), F.sum(p("_n1") * p("_n2"))).alias("expected"))
    return found.join(chance, [*keys, "_n1", "_n2"]).where(F.col("together") > 1.5 * F.col("expected")).select(*keys, "a", "b", "together", "shared", "weight", "cosine", "expected")
