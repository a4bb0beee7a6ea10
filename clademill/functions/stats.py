"""Statistics as column expressions and windows; numeric twins of those that have no closed form."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.operators.graph import checkpointed

# Coefficients of the rational erfc of Numerical Recipes, constant first; relative error below 1.2e-7.
ERFC = [-1.26551223, 1.00002368, 0.37409196, 0.09678418, -0.18628806, 0.27886807, -1.13520398, 1.48851587, -0.82215223, 0.17087277]
# Coefficients of the Lanczos series with g = 5 of Numerical Recipes.
LANCZOS = [76.18009172947146, -86.50532032941677, 24.01409824083091, -1.231739572450155, 0.1208650973866179e-2, -0.5395239384953e-5]


def erfc(x: Column) -> Column:
    z = F.abs(x)
    t = 1 / (1 + z / 2)
    poly = F.lit(ERFC[-1])
    for c in reversed(ERFC[:-1]):
        poly = F.lit(c) + t * poly
    value = t * F.exp(-z * z + poly)
    return F.when(x >= 0, value).otherwise(2 - value)


def lgamma(x: Column) -> Column:
    tmp = x + 5.5 - (x + 0.5) * F.log(x + 5.5)
    series = F.lit(1.000000000190015)
    for k, c in enumerate(LANCZOS):
        series = series + F.lit(c) / (x + (k + 1))
    return -tmp + F.log(F.lit(2.5066282746310005) * series / x)


def chi2_sf(x: Column, df: int) -> Column:
    """Upper tail of chi-square: closed forms for every whole df; 1 where x is null, not finite or not positive."""
    half = x / 2
    if df % 2 == 0:
        term = total = F.lit(1.0)
        for k in range(1, df // 2):
            term = term * half / k
            total = total + term
        tail = F.exp(-half) * total
    else:
        tail = erfc(F.sqrt(half))
        term = F.sqrt(half) * F.exp(-half) * 2 / math.sqrt(math.pi)
        for k in range(1, (df + 1) // 2):
            tail = tail + term
            term = term * half / (k + 0.5)
    bad = x.isNull() | F.isnan(x) | (x <= 0) | (x == float("inf"))
    return F.when(bad, F.lit(1.0)).otherwise(F.least(F.lit(1.0), tail))


def mixture_p(lrt: Column, kind: str) -> Column:
    """p of a likelihood ratio on the border of its parameters: meme, absrel, busted, busted1."""
    one, two = chi2_sf(lrt, 1), chi2_sf(lrt, 2)
    if kind == "meme":
        return F.lit(2 / 3) * (0.45 * one + 0.55 * two)
    if kind == "absrel":
        return 0.20 * one + 0.30 * two
    none = lrt <= 0
    return F.when(none, F.lit(0.5)).otherwise(0.5 * (F.exp(-lrt / 2) if kind == "busted" else one))


def clean(x: Column) -> Column:
    """Null for what isn't finite."""
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def aicc(lnl: Column, k: Column, n: Column) -> Column:
    return F.when(n > k + 1, -2 * lnl + 2 * k + 2 * k * (k + 1) / (n - k - 1)).otherwise(F.lit(float("inf")))


def bic(lnl: Column, k: Column, n: Column) -> Column:
    return -2 * lnl + k * F.log(n)


def _usable(p: Column) -> Column:
    return F.when(p.isNull() | F.isnan(p) | (F.abs(p) == float("inf")), F.lit(1.0)).otherwise(p)


def benjamini_hochberg(df: DataFrame, p: str, keys: list[str], order: list[str], out: str = "q") -> DataFrame:
    """Step-up q within each group of `keys`: the least p m / rank over ranks from here on, in 0..1. `order` breaks ties. p that isn't finite counts as 1."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    up = group.orderBy(F.col("_p"), *order)
    ranked = df.withColumn("_p", _usable(F.col(p))).withColumns({"_rank": F.row_number().over(up), "_m": F.count(F.lit(1)).over(group)})
    down = group.orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.min(F.col("_p") * F.col("_m") / F.col("_rank")).over(down)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.greatest(F.lit(0.0), q))).drop("_p", "_rank", "_m")


def global_benjamini_hochberg(df: DataFrame, p: str, order: list[str], out: str = "q", buckets: int = 64) -> DataFrame:
    """The same over all rows, without one task that sorts them all: rows are range-partitioned by p and `order` with sampled splitters, so that crowded or equal values are spread as well;
    ranks come from the partitions' sizes and the rank within, a partition's least from those behind it. Only two numbers of each partition are joined back."""
    rows = checkpointed(df.withColumn("_p", _usable(F.col(p))).repartitionByRange(buckets, "_p", *order).withColumn("_b", F.spark_partition_id()))
    sizes = rows.groupBy("_b").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    sizes = sizes.select("_b", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy()).alias("_m"))  # a row for each partition
    ranked = rows.join(F.broadcast(sizes), "_b").withColumn("_rank", F.col("_before") + F.row_number().over(Window.partitionBy("_b").orderBy("_p", *order)))
    ranked = ranked.withColumn("_v", F.col("_p") * F.col("_m") / F.col("_rank"))
    least = ranked.groupBy("_b").agg(F.min("_v").alias("_l"))
    behind = Window.orderBy(F.col("_b").desc()).rowsBetween(Window.unboundedPreceding, -1)
    least = least.select("_b", F.coalesce(F.min("_l").over(behind), F.lit(1.0)).alias("_behind"))
    within = Window.partitionBy("_b").orderBy(F.col("_rank").desc()).rowsBetween(Window.unboundedPreceding, 0)
    q = F.least(F.lit(1.0), F.col("_behind"), F.min("_v").over(within))
    return ranked.join(F.broadcast(least), "_b").withColumn(out, q).drop("_p", "_b", "_before", "_m", "_rank", "_v", "_behind")


def holm(df: DataFrame, p: str, keys: list[str], order: list[str], out: str = "holm") -> DataFrame:
    """Step-down: the most of p (m - rank + 1) over ranks up to here, at most 1."""
    group = Window.partitionBy(*keys) if keys else Window.partitionBy()
    up = group.orderBy(F.col("_p"), *order)
    ranked = df.withColumn("_p", _usable(F.col(p))).withColumns({"_rank": F.row_number().over(up), "_m": F.count(F.lit(1)).over(group)})
    run = group.orderBy("_rank").rowsBetween(Window.unboundedPreceding, 0)
    return ranked.withColumn(out, F.least(F.lit(1.0), F.max(F.col("_p") * (F.col("_m") - F.col("_rank") + 1)).over(run))).drop("_p", "_rank", "_m")


def simes(df: DataFrame, p: str, keys: list[str], order: list[str]) -> DataFrame:
    """One p for each family: the least K p(j) / j."""
    group = Window.partitionBy(*keys)
    ranked = df.withColumns({"_rank": F.row_number().over(group.orderBy(F.col(p), *order)), "_k": F.count(F.lit(1)).over(group)})
    return ranked.groupBy(*keys).agg(F.min(F.least(F.lit(1.0), F.col("_k") * F.col(p) / F.col("_rank"))).alias("simes_p"), F.count(F.lit(1)).alias("tests"))


def information_weights(df: DataFrame, ic: str, keys: list[str], out: str = "weight") -> DataFrame:
    """Shares exp(-(ic - least) / 2) within each group."""
    group = Window.partitionBy(*keys)
    raw = F.exp(-(F.col(ic) - F.min(ic).over(group)) / 2)
    return df.withColumn("_raw", raw).withColumn(out, F.col("_raw") / F.sum("_raw").over(group)).drop("_raw")


def contingency(df: DataFrame, row: str, column: str, n: str | None = None) -> DataFrame:
    """(chi2, df, total) of a two-way table of counts."""
    cells = df.groupBy(row, column).agg((F.sum(n) if n else F.count(F.lit(1))).cast("double").alias("o"))
    rows, columns = cells.groupBy(row).agg(F.sum("o").alias("r")), cells.groupBy(column).agg(F.sum("o").alias("c"))
    total = cells.agg(F.sum("o").alias("n"))
    # A small table of categories: every cell, also an empty one, has an expected count.
    every = rows.crossJoin(columns).crossJoin(total).join(cells, [row, column], "left").withColumn("e", F.col("r") * F.col("c") / F.col("n"))
    return every.agg(
        F.sum(F.pow(F.coalesce("o", F.lit(0.0)) - F.col("e"), 2) / F.col("e")).alias("chi2"),
        ((F.count_distinct(row) - 1) * (F.count_distinct(column) - 1)).alias("df"),
        F.max("n").alias("total"),
    )


def entropy(df: DataFrame, keys: list[str], category: str) -> DataFrame:
    """(keys, n, entropy, effective): natural-log entropy of the categories in each group and its exponential."""
    cells = df.groupBy(*keys, category).agg(F.count(F.lit(1)).alias("c"))
    sums = cells.groupBy(*keys).agg(F.sum("c").alias("n"), F.sum(F.col("c") * F.log("c")).alias("s"))
    h = F.log("n") - F.col("s") / F.col("n")
    return sums.select(*keys, "n", h.alias("entropy"), F.exp(h).alias("effective"))


def binomial_upper(k: Column, n: Column, p: Column) -> Column:
    """P(X >= k) for X of n trials: a sum of terms from their logarithms."""
    term = lambda i: F.exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * F.log(p) + (n - i) * F.log(1 - p))
    total = F.aggregate(F.sequence(k.cast("int"), n.cast("int")), F.lit(0.0), lambda acc, i: acc + term(i.cast("double")))
    return F.when(k <= 0, F.lit(1.0)).when(k > n, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


def hypergeometric_upper(k: Column, population: Column, marked: Column, drawn: Column) -> Column:
    """P(X >= k) marked among `drawn` from a population."""
    choose = lambda a, b: lgamma(a + 1) - lgamma(b + 1) - lgamma(a - b + 1)
    low, high = F.greatest(k, drawn + marked - population), F.least(marked, drawn)
    total = F.aggregate(
        F.sequence(low.cast("int"), F.greatest(low, high).cast("int")),
        F.lit(0.0),
        lambda acc, i: acc + F.when(i <= high, F.exp(choose(marked, i.cast("double")) + choose(population - marked, drawn - i) - choose(population, drawn))).otherwise(0.0),
    )
    return F.when(low > high, F.lit(0.0)).otherwise(F.least(F.lit(1.0), total))


# Numeric twins, for kernels.


def gamma_q(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    scale = math.exp(-x + a * math.log(x) - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        k = a
        while abs(term) > 1e-16 * abs(total):
            k += 1
            term *= x / k
            total += term
        return 1 - total * scale
    tiny = 1e-300
    b = x + 1 - a
    c, d = 1 / tiny, 1 / b
    h = d
    for k in range(1, 10_000):
        an = -k * (k - a)
        b += 2
        d = 1 / (an * d + b or tiny)
        c = b + an / c or tiny
        h *= d * c
        if abs(d * c - 1) < 1e-15:
            break
    return h * scale


def chi2_tail(x: float, df: int) -> float:
    if not math.isfinite(x) or x <= 0:
        return 1.0
    return math.erfc(math.sqrt(x / 2)) if df == 1 else math.exp(-x / 2) if df == 2 else gamma_q(df / 2, x / 2)


def binomial_left(n: float, p: float, x: float) -> float:
    """Left tail of the binomial for n and x that need not be whole: whole steps, then a share of the next."""
    if p <= 0 or x < 0:
        return 0.0
    if p >= 1 or x >= n:
        return 1.0
    whole, top = math.floor(x), math.floor(n)
    logs = [math.lgamma(n + 1) - math.lgamma(k + 1) - math.lgamma(n - k + 1) + k * math.log(p) + (n - k) * math.log1p(-p) for k in range(min(whole + 1, top) + 1)]
    head = math.fsum(math.exp(v) for v in logs[: whole + 1])
    if x <= top:
        head += (math.exp(logs[whole + 1]) if len(logs) > whole + 1 else 0.0) * (x - whole)
    elif n - top > 1e-12:
        head += (1 - head) * (x - whole) / (n - top)
    return min(1.0, max(0.0, head))


def poisson_binomial(ps: list[float], level: float = 0.95) -> tuple[float, int, int]:
    """Mean and central interval of the number of successes of independent trials."""
    dist = [1.0]
    for p in ps:
        grown = [v * (1 - p) for v in dist] + [0.0]
        for k, v in enumerate(dist):
            grown[k + 1] += v * p
        dist = grown
    total, low, high, tail = 0.0, None, len(dist) - 1, (1 - level) / 2
    for k, v in enumerate(dist):
        total += v
        if low is None and total >= tail:
            low = k
        if total >= 1 - tail:
            high = k
            break
    return math.fsum(ps), low or 0, high


def discrete_gamma(alpha: float, classes: int) -> list[float]:
    """Mean rates of classes of equal weight under a gamma of mean 1."""
    cuts = [0.0]
    for k in range(1, classes):
        low, high = 0.0, 1.0
        while 1 - gamma_q(alpha, alpha * high) < k / classes:
            high *= 2
        for _ in range(200):
            mid = (low + high) / 2
            low, high = (mid, high) if 1 - gamma_q(alpha, alpha * mid) < k / classes else (low, mid)
        cuts.append((low + high) / 2)
    mass = [1 - gamma_q(alpha + 1, alpha * c) if c else 0.0 for c in cuts] + [1.0]
    rates = [(b - a) * classes for a, b in zip(mass, mass[1:], strict=False)]
    mean = sum(rates) / classes
    return [r / mean for r in rates]
