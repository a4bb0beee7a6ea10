"""Multiple testing, information criteria, tails and contingency over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions import stats as S
from clademill.operators import aggregates as A
from clademill.operators import windows as W
from clademill.queries.registry import query, table

P_SQL = "CASE WHEN s_acctbal <= 0 THEN 1.0 ELSE exp(-s_acctbal / 1000 / 2) END"


def _erfc_sql(x: str) -> str:
    t = f"(1 / (1 + abs({x}) / 2))"
    poly = str(S.ERFC[-1])
    for c in reversed(S.ERFC[:-1]):
        poly = f"({c} + {t} * {poly})"
    return f"(CASE WHEN {x} >= 0 THEN {t} * exp(-{x} * {x} + {poly}) ELSE 2 - {t} * exp(-{x} * {x} + {poly}) END)"


@query(f"""
WITH p AS (SELECT s_suppkey, s_nationkey, {P_SQL} AS p FROM supplier),
r AS (SELECT *, row_number() OVER (PARTITION BY s_nationkey ORDER BY p, s_suppkey) AS rk, count(*) OVER (PARTITION BY s_nationkey) AS m FROM p)
SELECT s_suppkey, s_nationkey, round(p, 8) AS p,
  round(least(1.0, min(p * m / rk) OVER (PARTITION BY s_nationkey ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 8) AS q,
  round(least(1.0, max(p * (m - rk + 1)) OVER (PARTITION BY s_nationkey ORDER BY rk ROWS UNBOUNDED PRECEDING)), 8) AS holm
FROM r""")
def multiple_testing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN01, WIN02, MTH02: Benjamini-Hochberg and Holm within each nation."""
    rows = table(spark, sf_dir, "supplier").select("s_suppkey", "s_nationkey", S.chi2_sf(F.col("s_acctbal") / 1000, 2).alias("p"))
    rows = S.holm(S.benjamini_hochberg(rows, "p", ["s_nationkey"], ["s_suppkey"]), "p", ["s_nationkey"], ["s_suppkey"])
    return rows.select("s_suppkey", "s_nationkey", *(F.round(c, 8).alias(c) for c in ("p", "q", "holm")))


@query("""
WITH p AS (SELECT o_orderkey, exp(-o_totalprice / 50000 / 2) AS p FROM orders),
r AS (SELECT *, row_number() OVER (ORDER BY p, o_orderkey) AS rk, count(*) OVER () AS m FROM p)
SELECT o_orderkey, round(least(1.0, min(p * m / rk) OVER (ORDER BY rk DESC ROWS UNBOUNDED PRECEDING)), 8) AS q FROM r""")
def global_fdr(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN01 over all rows, by buckets of p instead of one sorted task."""
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.exp(-F.col("o_totalprice") / 50000 / 2).alias("p"))
    return S.global_benjamini_hochberg(rows, "p", ["o_orderkey"]).select("o_orderkey", F.round("q", 8).alias("q"))


@query("""
WITH r AS (SELECT o_custkey, exp(-o_totalprice / 100000 / 2) AS p, row_number() OVER (PARTITION BY o_custkey ORDER BY exp(-o_totalprice / 100000 / 2), o_orderkey) AS rk,
  count(*) OVER (PARTITION BY o_custkey) AS k FROM orders)
SELECT o_custkey, round(min(least(1.0, k * p / rk)), 8) AS simes_p, count(*) AS tests FROM r GROUP BY o_custkey""")
def simes_families(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN03: one p for each customer's orders."""
    rows = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", F.exp(-F.col("o_totalprice") / 100000 / 2).alias("p"))
    return S.simes(rows, "p", ["o_custkey"], ["o_orderkey"]).withColumn("simes_p", F.round("simes_p", 8))


@query("""
WITH c AS (SELECT l_returnflag, l_linestatus, count(*)::DOUBLE AS o FROM lineitem GROUP BY ALL),
e AS (SELECT r.l_returnflag, k.l_linestatus, r.t * k.t / n.t AS e, n.t AS n FROM (SELECT l_returnflag, sum(o) AS t FROM c GROUP BY 1) r, (SELECT l_linestatus, sum(o) AS t FROM c GROUP BY 1) k, (SELECT sum(o) AS t FROM c) n)
SELECT round(sum((coalesce(o, 0) - e) ** 2 / e), 6) AS chi2, (count(DISTINCT l_returnflag) - 1) * (count(DISTINCT l_linestatus) - 1) AS df, max(n) AS total
FROM e LEFT JOIN c USING (l_returnflag, l_linestatus)""")
def contingency_chi2(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG08: chi-square of a two-way table."""
    return S.contingency(table(spark, sf_dir, "lineitem"), "l_returnflag", "l_linestatus").withColumn("chi2", F.round("chi2", 6))


@query(f"""
SELECT s_suppkey, round({_erfc_sql("sqrt(greatest(s_acctbal, 0.0) / 1000 / 2)")}, 7) AS df1,
  round(CASE WHEN s_acctbal <= 0 THEN 1.0 ELSE exp(-s_acctbal / 2000) END, 7) AS df2,
  round(CASE WHEN s_acctbal <= 0 THEN 1.0 ELSE exp(-s_acctbal / 2000) * (1 + s_acctbal / 2000) END, 7) AS df4,
  round(2.0 / 3 * (0.45 * {_erfc_sql("sqrt(greatest(s_acctbal, 0.0) / 1000 / 2)")} + 0.55 * CASE WHEN s_acctbal <= 0 THEN 1.0 ELSE exp(-s_acctbal / 2000) END), 7) AS meme,
  round(0.2 * {_erfc_sql("sqrt(greatest(s_acctbal, 0.0) / 1000 / 2)")} + 0.3 * CASE WHEN s_acctbal <= 0 THEN 1.0 ELSE exp(-s_acctbal / 2000) END, 7) AS absrel,
  round(CASE WHEN s_acctbal <= 0 THEN 0.5 ELSE 0.5 * exp(-s_acctbal / 2000) END, 7) AS busted
FROM supplier""")
def boundary_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH02-MTH04: chi-square tails and the mixtures at a parameter's border."""
    x = F.col("s_acctbal") / 1000
    cols = {"df1": S.chi2_sf(x, 1), "df2": S.chi2_sf(x, 2), "df4": S.chi2_sf(x, 4), "meme": S.mixture_p(x, "meme"), "absrel": S.mixture_p(x, "absrel"), "busted": S.mixture_p(x, "busted")}
    return table(spark, sf_dir, "supplier").select("s_suppkey", *(F.round(c, 7).alias(k) for k, c in cols.items()))


@query("""
SELECT p_partkey, round(lgamma(p_size + 0.5), 6) AS log_gamma FROM part""")
def log_gamma(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH05: log-gamma by a Lanczos series."""
    return table(spark, sf_dir, "part").select("p_partkey", F.round(S.lgamma(F.col("p_size") + 0.5), 6).alias("log_gamma"))


@query("""
WITH c AS (SELECT o_custkey, count(*) AS n, sum((o_orderstatus = 'F')::INT)::BIGINT AS k FROM orders GROUP BY 1),
t AS (SELECT count(*) AS population, sum((o_orderstatus = 'F')::INT)::BIGINT AS marked FROM orders),
b AS (SELECT c.*, t.*, marked::DOUBLE / population AS p FROM c, t),
i AS (SELECT b.*, unnest(range(k, n + 1)) AS i FROM b WHERE k > 0),
g AS (SELECT o_custkey, sum(exp(lgamma(n + 1) - lgamma(i + 1) - lgamma(n - i + 1) + i * ln(p) + (n - i) * ln(1 - p))) AS bin,
  sum(CASE WHEN i <= marked AND n - i <= population - marked THEN exp(lgamma(marked + 1) - lgamma(i + 1) - lgamma(marked - i + 1) + lgamma(population - marked + 1) - lgamma(n - i + 1) - lgamma(population - marked - n + i + 1)
    - lgamma(population + 1) + lgamma(n + 1) + lgamma(population - n + 1)) ELSE 0 END) AS hyp FROM i GROUP BY 1)
SELECT c.o_custkey, c.n, c.k, round(CASE WHEN c.k = 0 THEN 1.0 ELSE least(1.0, bin) END, 6) AS binomial, round(CASE WHEN c.k = 0 THEN 1.0 ELSE least(1.0, hyp) END, 6) AS hypergeometric
FROM c LEFT JOIN g USING (o_custkey)""")
def upper_tails(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH08: binomial and hypergeometric upper tails of a customer's finished orders."""
    orders = table(spark, sf_dir, "orders")
    each = orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("o_orderstatus") == "F").alias("k"))
    whole = orders.agg(F.count(F.lit(1)).alias("population"), F.count_if(F.col("o_orderstatus") == "F").alias("marked"))
    both = each.crossJoin(F.broadcast(whole))  # one row broadcast
    d = {c: F.col(c).cast("double") for c in ("n", "k", "population", "marked")}
    return both.select(
        "o_custkey", "n", "k",
        F.round(S.binomial_upper(d["k"], d["n"], d["marked"] / d["population"]), 6).alias("binomial"),
        F.round(F.when(F.col("k") == 0, F.lit(1.0)).otherwise(S.hypergeometric_upper(d["k"], d["population"], d["marked"], d["n"])), 6).alias("hypergeometric"),
    )


@query("""
WITH g AS (SELECT p_brand, p_type, count(*) AS n, sum(ln(p_retailprice)) AS s, sum(ln(p_retailprice) ** 2) AS ss FROM part GROUP BY ALL),
f AS (SELECT p_brand, p_type, n, -n / 2.0 * (ln(2 * pi() * ((ss - s * s / n) / n + 1e-6)) + 1) AS lnl FROM g),
i AS (SELECT *, CASE WHEN n > 3 THEN -2 * lnl + 4 + 12.0 / (n - 3) ELSE NULL END AS aicc, -2 * lnl + 2 * ln(n) AS bic FROM f)
SELECT p_brand, p_type, n, round(aicc, 6) AS aicc, round(bic, 6) AS bic,
  round(exp(-(bic - min(bic) OVER (PARTITION BY p_brand)) / 2) / sum(exp(-bic / 2 + m / 2)) OVER (PARTITION BY p_brand), 6) AS weight
FROM (SELECT *, min(bic) OVER (PARTITION BY p_brand) AS m FROM i)""")
def model_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG16-AGG18: AICc, BIC and softmax weights of candidate groups."""
    x = F.log("p_retailprice")
    g = table(spark, sf_dir, "part").groupBy("p_brand", "p_type").agg(F.count(F.lit(1)).alias("n"), F.sum(x).alias("s"), F.sum(x * x).alias("ss"))
    n = F.col("n")
    lnl = -n / 2 * (F.log(2 * F.pi() * ((F.col("ss") - F.col("s") * F.col("s") / n) / n + 1e-6)) + 1)
    g = g.withColumn("lnl", lnl).withColumns({"aicc": S.clean(S.aicc(F.col("lnl"), F.lit(2), n)), "bic": S.bic(F.col("lnl"), F.lit(2), n)})
    return S.information_weights(g, "bic", ["p_brand"]).select("p_brand", "p_type", "n", *(F.round(c, 6).alias(c) for c in ("aicc", "bic", "weight")))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), s AS (SELECT user_id, sum(c) AS n, sum(c * ln(c)) AS s FROM c GROUP BY 1)
SELECT user_id, n::BIGINT AS n, round(ln(n) - s / n, 6) AS entropy, round(exp(ln(n) - s / n), 6) AS effective FROM s""")
def entropy_by_user(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG19: entropy and effective number of event types."""
    return S.entropy(table(spark, sf_dir, "events"), ["user_id"], "event_type").select("user_id", "n", F.round("entropy", 6).alias("entropy"), F.round("effective", 6).alias("effective"))


@query("""
WITH e AS (SELECT event_type AS site, user_id % 4 AS chain, value FROM events),
c AS (SELECT site, chain, avg(value) AS m, var_samp(value) AS v, count(*) AS n FROM e GROUP BY ALL),
b AS (SELECT site, avg(n) AS n, var_samp(m) AS vm, avg(v) AS w, count(*) AS chains FROM c GROUP BY 1)
SELECT site, chains, round(sqrt(((n - 1) / n * w + vm) / w), 6) AS psrf, round(chains * n * ((n - 1) / n * w + vm) / (n * vm), 4) AS neff FROM b""")
def chain_convergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG11: scale reduction and effective size across chains."""
    rows = table(spark, sf_dir, "events").select(F.col("event_type").alias("site"), (F.col("user_id") % 4).alias("chain"), "value")
    return A.convergence(rows, ["site"], "chain", "value").select("site", "chains", F.round("psrf", 6).alias("psrf"), F.round("neff", 4).alias("neff"))


@query("""
WITH w AS (SELECT o_custkey AS site, o_totalprice / 100000 AS a, ln(o_totalprice / 1000 + 1) AS b, exp(-o_totalprice / 200000) AS w FROM orders)
SELECT site, round(sum(w * a) / sum(w), 6) AS mean_a, round(sum(w * b) / sum(w), 6) AS mean_b, round(sum(CASE WHEN b > a THEN w ELSE 0 END) / sum(w), 6) AS p_greater FROM w GROUP BY site""")
def posterior_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG10: posterior means and the mass on b > a."""
    rows = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("site"), (F.col("o_totalprice") / 100000).alias("a"), F.log(F.col("o_totalprice") / 1000 + 1).alias("b"), F.exp(-F.col("o_totalprice") / 200000).alias("w"))
    return A.posterior_summary(rows, ["site"], "a", "b", "w").select("site", *(F.round(c, 6).alias(c) for c in ("mean_a", "mean_b", "p_greater")))


@query("""
SELECT l_returnflag, l_linestatus, round(quantile_cont(l_quantity, 0.025), 6) AS lower, round(quantile_cont(l_quantity, 0.5), 6) AS median, round(quantile_cont(l_quantity, 0.975), 6) AS upper
FROM lineitem GROUP BY ALL""")
def sample_quantiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG12: 2.5, 50 and 97.5 % of sampled values."""
    q = A.quantile_summary(table(spark, sf_dir, "lineitem"), ["l_returnflag", "l_linestatus"], "l_quantity")
    return q.select("l_returnflag", "l_linestatus", *(F.round(c, 6).alias(c) for c in ("lower", "median", "upper")))


@query("""
SELECT n_regionkey, CASE WHEN count(*) > 1 THEN round(corr(s_acctbal, s_suppkey), 6) END AS pearson, CASE WHEN count(*) > 1 THEN round(corr(ra, rb), 6) END AS spearman
FROM (SELECT n_regionkey, s_acctbal, s_suppkey, rank() OVER (PARTITION BY n_regionkey ORDER BY s_acctbal) AS ra, rank() OVER (PARTITION BY n_regionkey ORDER BY s_suppkey) AS rb
  FROM supplier JOIN nation ON s_nationkey = n_nationkey) GROUP BY 1""")
def correlations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN10: Pearson and Spearman."""
    from pyspark.sql import Window

    rows = table(spark, sf_dir, "supplier").join(F.broadcast(table(spark, sf_dir, "nation")), F.col("s_nationkey") == F.col("n_nationkey"))  # nations: a fixed small table
    w = Window.partitionBy("n_regionkey")
    rows = rows.withColumns({"ra": F.rank().over(w.orderBy("s_acctbal")), "rb": F.rank().over(w.orderBy("s_suppkey"))})
    return rows.groupBy("n_regionkey").agg(*(F.when(F.count(F.lit(1)) > 1, F.round(F.corr(a, b), 6)).alias(k) for k, a, b in (("pearson", "s_acctbal", "s_suppkey"), ("spearman", "ra", "rb"))))


@query("""
SELECT p_partkey, p_brand, round(CASE WHEN stddev_pop(p_retailprice) OVER w > 0 THEN (p_retailprice - avg(p_retailprice) OVER w) / stddev_pop(p_retailprice) OVER w ELSE 0 END, 6) AS z
FROM part WINDOW w AS (PARTITION BY p_brand)""")
def property_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH15: z-scores within a group."""
    return W.z_score(table(spark, sf_dir, "part"), "p_retailprice", ["p_brand"]).select("p_partkey", "p_brand", F.round("z", 6).alias("z"))


@query("""
SELECT event_id, round(-log2(greatest(value / 100, 1e-15)), 6) + 0.0 AS surprise, CASE WHEN event_type = 'error' THEN NULL ELSE round(value, 6) END AS cleaned FROM events""")
def surprise(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MTH14, MTH18: surprise in bits; what isn't finite becomes null."""
    value = F.when(F.col("event_type") == "error", F.lit(float("nan"))).otherwise(F.col("value"))
    return table(spark, sf_dir, "events").select("event_id", (F.round(-F.log2(F.greatest(F.col("value") / 100, F.lit(1e-15))), 6) + F.lit(0.0)).alias("surprise"), F.round(S.clean(value), 6).alias("cleaned"))


@query("""
SELECT user_id, count(*) AS events, round(pow(2, avg(-log2(greatest(value / 100, 1e-15)))), 5) AS perplexity,
  count(*) FILTER (event_type = 'click') AS click, count(*) FILTER (event_type = 'view') AS view FROM events GROUP BY 1""")
def perplexity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG15: tallies by kind and mean surprise as perplexity."""
    bits = -F.log2(F.greatest(F.col("value") / 100, F.lit(1e-15)))
    kinds = (F.count_if(F.col("event_type") == k).alias(k) for k in ("click", "view"))
    return table(spark, sf_dir, "events").groupBy("user_id").agg(F.count(F.lit(1)).alias("events"), F.round(F.pow(F.lit(2.0), F.avg(bits)), 5).alias("perplexity"), *kinds)


def poisson_binomial_interval(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG09: expected number of false positives and its interval, by priority and status of orders."""
    rows = table(spark, sf_dir, "orders").select("o_orderpriority", "o_orderstatus", F.exp(-F.col("o_totalprice") / 50000).alias("p"))
    return poisson_binomial_by(rows, ["o_orderpriority", "o_orderstatus"], "p")


def poisson_binomial_by(df: DataFrame, keys: list[str], p: str) -> DataFrame:
    """Mean and interval of the number of successes in each group. The distribution is built from parts: groups are convolved part by part in tasks of their own, halves with halves, by Fourier transforms where they are long."""
    import numpy as np
    import pandas as pd

    kinds = {f.name: f.dataType.simpleString() for f in df.schema}
    schema = ", ".join(f"{k} {kinds[k]}" for k in keys)

    def product(dists: list) -> np.ndarray:
        while len(dists) > 1:
            dists = [convolve(*dists[k : k + 2]) if k + 1 < len(dists) else dists[k] for k in range(0, len(dists), 2)]
        return dists[0] if dists else np.ones(1)

    def convolve(one: np.ndarray, two: np.ndarray) -> np.ndarray:
        n = len(one) + len(two) - 1
        if min(len(one), len(two)) < 64:
            return np.convolve(one, two)
        return np.maximum(np.fft.irfft(np.fft.rfft(one, n) * np.fft.rfft(two, n), n), 0)

    def part(rows: pd.DataFrame) -> pd.DataFrame:
        dist = product([np.array([1 - v, v]) for v in rows[p].to_numpy()])
        return rows[keys].iloc[:1].assign(dist=[dist.tolist()])

    def whole(rows: pd.DataFrame) -> pd.DataFrame:
        dist = product([np.array(d) for d in rows["dist"]])
        run = np.cumsum(dist)
        low, high = int(np.searchsorted(run, 0.025)), int(np.searchsorted(run, 0.975 - 1e-12))
        return rows[keys].iloc[:1].assign(expected=round(float(dist @ np.arange(len(dist))), 6), low=low, high=high)

    parts = df.withColumn("_part", F.pmod(F.xxhash64(p), F.lit(64))).groupBy(*keys, "_part").applyInPandas(part, f"{schema}, dist array<double>")
    return parts.groupBy(*keys).applyInPandas(whole, f"{schema}, expected double, low long, high long")


query()(poisson_binomial_interval)
