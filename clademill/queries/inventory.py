"""Joins, rankings and digests of the tree and gateway layers over whole tables, each held against SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.analyses import genes, mixtures, preferences, property_scan, synonymous
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.operators import branches, islands, lineages
from clademill.queries.registry import query, table
from clademill.queries.sequences import demo
from clademill.model.codes import code
from clademill.sources import tables

KEY = b"a key of the day"
_PADDED = KEY.ljust(64, b"\0")
_INNER, _OUTER = ("".join(f"\\x{b ^ pad:02X}" for b in _PADDED) for pad in (0x36, 0x5C))


@query("""
WITH t AS (SELECT doc_id AS name FROM documents), e AS (SELECT CASE WHEN vec_id % 7 = 0 THEN vec_id + 1 ELSE vec_id END AS name, embedding AS vector FROM embeddings), s AS (SELECT len(vector) AS size FROM e GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1),
p AS (SELECT DISTINCT 'missing' AS problem, name FROM t WHERE name NOT IN (SELECT name FROM e) UNION ALL SELECT DISTINCT 'unknown', name FROM e WHERE name NOT IN (SELECT name FROM t)
UNION ALL SELECT 'duplicate', name FROM e GROUP BY name HAVING count(*) > 1 UNION ALL SELECT DISTINCT 'ragged', name FROM e, s WHERE len(vector) <> size)
SELECT problem, count(*) AS n, min(name) AS first FROM p GROUP BY problem""")
def embedding_problems(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC17, JN05: embeddings by name with their checks; every seventh name is shifted, so that there is something to find."""
    taxa = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("name"))
    given = table(spark, sf_dir, "embeddings").select(F.when(F.col("vec_id") % 7 == 0, F.col("vec_id") + 1).otherwise(F.col("vec_id")).alias("name"), F.col("embedding").alias("vector"))
    return tables.embedding_problems(taxa, given).groupBy("problem").agg(F.count(F.lit(1)).alias("n"), F.min("name").alias("first"))


@query("""
WITH p AS (SELECT l_orderkey, l_linenumber, l_extendedprice, lead(l_linenumber) OVER w AS after, lead(l_extendedprice) OVER w AS price_after FROM lineitem WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice))
SELECT l_orderkey, count(*) AS pairs, round(sum(abs(l_extendedprice - price_after)), 2) AS change FROM p WHERE after IS NOT NULL GROUP BY 1""")
def adjacent_parts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN07: each part beside the next one."""
    pairs = branches.adjacent(table(spark, sf_dir, "lineitem"), ["l_orderkey"], ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"], ["l_extendedprice"])
    return pairs.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.sum(F.abs(F.col("l_extendedprice") - F.col("l_extendedprice_next"))), 2).alias("change"))


@query("""
WITH d AS (SELECT s_nationkey, s_suppkey, max(s_acctbal) OVER (PARTITION BY s_nationkey) - s_acctbal AS raw, s_acctbal FROM supplier)
SELECT s_nationkey, s_suppkey, round(raw / 100, 6) AS delta, round(exp(-raw / 100) / sum(exp(-raw / 100)) OVER (PARTITION BY s_nationkey), 9) AS weight, row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS rank FROM d""")
def root_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT04: candidates by log-likelihood with their weights."""
    df = table(spark, sf_dir, "supplier").select("s_nationkey", "s_suppkey", (F.col("s_acctbal") / 100).alias("lnl"))
    ranked = branches.rank_candidates(df, "lnl", ["s_nationkey"], ["s_suppkey"])
    return ranked.select("s_nationkey", "s_suppkey", F.round("delta", 6).alias("delta"), F.round("weight", 9).alias("weight"), F.col("rank").cast("long").alias("rank"))


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice, o_orderkey LIMIT 32")
def elite(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT10: the candidates with the least criterion (a top-k report)."""
    return branches.elite(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 32, ["o_orderkey"])


@query("""
WITH j AS (SELECT o_orderkey AS job, CASE o_orderstatus WHEN 'O' THEN 'queued' WHEN 'P' THEN 'submitted' ELSE 'running' END AS state FROM orders),
s AS (SELECT l_orderkey AS job, max(CASE WHEN l_returnflag = 'R' THEN 'running' END) AS state FROM lineitem GROUP BY 1)
SELECT coalesce(s.state, CASE WHEN j.state IN ('submitted', 'running') THEN 'done' ELSE j.state END) AS state, count(*) AS n FROM j LEFT JOIN s USING (job) GROUP BY 1""")
def job_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN16, STM06: jobs beside what the scheduler says."""
    status = F.col("o_orderstatus")
    jobs = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("job"), F.when(status == "O", "queued").when(status == "P", "submitted").otherwise("running").alias("state"))
    seen = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("job")).agg(F.max(F.when(F.col("l_returnflag") == "R", "running")).alias("state"))
    return branches.job_states(jobs, seen, "job").groupBy("state").agg(F.count(F.lit(1)).alias("n"))


@query(f"""
WITH v AS (SELECT DISTINCT user_id FROM events), h AS (SELECT user_id, sha256('{_OUTER}'::BLOB || unhex(sha256('{_INNER}'::BLOB || user_id::VARCHAR::BLOB))) AS visitor FROM v),
z AS (SELECT *, length(regexp_extract(visitor, '^0*')) AS zeros FROM h)
SELECT user_id, visitor, (zeros * 4 + CASE WHEN substring(visitor, zeros + 1, 1) >= '8' THEN 0 WHEN substring(visitor, zeros + 1, 1) >= '4' THEN 1 WHEN substring(visitor, zeros + 1, 1) >= '2' THEN 2 ELSE 3 END)::BIGINT AS zero_bits FROM z""")
def visitor_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH01: keyed visitor numbers by built-in digests, and their leading zero bits."""
    visitors = table(spark, sf_dir, "events").select("user_id").distinct().withColumn("visitor", branches.hmac_sha256(KEY, F.col("user_id").cast("string")))
    return visitors.withColumn("zero_bits", branches.leading_zero_bits(F.col("visitor")))


@query("""
WITH b AS (SELECT user_id, event_id, value, avg(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND 4 FOLLOWING) AS near FROM events)
SELECT user_id, count(*) AS n, count(*) FILTER (value >= near) AS active FROM b GROUP BY 1""")
def active_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ16, WIN06: values at or above a windowed mean, counted."""
    w = Window.partitionBy("user_id").orderBy("ts", "event_id").rowsBetween(-4, 4)
    near = table(spark, sf_dir, "events").select("user_id", "value", F.avg("value").over(w).alias("near"))
    return near.groupBy("user_id").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("value") >= F.col("near")).alias("active"))


@query("""
WITH c AS (SELECT l_returnflag, l_suppkey AS branch, l_partkey AS site, sum(l_discount)::DOUBLE * 5 AS u FROM lineitem GROUP BY ALL),
b AS (SELECT l_returnflag, l_suppkey AS branch, count(*) / 100.0 + l_suppkey % 7 AS length FROM lineitem GROUP BY l_returnflag, l_suppkey),
o AS (SELECT l_returnflag, branch, sum(u) AS observed, count(*) FILTER (u >= 0.6) AS invaded FROM c GROUP BY ALL),
n AS (SELECT l_returnflag, count(DISTINCT site) AS core FROM c GROUP BY ALL),
e AS (SELECT *, greatest(1e-5, greatest(1e-5, length) - greatest(0, observed - 1) / 5000) AS eff FROM b JOIN o USING (l_returnflag, branch) JOIN n USING (l_returnflag)),
r AS (SELECT *, row_number() OVER (PARTITION BY l_returnflag ORDER BY observed / eff, branch) AS rank, count(*) OVER (PARTITION BY l_returnflag) AS m FROM e),
k AS (SELECT *, (rank <= greatest(1, floor(m * 85 / 100)))::INT::DOUBLE AS kept FROM r),
d AS (SELECT *, sum(kept * observed) OVER (PARTITION BY l_returnflag) - kept * observed AS changes, sum(kept * eff) OVER (PARTITION BY l_returnflag) - kept * eff AS lengths FROM k),
x AS (SELECT *, greatest(0.25, CASE WHEN lengths > 1e-5 THEN changes / lengths ELSE 0 END * eff) AS expected FROM d),
y AS (SELECT *, greatest(expected * 2, least(observed, greatest(expected * 3, length * core * 0.75))) AS rate, observed > 2 * expected AND invaded >= 2 AND observed >= 2.5 AS tested FROM x)
SELECT l_returnflag, branch, round(observed, 6) AS observed, round(expected, 6) AS expected, invaded, round(CASE WHEN tested THEN greatest(-20, least(20, observed * ln(rate / expected) - (rate - expected))) END, 6) AS log_bf,
  round(CASE WHEN tested THEN greatest(0, 2 * (observed * ln(observed / expected) - (observed - expected))) END, 6) AS lrt FROM y""")
def lost_constraint(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA24: suppliers with more at their parts than the others, by leaving each out."""
    rows = table(spark, sf_dir, "lineitem").select("l_returnflag", F.col("l_suppkey").alias("branch"), F.col("l_partkey").alias("site"), F.col("l_discount").cast("double").alias("d"))
    counts = rows.groupBy("l_returnflag", "branch", "site").agg((F.sum("d") * 5).alias("u"))
    lengths = rows.groupBy("l_returnflag", "branch").agg((F.count(F.lit(1)) / 100.0 + F.col("branch") % 7).alias("length")).withColumn("sites", F.lit(5000))
    found = lineages.constraint_loss(counts, lengths, ["l_returnflag"])
    return found.select("l_returnflag", "branch", "invaded", *(F.round(c, 6).alias(c) for c in ("observed", "expected", "log_bf", "lrt")))


@query("""
WITH c AS (SELECT user_id, hour(ts) AS site, dayofyear(ts) % 31 AS branch, least(1.2, sum(value) / 50) AS u FROM events GROUP BY ALL HAVING sum(value) > 0),
l AS (SELECT user_id, branch, greatest(1e-4, 0.25 * 0.1 + sum(u)) AS load FROM c GROUP BY ALL), s AS (SELECT *, load / sum(load) OVER (PARTITION BY user_id) AS share FROM l),
g AS (SELECT user_id, sum(load ** 2) AS ll, sum(load) AS l, count(*) AS b FROM s GROUP BY ALL), u AS (SELECT * FROM c JOIN s USING (user_id, branch)),
t AS (SELECT user_id, site, sum(u) AS m, sum(u * load) / any_value(ll) AS d, sum(u * u) AS uu, count(*) FILTER (u >= 0.45) AS n, any_value(ll) AS ll, any_value(l) AS l, any_value(b) AS b FROM u JOIN g USING (user_id) GROUP BY ALL),
v AS (SELECT *, (m - d * l) / b AS c, uu - d ** 2 * ll - b * ((m - d * l) / b) ** 2 AS nn FROM t WHERE n >= 2 AND m >= 1.1),
a AS (SELECT u.*, n, d, c, ll, b, sqrt(greatest(0, nn)) AS norm FROM u JOIN v USING (user_id, site) WHERE nn > 1e-12),
p AS (SELECT x.user_id, x.site AS a, y.site AS b, sum(x.u * y.u) AS dot, count(*) FILTER (x.u >= 0.45 AND y.u >= 0.45) AS together, sum(least(1, x.u, y.u)) FILTER (x.u >= 0.45 AND y.u >= 0.45) AS shared,
  any_value(x.n) AS n1, any_value(y.n) AS n2, any_value(x.d * y.d * x.ll + x.b * x.c * y.c) AS off, any_value(x.norm * y.norm) AS norms FROM a x JOIN a y ON x.user_id = y.user_id AND x.branch = y.branch AND y.site > x.site + 2 GROUP BY ALL),
q AS (SELECT *, (dot - off) / norms AS cosine FROM p WHERE together >= 2 AND shared >= 1.1),
h AS (SELECT user_id, n1, n2, greatest(0.02, sum(least(1, n1 * share) * least(1, n2 * share))) AS expected FROM (SELECT DISTINCT user_id, n1, n2 FROM q WHERE cosine > 0.45) JOIN s USING (user_id) GROUP BY ALL)
SELECT user_id, a, b, together, round(shared, 6) AS shared, round(cosine, 6) AS cosine, round(expected, 6) AS expected FROM q JOIN h USING (user_id, n1, n2) WHERE cosine > 0.45 AND together > 1.5 * expected""")
def changing_together(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21: hours of a user's day that go together beyond what the days (modulo 31) explain; a user has 24 hours at most, as a gene has its sites."""
    rows = table(spark, sf_dir, "events").groupBy("user_id", F.hour("ts").cast("long").alias("site"), (F.dayofyear("ts") % 31).cast("long").alias("branch")).agg(F.sum("value").alias("v")).where("v > 0")
    counts = rows.withColumn("u", F.least(F.lit(1.2), F.col("v") / 50)).drop("v")
    lengths = counts.select("user_id", "branch").distinct().withColumn("length", F.lit(0.1))
    found = lineages.changing_together(counts, lengths, ["user_id"])
    return found.select("user_id", "a", "b", "together", *(F.round(c, 6).alias(c) for c in ("shared", "cosine", "expected")))


@query()
def silent_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN07 in full: stretches of each event type with next to no value; tests hold them against a plain scan."""
    rows = table(spark, sf_dir, "events").select("user_id", "event_id", (F.col("value") / 20).alias("alpha"), F.lit(0.0).alias("gap_fraction"))
    return islands.silent_islands(rows, ["user_id"], site="event_id")


@query()
def error_sinks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN12: runs of errors in each user's events, by the chain of error states; tests hold the chain against all paths."""
    odds = table(spark, sf_dir, "events").select(F.lit("all").alias("gene"), F.col("user_id").alias("branch"), F.col("event_id").alias("site"), F.when(F.col("event_type") == "error", 20.0).otherwise(0.2).alias("odds"))
    return islands.error_sinks(odds, ["gene"]).groupBy("branch").agg(F.first("log_z").alias("log_z"), F.first("flagged").alias("flagged"), F.sum("error").alias("error"))


@query()
def demo_genes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC19, SRC23, ANA01 for many genes: sixteen simulated genes, each fitted and scanned by the task that has it."""
    rows = [(f"gene{k}", simulate(seed=100 + k), DEMO_TREE) for k in range(16)]
    return genes.fel_genes(spark.createDataFrame(rows, "dataset_id string, alignment string, tree string"))


def _sixteen(spark: SparkSession, codons: int = 24) -> DataFrame:
    return spark.createDataFrame([(f"gene{k}", simulate(codons=codons, seed=200 + k), DEMO_TREE) for k in range(16)], "dataset_id string, alignment string, tree string")


@query()
def demo_busted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA07: sixteen simulated genes with rates that vary, steps of two and three bases and an error sink; classes by AICc."""
    return mixtures.busted_genes(_sixteen(spark), mixtures.Parts(2, 3, 3, 0.01), most=3)


@query()
def demo_phenotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA08: the same genes with the branches to a, b and c as those of a phenotype."""
    return mixtures.phenotype_genes(_sixteen(spark), "a,b,c", mixtures.Parts(2))


@query()
def demo_informed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA15: each site's omega given preferences: half for the commonest amino acid of the site, the rest even."""
    data = demo(spark)
    model = data.fit()
    amino = F.element_at(F.array(*map(F.lit, data.code.aa)), F.col("state") + 1)
    known = data.sites().where("state >= 0").withColumn("aa", amino).groupBy("site", "aa").agg(F.count(F.lit(1)).alias("n")).groupBy("site").agg(F.max_by("aa", F.struct("n", "aa")).alias("top"))
    letters = F.array(*map(F.lit, property_scan.AMINO))
    share = F.map_from_entries(F.transform(letters, lambda a: F.struct(a, F.when(a == F.col("top"), 0.525).otherwise(0.025))))
    prefs = known.select((F.col("site") + 1).alias("site"), share.alias("preferences"))
    informed, _ = preferences.fit_informed(data, model, prefs)
    return preferences.scan_informed(data, informed, prefs)


@query()
def demo_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA22: the log-fitness of each amino acid at each site, from rates and weights of the property scan."""
    data = demo(spark)
    model = data.fit()
    sites = property_scan.property_scan(data, model)
    return preferences.amino_rows(preferences.forecast(data, model, sites, reference="a"))


@query()
def demo_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA14: synonymous transitions against transversions in sixteen genes, and their rates over all of them."""
    pairs = [(a, b, "transition" if {x for p in zip(a, b, strict=True) if p[0] != p[1] for x in p} in ({"A", "G"}, {"C", "T"}) else "transversion", None) for a, b in tables.synonymous_pairs(code())]
    return synonymous.rates_over_genes(synonymous.class_genes(_sixteen(spark), pairs))
