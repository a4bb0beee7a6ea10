"""Windows, joins, sets, classifications and telemetry over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from clademill.operators import aggregates as A
from clademill.operators import joins as J
from clademill.operators import windows as W
from clademill.queries.registry import query, table


def _daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    day = F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("long")
    return table(spark, sf_dir, "orders").groupBy("o_orderpriority", day.alias("day")).agg(F.sum("o_totalprice").alias("revenue"))


DAILY = "WITH d AS (SELECT o_orderpriority, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day, sum(o_totalprice) AS revenue FROM orders GROUP BY ALL)"


@query(f"""{DAILY} SELECT o_orderpriority, day, round(avg(revenue) OVER (w ROWS BETWEEN 2 PRECEDING AND 2 FOLLOWING), 2) AS smoothed, round(sum(revenue) OVER (w ROWS UNBOUNDED PRECEDING), 2) AS prefix,
  lag(day) OVER w AS left_day, lead(day) OVER w AS right_day FROM d WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)""")
def smoothed_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN04, WIN05, WIN11: centred means, prefix sums and neighbours."""
    d = W.neighbours(W.prefix_sum(W.smooth(_daily(spark, sf_dir), "revenue", ["o_orderpriority"], "day"), "revenue", ["o_orderpriority"], "day"), "day", ["o_orderpriority"], "day")
    return d.select("o_orderpriority", "day", F.round("smoothed", 2).alias("smoothed"), F.round("prefix", 2).alias("prefix"), "left_day", "right_day")


@query(f"""{DAILY}, h AS (SELECT * FROM d WHERE revenue > 300000), g AS (SELECT *, day - lag(day) OVER w > 1 AS new FROM h WINDOW w AS (PARTITION BY o_orderpriority ORDER BY day)),
r AS (SELECT *, sum(coalesce(new, false)::INT) OVER (PARTITION BY o_orderpriority ORDER BY day) AS run FROM g)
SELECT o_orderpriority, min(day) AS first, max(day) AS last, count(*) AS n FROM r GROUP BY o_orderpriority, run""")
def busy_islands(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ13: gaps and islands."""
    return W.islands(_daily(spark, sf_dir), F.col("revenue") > 300000, ["o_orderpriority"], "day")


@query("""
SELECT user_id, event_id, previous FROM (SELECT user_id, event_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY event_id) AS previous FROM events) WHERE event_id - previous <= 20""")
def close_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN13: neighbouring places of one branch that are close together."""
    return W.close_pairs(table(spark, sf_dir, "events").select("user_id", "event_id"), ["user_id"], "event_id", 20)


@query("""
SELECT s_suppkey, round((sum(s_acctbal) OVER w - s_acctbal) / nullif(count(*) OVER w - 1, 0), 4) AS others FROM supplier WINDOW w AS (PARTITION BY s_nationkey)""")
def leave_one_out(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA24: a branch against the mean of the others."""
    return W.leave_one_out(table(spark, sf_dir, "supplier"), "s_acctbal", ["s_nationkey"]).select("s_suppkey", F.round("others", 4).alias("others"))


@query("""
SELECT o_custkey, o_orderkey, rank FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rank FROM orders) WHERE rank <= 3""")
def top_three(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT05, SRT11: the best three of each group."""
    rows = W.top_k(table(spark, sf_dir, "orders"), ["o_custkey"], [F.col("o_totalprice").desc(), F.col("o_orderkey")], 3)
    return rows.select("o_custkey", "o_orderkey", F.col("rank").cast("long").alias("rank"))


@query("SELECT s_suppkey, s_acctbal FROM supplier ORDER BY s_acctbal DESC, s_suppkey LIMIT 5")
def closest_calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT01-SRT03, SRT06: top n with a tie-break; the limit is the feature."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", "s_acctbal").orderBy(F.col("s_acctbal").desc(), "s_suppkey").limit(5)


@query("SELECT p_partkey, p_name, p_retailprice FROM part WHERE p_retailprice > 1000 AND contains(lower(p_name), 'ring') ORDER BY p_retailprice DESC, p_partkey LIMIT 20 OFFSET 20")
def result_page(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ15, SRT07: filter, case-insensitive search, sort and one page of a results table; the page is the feature."""
    rows = table(spark, sf_dir, "part").where((F.col("p_retailprice") > 1000) & F.lower("p_name").contains("ring"))
    return rows.select("p_partkey", "p_name", "p_retailprice").orderBy(F.col("p_retailprice").desc(), "p_partkey").offset(20).limit(20)


CLASSES = ["pervasive", "episodic", "purifying", "neutral"]


def classify(p_high, p_mid, direction):
    """First rule that holds: pervasive, episodic, purifying, else neutral."""
    return F.when(p_high & (direction > 0), CLASSES[0]).when(p_mid & (direction > 0), CLASSES[1]).when(p_high & (direction <= 0), CLASSES[2]).otherwise(CLASSES[3])


@query("""
WITH c AS (SELECT CASE WHEN l_discount >= 0.08 AND l_quantity > 25 THEN 'pervasive' WHEN l_tax >= 0.06 AND l_quantity > 25 THEN 'episodic' WHEN l_discount >= 0.08 THEN 'purifying' ELSE 'neutral' END AS label FROM lineitem)
SELECT count(*) FILTER (label = 'pervasive') AS pervasive, count(*) FILTER (label = 'episodic') AS episodic, count(*) FILTER (label = 'purifying') AS purifying, count(*) FILTER (label = 'neutral') AS neutral, count(*) AS total FROM c""")
def site_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ14, AGG14, AGG24: ordered labels and their counts."""
    label = classify(F.col("l_discount") >= 0.08, F.col("l_tax") >= 0.06, F.col("l_quantity") - 25)
    return A.class_counts(table(spark, sf_dir, "lineitem").select(label.alias("label")), "label", CLASSES)


@query("""
WITH s AS (SELECT l_orderkey AS site, max(CASE WHEN l_linenumber = 1 THEN l_returnflag END) AS a, max(CASE WHEN l_linenumber = 2 THEN l_returnflag END) AS b, max(CASE WHEN l_linenumber = 3 THEN l_returnflag END) AS c FROM lineitem GROUP BY 1),
p AS (SELECT a, b, c, count(*) AS weight, min(site) AS first_site FROM s GROUP BY ALL)
SELECT a, b, c, weight, first_site, row_number() OVER (ORDER BY first_site) - 1 AS pattern_id, len(list_distinct([x for x in [a, b, c] if x IS NOT NULL])) <= 1 AS invariant FROM p""")
def site_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG01, PRJ12: distinct columns with weights, and which never vary."""
    at = lambda k: F.max(F.when(F.col("l_linenumber") == k, F.col("l_returnflag")))
    sites = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("site")).agg(at(1).alias("a"), at(2).alias("b"), at(3).alias("c"))
    return A.compress_patterns(sites, ["a", "b", "c"], "site").select(
        "a", "b", "c", "weight", "first_site", F.col("pattern_id").cast("long").alias("pattern_id"), (F.size(F.array_distinct(F.array_compact(F.array("a", "b", "c")))) <= 1).alias("invariant")
    )


@query("""
WITH p AS (SELECT o_orderstatus, o_orderpriority, avg(o_totalprice) AS v FROM orders GROUP BY ALL) SELECT o_orderkey AS site, round(v, 4) AS value FROM orders JOIN p USING (o_orderstatus, o_orderpriority)""")
def expanded_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN02: evaluate once for each pattern, expand to sites."""
    states = ["o_orderstatus", "o_orderpriority"]
    orders = table(spark, sf_dir, "orders")
    patterns = A.compress_patterns(orders, states, "o_orderkey")
    values = orders.groupBy(*states).agg(F.avg("o_totalprice").alias("value"))
    results = patterns.select("pattern_id", *states).join(values, states).select("pattern_id", "value")
    return A.expand_patterns(results, patterns, orders, states, "o_orderkey").select("site", F.round("value", 4).alias("value"))


@query("""
WITH c AS (SELECT user_id, event_type, count(*) AS c FROM events GROUP BY ALL), h AS (SELECT user_id, 1 - sum(c * c)::DOUBLE / (sum(c) * sum(c)) AS h FROM c GROUP BY 1)
SELECT user_id, round(h, 6) AS h, round(1 / sqrt(h + 0.05) / avg(1 / sqrt(h + 0.05)) OVER (), 6) AS weight FROM h""")
def variability_weights(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG06: weights from the diversity of a site."""
    return A.gini_weights(table(spark, sf_dir, "events"), "user_id", "event_type").select("user_id", F.round("h", 6).alias("h"), F.round("weight", 6).alias("weight"))


@query("""
WITH c AS (SELECT c_nationkey, c_mktsegment, count(*) AS c FROM customer GROUP BY ALL)
SELECT c_nationkey, arg_min(c_mktsegment, (-c, c_mktsegment)) AS consensus, round(max(c) / sum(c), 6) AS share FROM c GROUP BY 1""")
def consensus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG25: the majority state."""
    return A.consensus(table(spark, sf_dir, "customer"), ["c_nationkey"], "c_mktsegment").select("c_nationkey", "consensus", F.round("share", 6).alias("share"))


@query("""
WITH e AS (SELECT lang, sum(length(text) - length(replace(text, 'th', '')))::DOUBLE / 2 AS hits, sum(length(text) - length(replace(text, 't', '')))::DOUBLE AS places FROM documents GROUP BY 1),
s AS (SELECT *, sum(hits) OVER () / sum(places) OVER () AS s FROM e)
SELECT lang, hits, places, round(CASE WHEN hits > 0 THEN 2 * hits * ln(hits / (places * s)) ELSE 0 END + CASE WHEN places - hits > 0 THEN 2 * (places - hits) * ln((places - hits) / (places * (1 - s))) ELSE 0 END, 4) AS g FROM s""")
def motif_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG20: motif counts and the G test."""
    return A.motif_enrichment(table(spark, sf_dir, "documents"), ["lang"], F.col("text"), "th", "t").select("lang", "hits", "places", F.round("g", 4).alias("g"))


@query("""
SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'site' ELSE 'branch' END AS level, coalesce(l_returnflag, l_linestatus) AS name, round(sum(l_quantity), 4) AS quantity, round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS n
FROM lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""")
def site_and_branch_sums(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG13: sums by site and by branch in one pass."""
    table(spark, sf_dir, "lineitem").createOrReplaceTempView("clademill_lineitem")
    return spark.sql("""
        SELECT CASE WHEN grouping(l_returnflag) = 0 THEN 'site' ELSE 'branch' END AS level, coalesce(l_returnflag, l_linestatus) AS name, round(sum(l_quantity), 4) AS quantity,
               round(sum(l_extendedprice * (1 - l_discount)), 2) AS net, count(*) AS n
        FROM clademill_lineitem GROUP BY GROUPING SETS ((l_returnflag), (l_linestatus))""")


@query("""
WITH u AS (SELECT DISTINCT user_id, date_diff('day', DATE '2024-01-01', ts::DATE) AS site FROM events WHERE event_type = 'error')
SELECT x.site AS a, y.site AS b, count(*) AS shared FROM u x JOIN u y ON x.user_id = y.user_id AND x.site + 2 < y.site GROUP BY ALL HAVING count(*) >= 2""")
def shared_branches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG21, JN08: pairs of sites more than two apart that change on at least two common branches."""
    u = table(spark, sf_dir, "events").where("event_type = 'error'").select("user_id", F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("site")).distinct()
    x, y = u.alias("x"), u.alias("y")
    return x.join(y, (F.col("x.user_id") == F.col("y.user_id")) & (F.col("x.site") + 2 < F.col("y.site"))).groupBy(F.col("x.site").alias("a"), F.col("y.site").alias("b")).agg(F.count(F.lit(1)).alias("shared")).where("shared >= 2")


@query("""
WITH s AS (SELECT p_partkey AS span, p_size * 40 AS s, p_size * 40 + p_partkey % 60 AS e FROM part)
SELECT o_orderkey, span FROM (SELECT o_orderkey, date_diff('day', DATE '1992-01-01', o_orderdate::DATE) AS day FROM orders) JOIN s ON day BETWEEN s AND e""")
def range_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN10, JN12, PRJ27: sites in segments, by buckets."""
    points = table(spark, sf_dir, "orders").select("o_orderkey", F.datediff(F.to_date("o_orderdate"), F.lit("1992-01-01")).cast("long").alias("day"))
    spans = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("span"), (F.col("p_size") * 40).cast("long").alias("s"), (F.col("p_size") * 40 + F.col("p_partkey") % 60).alias("e"))
    return J.range_join(points, spans, "day", "s", "e", 64).select("o_orderkey", "span")


@query("""
WITH s AS (SELECT s_suppkey AS k, floor(s_acctbal / 10)::BIGINT AS s, floor(s_acctbal / 10)::BIGINT + 20 AS e FROM supplier)
SELECT x.k AS a, y.k AS b, least(x.e, y.e) - greatest(x.s, y.s) + 1 AS common FROM s x JOIN s y ON x.k < y.k AND x.s <= y.e AND y.s <= x.e""")
def overlapping_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN11: interval overlaps."""
    s = F.floor(F.col("s_acctbal") / 10).cast("long")
    return J.overlaps(table(spark, sf_dir, "supplier").select(F.col("s_suppkey").alias("k"), s.alias("s"), (s + 20).alias("e")), "k", "s", "e", 32)


@query("""
WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings), n AS (SELECT vec_id, e, sqrt(list_inner_product(e, e)) AS n FROM v),
p AS (SELECT a.vec_id AS query, b.vec_id AS match, round(list_inner_product(a.e, b.e) / (a.n * b.n), 9) AS cosine FROM n a JOIN n b ON a.vec_id <> b.vec_id),
r AS (SELECT *, row_number() OVER (PARTITION BY query ORDER BY cosine DESC, match) AS rank FROM p)
SELECT query, match, round(cosine, 5) AS cosine, rank FROM r WHERE rank <= 5""")
def nearest_vectors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN13, MTH13: the five nearest by cosine, exact, in blocks."""
    found = J.nearest(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", 5)
    return found.select("query", "match", F.round("cosine", 5).alias("cosine"), F.col("rank").cast("long").alias("rank"))


@query("""
WITH p AS (SELECT a.n_nationkey AS i, b.n_nationkey AS j, abs(a.n_regionkey - b.n_regionkey) / 5.0 + levenshtein(a.n_name, b.n_name) / 10.0 AS d FROM nation a JOIN nation b ON a.n_nationkey < b.n_nationkey),
m AS (SELECT quantile_cont(d, 0.5) AS s FROM p) SELECT i, j, round(d, 6) AS d, round(exp(-d / s) / (d + 1e-6), 6) AS w FROM p, m""")
def conductance(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN04, MTH11: all pairs of a fixed dimension, conductance at the scale of the median distance."""
    n = table(spark, sf_dir, "nation").withColumn("v", F.struct("n_name", "n_regionkey"))
    d = F.abs(F.col("x.n_regionkey") - F.col("y.n_regionkey")) / 5.0 + F.levenshtein(F.col("x.n_name"), F.col("y.n_name")) / 10.0
    pairs = J.pairwise(n, "n_nationkey", "v", d).select("i", "j", F.col("distance").alias("d"))
    scale = pairs.agg(F.percentile("d", 0.5).alias("s"))
    return pairs.crossJoin(F.broadcast(scale)).select("i", "j", F.round("d", 6).alias("d"), F.round(F.exp(-F.col("d") / F.col("s")) / (F.col("d") + 1e-6), 6).alias("w"))  # one row broadcast


@query("""
WITH RECURSIVE r AS (SELECT r_regionkey AS node, NULL::INT AS parent, r_name AS state FROM region UNION ALL SELECT 100 + n_nationkey, n_regionkey, n_name FROM nation)
SELECT c.node AS child, p.state AS "from", c.state AS "to", (SELECT count(*) FROM customer WHERE c_nationkey + 100 = c.node) AS customers FROM r c JOIN r p ON c.parent = p.node WHERE c.state <> p.state""")
def parent_child(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN09, JN06: states that differ between child and parent, with labels joined to the nodes."""
    region, nation = table(spark, sf_dir, "region"), table(spark, sf_dir, "nation")
    nodes = nation.select((F.col("n_nationkey") + 100).alias("node"), F.col("n_regionkey").alias("parent"))
    states = region.select(F.col("r_regionkey").alias("node"), F.col("r_name").alias("state")).unionAll(nation.select(F.col("n_nationkey") + 100, "n_name")).withColumn("site", F.lit(0))
    counts = table(spark, sf_dir, "customer").groupBy((F.col("c_nationkey") + 100).alias("child")).agg(F.count(F.lit(1)).alias("customers"))
    return J.substitutions(nodes, states).join(counts, "child", "left").select("child", "from", "to", F.coalesce("customers", F.lit(0)).cast("long").alias("customers"))


@query("""
SELECT c_custkey, coalesce(e.s_suppkey, l.k) AS s_suppkey FROM (SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN replace(c_name, 'Customer', 'Supplier') ELSE replace(c_name, 'Customer', 'SUPPLIER') END AS name FROM customer) c
LEFT JOIN supplier e ON e.s_name = c.name LEFT JOIN (SELECT lower(s_name) AS low, min(s_suppkey) AS k FROM supplier GROUP BY 1) l ON lower(c.name) = l.low""")
def name_matching(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN01: leaves to taxa by exact name, then in lower case."""
    other = F.when(F.col("c_custkey") % 2 == 0, F.lit("Supplier")).otherwise(F.lit("SUPPLIER"))
    left = table(spark, sf_dir, "customer").select("c_custkey", F.replace("c_name", F.lit("Customer"), other).alias("name"))
    return J.with_fallback(left, table(spark, sf_dir, "supplier").select("s_name", "s_suppkey"), "name", "s_name", "s_suppkey").select("c_custkey", "s_suppkey")


@query("""
WITH m AS (SELECT o_custkey AS k, list_sort(list_distinct(list(o_orderpriority))) AS model FROM orders GROUP BY 1),
u AS (SELECT DISTINCT model FROM m), seen AS (SELECT DISTINCT list_sort(list_distinct(list(o_orderpriority))) AS model FROM orders WHERE o_orderstatus = 'F' GROUP BY o_custkey)
SELECT array_to_string(model, '|') AS model, len(model) AS size, model IN (SELECT model FROM seen) AS known FROM u""")
def model_sets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET01, SET02, SET05: distinct models, and those evaluated before."""
    build = lambda df: df.groupBy("o_custkey").agg(F.array_sort(F.collect_set("o_orderpriority")).alias("model")).select("model").distinct()
    orders = table(spark, sf_dir, "orders")
    seen = build(orders.where("o_orderstatus = 'F'")).withColumn("known", F.lit(True))
    return build(orders).join(seen, "model", "left").select(F.array_join("model", "|").alias("model"), F.size("model").cast("long").alias("size"), F.coalesce("known", F.lit(False)).alias("known"))


@query("""
WITH s AS (SELECT l_orderkey, bit_or(1::BIGINT << l_linenumber) AS bits FROM lineitem GROUP BY 1), m AS (SELECT bit_or(bits) AS every FROM s)
SELECT l_orderkey, least(bits, every - bits) AS canonical, bit_count(bits)::BIGINT AS members, bit_count(bits) > 1 AND bit_count(every - bits) > 1 AS informative, (bits & 14) IN (0, 14) AS compatible FROM s, m""")
def split_masks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET03: splits as bit masks."""
    s = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.bit_or(F.expr("shiftleft(1L, l_linenumber)")).alias("bits"))
    both = s.crossJoin(F.broadcast(s.agg(F.bit_or("bits").alias("every"))))  # one row broadcast
    rest = F.col("every") - F.col("bits")
    return both.select(
        "l_orderkey", F.least("bits", rest).alias("canonical"), F.bit_count("bits").cast("long").alias("members"),
        ((F.bit_count("bits") > 1) & (F.bit_count(rest) > 1)).alias("informative"), F.col("bits").bitwiseAND(F.lit(14)).isin(0, 14).alias("compatible"),
    )


@query("""
WITH s AS (SELECT o_custkey, list_distinct(list(o_orderpriority)) AS a, list_distinct(list(o_orderpriority) FILTER (o_orderstatus = 'F')) AS b FROM orders GROUP BY 1)
SELECT o_custkey, len(a) + coalesce(len(b), 0) - 2 * coalesce(len(list_intersect(a, b)), 0) AS robinson_foulds FROM s""")
def robinson_foulds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET04: symmetric difference of two sets of splits."""
    s = table(spark, sf_dir, "orders").groupBy("o_custkey").agg(F.collect_set("o_orderpriority").alias("a"), F.collect_set(F.when(F.col("o_orderstatus") == "F", F.col("o_orderpriority"))).alias("b"))
    return s.select("o_custkey", (F.size(F.array_except("a", "b")) + F.size(F.array_except("b", "a"))).cast("long").alias("robinson_foulds"))


@query("SELECT text, count(*) AS copies, min(doc_id) AS first, list_sort(list(doc_id))::VARCHAR AS members FROM documents GROUP BY 1 HAVING count(*) > 1")
def supernodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SET07: equal sequences collapsed."""
    g = table(spark, sf_dir, "documents").groupBy("text").agg(F.count(F.lit(1)).alias("copies"), F.min("doc_id").alias("first"), F.concat(F.lit("["), F.array_join(F.sort_array(F.collect_list("doc_id")), ", "), F.lit("]")).alias("members"))
    return g.where("copies > 1")


@query("""
SELECT strftime(ts, '%Y-%m-%d') AS day, count(DISTINCT user_id) AS visitors, count(*) AS events, round(avg(nullif(value, 0)), 6) AS mean, max(value) AS most, sum(CASE WHEN event_type = 'error' THEN 1 ELSE 0 END)::BIGINT AS errors
FROM events GROUP BY 1""")
def telemetry_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG22, AGG23: the daily rollup."""
    return table(spark, sf_dir, "events").groupBy(F.date_format("ts", "yyyy-MM-dd").alias("day")).agg(
        F.count_distinct("user_id").alias("visitors"), F.count(F.lit(1)).alias("events"), F.round(F.avg(F.nullif("value", F.lit(0.0))), 6).alias("mean"), F.max("value").alias("most"), F.count_if(F.col("event_type") == "error").alias("errors")
    )


@query("SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL ORDER BY n DESC, user_id, event_type LIMIT 12")
def telemetry_top(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT08: a top-12 report; the limit is the feature."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.count(F.lit(1)).alias("n")).orderBy(F.desc("n"), "user_id", "event_type").limit(12)


@query("""
WITH n AS (SELECT max(ts) AS now FROM events)
SELECT event_type, count(*) FILTER (ts >= now - INTERVAL 24 HOUR) AS day, count(*) FILTER (ts >= now - INTERVAL 7 DAY) AS week, count(*) AS kept FROM events, n WHERE ts >= now - INTERVAL 25 DAY GROUP BY 1""")
def telemetry_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM03, STM04, DAT01: rolling 24 h and 7 d, after the retention."""
    events = table(spark, sf_dir, "events")
    both = events.crossJoin(F.broadcast(events.agg(F.max("ts").alias("now"))))  # one row broadcast
    since = lambda days: F.col("ts") >= F.col("now") - F.expr(f"INTERVAL {days} DAY")
    return both.where(since(25)).groupBy("event_type").agg(F.count_if(since(1)).alias("day"), F.count_if(since(7)).alias("week"), F.count(F.lit(1)).alias("kept"))


@query("""
SELECT user_id, strftime(date_trunc('minute', ts), '%Y-%m-%d %H:%M') AS minute, count(*) AS n, count(*) <= 1 AS admitted FROM events GROUP BY ALL""")
def rate_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STM02: events of a user in each minute against a limit."""
    minute = F.date_format(F.date_trunc("minute", F.col("ts")), "yyyy-MM-dd HH:mm")
    return table(spark, sf_dir, "events").groupBy("user_id", minute.alias("minute")).agg(F.count(F.lit(1)).alias("n")).withColumn("admitted", F.col("n") <= 1)


@query("SELECT o_orderkey, strftime(o_orderdate, '%Y-%m-%d') AS created FROM (SELECT o_orderkey, o_orderdate::DATE AS o_orderdate FROM orders WHERE o_orderstatus = 'O' ORDER BY o_orderdate, o_orderkey LIMIT 10)")
def queue_head(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRT09: the first jobs in the queue; the limit is the feature."""
    rows = table(spark, sf_dir, "orders").where("o_orderstatus = 'O'").orderBy("o_orderdate", "o_orderkey").limit(10)
    return rows.select("o_orderkey", F.date_format("o_orderdate", "yyyy-MM-dd").alias("created"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts DESC, event_id DESC) AS r FROM events) WHERE r = 1")
def latest_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN17, STM05: the latest result of each cache key."""
    return table(spark, sf_dir, "events").groupBy("user_id", "event_type").agg(F.max_by("event_id", F.struct("ts", "event_id")).alias("event_id"))


@query("""
SELECT event_id, (props ->> 'k')::BIGINT AS k, CASE WHEN (props ->> 'k') IS NULL THEN 'none' WHEN (props ->> 'k')::BIGINT >= 50 THEN 'modern' ELSE 'legacy' END AS layout, '{"id":' || event_id || ',"type":"' || event_type || '"}' AS document FROM events""")
def json_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JSN01, SRC20: nested JSON read, layout found out, JSON built."""
    k = F.get_json_object("props", "$.k").cast("long")
    return table(spark, sf_dir, "events").select(
        "event_id", k.alias("k"), F.when(k.isNull(), "none").when(k >= 50, "modern").otherwise("legacy").alias("layout"), F.to_json(F.struct(F.col("event_id").alias("id"), F.col("event_type").alias("type"))).alias("document")
    )


@query("""
SELECT o_custkey, max(CASE WHEN o_orderstatus = 'F' THEN o_totalprice END) AS best_f, count(DISTINCT o_orderstatus) AS keys FROM orders GROUP BY 1""")
def branch_maps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """MAP01, ARR01: values by branch as a map."""
    best = table(spark, sf_dir, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.max("o_totalprice").alias("v"))
    maps = best.groupBy("o_custkey").agg(F.map_from_entries(F.collect_list(F.struct("o_orderstatus", "v"))).alias("m"))
    return maps.select("o_custkey", F.try_element_at("m", F.lit("F")).alias("best_f"), F.size("m").cast("long").alias("keys"))


@query("""
WITH v AS (SELECT doc_id, list_filter([CASE WHEN n_chars < 200 THEN 'short' END, CASE WHEN n_chars > 30000 THEN 'long' END, CASE WHEN lang NOT IN ('en', 'de') THEN 'language' END, CASE WHEN length(regexp_replace(text, '[^A-Za-z ]', '', 'g')) < 0.8 * length(text) THEN 'letters' END], lambda x: x IS NOT NULL) AS v FROM documents)
SELECT doc_id, array_to_string(v, ',') AS violations, len(v) = 0 AS admitted FROM v""")
def upload_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ17, PRJ22, PRJ23: a table of rules, and all that a row violates."""
    rules = {
        "short": F.col("n_chars") < 200, "long": F.col("n_chars") > 30000, "language": ~F.col("lang").isin("en", "de"),
        "letters": F.length(F.regexp_replace("text", "[^A-Za-z ]", "")) < 0.8 * F.length("text"),
    }
    found = F.array_compact(F.array(*(F.when(c, F.lit(k)) for k, c in rules.items())))
    return table(spark, sf_dir, "documents").select("doc_id", F.array_join(found, ",").alias("violations"), (F.size(found) == 0).alias("admitted"))


@query("""
WITH m AS (SELECT lang, quantile_cont(n_chars, 0.5) AS m FROM documents GROUP BY 1)
SELECT doc_id, CASE WHEN n_chars < 0.3 * m THEN 'short' WHEN n_chars > 2.8 * m THEN 'long' ELSE 'ok' END AS gate FROM documents JOIN m USING (lang)""")
def length_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ19: lengths against the median of the group."""
    docs = table(spark, sf_dir, "documents")
    m = docs.groupBy("lang").agg(F.percentile("n_chars", 0.5).alias("m"))
    gate = F.when(F.col("n_chars") < 0.3 * F.col("m"), "short").when(F.col("n_chars") > 2.8 * F.col("m"), "long").otherwise("ok")
    return docs.select("doc_id", "lang", "n_chars").join(m, "lang").select("doc_id", gate.alias("gate"))


@query("""
WITH e AS (SELECT l_returnflag || '>' || l_linestatus AS exchange, l_suppkey AS site, count(*) AS c FROM lineitem GROUP BY ALL)
SELECT site, sum(c)::BIGINT AS events, count(*) AS kinds, max(c) AS most, string_agg(exchange || ':' || c, ',' ORDER BY exchange) AS summary FROM e GROUP BY 1""")
def exchange_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA25, STR08: exchanges of a site as counts and as text."""
    e = table(spark, sf_dir, "lineitem").groupBy(F.concat_ws(">", "l_returnflag", "l_linestatus").alias("exchange"), F.col("l_suppkey").alias("site")).agg(F.count(F.lit(1)).alias("c"))
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("exchange", "c"))), lambda x: F.concat_ws(":", x["exchange"], x["c"].cast("string"))), ",")
    return e.groupBy("site").agg(F.sum("c").alias("events"), F.count(F.lit(1)).alias("kinds"), F.max("c").alias("most"), text.alias("summary"))


def telemetry_visitors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """HSH01: visitor ids as digests that change with the day."""
    day = F.date_format("ts", "yyyy-MM-dd")
    return table(spark, sf_dir, "events").select("event_id", F.sha2(F.concat_ws("|", day, F.col("user_id").cast("string")), 256).alias("visitor"))


query("SELECT event_id, sha256(strftime(ts, '%Y-%m-%d') || '|' || user_id) AS visitor FROM events")(telemetry_visitors)


def first_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN06: each user's sliding sum over three events."""
    w = Window.partitionBy("user_id").orderBy("event_id").rowsBetween(-2, 0)
    return table(spark, sf_dir, "events").select("event_id", F.round(F.avg("value").over(w), 6).alias("affinity"))


query("SELECT event_id, round(avg(value) OVER (PARTITION BY user_id ORDER BY event_id ROWS 2 PRECEDING), 6) AS affinity FROM events")(first_days)
