"""Gates, text fields, graphs and segments over the driver's tables."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.functions import sequence as Q
from clademill.functions.stats import contingency
from clademill.operators import graph, joins, segments
from clademill.queries.registry import query, table


@query("""
WITH d AS (SELECT doc_id, regexp_replace(translate(text, 'acgtn', 'ACGTN'), '[^ACGTN]', '', 'g') AS dna FROM documents)
SELECT doc_id, CASE WHEN length(dna) < 60 THEN 'short' WHEN length(dna) % 3 <> 0 THEN 'frame' WHEN substring(dna, 1, 3) <> 'ATG' THEN 'start'
  WHEN length(dna) - length(replace(dna, 'N', '')) > 0.05 * length(dna) THEN 'unknown' ELSE 'ok' END AS reason FROM d""")
def reading_frame_check(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ21: why a sequence is no open frame, the first rule that fails."""
    dna = F.regexp_replace(F.translate("text", "acgtn", "ACGTN"), "[^ACGTN]", "")
    rows = table(spark, sf_dir, "documents").select("doc_id", dna.alias("dna"))
    n = F.length("dna")
    reason = (
        F.when(n < 60, "short").when(n % 3 != 0, "frame").when(F.substring("dna", 1, 3) != "ATG", "start").when(n - F.length(F.replace("dna", F.lit("N"), F.lit(""))) > 0.05 * n, "unknown").otherwise("ok")
    )
    return rows.select("doc_id", reason.alias("reason"))


@query(r"""
SELECT page_id, regexp_extract(url, '^https?://([^/?#]+)', 1) AS host, trim(regexp_replace(regexp_replace(url, '(/[A-Za-z0-9._-]+)+', '<path>', 'g'), '\s+', ' ', 'g')) AS scrubbed,
  TRY_CAST(nullif(regexp_extract(url, '[?&]page=(\d+)', 1), '') AS BIGINT) AS step, CASE WHEN regexp_matches(url, '[",\n\r]') THEN '"' || replace(url, '"', '""') || '"' ELSE url END AS field FROM pages""")
def log_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR10-STR12: hosts, scrubbed text, progress numbers and CSV fields."""
    url = F.col("url")
    scrubbed = F.trim(F.regexp_replace(F.regexp_replace(url, "(/[A-Za-z0-9._-]+)+", "<path>"), r"\s+", " "))
    step = F.regexp_extract("url", r"[?&]page=(\d+)", 1)
    return table(spark, sf_dir, "pages").select(
        "page_id", F.regexp_extract("url", "^https?://([^/?#]+)", 1).alias("host"), scrubbed.alias("scrubbed"), F.when(step != "", step.cast("long")).alias("step"), Q.csv_field(url).alias("field")
    )


@query(r"""
WITH s AS (SELECT l_orderkey, string_agg(l_returnflag || l_linenumber || l_linestatus, ';' ORDER BY l_linenumber, l_returnflag, l_linestatus) AS text FROM lineitem GROUP BY 1)
SELECT l_orderkey, len(regexp_extract_all(text, '[A-Z]\d+[A-Z]')) AS n, list_sum(list_transform(regexp_extract_all(text, '[A-Z](\d+)[A-Z]', 1), lambda x: x::BIGINT))::BIGINT AS total FROM s""")
def substitution_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR08, STR13: substitutions written as text and read back."""
    item = F.struct("l_linenumber", "l_returnflag", "l_linestatus")
    rows = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(item)).alias("i"))
    text = F.array_join(F.transform("i", lambda x: F.concat(x["l_returnflag"], x["l_linenumber"].cast("string"), x["l_linestatus"])), ";")
    numbers = F.regexp_extract_all(text, F.lit(r"[A-Z](\d+)[A-Z]"), F.lit(1))
    return rows.select("l_orderkey", F.size(numbers).cast("long").alias("n"), F.aggregate(numbers, F.lit(0).cast("long"), lambda a, x: a + x.cast("long")).alias("total"))


@query()
def graph_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN15: connected components of suppliers and parts over every edge of lineitem; tests hold it against union-find."""
    e = table(spark, sf_dir, "lineitem").select("l_suppkey", (F.col("l_partkey") + 1000000).alias("p"))
    return graph.components(e, "l_suppkey", "p")


@query("""
WITH k AS (SELECT item_id, unnest(list_distinct(string_split(text, ' '))) AS w FROM benchmark)
SELECT x.item_id AS a, y.item_id AS b, count(*) AS shared FROM k x JOIN k y ON x.w = y.w AND x.item_id < y.item_id GROUP BY ALL""")
def shared_words(spark: SparkSession, sf_dir: str) -> DataFrame:
    """JN14: pairs by an inverted index."""
    return joins.shared_kmers(table(spark, sf_dir, "benchmark"), "item_id", F.split("text", " "))


@query("""
WITH c AS (SELECT doc_id, lang, len(regexp_extract_all(text, '[GCgc]'))::DOUBLE AS gc, len(regexp_extract_all(text, '[ATat]'))::DOUBLE AS ta FROM documents),
l AS (SELECT lang, base, sum(n) AS n FROM (SELECT lang, 'gc' AS base, gc AS n FROM c UNION ALL SELECT lang, 'at', ta FROM c) GROUP BY ALL),
e AS (SELECT l.*, sum(n) OVER (PARTITION BY lang) * sum(n) OVER (PARTITION BY base) / sum(n) OVER () AS e, sum(n) OVER () AS t FROM l)
SELECT round(sum((n - e) ** 2 / e), 4) AS chi2, (count(DISTINCT lang) - 1) * (count(DISTINCT base) - 1) AS df, max(t) AS total FROM e""")
def composition_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG07, AGG08: composition of groups against the whole."""
    docs = table(spark, sf_dir, "documents")
    each = docs.select("lang", F.explode(F.array(*(F.struct(F.lit(k).alias("base"), F.regexp_count("text", F.lit(p)).cast("double").alias("n")) for k, p in (("gc", "[GCgc]"), ("at", "[ATat]"))))).alias("x"))
    return contingency(each.select("lang", "x.base", "x.n"), "lang", "base", "n").withColumn("chi2", F.round("chi2", 4))


@query("""
WITH d AS (SELECT user_id, event_id, sum((event_type = 'error')::INT) OVER w AS hits, count(*) OVER w AS n FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id ROWS 10 PRECEDING))
SELECT user_id, event_id, hits::BIGINT AS hits, round((hits - 11 * 0.2) / sqrt(11 * 0.2 * 0.8), 6) AS z FROM d WHERE n = 11""")
def dense_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN07: windows of eleven with more hits than by chance."""
    found = segments.dense_windows(table(spark, sf_dir, "events").select("user_id", "event_id", "event_type"), F.col("event_type") == "error", ["user_id"], "event_id", 11, 0.2)
    return found.select("user_id", "event_id", "hits", F.round("z", 6).alias("z"))


@query()
def change_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN08: segments of each user's values."""
    return segments.segment_groups(table(spark, sf_dir, "events"), "user_id", "event_id", "value")


@query()
def best_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """WIN09: the best scoring segment with a permutation test."""
    return segments.best_segments(table(spark, sf_dir, "events"), "event_type", "event_id", "value")
