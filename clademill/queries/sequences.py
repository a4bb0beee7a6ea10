"""Sequence functions over the documents' letters, and the analyses over a small simulated gene."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.analyses import gene_tests, site_scans
from clademill.analyses.dataset import Dataset
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.functions import sequence as Q
from clademill.kernels import frames
from clademill.model.codes import CODONS, STANDARD, codon_table
from clademill.operators import alignment
from clademill.queries.registry import query, table

DNA = "regexp_replace(upper(text), '[^ACGT]', '', 'g')"
TABLE = "(VALUES " + ", ".join(f"('{c}', '{a}')" for c, a in zip(CODONS, STANDARD, strict=True)) + ") AS t(codon, aa)"


def _dna(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", "lang", F.regexp_replace(F.upper("text"), "[^ACGT]", "").alias("dna"))


@query("SELECT doc_id, sha256(reverse(translate(regexp_replace(translate(text, 'acgtu', 'ACGTU'), '[^ACGTU]', 'N', 'g'), 'ACGTU', 'TGCAA'))) AS reversed FROM documents")
def reverse_complement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR01."""
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2(Q.reverse_complement(F.col("text")), 256).alias("reversed"))


@query(f"""
WITH d AS (SELECT lang, {DNA} AS dna FROM documents), c AS (SELECT lang, substring(dna, k * 3 + 1, 3) AS codon FROM (SELECT lang, dna, unnest(range(length(dna) // 3)) AS k FROM d)),
g AS (SELECT lang, codon, aa, count(*) AS n FROM c JOIN {TABLE} USING (codon) GROUP BY ALL)
SELECT lang, codon, aa, n, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang, aa), 6) AS share FROM g""")
def codon_usage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """PRJ01, PRJ05, JN03: codons joined to the code."""
    from pyspark.sql import Window

    long = frames.codon_counts(_dna(spark, sf_dir), "lang", "dna")
    both = long.join(F.broadcast(codon_table(spark)), "codon")  # 64 rows
    return both.select("lang", "codon", "aa", "n", F.round(F.col("n") / F.sum("n").over(Window.partitionBy("lang", "aa")), 6).alias("share"))


@query(f"""
WITH d AS (SELECT lang, {DNA} AS dna FROM documents), p AS (SELECT lang, (k % 3) + 1 AS pos, substring(dna, k + 1, 1) AS base FROM (SELECT lang, dna, unnest(range(length(dna))) AS k FROM d)),
g AS (SELECT lang, pos, base, count(*) AS n FROM p GROUP BY ALL)
SELECT lang, pos, base, round(n::DOUBLE / sum(n) OVER (PARTITION BY lang, pos), 6) AS freq FROM g""")
def position_frequencies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG02, AGG07: base frequencies by codon position."""
    seqs = _dna(spark, sf_dir).select(F.col("lang").alias("dataset_id"), F.col("dna").alias("raw_seq"))
    return alignment.base_frequencies(seqs).where("scope <> 'all' and freq > 1e-7").select(F.col("dataset_id").alias("lang"), F.col("scope").cast("long").alias("pos"), "base", F.round("freq", 6).alias("freq"))


@query(f"""
WITH s AS (SELECT doc_id, {DNA} AS dna FROM documents), b AS (SELECT doc_id, dna, 0 AS strand FROM s UNION ALL SELECT doc_id, reverse(translate(dna, 'ACGT', 'TGCA')), 1 FROM s),
f AS (SELECT doc_id, strand * 3 + o AS frame, substring(dna, o + 1) AS seq FROM b, (SELECT unnest([0, 1, 2]) AS o)),
c AS (SELECT doc_id, frame, k, substring(seq, k * 3 + 1, 3) AS codon FROM (SELECT doc_id, frame, seq, unnest(range(length(seq) // 3)) AS k FROM f)),
a AS (SELECT doc_id, frame, string_agg(aa, '' ORDER BY k) AS protein, count(*) FILTER (aa = '*') AS stops, count(*) FILTER (codon = 'ATG') AS starts FROM c JOIN {TABLE} USING (codon) GROUP BY ALL)
SELECT doc_id, frame::BIGINT AS frame, stops, starts, list_max(list_transform(string_split(protein, '*'), lambda x: length(x))) AS longest FROM a""")
def six_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR02, STR03, PRJ18: stops, starts and the longest open stretch in all six frames."""
    return frames.open_frames(_dna(spark, sf_dir), "doc_id", "dna")


@query("""
WITH k AS (SELECT doc_id, list_distinct(list_transform(range(0, greatest(length(text) - 11, 0), 3), lambda k: substring(text, k + 1, 12))) AS s FROM documents)
SELECT a.doc_id, round(CASE WHEN len(a.s) + len(b.s) = 0 THEN 0 ELSE len(list_intersect(a.s, b.s))::DOUBLE / (len(a.s) + len(b.s) - len(list_intersect(a.s, b.s))) END, 6) AS jaccard FROM k a JOIN k b ON b.doc_id = a.doc_id + 1""")
def kmer_jaccard(spark: SparkSession, sf_dir: str) -> DataFrame:
    """AGG26: sets of 12-mers at every third place, each document with the next; one pass over each text, as places in a UTF-8 string are found by counting from its start."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kmers = lambda text: F.array_distinct(F.coalesce(F.regexp_extract_all(text, F.lit("(?s)(?=(.{12})).{3}"), F.lit(1)), F.array().cast("array<string>")))
    both = docs.join(docs.select((F.col("doc_id") - 1).alias("doc_id"), F.col("text").alias("next")), "doc_id")  # texts go to the join: sets are eight times as large
    sets = both.select("doc_id", kmers(F.col("text")).alias("s"), kmers(F.col("next")).alias("t"))
    sizes = sets.select("doc_id", F.size(F.array_intersect("s", "t")).alias("common"), (F.size("s") + F.size("t")).alias("total"))
    return sizes.select("doc_id", F.round(F.when(F.col("total") == 0, 0.0).otherwise(F.col("common") / (F.col("total") - F.col("common"))), 6).alias("jaccard"))


@query("SELECT s_suppkey, regexp_replace(trim(s_name), '[^A-Za-z0-9]+', '_', 'g') AS name, CASE WHEN s_acctbal < 0.001 THEN '<0.001' ELSE printf('%.3f', s_acctbal) END AS p FROM supplier")
def name_formats(spark: SparkSession, sf_dir: str) -> DataFrame:
    """STR05, STR09: names and numbers as text."""
    return table(spark, sf_dir, "supplier").select("s_suppkey", Q.species_name(F.col("s_name")).alias("name"), Q.format_p(F.col("s_acctbal")).alias("p"))


def demo(spark: SparkSession) -> Dataset:
    return Dataset.of(spark, simulate(), DEMO_TREE, name="demo")


@query()
def demo_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Alignment to site patterns, all in columns."""
    return demo(spark).patterns().select("pattern_id", "weight", "sites", F.size("states").alias("taxa"))


@query()
def demo_fel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA01."""
    data = demo(spark)
    return site_scans.fel(data, data.fit())


@query()
def demo_meme(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA03."""
    data = demo(spark)
    return site_scans.meme(data, data.fit())


@query()
def demo_fubar(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA04."""
    data = demo(spark)
    return site_scans.fubar(data, data.fit())


@query()
def demo_slac(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA05."""
    data = demo(spark)
    return site_scans.slac(data, data.fit())


@query()
def demo_absrel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA06."""
    data = demo(spark)
    return gene_tests.absrel(data, data.fit())


@query()
def demo_gene(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA07, ANA10: BUSTED and RELAX with half of the branches in the foreground."""
    data = demo(spark)
    model = data.fit()
    gene = gene_tests.busted(data, model)
    strength = gene_tests.relax(data, model, [False, *(k % 2 == 0 for k in range(1, len(model.tree.nodes)))])
    rows = [("busted", gene["lrt"], gene["p_value"], max(gene["omegas"])), ("relax", strength["lrt"], strength["p_value"], strength["k"])]
    return spark.createDataFrame(rows, "method string, lrt double, p_value double, estimate double")


@query()
def demo_properties(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA11: conservation of amino-acid properties."""
    from clademill.analyses.property_scan import property_scan

    data = demo(spark)
    return property_scan(data, data.fit())


@query()
def demo_contrast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA02: two groups of branches."""
    data = demo(spark)
    model = data.fit()
    n = len(model.tree.nodes)
    return site_scans.contrast_fel(data, model, {"odd": [k > 0 and k % 2 == 1 for k in range(n)], "even": [k > 0 and k % 2 == 0 for k in range(n)]})


@query()
def demo_breakpoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """ANA13: one breakpoint or none."""
    return gene_tests.gard(demo(spark), spacing=1, least=20)
