"""Data source for alignment and tree files, and table functions for SQL.

spark.dataSource.register(AlignmentSource); spark.read.format("alignment").option("listing", paths).load() gives one row for each sequence. Each file is
a partition of its own; files that Spark alone can reach are read with read_files and parsed by the table functions."""

from __future__ import annotations

import gzip
from collections.abc import Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition
from pyspark.sql.functions import udtf

from clademill.sources.parsers import FormatError, Tree, check_rectangular, parse_alignment, parse_nexus, sniff

SEQUENCES = "dataset_id string, taxon_idx int, name string, raw_seq string"
NODES = "tree_id string, node_id int, parent_id int, name string, branch_length double, is_leaf boolean, tag string, post_order int"


class _File(InputPartition):
    def __init__(self, path: str) -> None:
        self.path = path


class _Reader(DataSourceReader):
    def __init__(self, options: dict) -> None:
        self.paths = [p for p in options.get("listing", options.get("path", "")).split("\n") if p]
        self.codons = options.get("mode", "codon") == "codon"
        self.rectangular = options.get("rectangular", "true") == "true"

    def partitions(self) -> list[InputPartition]:
        return [_File(p) for p in self.paths]

    def read(self, part: _File) -> Iterator[tuple]:
        path = part.path.removeprefix("file://")
        with (gzip.open if path.endswith(".gz") else open)(path, "rt", encoding="utf-8", errors="replace") as file:
            found = parse_alignment(file.read())
        if self.rectangular:
            check_rectangular(found, self.codons)
        for k, (name, seq) in enumerate(found):
            yield part.path, k, name, seq


class AlignmentSource(DataSource):
    """Options: listing (paths, one a line), mode (codon or nucleotide), rectangular (true or false)."""

    @classmethod
    def name(cls) -> str:
        return "alignment"

    def schema(self) -> str:
        return SEQUENCES

    def reader(self, schema) -> DataSourceReader:
        return _Reader({k.lower(): v for k, v in self.options.items()})


@udtf(returnType="taxon_idx: int, name: string, raw_seq: string, error: string")
class ParseAlignment:
    """SELECT * FROM files, LATERAL parse_alignment(content): sequences of a text, or one row with what is wrong with it."""

    def eval(self, content: str):
        try:
            for k, (name, seq) in enumerate(parse_alignment(content or "")):
                yield k, name, seq, None
        except FormatError as error:
            yield None, None, None, str(error)


@udtf(returnType="node_id: int, parent_id: int, name: string, branch_length: double, is_leaf: boolean, tag: string, post_order: int")
class ParseNewick:
    """SELECT * FROM parse_newick('(a:1,(b:2,c:3){T}:1);')"""

    def eval(self, newick: str):
        for row in Tree.parse(newick).rows():
            yield row[1:]


def register(spark: SparkSession) -> None:
    spark.dataSource.register(AlignmentSource)
    spark.udtf.register("parse_alignment", ParseAlignment)
    spark.udtf.register("parse_newick", ParseNewick)


def read_files(spark: SparkSession, path: str) -> DataFrame:
    """(path, content, format): whole text files by Spark's own reader, gzip by extension, from any store."""
    files = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), F.col("value").alias("content"))
    head = F.ltrim(F.col("content"))
    kind = (
        F.when(F.lower(head).startswith("#nexus"), "nexus")
        .when(F.lower(head).startswith("# stockholm"), "stockholm")
        .when(head.startswith(">"), "fasta")
        .when(head.startswith("("), "newick")
        .when(head.rlike(r"^\d+\s+\d+"), "phylip")
        .otherwise("fasta")
    )
    return files.withColumn("format", kind)


def sequences(spark: SparkSession, path: str) -> DataFrame:
    """(dataset_id, taxon_idx, name, raw_seq, error) of all files under a path."""
    register(spark)
    read_files(spark, path).createOrReplaceTempView("clademill_files")
    return spark.sql("SELECT path AS dataset_id, taxon_idx, name, raw_seq, error FROM clademill_files, LATERAL parse_alignment(content)")


def tree_nodes(spark: SparkSession, newick: str, tree_id: str = "tree") -> DataFrame:
    return spark.createDataFrame(Tree.parse(newick).rows(tree_id), NODES)


def embedded_trees(text: str) -> list[tuple[str, str]]:
    return parse_nexus(text).trees if sniff(text) == "nexus" else []


def preferences(spark: SparkSession, path: str, floor: float = 0.002) -> DataFrame:
    """(site, prefs): a table site, A, C, ... Y; each preference at least `floor`, each row summing to 1."""
    table = spark.read.csv(path, header=True, comment="#", inferSchema=False)
    amino = [c for c in table.columns if c != "site"]
    values = [F.greatest(F.col(a).cast("double"), F.lit(floor)) for a in amino]
    total = sum(values[1:], values[0])
    return table.select(F.col("site").cast("int").alias("site"), F.array(*(v / total for v in values)).alias("prefs"))


def label_map(spark: SparkSession, path: str) -> DataFrame:
    """(taxon, grp) from two columns split by tab, comma or semicolon. A taxon in two groups is an error when the rows are read."""
    lines = spark.read.text(path).where("trim(value) <> '' and not startswith(ltrim(value), '#')")
    parts = F.split("value", "[\t,;]", 2)
    rows = lines.select(F.trim(parts[0]).alias("taxon"), F.trim(parts[1]).alias("grp")).where(~F.lower("taxon").isin("taxon", "name", "sequence"))
    each = rows.groupBy("taxon").agg(F.min("grp").alias("grp"), F.max("grp").alias("other"))
    return each.select("taxon", F.when(F.col("grp") == F.col("other"), F.col("grp")).otherwise(F.raise_error(F.concat(F.lit("taxon in two groups: "), "taxon"))).alias("grp"))


def strip_gaps(seqs: DataFrame) -> DataFrame:
    """Aligned sequences -> ungapped ones."""
    return seqs.withColumn("raw_seq", F.regexp_replace("raw_seq", r"[-.~?\s]", ""))
