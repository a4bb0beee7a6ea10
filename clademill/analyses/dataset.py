"""A dataset: alignment and tree, the fitted background model, and its site patterns as a DataFrame."""

from __future__ import annotations

from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from clademill.kernels.likelihood import MG94, Fit, Pruner, fit_gtr, fit_mg94, leaf_vectors
from clademill.model.codes import BASES, GeneticCode, code
from clademill.operators.alignment import cf3x4, site_patterns, sites_long
from clademill.sources.parsers import Tree, check_rectangular, parse_alignment, parse_nexus, select_branches, sniff


@dataclass
class Model:
    """What the kernels get: plain arrays and the tree."""

    code: GeneticCode
    tree: Tree
    names: list[str]
    mg94: MG94
    lengths: np.ndarray
    tested: list[bool] = field(default_factory=list)
    omega: float = 1.0

    def leaves(self, rows) -> np.ndarray:
        """Leaf vectors of pattern rows (states, masks)."""
        states = np.array(rows["states"].tolist(), np.int64).T
        masks = np.array(rows["masks"].tolist(), np.int64).T
        return leaf_vectors(states, masks, self.code.size)

    def pruner(self, rows) -> Pruner:
        return Pruner(self.tree, self.names, self.leaves(rows))


@dataclass
class Dataset:
    spark: SparkSession
    name: str
    names: list[str]
    seqs: list[str]
    tree: Tree
    code: GeneticCode

    @classmethod
    def of(cls, spark: SparkSession, alignment: str, tree: str | None = None, *, name: str = "data", genetic_code: str | int = "Universal") -> Dataset:
        """From file texts; see read_gene."""
        return cls(spark, name, *read_gene(alignment, tree), code(genetic_code))

    def sequences(self) -> DataFrame:
        rows = [(self.name, k, n, s) for k, (n, s) in enumerate(zip(self.names, self.seqs, strict=True))]
        return self.spark.createDataFrame(rows, "dataset_id string, taxon_idx int, name string, raw_seq string")

    def sites(self) -> DataFrame:
        return sites_long(self.sequences(), self.code.name)

    def patterns(self) -> DataFrame:
        return site_patterns(self.sites())

    def fit(self, branches: str = "All", *, quick: bool = False) -> Model:
        """The model of this one gene, on the driver; genes.py fits many at once in tasks."""
        rows = self.patterns().select("states", "masks", "weight").toPandas()
        model, self.lnl, self.gtr = fit_model(self.tree, self.names, self.seqs, self.code, rows, branches, quick=quick)
        return model


def fit_model(tree: Tree, names: list[str], seqs: list[str], genetic: GeneticCode, rows, branches: str = "All", *, quick: bool = False) -> tuple[Model, float, Fit]:
    """Nucleotide fit, then the codon fit that all analyses start from. rows: patterns with states, masks and weight."""
    n = np.array([sum(s.count(b) for s in seqs) for b in BASES], float)
    pi = np.maximum(n / n.sum(), 1e-8)
    gtr = fit_gtr(tree, names, seqs, pi / pi.sum(), 2 if quick else 6)
    positions = np.array([[sum(s[k::3].count(b) for s in seqs) for b in BASES] for k in range(3)], float)
    positions = np.maximum(positions / positions.sum(axis=1, keepdims=True), 1e-8)
    corrected, codons = cf3x4(positions / positions.sum(axis=1, keepdims=True), genetic)
    model = Model(genetic, tree, names, MG94(genetic, gtr.rates, corrected, codons), gtr.lengths)
    fit: Fit = fit_mg94(tree, names, model.leaves(rows), rows["weight"].to_numpy(float), model.mg94, gtr.lengths, 2 if quick else 5)
    model.lengths, model.omega = fit.lengths, fit.omega
    model.tested = select_branches(tree, branches, auto=True)
    return model, fit.lnl, gtr


def read_gene(alignment: str, tree: str | None = None) -> tuple[list[str], list[str], Tree]:
    """Names, sequences and tree from file texts. Without a tree the alignment's own is taken, and where there is none a neighbour-joining tree is made."""
    found = parse_alignment(alignment)
    check_rectangular(found)
    names, seqs = [n for n, _ in found], [s.upper().replace("U", "T") for _, s in found]
    if tree is None and sniff(alignment) == "nexus" and (trees := parse_nexus(alignment).trees):
        tree = trees[0][1]
    if tree is None:
        from clademill.kernels.distances import neighbour_joining, tn93_matrix

        tree = neighbour_joining(tn93_matrix(seqs), names)
    parsed = Tree.parse(tree).unrooted()
    missing = {parsed.nodes[k].name.lower() for k in parsed.leaves()} ^ {n.lower() for n in names}
    if missing:
        raise ValueError(f"alignment and tree differ in: {', '.join(sorted(missing))}")
    return names, seqs, parsed


def by_site(results: DataFrame, patterns: DataFrame) -> DataFrame:
    """Pattern results at each of their sites, numbered from 1."""
    places = patterns.select("pattern_id", F.explode("sites").alias("site"))
    return places.join(results, "pattern_id").withColumn("site", F.col("site") + 1)
