"""Many genes at once: each gene is a row, fitted and scanned as a whole by the task that has it.

A gene fits in a task's memory, and a run has thousands of them, so genes and not sites are what is dealt out. A gene that can't be read or fitted has one row with its error, and the others go on."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from clademill.analyses import site_scans
from clademill.analyses.dataset import fit_model, read_gene
from clademill.functions import stats as S
from clademill.model.codes import GeneticCode, code


def local_patterns(seqs: list[str], genetic: GeneticCode) -> pd.DataFrame:
    """The distinct columns of one alignment as operators.alignment.site_patterns has them: pattern_id, states, masks, weight, sites."""
    seen: dict[tuple, list[int]] = {}
    decoded: dict[str, tuple[int, int]] = {}
    for site in range(min(map(len, seqs)) // 3):
        column = []
        for s in seqs:
            triplet = s[3 * site : 3 * site + 3]
            if triplet not in decoded:
                decoded[triplet] = genetic.state.get(triplet, -1), genetic.mask(triplet)
            column.append(decoded[triplet])
        seen.setdefault(tuple(column), []).append(site)
    return pd.DataFrame({"pattern_id": range(len(seen)), "states": [[s for s, _ in c] for c in seen], "masks": [[m for _, m in c] for c in seen], "weight": [len(v) for v in seen.values()], "sites": list(seen.values())})


def varies(states: list[int]) -> bool:
    return len({s for s in states if s >= 0}) > 1


SITES = "dataset_id string, site int, alpha double, beta double, alpha_null double, lnl double, lnl_null double, lrt double, omega double, gene_lnl double, error string"


def fel_genes(genes: DataFrame, *, branches: str = "All", genetic_code: str | int = "Universal", p: float = 0.1, quick: bool = False, tasks: int | None = None) -> DataFrame:
    """FEL of every gene of (dataset_id, alignment, tree): a row for each site with p_value, q_value (within its gene) and classification, as site_scans.fel has them for one gene.

    alignment and tree are file texts; a null tree is found as read_gene says. Genes are dealt over `tasks` tasks one by one (default: three for each core)."""
    names = [c.split()[0] for c in SITES.split(", ")]

    def one(row) -> pd.DataFrame:
        try:
            taxa, seqs, tree = read_gene(row.alignment, row.tree)
            genetic = code(genetic_code)
            patterns = local_patterns(seqs, genetic)
            model, lnl, _ = fit_model(tree, taxa, seqs, genetic, patterns, branches, quick=quick)
            moving = patterns[patterns["states"].map(varies)]
            found = site_scans._fel(model, moving) if len(moving) else pd.DataFrame(columns=["pattern_id", *names[2:8]])
            out = patterns[["pattern_id", "sites"]].merge(found, on="pattern_id", how="left").fillna({c: 0.0 for c in names[2:8]}).explode("sites")
            return out.assign(dataset_id=row.dataset_id, site=out["sites"].astype(int) + 1, omega=model.omega, gene_lnl=lnl, error=None)[names]
        except (ValueError, KeyError, ArithmeticError, np.linalg.LinAlgError, AttributeError) as error:
            return pd.DataFrame([{"dataset_id": row.dataset_id, "error": f"{type(error).__name__}: {error}"}], columns=names)

    def run(batches: Iterable[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for rows in batches:
            for row in rows.itertuples(index=False):
                yield one(row)

    dealt = genes.select("dataset_id", "alignment", "tree").repartition(tasks or genes.sparkSession.sparkContext.defaultParallelism * 3)
    sites = dealt.mapInPandas(run, SITES).withColumn("p_value", F.when(F.col("error").isNull(), S.chi2_sf(F.col("lrt"), 1)))
    sites = S.benjamini_hochberg(sites, "p_value", ["dataset_id"], ["site"], "q_value")
    label = F.when(F.col("error").isNotNull(), F.lit(None)).when(F.col("p_value") > p, "neutral").when(F.col("beta") > F.col("alpha"), "diversifying").otherwise("purifying")
    return sites.withColumns({"q_value": F.when(F.col("error").isNull(), F.col("q_value")), "classification": label})
