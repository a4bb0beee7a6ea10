"""Synonymous classes: known rates come back, and the model is the plain one where the classes are alike."""

import numpy as np
import pytest

from clademill.analyses import synonymous
from clademill.analyses.dataset import fit_model, read_gene
from clademill.analyses.genes import local_patterns
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.model.codes import code
from clademill.sources.tables import synonymous_pairs


def partition(fast="AG"):
    """Transitions of the third place are `fast`, all others `slow`."""
    return [(a, b, "fast" if {a[2], b[2]} in ({"A", "G"}, {"C", "T"}) else "slow", None) for a, b in synonymous_pairs(code())]


def factors(rates):
    c = code()
    out = np.ones((c.size, c.size))
    for a, b, name, _ in partition():
        i, j = c.sense.index(a), c.sense.index(b)
        out[i, j] = out[j, i] = rates[name]
    return out


def gene(pairs=None, codons=150):
    taxa, seqs, tree = read_gene(simulate(codons=codons, omegas=(0.2,), seed=5, pairs=pairs), DEMO_TREE)
    patterns = local_patterns(seqs, code())
    return fit_model(tree, taxa, seqs, code(), patterns, quick=True)[0], patterns


def test_rates_of_classes():
    found = synonymous.fit_classes(*gene(factors({"fast": 1.0, "slow": 0.1})), partition(), neutral="fast")
    assert found["rates"]["fast"] == 1.0 and found["rates"]["slow"] < 0.5 and found["df"] == 1 and found["lnl"] >= found["lnl_null"] - 1e-9
    model, patterns = gene()
    free = synonymous.fit_classes(model, patterns, partition())
    n = {name: sum(p[2] == name for p in partition()) for name in ("fast", "slow")}
    assert np.isclose(sum(free["rates"][k] * n[k] for k in n), sum(n.values()))
    one = synonymous.fit_classes(model, patterns, [(a, b, "all", None) for a, b, *_ in partition()])
    assert np.isclose(one["lnl"], one["lnl_null"]) and one["p_value"] is None and one["rates"] == {"all": 1.0}
    known = synonymous.fit_classes(model, patterns, [(a, b, "Empirical", 1.0) for a, b, *_ in partition()])
    assert np.isclose(known["lnl"], one["lnl"], atol=1e-3) and known["df"] == 0
    with pytest.raises(ValueError):
        synonymous.fit_classes(model, patterns, partition(), neutral="none")


def test_many_genes(spark):
    rows = [(f"g{k}", simulate(codons=20, seed=k), DEMO_TREE) for k in range(2)] + [("bad", ">a\nACG\n>b\nACGTT\n", None)]
    df = spark.createDataFrame(rows, "dataset_id string, alignment string, tree string")
    found = synonymous.class_genes(df, partition(), quick=True, steps=10, tasks=2)
    got = {r.dataset_id: r for r in found.collect()}
    assert got["bad"].error and set(got["g0"].rates) == {"fast", "slow"} and got["g1"].df == 1
    assert {r["class"]: r.genes for r in synonymous.rates_over_genes(found).collect()} == {"fast": 2, "slow": 2}
