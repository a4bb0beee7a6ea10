"""The parts of BUSTED against plain versions of them."""

import numpy as np
import pytest

from clademill.analyses import mixtures
from clademill.analyses.dataset import fit_model, read_gene
from clademill.analyses.genes import local_patterns
from clademill.analyses.mixtures import GeneMixture, Parts
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.kernels.numeric import expm
from clademill.model.codes import code


def gene(codons=10, omegas=(0.1, 0.5, 3.0), seed=7, branches="All"):
    taxa, seqs, tree = read_gene(simulate(codons=codons, omegas=omegas, seed=seed), DEMO_TREE)
    patterns = local_patterns(seqs, code())
    return fit_model(tree, taxa, seqs, code(), patterns, branches, quick=True)[0], patterns


@pytest.fixture(scope="module")
def small():
    return gene()


def test_generator_of_several_hits(small):
    m = small[0].mg94
    assert np.allclose(m.multiple(1.3, 0.4), m.generator(1.3, 0.4))
    q = m.multiple(1.0, 0.4, 0.2, 0.1)
    flow = m.pi[:, None] * q
    assert np.allclose(flow, flow.T) and np.allclose(q.sum(axis=1), 0)
    sense = m.code.sense
    i, j = sense.index("AAA"), sense.index("CCA")
    rate = dict(zip(("AC", "AG", "AT", "CG", "CT", "GT"), m.rates, strict=True))
    same = m.code.aa[i] == m.code.aa[j]
    assert np.isclose(q[i, j], 0.2 * (1.0 if same else 0.4) * rate["AC"] ** 2 * m.positions[0, 1] * m.positions[1, 1])
    pairs = np.full(q.shape, 2.0)
    i, j = sense.index("AAA"), sense.index("AAG")
    assert np.isclose(m.multiple(1.0, 0.4, pairs=pairs)[i, j], 2 * q[i, j])


def test_likelihood_equals_matrix_exponentials(small):
    model, patterns = small
    g = GeneMixture(model, patterns, Parts(2, 2, 3, 0.01), [False] + [k % 2 == 0 for k in range(1, len(model.tree.nodes))])
    x = g.point(np.array([0.2, 4.0, 0.7, 0.1, 1.5, 0.4, 0.3, 0.6, 0.2, 0.05, 0.004]))
    assert np.isclose(x.rates @ x.rate_shares, 1) and x.double == 0.2 and x.triple == 0.05 and x.sink == 0.004
    pi, want = model.mg94.pi, 0.0
    jump = np.array([[0 if a == b else pi[b] / (1 - pi[a]) for b in range(len(pi))] for a in range(len(pi))])
    for rate, share in zip(x.rates, x.rate_shares, strict=True):
        p = np.zeros((len(model.tree.nodes), len(pi), len(pi)))
        for k in range(1, len(p)):
            omegas, shares = x.test if g.tested[k] else x.other
            p[k] = sum(s * expm(model.mg94.multiple(1.0, w, 0.2, 0.05) * model.lengths[k] * rate) for w, s in zip(omegas, shares, strict=True))
            p[k] = 0.996 * p[k] + 0.004 * jump
        want = want + share * np.exp(g.pruner.log_likelihoods(p, pi))
    assert np.allclose(g.site_lnl(x), np.log(want))
    assert np.allclose(g.rate_posteriors(x).sum(axis=0), 1)


def test_selection_is_found_and_nesting_holds(small):
    strong = mixtures.busted(*gene(16, (0.05, 9.0), 3), Parts(2), steps=15)
    none = mixtures.busted(*gene(16, (0.05, 0.3), 3), Parts(2), steps=15)
    assert strong["p_value"] < 0.05 and max(strong["omegas"]) > 1 and none["p_value"] > 0.05
    assert strong["lnl"] >= strong["lnl_null"] and np.isclose(sum(strong["shares"]), 1) and len(strong["evidence"]) == len(gene(16, (0.05, 9.0), 3)[1])
    plain = mixtures.busted(*small, Parts(2), steps=10)
    more = mixtures.busted(*small, Parts(2, 2, 2, 0.01), steps=10)
    assert all(r["lnl"] >= r["lnl_null"] - 1e-9 for r in (strong, none, plain, more))
    assert more["lnl"] >= plain["lnl"] - 0.5 and np.isclose(np.dot(more["rates"], more["rate_shares"]), 1)
    n, k = 10 * 7, 15 + 3
    assert np.isclose(plain["aicc"], -2 * plain["lnl"] + 2 * k + 2 * k * (k + 1) / (n - k - 1))


def test_phenotype(small):
    model, patterns = small
    some = [False] + [k % 2 == 0 for k in range(1, len(model.tree.nodes))]
    r = mixtures.busted_ph(model, patterns, some, Parts(2), steps=8)
    assert min(r["lrt"], r["background_lrt"], r["shared_lrt"]) >= 0 and r["union_p"] == max(r["p_value"], r["shared_p"])
    with pytest.raises(ValueError):
        mixtures.busted_ph(model, patterns, [True] * len(model.tree.nodes), Parts(2))


def test_many_genes(spark):
    rows = [("g", simulate(codons=8, seed=2), DEMO_TREE), ("bad", ">a\nACG\n>b\nACGTT\n", None)]
    got = {r.dataset_id: r for r in mixtures.busted_genes(spark.createDataFrame(rows, "dataset_id string, alignment string, tree string"), Parts(2, 2), quick=True, steps=5, tasks=2).collect()}
    assert got["bad"].error and got["bad"].omegas is None and got["g"].error is None and len(got["g"].rates) == 2 and got["g"].lrt >= 0
