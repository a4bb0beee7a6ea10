"""The model informed by preferences, and forecasts, against plain versions."""

import numpy as np
import pytest

from clademill.analyses import preferences as P
from clademill.analyses.dataset import Dataset
from clademill.analyses.property_scan import AMINO, scaled
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.kernels.numeric import expcm, expm


@pytest.fixture(scope="module")
def gene(spark):
    data = Dataset.of(spark, simulate(codons=9), DEMO_TREE)
    model = data.fit(quick=True)
    rng = np.random.default_rng(1)
    rows = []
    for site in range(1, 10):
        x = rng.dirichlet(np.ones(20))
        rows.append((site, dict(zip(AMINO, map(float, x), strict=True))))
    return data, model, rows, spark.createDataFrame(rows, "site int, preferences map<string,double>")


def test_generator_equals_the_plain_one(gene):
    _, model, rows, _ = gene
    phi = np.array([0.3, 0.2, 0.2, 0.3])
    m = P.Informed(model, phi, 1.4, 0.6, 3.0)
    q, pi = expcm(rows[0][1], phi, 3.0, 0.6, 1.4, model.code)
    spectrum, mine = m.spectrum(rows[0][1])
    assert np.allclose(mine, pi)
    assert np.allclose(spectrum.transition(np.array([0.3]))[0], expm(q * 0.3), atol=1e-9)
    even = {a: 0.05 for a in AMINO}
    q, pi = expcm(even, phi, 3.0, 0.6, 1.4, model.code)
    assert np.allclose(m.spectrum(even)[0].transition(np.array([0.3]))[0], expm(q * 0.3), atol=1e-9)


def test_fit_and_scan(gene):
    data, model, rows, prefs = gene
    fixed, low = P.fit_informed(data, model, prefs, beta=1.0, omega=1.0, kappa=2.0)
    free, high = P.fit_informed(data, model, prefs, steps=8)
    part, between = P.fit_informed(data, model, prefs, beta=1.0, steps=8)
    assert high >= between - 1e-3 >= low - 2e-3 and part.beta == 1.0 and fixed.kappa == 2.0 and free.phi.sum() == pytest.approx(1)
    got = {r.site: r for r in P.scan_informed(data, fixed, prefs).collect()}
    assert sorted(got) == list(range(1, 10))
    sites = {s + 1: (p.states, p.masks) for p in data.patterns().collect() for s in p.sites}
    import pandas as pd

    total = 0.0
    for site, pref in rows:
        pruner = model.pruner(pd.DataFrame([{"states": sites[site][0], "masks": sites[site][1]}]))
        each = [fixed.lnl(pruner, pref, w) for w in np.geomspace(0.001, 100, 200)]
        r = got[site]
        total += r.lnl_null
        assert np.isclose(r.lnl_null, fixed.lnl(pruner, pref, 1.0)) and r.lnl >= max(each) - 1e-3 and r.lrt >= 0 and r.q_value >= r.p_value - 1e-12
    assert np.isclose(total, low)
    with pytest.raises(ValueError):
        P.fit_informed(data, model, prefs.where("site < 5"))


def test_tilt_is_reversible(gene):
    model = gene[1]
    rng = np.random.default_rng(2)
    far = rng.random((model.code.size,) * 2)
    phi = rng.random(20)[[AMINO.index(a) for a in model.code.aa]] + 0.1
    q, pi = P.tilted(model.mg94, 1.2, 0.5, far + far.T, phi)
    flow = pi[:, None] * q
    assert np.allclose(flow, flow.T) and np.allclose(q.sum(axis=1), 0) and np.isclose(pi.sum(), 1)
    flat, same = P.tilted(model.mg94, 1.2, 0.5, np.zeros_like(far), np.ones(model.code.size))
    assert np.allclose(flat, model.mg94.generator(1.2, 0.5)) and np.allclose(same, model.mg94.pi, atol=1e-9)


def test_forecast(gene, spark):
    data, model, _, _ = gene
    rows = [(k, 0.0 if k == 9 else 1.0, 0.0 if k == 9 else 0.2 * k, {"volume": 0.5, "charge": -0.1}) for k in range(1, 10)]
    sites = spark.createDataFrame(rows, "site int, alpha double, beta double, lambdas map<string,double>")
    found = P.forecast(data, model, sites, reference="a")
    got = {r.site: r for r in found.collect()}
    assert sorted(got) == list(range(1, 10))
    seq = data.seqs[data.names.index("a")]
    tables = {n: scaled(P.PROPERTIES[n]) for n in P.PROPERTIES}
    for site, alpha, beta, lambdas in rows:
        r = got[site]
        assert r.focal == seq[3 * site - 3 : 3 * site] and np.isclose(np.exp(r.log_p).sum(), 1) and np.isclose(sum(r.stationary), 1) and np.isclose(sum(r.ancestral), 1)
        own = AMINO.index(model.code.aa[model.code.sense.index(r.focal)])
        assert r.dms[own] == 0 and np.isclose(r.effective_omega, (beta + 0.05 * model.omega) / (alpha + 0.05))
        assert np.isclose(r.changes, 1 - np.exp(r.log_p[model.code.sense.index(r.focal)])) and min(r.rates) >= 0
        usual = np.zeros(20)
        for a, x in zip(model.code.aa, model.mg94.pi, strict=True):
            usual[AMINO.index(a)] += x
        phi = np.sqrt((np.array(r.ancestral) + 0.05 * usual) / 1.05 / usual)
        push = sum(v * np.abs(tables[n][own] - tables[n]) for n, v in lambdas.items())
        want = np.log(r.effective_omega) - 8 * np.tanh(push / 8) + 0.5 * np.log(phi / phi[own])
        want[own] = 0
        assert np.allclose(r.dms, want)
    long = P.amino_rows(found).collect()
    assert len(long) == 9 * 20 and {r.aa for r in long} == set(AMINO)
    assert P.codon_rows(found, model.code).count() == 9 * model.code.size
