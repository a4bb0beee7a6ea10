import json

import numpy as np
import pytest

from clademill import catalogue
from clademill.analyses import gene_tests, site_scans
from clademill.analyses.dataset import Dataset
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.queries import sequences
from clademill.sinks import writers


@pytest.fixture(scope="module")
def fitted(spark):
    data = Dataset.of(spark, simulate(), DEMO_TREE)
    return data, data.fit(quick=True)


def test_fit(fitted):
    data, model = fitted
    assert data.lnl < 0 and 0.05 < model.omega < 3 and data.patterns().selectExpr("sum(weight)").first()[0] == 24


def test_site_scans(fitted):
    data, model = fitted
    fel = {r.site: r for r in site_scans.fel(data, model).collect()}
    fubar = {r.site: r for r in site_scans.fubar(data, model).collect()}
    slac = {r.site: r for r in site_scans.slac(data, model).collect()}
    assert set(fel) == set(fubar) == set(slac) == set(range(1, 25))
    assert all(0 <= r.p_value <= r.q_value + 1e-9 <= 1 + 1e-9 and r.lrt >= 0 for r in fel.values())
    assert all(abs(r.p_negative + r.p_positive) <= 1 + 1e-9 for r in fubar.values())
    low, high = [k for k in fel if k % 3 == 1], [k for k in fel if k % 3 == 0]
    mean = lambda rows, keys, f: np.mean([f(rows[k]) for k in keys])
    assert mean(fubar, high, lambda r: r.p_positive) > mean(fubar, low, lambda r: r.p_positive)
    assert mean(slac, high, lambda r: r.n) > mean(slac, low, lambda r: r.n)
    text = writers.document(site_scans.slac(data, model), "slac", ["site"])
    assert json.loads(text)["site_results"]["rows"] == 24 and "<script" in writers.report("slac", text)


def test_gene_tests(fitted):
    data, model = fitted
    gene = gene_tests.busted(data, model)
    assert gene["lnl"] >= gene["lnl_null"] - 1e-3 and 0 <= gene["p_value"] <= 0.5 and abs(sum(gene["shares"]) - 1) < 1e-9
    branches = gene_tests.absrel(data, model, most=2).collect()
    assert len(branches) == 11 and all(0 <= r.p_uncorrected <= r.p_value + 1e-9 <= 1 + 1e-9 for r in branches)


def test_registered_analyses_use_full_fits_and_every_breakpoint(spark, monkeypatch):
    class Fitted(Exception):
        pass

    def fit(self, *args, **kwargs):
        raise Fitted(kwargs)

    monkeypatch.setattr(Dataset, "fit", fit)
    for name in ("fel", "meme", "fubar", "slac", "absrel", "gene", "properties", "contrast"):
        with pytest.raises(Fitted) as found:
            catalogue.QUERIES[f"demo_{name}"](spark, "")
        assert not found.value.args[0].get("quick")
    seqs = sequences.demo(spark).seqs
    variable = [k for k in range(len(seqs[0])) if len({s[k] for s in seqs} & set("ACGT")) > 1]
    assert {r.breakpoint for r in catalogue.QUERIES["demo_breakpoints"](spark, "").collect()} == {-1, *variable[20:-20]}


def test_grid_and_weights():
    grid = site_scans.fubar_grid()
    assert len(grid) == 400 and grid[0] == (0, 0) and grid[273] == (1.0, 1.0) and np.allclose(grid[399], (50, 50))
    w = site_scans.variational_weights(np.array([[1.0, 0.1], [0.1, 1.0]]), np.array([30.0, 10.0]))
    assert abs(w.sum() - 1) < 1e-9 and w[0] > w[1]


def test_tree_tests():
    rng = np.random.default_rng(0)
    table = rng.normal(size=(3, 200)) * 0.1 + np.array([[0.0], [-0.01], [-0.5]])
    assert gene_tests.shimodaira_hasegawa(table)[2] < 0.05
    assert gene_tests.kishino_hasegawa(table[0], table[2])["p_normal"] < 1e-6
