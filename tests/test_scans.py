"""Analyses that brute force can confirm: segments, change points, numbers of successes, numbering, contrasts."""

import itertools

import numpy as np
import pytest

from clademill.analyses import gene_tests, site_scans
from clademill.analyses.dataset import Dataset
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.operators import aggregates, segments
from clademill.queries.statistics import poisson_binomial_by


def test_poisson_binomial_equals_enumeration(spark):
    rng = np.random.default_rng(1)
    p = rng.random(9)
    want = np.zeros(10)
    for bits in itertools.product((0, 1), repeat=9):
        want[sum(bits)] += np.prod(np.where(bits, p, 1 - p))
    run = np.cumsum(want)
    rows = poisson_binomial_by(spark.createDataFrame([("g", float(x)) for x in p], "g string, p double"), ["g"], "p").collect()
    values = [v for v in rows[0].asDict().values() if isinstance(v, (int, float))]
    assert any(np.isclose(v, p.sum()) for v in values)
    low, high = int(np.searchsorted(run, 0.025)), int(np.searchsorted(run, 0.975))
    assert {low, high} <= {int(v) for v in values if float(v).is_integer()}
    many = spark.createDataFrame([("g", 0.3)] * 700, "g string, p double")
    assert any(np.isclose(v, 210, atol=1e-6) for v in poisson_binomial_by(many, ["g"], "p").first().asDict().values() if isinstance(v, (int, float)))


def test_numbering(spark):
    rng = np.random.default_rng(2)
    x = rng.permutation(500).tolist()
    got = aggregates.numbered(spark.createDataFrame([(int(v),) for v in x], "v long").repartition(5), ["v"], "n", parts=7).collect()
    assert all(r.v == r.n for r in got) and len(got) == 500


def test_best_segment_equals_all_segments():
    rng = np.random.default_rng(3)
    for _ in range(20):
        x = rng.normal(size=25)
        x -= x.mean()
        a, b, score = segments.best_segment(x)
        every = [segments_score(x, i, j) for i in range(25) for j in range(i + 1, 26)]
        assert np.isclose(score, max(every)) and np.isclose(segments_score(x, a, b), score)


def segments_score(x, i, j):
    return x[i:j].sum()


def test_change_points_find_a_step():
    x = np.concatenate([np.zeros(40), np.ones(40) * 5]) + np.random.default_rng(4).normal(size=80) * 0.3
    found = segments.change_points(x, 15)
    assert found[0] == 0 and len(found) == 2 and abs(found[1] - 40) <= 1


@pytest.fixture(scope="module")
def gene(spark):
    data = Dataset.of(spark, simulate(codons=18), DEMO_TREE)
    return data, data.fit(quick=True)


def test_mixture_scan_nests_its_null(gene):
    data, model = gene
    rows = site_scans.meme(data, model).collect()
    assert len(rows) == 18 and all(0 <= r.p_value <= 1 and r.lrt >= 0 for r in rows)
    assert len({r.site for r in rows}) == 18
