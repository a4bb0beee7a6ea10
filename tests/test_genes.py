"""Many genes at once against one gene at a time, and what else the analyses say that brute force can confirm."""

import numpy as np
import pytest

from clademill.analyses import genes, site_scans
from clademill.analyses.dataset import Dataset
from clademill.analyses.simulate import DEMO_TREE, simulate
from clademill.kernels import distances, frames
from clademill.model.codes import CODONS, code


@pytest.fixture(scope="module")
def many(spark):
    rows = [(f"g{k}", simulate(codons=12, seed=k), DEMO_TREE if k else None) for k in range(3)] + [("bad", ">a\nACG\n>b\nACGTT\n", None)]
    return spark.createDataFrame(rows, "dataset_id string, alignment string, tree string")


def test_genes_equal_one_at_a_time(spark, many):
    got = {(r.dataset_id, r.site): r for r in genes.fel_genes(many, quick=True, tasks=2).collect()}
    assert got["bad", None].error and got["bad", None].classification is None
    for k in range(3):
        data = Dataset.of(spark, simulate(codons=12, seed=k), DEMO_TREE if k else None)
        want = site_scans.fel(data, data.fit(quick=True)).collect()
        assert len(want) == 12
        for w in want:
            g = got[f"g{k}", w.site]
            assert np.allclose([g.alpha, g.beta, g.lrt, g.p_value, g.q_value], [w.alpha, w.beta, w.lrt, w.p_value, w.q_value], atol=1e-6) and g.classification == w.classification


def test_frames_equal_brute_force(spark):
    rng = np.random.default_rng(1)
    seqs = ["", "A", "ACG", "".join(rng.choice(list("ACGT"), 500)), "ATG" * 7, "TAA" * 5]
    amino = dict(zip(CODONS, code().amino, strict=True))
    want = {}
    for k, s in enumerate(seqs):
        back = s[::-1].translate(str.maketrans("ACGT", "TGCA"))
        for frame in range(6):
            some = (s, back)[frame // 3][frame % 3 :]
            triplets = [some[j : j + 3] for j in range(0, len(some) - 2, 3)]
            if triplets:
                protein = "".join(amino[t] for t in triplets)
                want[k, frame] = (protein.count("*"), triplets.count("ATG"), max(map(len, protein.split("*"))))
    got = frames.open_frames(spark.createDataFrame(list(enumerate(seqs)), "k long, dna string"), "k", "dna").collect()
    assert {(r.k, r.frame): (r.stops, r.starts, r.longest) for r in got} == want


def test_distance_of_diverged_pairs_uses_the_alignment_shares():
    rng = np.random.default_rng(2)
    one = "".join(rng.choice(list("ACGT"), 400, p=[0.4, 0.1, 0.2, 0.3]))
    far = "".join(rng.choice(list("ACGT"), 400, p=[0.4, 0.1, 0.2, 0.3]))
    near = one[:360] + far[360:]
    pi = distances.base_shares([one, far, near])
    assert np.allclose(pi, [sum(s.count(b) for s in (one, far, near)) / 1200 for b in "ACGT"])
    d = distances.tn93_matrix([one, far, near])
    r, y = pi[0] + pi[2], pi[1] + pi[3]
    for (i, x), (j, z) in (((0, one), (1, far)), ((0, one), (2, near))):
        pairs = list(zip(x, z, strict=True))
        ag, ct = (sum(a != b and {a, b} == set(w) for a, b in pairs) / 400 for w in ("AG", "CT"))
        tv = sum(a != b for a, b in pairs) / 400 - ag - ct
        ka, kc = 2 * pi[0] * pi[2] / r, 2 * pi[1] * pi[3] / y
        kt = 2 * (r * y - pi[0] * pi[2] * y / r - pi[1] * pi[3] * r / y)
        args = [max(0.02, v) for v in (1 - ag / ka - tv / (2 * r), 1 - ct / kc - tv / (2 * y), 1 - tv / (2 * r * y))]
        assert np.isclose(d[i, j], -ka * np.log(args[0]) - kc * np.log(args[1]) - kt * np.log(args[2]))
    assert d[0, 2] < d[0, 1]
