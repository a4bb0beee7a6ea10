"""Parsers, codes, trees, statistics and kernels on literals."""

import math

import numpy as np
import pytest

from clademill.functions import stats as S
from clademill.kernels import distances, optimise
from clademill.kernels.likelihood import MG94, Pruner, Spectrum, gtr, leaf_vectors
from clademill.model.codes import CODES, code
from clademill.operators import alignment
from clademill.sources import alignment_source as src
from clademill.sources.parsers import FormatError, Tree, parse_alignment, parse_nexus, propagate_labels, robinson_foulds, select_branches, sniff, strip_comments

FASTA = ">a\nATGAAATTT\n>b x\nATGAARTTC\n>c\nATG---TTT\n"
NEXUS = """#NEXUS
begin taxa; dimensions ntax=3; taxlabels 'a one' b c; end;
begin characters; dimensions nchar=6; format datatype=dna interleave matchchar=.;
matrix
'a one' ATG [note]
b       ...
c       ATC

'a one' AAA
b       ..G
c       ...
;
end;
begin trees; translate 1 'a one', 2 b, 3 c; tree t = [&U] (1:0.1,(2:0.2,3:0.3){FG}:0.1); end;
"""


def test_formats():
    assert parse_alignment(FASTA)[1] == ("b x", "ATGAARTTC")
    assert parse_alignment("2 6\nx ATGAAA\ny ATGAAG\n") == [("x", "ATGAAA"), ("y", "ATGAAG")]
    assert parse_alignment("2 6\nx ATG\ny ATG\n\nAAA\nAAG\n") == [("x", "ATGAAA"), ("y", "ATGAAG")]
    found = parse_nexus(NEXUS)
    assert found.sequences == [("a one", "ATGAAA"), ("b", "ATGAAG"), ("c", "ATCAAA")]
    tree = Tree.parse(found.trees[0][1])
    assert sorted(tree.nodes[k].name for k in tree.leaves()) == ["a one", "b", "c"] and any(n.tag == "FG" for n in tree.nodes)
    assert strip_comments("a[b[c]d]e'[f]'") == "ae'[f]'" and sniff(NEXUS) == "nexus"
    for bad in ("# STOCKHOLM 1.0\n", "(a,b);", ">a\nA\n>a\nC\n"):
        with pytest.raises(FormatError):
            parse_alignment(bad)


def test_codes():
    assert len(CODES) == 22 and code("transl_table=2").size == 60 and code().size == 61 and code("Mesodinium").size == 63
    c = code()
    assert c.translate("ATGTAAGCN") == "M*X" and bin(c.mask("GCN")).count("1") == 4 and c.mask("NNN") == c.mask("!AA") == c.mask("TAA") == c.everything
    with pytest.raises(ValueError):
        code("nothing")


TREE = "((a{T}:1,b:2)i:1,(c{R}:1,d{t}:3)j:2,e:1);"


def test_trees():
    t = Tree.parse(TREE)
    pick = lambda *a, **k: sorted(n.name for n, on in zip(t.nodes, select_branches(t, *a, **k), strict=True) if on)
    assert pick() == list("abcdeij") and pick(auto=True) == ["a", "d"] and pick("Internal") == ["i", "j"] and pick("test") == ["a", "d"] and pick("{reference}") == ["c"]
    assert pick("a, internal") == ["a", "i", "j"] and pick("unlabeled") == ["b", "e", "i", "j"] and pick("^[ab]$") == ["a", "b"] and pick(names=["E", "t"]) == ["a", "d", "e"] and pick(regex="T") == ["a", "d"]
    with pytest.raises(ValueError):
        pick("nobody")
    assert Tree.parse(t.newick()).newick() == t.newick()
    assert t.prune({"a", "c", "e"}).newick(tags=False) == "(a:2,c:3,e:1);"
    assert robinson_foulds(t, Tree.parse("((a,c),(b,d),e);")) == 4 and robinson_foulds(t, t) == 0
    labels = {"a": "x", "b": "x", "c": "y", "d": "x"}
    assert t.nodes[1].name == "i" and propagate_labels(t, labels)[1] == "x" and propagate_labels(t, labels, "only").keys() == {2, 3, 5, 6}
    rooted = Tree.parse("((a:1,b:1):1,c:2);").unrooted()
    assert len(rooted.nodes[0].children) == 3 and sum(n.length or 0 for n in rooted.nodes) == 5


def test_statistics(spark):
    from pyspark.sql import functions as F

    xs = [0.1, 1.0, 3.84, 10.0, 0.0, -1.0, float("nan")]
    rows = spark.createDataFrame([(float(x),) for x in xs], "x double").select("x", *(S.chi2_sf(F.col("x"), k).alias(str(k)) for k in (1, 2, 3, 4, 5)), S.lgamma(F.abs("x") + 1).alias("lg")).collect()
    for r in rows:
        for k in (1, 2, 3, 4, 5):
            assert abs(r[str(k)] - S.chi2_tail(r.x, k)) < 1e-6
        assert math.isnan(r.x) or abs(r.lg - math.lgamma(abs(r.x) + 1)) < 1e-8
    assert abs(S.gamma_q(2.5, 1.0) - S.chi2_tail(2.0, 5)) < 1e-12
    assert S.binomial_left(5, 0.3, 5) == 1.0 and abs(S.binomial_left(5, 0.3, 1) - (0.7**5 + 5 * 0.3 * 0.7**4)) < 1e-12
    assert abs(S.binomial_left(5, 0.3, 1.5) - (0.7**5 + 5 * 0.3 * 0.7**4 + 0.5 * 10 * 0.09 * 0.343)) < 1e-12
    assert S.poisson_binomial([0.5] * 4)[0] == 2 and S.poisson_binomial([0.5] * 4)[1:] == (0, 4)
    rates = S.discrete_gamma(0.5, 4)
    assert abs(sum(rates) / 4 - 1) < 1e-9 and abs(rates[0] - 0.0334) < 1e-3 and abs(rates[3] - 2.8954) < 1e-3


def test_optimisers():
    assert abs(optimise.brent(lambda x: (x - 2) ** 2, 0, 10)[0] - 2) < 1e-4
    rosen = lambda x: (1 - x[0]) ** 2 + 100 * (x[1] - x[0] ** 2) ** 2
    assert np.allclose(optimise.nelder_mead(rosen, [-1, 1], [-5, -5], [5, 5], tol=1e-8, steps=2000)[0], 1, atol=1e-2)
    assert np.allclose(optimise.lbfgs(rosen, [-1, 1], [-5, -5], [5, 5], steps=500)[0], 1, atol=1e-2)
    assert np.allclose(optimise.lbfgs(lambda x: ((x - 3) ** 2).sum(), [0, 0], [0, 0], [1, 5])[0], [1, 3], atol=1e-4)
    share = np.array([0.7, 0.2, 0.1])
    got = optimise.squarem(lambda x: 0.5 * x + 0.5 * share, np.ones(3) / 3, lambda x: -((x - share) ** 2).sum())
    assert np.allclose(got, share, atol=1e-6)


def test_generators():
    pi = np.array([0.3, 0.2, 0.3, 0.2])
    q = gtr(np.array([0.5, 1, 0.4, 0.4, 1, 0.5]), pi)
    assert np.abs(q.sum(axis=1)).max() < 1e-12 and abs(pi @ np.diag(q) + 1) < 1e-12
    p = Spectrum.of(q, pi).transition(np.array([0.0, 0.5, 50.0]))
    assert np.allclose(p[0], np.eye(4)) and np.allclose(p.sum(axis=2), 1) and np.allclose(p[2], pi, atol=1e-6)
    c = code()
    m = MG94(c, np.ones(6), np.full((3, 4), 0.25), np.ones(61) / 61)
    assert np.abs(m.generator(1.0, 0.3).sum(axis=1)).max() < 1e-12
    assert np.allclose(m.spectrum(1, 0.3).transition(np.array([0.7]))[0] @ np.ones(61), 1)


def test_pruning_is_the_sum_over_histories():
    pi = np.array([0.3, 0.2, 0.3, 0.2])
    tree = Tree.parse("(a:0.3,b:0.5,(c:0.1,d:0.7):0.2);")
    t = np.array([n.length or 0.0 for n in tree.nodes])
    s = Spectrum.of(gtr(np.array([0.5, 1, 0.4, 0.4, 1, 0.5]), pi), pi)
    p = s.transition(t)
    states = np.array([[0], [1], [2], [-1]])
    pruner = Pruner(tree, list("abcd"), leaf_vectors(states, np.full((4, 1), 15), 4))
    inner = next(k for k, n in enumerate(tree.nodes) if k and not n.leaf)
    at = {n.name: k for k, n in enumerate(tree.nodes)}
    want = sum(pi[x] * p[at["a"]][x, 0] * p[at["b"]][x, 1] * p[inner][x, y] * p[at["c"]][y, 2] for x in range(4) for y in range(4))
    assert abs(pruner.log_likelihoods(p, pi)[0] - math.log(want)) < 1e-12
    assert abs(pruner.lnl_by(lambda k, v: s.move(t[k], v), pi)[0] - math.log(want)) < 1e-12


def test_distances():
    assert distances.tn93("ACGT", "ACGT") == 0 and distances.hamming("ACGT-", "ACGAA") == 0.25 and distances.tn93("AC", "--") == 1
    d = np.array([[0, 3, 7, 8], [3, 0, 6, 7], [7, 6, 0, 3], [8, 7, 3, 0]], float)
    t = Tree.parse(distances.neighbour_joining(d, list("abcd")))
    assert t.bipartitions() == {frozenset("cd")} and abs(sum(n.length or 0 for n in t.nodes) - (3 + 3 + 4.5)) < 0.6
    w, omega, p = distances.resistance(d)
    assert abs(p[np.triu_indices(4, 1)].sum() - 3) < 1e-9 and (omega >= -1e-12).all() and (w >= 0).all()


def test_alignment_frames(spark):
    rows = spark.createDataFrame([("d", k, n, s) for k, (n, s) in enumerate(parse_alignment(FASTA))], "dataset_id string, taxon_idx int, name string, raw_seq string")
    long = {(r.taxon_idx, r.site): (r.triplet, r.state, r.mask) for r in alignment.sites_long(rows).collect()}
    c = code()
    assert long[0, 0][1] == c.state["ATG"] and long[1, 1] == ("AAR", -1, c.mask("AAR")) and long[2, 1][1:] == (-1, c.everything)
    patterns = alignment.site_patterns(alignment.sites_long(rows)).orderBy("pattern_id").collect()
    assert [r.weight for r in patterns] == [1, 1, 1] and [r.sites for r in patterns] == [[0], [1], [2]]
    f = {(r.scope, r.base): r.freq for r in alignment.base_frequencies(rows).collect()}
    text = "".join(s for _, s in parse_alignment(FASTA))
    n = sum(text.count(b) for b in "ACGT")
    assert all(abs(f["all", b] - text.count(b) / n) < 1e-6 for b in "ACGT")
    observed = np.array([[f.get((str(k), b), 0) for b in "ACGT"] for k in (1, 2, 3)])
    p, pi = alignment.cf3x4(np.maximum(observed, 1e-3) / np.maximum(observed, 1e-3).sum(axis=1, keepdims=True), c)
    assert abs(pi.sum() - 1) < 1e-12 and np.allclose(p.sum(axis=1), 1)


def test_files(spark, tmp_path):
    (tmp_path / "in").mkdir()
    (tmp_path / "in" / "a.fna").write_text(FASTA)
    (tmp_path / "in" / "b.nex").write_text(NEXUS)
    (tmp_path / "in" / "c.txt").write_text("(a,b);")
    got = src.sequences(spark, str(tmp_path / "in")).collect()
    assert sorted(r.name for r in got if r.name) == ["a", "a one", "b", "b x", "c", "c"] and [r.error is not None for r in got].count(True) == 1
    loaded = spark.read.format("alignment").option("listing", f"{tmp_path}/in/a.fna").load().collect()
    assert [r.name for r in loaded] == ["a", "b x", "c"]
    assert spark.sql(f"SELECT count(*) FROM parse_newick('{TREE}')").first()[0] == 8
    (tmp_path / "labels.tsv").write_text("taxon\tgroup\na\tx\nb\ty\n")
    assert {(r.taxon, r.grp) for r in src.label_map(spark, str(tmp_path / "labels.tsv")).collect()} == {("a", "x"), ("b", "y")}
    assert src.tree_nodes(spark, TREE).where("is_leaf").count() == 5
