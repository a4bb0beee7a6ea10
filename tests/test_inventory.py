"""Small operators, readers, writers and kernels, each against a plain version or a known value."""

import hashlib
import hmac
import json
import math

import numpy as np
import pytest

from clademill.kernels import numeric, posteriors
from clademill.kernels.likelihood import MG94, Pruner, Spectrum
from clademill.model.codes import code
from clademill.operators import branches
from clademill.plans import stages
from clademill.sinks import reports
from clademill.sources import tables
from clademill.sources.parsers import FormatError, Tree

TREE = "((a{test}:1,b:1)x{test}:1,(c:1,d{reference}:1)y:1,e:1);"


def test_taxa_and_trees():
    assert tables.taxa_of("a, b\n# no\nc # d\n\na") == ["a", "b", "c"]
    assert tables.taxa_of(">x 1\nACG\n>y\nACG\n")[1] == "y"
    assert tables.tree_source(">a\nACG\n", None) == "infer" and tables.tree_source(">a\nACG\n", "t.nwk") == "file" and tables.tree_source(">a\nACG\n", "ohmic") == "network" and tables.tree_source(">a\nACG\n", "auto") == "infer"


def test_partitions_of_four_layouts(spark, tmp_path):
    pairs = tables.synonymous_pairs(code())
    assert len(pairs) == 67 and ("AAA", "AAG") in pairs and ("TCT", "AGT") not in pairs
    by = lambda text, **k: {(a, b): (c, r) for a, b, c, r in tables.parse_partition(text, **k)}
    assert by("AA\tc1\tc2\tclass\nK\tAAG\tAAA\tfast\n")["AAA", "AAG"] == ("fast", None)
    assert by("AAA AAG slow\n")["AAA", "AAG"] == ("slow", None) and by("AAA AAG slow\n")["AAC", "AAT"] == ("neutral", None)
    rates = "\n".join(f"{b}\t{a}\t{k / 2}" for k, (a, b) in enumerate(pairs))
    assert by(rates)[pairs[4]] == ("Empirical", 2.0)
    with pytest.raises(FormatError):
        by("AAA\tAAG\t0.5\n")
    assert by("K\tAAGAAA\tfast\n")["AAA", "AAG"] == ("fast", None)
    classes = "\n".join(f"x\t{c}\t{'s' if c[2] in 'GC' else 'w'}" for c in code().sense)
    assert by(classes)["AAA", "AAG"][0] == "s__w" and by(classes, shared_between=True)["AAA", "AAG"][0] == "BETWEEN_CLASSES"
    (tmp_path / "p.tsv").write_text(rates)
    made = tables.partition_table(spark, str(tmp_path / "p.tsv"))
    again = "\n".join(r.value for r in reports.partition_lines(made).collect())
    assert sorted(tables.parse_partition(again)) == sorted(tables.parse_partition(rates))


def test_properties(spark, tmp_path):
    (tmp_path / "p.json").write_text(json.dumps({"list": list(range(20)), "map": {a: 2.0 * k for k, a in enumerate(tables.AMINO)}}))
    got = {(r.property, r.aa): r for r in tables.property_table(spark, str(tmp_path / "p.json")).collect()}
    z = (np.arange(20) - 9.5) / np.arange(20).std()
    assert all(np.isclose(got[p, a].z, z[k]) for k, a in enumerate(tables.AMINO) for p in ("list", "map")) and got["map", "Y"].value == 38
    (tmp_path / "q.json").write_text(json.dumps({"map": {"A": 1.0}}))
    with pytest.raises(Exception, match="has no value for"):
        tables.property_table(spark, str(tmp_path / "q.json")).collect()


def test_embeddings_by_name(spark):
    taxa = spark.createDataFrame([("a",), ("b",)], "name string")
    good = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "name string, vector array<double>")
    assert sorted((r.name, r.vector[0]) for r in tables.join_embeddings(taxa, good).collect()) == [("a", 1.0), ("b", 2.0)]
    bad = spark.createDataFrame([("a", [1.0]), ("a", [1.0]), ("c", [1.0, 2.0])], "name string, vector array<double>")
    assert sorted(tuple(r) for r in tables.embedding_problems(taxa, bad).collect()) == [("duplicate", "a"), ("missing", "b"), ("ragged", "c"), ("unknown", "c")]
    with pytest.raises(ValueError, match="duplicate a; missing b"):
        tables.join_embeddings(taxa, bad)


def test_gene_list(spark, tmp_path):
    (tmp_path / "g1.fna").write_text(">a\nACG\n")
    (tmp_path / "g2.fna").write_text(">b\nACG\n")
    (tmp_path / "g2.nwk").write_text("(b);")
    (tmp_path / "list").write_text(f"# genes\n{tmp_path}/g1.fna\n{tmp_path}/g2.fna {tmp_path}/g2.nwk\n\n")
    got = {r.dataset_id.rsplit("/")[-1]: (r.alignment, r.tree) for r in tables.gene_list(spark, str(tmp_path / "list")).collect()}
    assert got == {"g1.fna": (">a\nACG\n", None), "g2.fna": (">b\nACG\n", "(b);")}


def test_preferences(spark):
    p = spark.createDataFrame([(1, {"A": 0.7}), (2, {"A": 0.2})], "site int, preferences map<string,double>")
    assert tables.preference_at(p, 2, "A").first().preference == 0.2
    tables.check_preferences(p, 2)
    with pytest.raises(ValueError):
        tables.check_preferences(p, 3)


def test_result_documents(spark):
    docs = {
        "v3": {"analysis": {"id": "MEME"}}, "fel": {"analysis": {"info": "FEL (Fixed Effects Likelihood)", "version": "2.1"}, "runtime": "2.5.30"}, "dfel": {"analysis": {"info": "Directional FEL"}},
        "slac": {"MLE": {"content": {"0": {"by-site": {}}}}}, "fubar": {"grid": [], "posterior": {}}, "prime": {"MLE": {"headers": [["PRIME LogL", "x"]]}}, "busted": {"fits": {"Unconstrained model": {}}, "test results": {"p-value": 1}},
        "absrel": {"test results": {"positive test results": 2}}, "relax": {"test results": {"relaxation or intensification parameter": 1.5}}, "gard": {"breakpointData": {"0": {}}}, "meme": {"MLE": {"headers": {"beta+": "x"}}}, "none": {},
        "old": {"MLE": {"headers": [["alpha=beta", "x"]]}, "analysis": {"info": "nothing\nknown"}},
    }
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v in docs.items()], "name string, doc string")
    got = {r.name: (r.m.method, r.m.format) for r in df.select("name", tables.detect_method(df.doc).alias("m")).collect()}
    assert {k: v[0] for k, v in got.items()} == {**{k: k for k in docs}, "v3": "meme", "none": None, "old": "fel"}
    assert got["v3"][1] == "v3" and got["fel"][1] == "v2" and got["dfel"][1] == "v3-legacy" and got["old"][1] == "v2"
    doc = json.dumps({"MLE": {"headers": [["alpha", "rate"], ["beta", "rate"]], "content": {"0": [[1.0, 2.0], [3.0, 4.0]]}}})
    rows = tables.result_rows(spark.createDataFrame([("d", doc)], "id string, doc string"), "id", "doc").collect()
    assert sorted((r.partition, r.site, r.column, r.value) for r in rows) == [("0", 1, "alpha", 1.0), ("0", 1, "beta", 2.0), ("0", 2, "alpha", 3.0), ("0", 2, "beta", 4.0)]


def test_branch_sets():
    t = Tree.parse(TREE)
    of = dict(zip([n.name for n in t.nodes], branches.test_and_reference(t, "test", "reference"), strict=True))
    assert of["a"] == of["x"] == "test" and of["d"] == "reference" and of["b"] == "unclassified"
    assert branches.test_and_reference(t, "test").count("reference") == 5
    with pytest.raises(ValueError):
        branches.test_and_reference(t, "test", "a,d")
    groups = dict(zip([n.name for n in t.nodes], branches.branch_groups(t), strict=True))
    assert groups["a"] == "test" and groups["d"] == "reference" and groups["e"] == "background"
    mine = dict(zip([n.name for n in t.nodes], branches.branch_groups(t, {"one": "a,b", "two": "Leaves"}), strict=True))
    assert mine["a"] == "one" and mine["c"] == "two" and mine["y"] == "background"
    sets = dict(zip([n.name for n in t.nodes], branches.leaf_sets(t), strict=True))
    assert sets["x"] == {"a", "b"} and len(branches.leaf_sets(t)[0]) == 5


def test_masks_and_nucleotides(spark):
    t = Tree.parse(TREE)
    seqs = spark.createDataFrame([(n, "ACGTTTGGA") for n in "abcde"], "name string, raw_seq string")
    flagged = spark.createDataFrame([("x", 2), ("e", 3)], "branch string, site int")
    got = {r.name: r.raw_seq for r in branches.mask_flagged(seqs, flagged, t).collect()}
    assert got == {"a": "ACG---GGA", "b": "ACG---GGA", "c": "ACGTTTGGA", "d": "ACGTTTGGA", "e": "ACGTTT---"}
    rows = branches.to_nucleotides(spark.createDataFrame([("n", 0, "ACG"), ("n", 1, "TT-")], "name string, site int, triplet string")).collect()
    assert "".join(r.base for r in sorted(rows, key=lambda r: r.pos)) == "ACGTT-"
    c = code()
    masks = spark.createDataFrame([(c.mask("AAR"),), (c.mask("TGN"),)], "m long")
    assert [r[0] for r in masks.select(branches.codons_of(masks.m)).collect()] == [["AAA", "AAG"], ["TGC", "TGG", "TGT"]]


def test_rankings(spark):
    assert branches.disjoint_greedy([(3.0, 1, 2), (2.5, 2, 3), (2.0, 3, 4), (0.0, 5, 6)], 5) == [(3.0, 1, 2), (2.0, 3, 4)]
    assert len(branches.disjoint_greedy([(3.0, 1, 2), (2.0, 3, 4)], 1)) == 1
    assert branches.active_bridges(spark.createDataFrame([(0.2,), (0.5,)], "stress double"), 0.5).count() == 1


def test_digests(spark):
    for key in (b"k", b"long key " * 20):
        df = spark.createDataFrame([("visitor",), ("",)], "v string")
        assert [r[0] for r in df.select(branches.hmac_sha256(key, df.v)).collect()] == [hmac.new(key, m, hashlib.sha256).hexdigest() for m in (b"visitor", b"")]
    digests = spark.createDataFrame([("00f1",), ("8000",), ("0001",), ("4000",)], "d string")
    assert [r[0] for r in digests.select(branches.leading_zero_bits(digests.d)).collect()] == [8, 0, 15, 1]


def test_expm_and_draws():
    rng = np.random.default_rng(1)
    for scale in (0.01, 1, 30):
        a = rng.normal(size=(6, 6)) * scale / 6
        values, vectors = np.linalg.eig(a)
        assert np.allclose(numeric.expm(a), (vectors * np.exp(values) @ np.linalg.inv(vectors)).real, rtol=1e-7, atol=1e-9)
    assert np.allclose(numeric.expm(np.zeros((3, 3))), np.eye(3))
    one, two = numeric.Draws(5, 1), numeric.Draws(5, 1)
    assert one.normal() == two.normal() and one.gamma(2.0) == two.gamma(2.0) and numeric.Draws(5, 2).uniform() != numeric.Draws(5, 1).uniform() and 0 <= one.integer(4) < 4


def test_properties_and_options():
    assert numeric.physical_distance("A", "A") == 0 and numeric.physical_distance("A", "?") == 0.5 and len(numeric.physical_rows()) == 400
    assert np.isclose(numeric.physical_distance("A", "R"), math.sqrt(((2.4 / 8.1) ** 2 + (93 / 167) ** 2 + 0.25 + (6.3 / 9) ** 2) / 4))
    assert numeric.parse_integer("-n", "12") == 12 and numeric.parse_number("-x", "1e-3") == 1e-3 and numeric.parse_probability("-p", "0") == 0
    for f, text in ((numeric.parse_integer, "1.5"), (numeric.parse_integer, "1x"), (numeric.parse_number, "inf"), (numeric.parse_number, ""), (numeric.parse_probability, "1.2"), (numeric.parse_integer, "1_0")):
        with pytest.raises(ValueError):
            f("-o", text)
    with pytest.raises(ValueError):
        numeric.parse_integer("-n", "-1", 0, 10)
    p = numeric.Parameters().add("a", 1.0, 0, 2).add("b", 2.0).add("c", 0.0).tie("c", lambda v: v["a"] + v["b"])
    assert p.free == ["a", "b"] and p.put(np.array([5.0, 3.0])) == {"a": 2.0, "b": 3.0, "c": 5.0}


def test_gradients():
    def f(x, y):
        return (x * y + x.exp() / y - (y**2 + 1.0).log()).sqrt() * 2.0 + 3.0 / x

    x, y = numeric.Var(0.7), numeric.Var(1.9)
    f(x, y).backward()
    for at, grad in (((1e-6, 0), x.grad), ((0, 1e-6), y.grad)):
        up, down = (f(numeric.Var(0.7 + s * at[0]), numeric.Var(1.9 + s * at[1])).value for s in (1, -1))
        assert np.isclose((up - down) / 2e-6, grad, rtol=1e-5)
    assert np.allclose(numeric.adam(lambda v: 2 * (v - np.array([1.0, -2.0])), np.zeros(2)), [1, -2], atol=1e-2)


def test_codon_models():
    c = code()
    rng = np.random.default_rng(2)
    pref = dict(zip(tables.AMINO, rng.dirichlet(np.ones(20)), strict=True))
    q, pi = numeric.expcm(pref, np.array([0.3, 0.2, 0.2, 0.3]), 2.0, 0.7, 1.3, c)
    assert np.allclose(pi[:, None] * q, (pi[:, None] * q).T) and np.allclose(q.sum(axis=1), 0)
    shares = numeric.flux_shares(q, pi, c)
    assert shares["share_double"] == shares["share_triple"] == 0 and np.isclose(shares["single"], -(pi * np.diag(q)).sum())
    spread = numeric.flux_shares(np.ones((61, 61)), np.ones(61) / 61, c)
    assert np.isclose(spread["single"] + spread["double"] + spread["triple"], spread["total"]) and np.isclose(spread["total"], 60)


def test_posteriors_equal_enumeration():
    t = Tree.parse("((a:0.3,b:0.2)x:0.1,c:0.4,d:0.5);")
    n = 4
    rng = np.random.default_rng(3)
    pi = rng.dirichlet(np.ones(n))
    q = rng.random((n, n)) * pi
    q = (q + (q.T * pi) / pi[:, None]) / 2
    np.fill_diagonal(q, 0)
    q = (pi[:, None] * q + (pi[:, None] * q).T) / 2 / pi[:, None]
    q -= np.diag(q.sum(axis=1))
    leaves = np.eye(n)[:, :, None][[0, 1, 1, 2]]
    pruner = Pruner(t, list("abcd"), leaves)
    lengths = np.array([k.length or 0.0 for k in t.nodes])
    p = np.stack([numeric.expm(q * x) for x in lengths])
    assert np.allclose(p, Spectrum.of(q, pi).transition(lengths), atol=1e-8)
    inner = [k for k, node in enumerate(t.nodes) if not node.leaf]
    seen = {node.name: s for node, s in ((t.nodes[k], dict(a=0, b=1, c=1, d=2).get(t.nodes[k].name)) for k in t.leaves())}
    joint = np.zeros((n, n))
    for r in range(n):
        for x in range(n):
            state = {0: r, inner[1]: x}
            value = pi[r]
            for k, node in enumerate(t.nodes):
                if k:
                    value *= p[k][state.get(node.parent), state[k] if k in state else seen[node.name]]
            joint[r, x] = value
    got = posteriors.node_posteriors(pruner, p, pi)
    assert np.allclose(got[0][:, 0], joint.sum(axis=1) / joint.sum()) and np.allclose(got[inner[1]][:, 0], joint.sum(axis=0) / joint.sum())
    slow = np.stack([numeric.expm(q * x * 0.1) for x in lengths])
    r = posteriors.class_responsibilities(pruner, [p, slow], np.array([0.6, 0.4]), pi)
    mixed = 0.6 * p + 0.4 * slow
    base = np.exp(pruner.log_likelihoods(mixed, pi))
    for k in range(1, len(t.nodes)):
        for j, (w, m) in enumerate(((0.6, p), (0.4, slow))):
            one = mixed.copy()
            one[k] = w * m[k]
            assert np.allclose(r[k, j], np.exp(pruner.log_likelihoods(one, pi)) / base)
    assert isinstance(MG94, type)


def test_graph_and_tables(spark, tmp_path):
    s = spark.createDataFrame([(1, "ACG"), (2, 'T"T')], "id long, seq string")
    e = spark.createDataFrame([(1, 2, 3)], "from_id long, to_id long, weight long")
    assert [r.value for r in reports.gfa_lines(s, e).collect()] == ["H\tVN:Z:1.0", "S\t1\tACG", 'S\t2\tT"T', "L\t1\t+\t2\t+\t0M\tRC:i:3"]
    dot = [r.value for r in reports.dot_lines(s, e).collect()]
    assert dot[0] == "digraph graph {" and dot[-1] == "}" and '  "1" -> "2" [weight=3];' in dot
    wide = reports.wide_preferences(spark.createDataFrame([(1, "A", 0.5), (1, "Y", 0.25), (2, "A", 1.0)], "site int, aa string, value double"))
    assert len(wide.columns) == 21 and wide.first().Y == 0.25
    codons = reports.codon_rows(spark.createDataFrame([(1, 0.5, None)], "site int, AAA double, AAC double")).collect()
    assert [(r.site, r.codon, r.value) for r in codons] == [(1, "AAA", 0.5)]
    text = reports.text_table(spark.createDataFrame([(1, None, 0.123456), (2, "x" * 40, 1e9)], "k int, t string, v double").orderBy("k"), rows=1)
    assert text.splitlines()[0].split() == ["k", "t", "v"] and "0.1235" in text and text.endswith("…")
    paths = reports.write_bundle({"fel": "{}", "meme": '{"a": 1}'}, str(tmp_path / "b"))
    assert [p.rsplit("/")[-1] for p in paths] == ["fel.json", "meme.json", "index.json"] and json.load(open(paths[-1]))["documents"] == ["fel.json", "meme.json"]
    with pytest.raises(ValueError):
        reports.write_bundle({"bad": "{"}, str(tmp_path / "b"))
    page = reports.dossier("a <b>", {"s": spark.createDataFrame([("<x>",)], "c string")})
    assert "&lt;x&gt;" in page and "<x>" not in page and "a &lt;b&gt;" in page


def test_stages_are_read_again(spark, tmp_path):
    calls = []

    def add(df):
        calls.append(1)
        return df.selectExpr("id + 1 as id")

    steps = [("one", add), ("two", add)]
    for _ in range(2):
        assert stages.run_stages(spark, spark.range(3), steps, str(tmp_path / "s"), inputs="x").agg({"id": "sum"}).first()[0] == 9
    assert len(calls) == 2
    stages.run_stages(spark, spark.range(3), steps, str(tmp_path / "s"), inputs="y")
    assert len(calls) == 4


def test_progress_listener():
    class Event:
        id, name, exception = "1", "q", None

        class progress:
            id, name, batchId, numInputRows, processedRowsPerSecond = "1", "q", 4, 10, 2.5

    told = []
    p = stages.Progress(told.append)
    p.onQueryStarted(Event)
    p.onQueryProgress(Event)
    assert p.last["1"]["batch"] == 4 and told[0]["rows"] == 10
    p.onQueryTerminated(Event)
    assert p.last["1"]["state"] == "done"
