"""Islands, error sinks, routed segments, lost constraint and sites that change together, each against a plain version."""

import itertools
import math

import numpy as np

from clademill.operators import islands, lineages


def plain_islands(alpha, gap):
    n, out, s = len(alpha), [], 0
    if n < 25:
        return out
    a = [min(5.0, x) for x in alpha]
    mean = max(0.15, sum(a) / n)
    sd = math.sqrt(max(0.04, sum(x * x for x in a) / n - mean**2))
    share = min(0.9, max(0.05, sum(x <= 0.15 and g <= 0.25 for x, g in zip(a, gap, strict=True)) / n))
    while s < n:
        best = (1.0, 0)
        for size in range(min(11, n // 3), 25):
            if s + size > n or sum(gap[s : s + size]) / size > 0.2 or sum(a[s : s + size]) / size > 0.35 * mean:
                continue
            z = (mean - sum(a[s : s + size]) / size) / (sd / math.sqrt(size))
            k = sum(x <= 0.15 for x in a[s : s + size])
            tail = sum(math.comb(size, j) * share**j * (1 - share) ** (size - j) for j in range(k, size + 1))
            best = min(best, (min(0.5 * math.erfc(z / math.sqrt(2)), tail), size))
        if best[0] <= 0.01 and best[0] * max(1, n // 12) <= 0.12:
            out.append((s, s + best[1] - 1, best[0] * max(1, n // 12)))
            s += best[1]
        else:
            s += 1
    return out


def test_islands_equal_a_plain_scan(spark):
    rng = np.random.default_rng(5)
    rows, want = [], {}
    for gene, n in (("a", 120), ("b", 80), ("short", 20), ("c", 26)):
        alpha = rng.gamma(1.0, 1.2, n)
        alpha[10:25] *= 0.02
        alpha[60:100] *= 0.05
        gap = np.where(rng.random(n) < 0.05, 0.5, 0.0)
        rows += [(gene, k, float(alpha[k]), float(gap[k])) for k in range(n)]
        want[gene] = plain_islands(alpha.tolist(), gap.tolist())
    df = spark.createDataFrame(rows, "gene string, site int, alpha double, gap_fraction double").repartition(5)
    got = {}
    for r in islands.silent_islands(df, ["gene"]).collect():
        got.setdefault(r.gene, []).append((r["first"], r["last"], r.p_value))
    for gene, found in want.items():
        mine = sorted(got.get(gene, []))
        assert [m[:2] for m in mine] == [f[:2] for f in found]
        assert np.allclose([m[2] for m in mine], [f[2] for f in found], rtol=1e-4)
    assert len(want["a"]) >= 2 and not want["short"]
    assert islands.silent_islands(df.limit(0), ["gene"]).count() == 0


def test_sink_chain_equals_all_paths():
    odds = np.array([0.2, 5.0, 30.0, 8.0, 0.5, 0.1])
    t = islands.sink_chain(1 / 100, 0.75)
    emit = lambda s, k: 1.0 if s == 0 else odds[k]
    z, error = 0.0, np.zeros(len(odds))
    for path in itertools.product(range(4), repeat=len(odds)):
        if path[-1] not in (0, 3):
            continue
        p = t[0, path[0]] * emit(path[0], 0)
        for k in range(1, len(odds)):
            p *= t[path[k - 1], path[k]] * emit(path[k], k)
        z += p
        error += [p * (s > 0) for s in path]
    _, log_z, enough = islands.sink_posterior(odds, 4, turns=1)
    assert np.isclose(log_z, math.log(z)) and not enough
    odds = odds * 50
    found, log_z, enough = islands.sink_posterior(odds, 2, turns=8)
    assert enough and found.max() > 0.99 and log_z > 0
    assert not islands.sink_posterior(odds[:2], 2)[2]


def test_sinks_by_branch(spark):
    rows = [("g", b, k, 400.0 if b == "bad" and 10 <= k < 18 else 0.05) for b in ("bad", "good") for k in range(40)]
    got = islands.error_sinks(spark.createDataFrame(rows, "gene string, branch string, site int, odds double").repartition(3), ["gene"]).collect()
    assert sorted(r.site for r in got if r.error > 0.5) == list(range(10, 18)) and {r.branch for r in got if r.flagged} == {"bad"}


def test_routes(spark):
    rng = np.random.default_rng(6)
    segments = [(int(a), int(a + n), float(g)) for a, n, g in zip(rng.integers(0, 60, 40), rng.integers(2, 25, 40), rng.integers(1, 9, 40), strict=True)]
    owned: dict[int, tuple[float, int]] = {}
    want = []
    for k, (a, b, g) in enumerate(segments):
        covered = sum(1 for c in range(a, b + 1) if c in owned and owned[c][0] >= g)
        want.append(covered * 2 <= b - a + 1)
        if want[-1]:
            for c in range(a, b + 1):
                if c not in owned or g > owned[c][0]:
                    owned[c] = (g, k)
    taken, owner = islands.route_segments(segments, 100)
    assert taken == want and {k: v for k, v in enumerate(owner) if v >= 0} == {c: k for c, (_, k) in owned.items()}
    df = spark.createDataFrame([("g", k, *s) for k, s in enumerate(segments)], "gene string, order int, first int, last int, gain double")
    assert [r.routed for r in islands.routed(df, ["gene"]).orderBy("order").collect()] == want


def genes(rng, branches=12, sites=40):
    u = np.where(rng.random((sites, branches)) < 0.12, rng.random((sites, branches)) * 1.2, 0.0)
    u[:6, 3] = 0.9  # one branch invades the first sites
    u[10, [1, 5, 7]] = u[20, [1, 5, 7]] = [0.8, 0.9, 1.0]  # two sites change together
    return u, rng.random(branches) * 0.2 + 0.05


def frames(spark, u, length):
    counts = [("g", c, f"b{b:02}", float(u[c, b])) for c in range(u.shape[0]) for b in range(u.shape[1])]
    return (
        spark.createDataFrame(counts, "gene string, site int, branch string, u double"),
        spark.createDataFrame([("g", f"b{b:02}", float(t), u.shape[0]) for b, t in enumerate(length)], "gene string, branch string, length double, sites int"),
    )


def test_constraint_loss_equals_a_plain_version(spark):
    u, length = genes(np.random.default_rng(7))
    u[:25] *= 0.5
    u[:6, 3] = 0.95
    sites, n = u.shape
    core = list(range(25))
    obs = u[core].sum(axis=0)
    eff = np.maximum(1e-5, length - np.maximum(0, obs - 1) / sites)
    keep = sorted(range(n), key=lambda b: obs[b] / eff[b])[: max(1, n * 85 // 100)]
    counts, branches = frames(spark, u, length)
    got = {r.branch: r for r in lineages.constraint_loss(counts.where("site < 25"), branches, ["gene"]).collect()}
    for b in range(n):
        rest = [k for k in keep if k != b]
        e = max(0.25, obs[rest].sum() / eff[rest].sum() * eff[b])
        r = got[f"b{b:02}"]
        assert np.isclose(r.observed, obs[b]) and np.isclose(r.expected, e) and r.invaded == (u[core, b] >= 0.6).sum()
        if obs[b] > 2 * e and r.invaded >= 2 and obs[b] >= 2.5:
            rate = min(max(obs[b], 2 * e), max(3 * e, length[b] * len(core) * 0.75))
            rate = max(rate, 2 * e)
            assert np.isclose(r.log_bf, min(20, obs[b] * math.log(rate / e) - (rate - e)))
            assert np.isclose(r.p_value, math.erfc(math.sqrt((obs[b] * math.log(obs[b] / e) - (obs[b] - e)))), rtol=1e-4)
        else:
            assert r.p_value == 1.0 and not r.flagged
    assert got["b03"].log_bf is not None


def test_changing_together_equals_dense_vectors(spark):
    u, length = genes(np.random.default_rng(8))
    sites, n = u.shape
    load = np.maximum(1e-4, 0.25 * length + u.sum(axis=0))
    share = load / load.sum()
    centred, many = {}, {}
    for c in range(sites):
        many[c] = int((u[c] >= 0.45).sum())
        if many[c] >= 2 and u[c].sum() >= 1.1:
            v = u[c] - (u[c] @ load) / (load @ load) * load
            centred[c] = v - v.mean()
    want = {}
    for a, b in itertools.combinations(sorted(centred), 2):
        if b <= a + 2:
            continue
        both = (u[a] >= 0.45) & (u[b] >= 0.45)
        shared = np.minimum(1, np.minimum(u[a], u[b]))[both].sum()
        r = centred[a] @ centred[b] / np.linalg.norm(centred[a]) / np.linalg.norm(centred[b])
        chance = max(0.02, (np.minimum(1, many[a] * share) * np.minimum(1, many[b] * share)).sum())
        if both.sum() >= 2 and shared >= 1.1 and r > 0.45 and both.sum() > 1.5 * chance:
            want[a, b] = (int(both.sum()), shared, share[both].sum(), r, chance)
    counts, branches = frames(spark, u, length)
    got = {(r.a, r.b): (r.together, r.shared, r.weight, r.cosine, r.expected) for r in lineages.changing_together(counts.where("u > 0"), branches, ["gene"]).collect()}
    assert got.keys() == want.keys() and (10, 20) in got
    assert all(np.allclose(got[k], want[k]) for k in want)
    pools = {r.pool for r in lineages.branch_loads(counts, branches, ["gene"]).collect()}
    assert np.allclose(list(pools), 1 / (share @ share))


def test_core_sites(spark):
    u, _ = genes(np.random.default_rng(9))
    counts = spark.createDataFrame([("g", c, f"b{b}", float(u[c, b])) for c in range(40) for b in range(12)], "gene string, site int, branch string, u double")
    atlas = [("g", c, 1.0, 0.02 if c < 9 else 2.0, 0.9, 0.5 if c == 8 else 0.0, 5.0) for c in range(40)]
    schema = "gene string, site int, alpha double, beta double, p_value double, gap_fraction double, alphabet double"
    got = lineages.core_sites(spark.createDataFrame(atlas, schema), counts, ["gene"])
    assert sorted(r.site for r in got.collect()) == list(range(8))
    few = [(g, c, a, b + c / 100, p, gap, al) for g, c, a, b, p, gap, al in atlas if c >= 4]
    assert sorted(r.site for r in lineages.core_sites(spark.createDataFrame(few, schema), counts, ["gene"]).collect()) == [4, 5, 6, 7, *range(9, 14)]
