"""Branch sets, masks and the small rankings of the tree analyses."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from clademill.model.codes import GeneticCode, code
from clademill.sources.parsers import Tree, select_branches


def test_and_reference(tree: Tree, test: str = "", reference: str = "") -> list[str]:
    """Of each node: test, reference, or unclassified (the root is always). Without a reference, all branches that aren't tested are the reference. A branch that both name is an error."""
    tested = select_branches(tree, test or "test")
    other = select_branches(tree, reference) if reference else [k > 0 and not t for k, t in enumerate(tested)]
    if both := [tree.nodes[k].name or f"Node{k}" for k, (a, b) in enumerate(zip(tested, other, strict=True)) if a and b]:
        raise ValueError(f"both test and reference: {', '.join(both)}")
    if not any(other):
        raise ValueError("no reference branch is left")
    return ["test" if a else "reference" if b else "unclassified" for a, b in zip(tested, other, strict=True)]


def branch_groups(tree: Tree, specs: dict[str, str] | None = None, background: str = "background") -> list[str]:
    """The group of each node: by specification in order, the first that matches; without any by the tags there are. Other branches are the background."""
    out = [background] * len(tree.nodes)
    chosen = {n: select_branches(tree, s, strict=False) for n, s in specs.items()} if specs else {t: [n.tag.lower() == t for n in tree.nodes] for t in sorted({n.tag.lower() for n in tree.nodes[1:] if n.tag})}
    for name, mine in chosen.items():
        if not any(mine[1:]):
            raise ValueError(f"group {name} has no branch")
        for k, here in enumerate(mine):
            if k and here and out[k] == background:
                out[k] = name
    if len(chosen) < 2 and not (chosen and background in out[1:]):
        raise ValueError("fewer than two groups")
    return out


def leaf_sets(tree: Tree) -> list[frozenset[str]]:
    """The leaves below each node, from the leaves up."""
    out: list[frozenset[str]] = [frozenset()] * len(tree.nodes)
    for k in tree.postorder():
        n = tree.nodes[k]
        out[k] = frozenset({n.name}) if n.leaf else frozenset().union(*(out[c] for c in n.children))
    return out


def descendants(tree: Tree) -> list[tuple[str, str]]:
    """(branch, taxon): each branch with every leaf below it, itself included; branches without a name are Node<k>."""
    return [(tree.nodes[k].name or f"Node{k}", leaf) for k, leaves in enumerate(leaf_sets(tree)) if k for leaf in sorted(leaves)]


def mask_flagged(sequences: DataFrame, flagged: DataFrame, tree: Tree, gap: str = "---") -> DataFrame:
    """Sequences of (name, raw_seq) with the codons below flagged (branch, site from 1) replaced: an error on a branch is in all of its descendants."""
    below = sequences.sparkSession.createDataFrame(descendants(tree), "branch string, name string")
    sites = flagged.join(F.broadcast(below), "branch").groupBy("name").agg(F.collect_set("site").alias("_sites"))  # of one gene: a row for each pair of branch and leaf
    triplets = F.transform(F.sequence(F.lit(1), F.ceil(F.length("raw_seq") / 3).cast("int")), lambda k: F.when(F.array_contains("_sites", k), F.lit(gap)).otherwise(F.substring("raw_seq", k * 3 - 2, F.lit(3))))
    whole = F.when(F.col("_sites").isNull() | (F.length("raw_seq") == 0), F.col("raw_seq")).otherwise(F.array_join(triplets, ""))
    return sequences.join(sites, "name", "left").withColumn("raw_seq", whole).drop("_sites")


def to_nucleotides(codons: DataFrame) -> DataFrame:
    """Rows of (.., site, triplet) -> rows of (.., pos, base), three for each codon."""
    bases = F.posexplode(F.split(F.rpad("triplet", 3, "-"), "")).alias("_k", "base")
    kept = [c for c in codons.columns if c not in ("site", "triplet")]
    return codons.select(*kept, "site", bases).where("base <> ''").select(*kept, (F.col("site") * 3 + F.col("_k")).alias("pos"), "base")


def codons_of(mask: Column, genetic_code: str | int = "Universal") -> Column:
    """The sense codons that a mask of an ambiguous triplet allows, in order."""
    c: GeneticCode = code(genetic_code)
    every = F.array(*map(F.lit, c.sense))
    return F.filter(every, lambda x, k: F.getbit(mask, k) == 1)


def adjacent(parts: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """Each part beside the next in order: columns of the next one have the ending _next; the last has no row."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return parts.withColumns({f"{c}_next": F.lead(c).over(w) for c in [order[0], *columns]}).where(F.col(f"{order[0]}_next").isNotNull())


def rank_candidates(df: DataFrame, lnl: str, keys: list[str], tie: list[str]) -> DataFrame:
    """Candidates by log-likelihood: rank from 1, delta to the best, and weight exp(-delta) as a share of all."""
    group = Window.partitionBy(*keys)
    with_delta = df.withColumn("delta", F.max(lnl).over(group) - F.col(lnl))
    return with_delta.withColumns({"weight": F.exp(-F.col("delta")) / F.sum(F.exp(-F.col("delta"))).over(group), "rank": F.row_number().over(group.orderBy(F.col(lnl).desc(), *tie))})


def elite(df: DataFrame, criterion: str, n: int, tie: list[str]) -> DataFrame:
    """The n candidates with the least criterion: a top-k, not a sort of all."""
    return df.orderBy(F.col(criterion), *tie).limit(n)


def disjoint_greedy(candidates: list[tuple[float, int, int]], most: int) -> list[tuple[float, int, int]]:
    """Of (gain, a, b), from the largest gain on, at most `most` whose ends aren't taken; gains of 0 or less are left. Ties by a, then b."""
    taken: set[int] = set()
    out: list[tuple[float, int, int]] = []
    for gain, a, b in sorted(candidates, key=lambda c: (-c[0], c[1], c[2])):
        if len(out) < most and gain > 0 and not {a, b} & taken:
            taken |= {a, b}
            out.append((gain, a, b))
    return out


def active_bridges(bridges: DataFrame, tau: float, stress: str = "stress") -> DataFrame:
    return bridges.where(F.col(stress) >= tau)


def job_states(jobs: DataFrame, seen: DataFrame, key: str, state: str = "state") -> DataFrame:
    """Jobs with the scheduler's state; one that it doesn't know keeps its own, but a job once submitted that is gone is done."""
    known = seen.select(key, F.col(state).alias("_seen"))
    own = F.when(F.col(state).isin("submitted", "running"), F.lit("done")).otherwise(F.col(state))
    return jobs.join(known, key, "left").withColumn(state, F.coalesce("_seen", own)).drop("_seen")


def hmac_sha256(key: bytes, message: Column) -> Column:
    """Lower-case hex of the HMAC with a fixed key, by the built-in digest: both padded keys are literals."""
    block = (hashlib.sha256(key).digest() if len(key) > 64 else key).ljust(64, b"\0")
    inner, outer = (F.lit(bytearray(b ^ pad for b in block)) for pad in (0x36, 0x5C))
    return F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, message.cast("binary")), 256))), 256)


def leading_zero_bits(digest: Column) -> Column:
    """Zero bits before the first one of a digest in hex."""
    zeros = F.length(F.regexp_extract(digest, "^0*", 0))
    nibble = F.conv(F.substring(digest, zeros + 1, F.lit(1)), 16, 10).cast("int")
    return (zeros * 4 + F.when(nibble >= 8, 0).when(nibble >= 4, 1).when(nibble >= 2, 2).when(nibble >= 1, 3).otherwise(0)).cast("long")
