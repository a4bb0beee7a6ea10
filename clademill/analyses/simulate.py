"""Alignments drawn from the codon model, for demonstrations and tests."""

from __future__ import annotations

import numpy as np

from clademill.kernels.likelihood import MG94, Spectrum
from clademill.model.codes import GeneticCode, code
from clademill.sources.parsers import Tree

DEMO_TREE = "(((a:0.2,b:0.3):0.15,(c:0.25,d:0.2):0.1):0.1,(e:0.3,f:0.25):0.2,g:0.4);"


def simulate(newick: str = DEMO_TREE, codons: int = 24, omegas: tuple[float, ...] = (0.1, 0.5, 3.0), seed: int = 7, genetic_code: str = "Universal", pairs: np.ndarray | None = None) -> str:
    """FASTA text; the ratio of a site goes round `omegas`. pairs: factors of the synonymous steps."""
    c: GeneticCode = code(genetic_code)
    tree, rng = Tree.parse(newick), np.random.default_rng(seed)
    positions = np.array([[0.3, 0.2, 0.25, 0.25], [0.25] * 4, [0.2, 0.3, 0.3, 0.2]])
    pi = np.ones(c.size) / c.size
    model = MG94(c, np.array([0.5, 1, 0.4, 0.4, 1, 0.5]), positions, pi)
    lengths = np.array([n.length or 0.0 for n in tree.nodes]) * 3 / model.scale()
    out = {tree.nodes[k].name: [] for k in tree.leaves()}
    matrices = {w: Spectrum.of(model.multiple(1.0, w, pairs=pairs), pi).transition(lengths) for w in omegas}
    for site in range(codons):
        p = matrices[omegas[site % len(omegas)]]
        state = {0: int(rng.integers(c.size))}
        for k in reversed(tree.postorder()):
            for child in tree.nodes[k].children:
                row = p[child][state[k]]
                state[child] = int(rng.choice(c.size, p=row / row.sum()))
        for k in tree.leaves():
            out[tree.nodes[k].name].append(c.sense[state[k]])
    return "".join(f">{n}\n{''.join(s)}\n" for n, s in out.items())
