"""Posteriors on a tree: states at nodes, and rate classes on branches."""

from __future__ import annotations

import numpy as np

from clademill.kernels.likelihood import Pruner


def node_posteriors(pruner: Pruner, p: np.ndarray, pi: np.ndarray) -> list[np.ndarray]:
    """For each node (states, patterns): the probability of its states given all leaves, with transitions p[branch]."""
    down, _ = pruner.below(p)
    up = pruner.above(p, down, pi)
    out = []
    for k in range(len(down)):
        # What is above a branch meets, through it, what is below.
        joint = down[k] * (pi[:, None] if k == 0 else p[k].T @ up[k])
        out.append(joint / np.maximum(joint.sum(axis=0, keepdims=True), 1e-300))
    return out


def class_responsibilities(pruner: Pruner, classes: list[np.ndarray], weights: np.ndarray, pi: np.ndarray) -> np.ndarray:
    """(branch, class, pattern): how much each class has to do with each branch when every branch is a mixture of classes. classes: transitions of all branches for each; the root has the weights themselves."""
    mixed = sum(w * c for w, c in zip(weights, classes, strict=True))
    down, _ = pruner.below(mixed)
    up = pruner.above(mixed, down, pi)
    out = np.empty((len(down), len(classes), down[0].shape[1]))
    out[0] = np.asarray(weights)[:, None]
    for k in range(1, len(down)):
        share = np.stack([w * (up[k] * (c[k] @ down[k])).sum(axis=0) for w, c in zip(weights, classes, strict=True)])
        out[k] = share / np.maximum(share.sum(axis=0, keepdims=True), 1e-300)
    return out
