"""Repulsion by the tree against the sum over all pairs."""

from __future__ import annotations

import numpy as np
import pytest
from mossgraph.operators import graph, repulsion


def summed(at: np.ndarray) -> np.ndarray:
    d = at[:, None] - at
    return (d / np.maximum((d**2).sum(axis=2), repulsion.NEAREST)[:, :, None]).sum(axis=1)


draw = np.random.default_rng(3)
PLACES = {
    "uniform": draw.uniform(-500, 500, (1500, 2)),
    "one dense cluster": np.concatenate([draw.normal(0, 1, (1000, 2)), draw.uniform(-500, 500, (300, 2))]),
    "clusters of every size": np.concatenate([draw.normal(9 * k, 10.0**-k, (250, 2)) for k in range(6)]),
    "piled in a corner": np.concatenate([np.full((900, 2), 500.0), draw.uniform(-500, 500, (700, 2))]),
    "closer than the least distance": draw.uniform(0, 0.004, (800, 2)),
    "on a line": np.stack([np.linspace(-500, 500, 1111), np.zeros(1111)], axis=1),
    "odd number": draw.uniform(-5, 5, (97, 2)),
    "fewer than a leaf": draw.uniform(-5, 5, (7, 2)),
}


@pytest.mark.parametrize("name", PLACES)
def test_tree_equals_all_pairs(name):
    at = PLACES[name]
    want, found = summed(at), repulsion.pushed(at)
    size = np.sqrt((want**2).sum(axis=1).mean())
    assert np.sqrt(((want - found) ** 2).sum(axis=1).mean()) < 1e-3 * size
    assert np.quantile(np.linalg.norm(want - found, axis=1), 0.99) < 5e-3 * size


def test_no_node_one_node_and_copies():
    assert repulsion.pushed(np.zeros((0, 2))).shape == (0, 2)
    assert (repulsion.pushed(np.array([[3.0, 4.0]])) == 0).all()
    assert (repulsion.pushed(np.full((5000, 2), 2.5)) == 0).all()


def test_coincident_nodes_open_no_pairs(monkeypatch):
    """Piled nodes are summed by the linear rule: the pairs of leaves left don't grow with their square."""
    seen = []
    kept = repulsion.direct
    monkeypatch.setattr(repulsion, "direct", lambda points, mass, a, b: seen.append(len(a)) or kept(points, mass, a, b))
    repulsion.pushed(np.concatenate([np.full((20_000, 2), 500.0), draw.uniform(-500, 500, (2_000, 2))]))
    assert sum(seen) < 3_000


def test_layout_of_two_clusters_keeps_them_apart():
    """Two cliques joined by one edge: the mean distance inside is below half of that between, with the tree as without it."""
    pairs = [(c * 30 + i, c * 30 + j) for c in range(2) for i in range(30) for j in range(i)] + [(0, 30)]
    for exact in (4096, 0):
        at, _ = graph.layout(60, np.array(pairs), 149, exact=exact)
        d = np.linalg.norm(at[:, None] - at, axis=2)
        assert d[:30, :30].mean() < d[:30, 30:].mean() / 2 and np.isfinite(at).all() and np.abs(at).max() <= 500
