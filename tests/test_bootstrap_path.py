"""Blocks that follow each other share their path of halvings, and draw what they draw alone."""

import numpy as np

from chartspark.operators import bootstrap as B


def test_neighbours_halve_only_what_they_do_not_share(monkeypatch):
    hashed = []
    real = B.node_hash
    monkeypatch.setattr(B, "node_hash", lambda *a: hashed.append(a) or real(*a))
    size, length, replicates, blocks = 100, 3, 4, 34
    alone = [B.block_draws("s", b, size, replicates, 7, length) for b in range(blocks)]
    single, path = len(hashed), []
    hashed.clear()
    beside = [B.block_draws("s", b, size, replicates, 7, length, path) for b in range(blocks)]
    assert all((a == b).all() for a, b in zip(alone, beside))
    assert (sum(alone) == size).all()
    # every inner node once per side: at most two halvings a node instead of one a level and block
    assert len(hashed) <= 2 * (blocks - 1) * replicates < single


def test_any_order_and_another_scope_give_the_same():
    path = []
    for scope, block in (("a", 5), ("a", 2), ("b", 2), ("b", 33), ("a", 33), ("a", 0)):
        assert np.array_equal(B.block_draws(scope, block, 100, 3, 7, 3, path), B.block_draws(scope, block, 100, 3, 7, 3))
