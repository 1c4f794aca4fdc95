"""The forest's depth."""

import numpy as np

from tidemark.llm import vectors


def test_leaves_of_a_query_do_not_grow_with_a_table_without_structure():
    x = np.random.default_rng(3).standard_normal((4096, 48))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    for n in (8192, 5 * 8192, 100 * 8192):
        forest = vectors.Forest(x[:2048], n, 128, 8, 5)
        share = forest.calibrate(x[:2048], 5, 0.97)
        gone, hit = [], 0
        placed = forest.leaves(x)
        for q in x[2048:2098]:
            cosine = x @ q
            true = np.argsort(-cosine)[1:6]
            order = forest.order(q, bound=share * float(np.sqrt(2 - 2 * cosine[true[-1]])))
            gone.append(len(order))
            hit += np.isin(placed[true], order).any(1).sum()
        assert np.mean(gone) <= 48 and hit >= 0.9 * 250


def test_trees_of_clustered_vectors_stay_deep():
    rng = np.random.default_rng(4)
    x = np.repeat(rng.standard_normal((64, 32)), 64, axis=0) + 0.05 * rng.standard_normal((4096, 32))
    x /= np.linalg.norm(x, axis=1, keepdims=True)
    forest = vectors.Forest(x, len(x), 64, 8, 5)
    forest.calibrate(x, 5, 0.97)
    assert forest.top + forest.deep >= 5
