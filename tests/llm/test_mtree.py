"""Page-wise search of M-trees against all products."""

import numpy as np
import pytest

from plantwise.llm import mtree


def wanted(ids, rows, q, k):
    scores = rows @ q
    order = np.lexsort((ids, -scores))[:k]
    return list(zip(ids[order].tolist(), scores[order].tolist()))


def searched(tree, qs, k, least=None):
    least = np.full(len(qs), -np.inf) if least is None else least
    q, ids, scores = tree.search_all(qs, k, least)
    out = {i: [] for i in range(len(qs))}
    for a, b, c in zip(q.tolist(), ids.tolist(), scores.tolist()):
        out[a].append((b, int(c)))
    return out


def tree_of(ids, rows):
    tree = mtree.MTree.build(ids, rows)
    tree.rows = tree.rows.astype(np.float64)
    return tree


def clustered(draw, n, width=32, groups=40):
    centres = draw.normal(size=(groups, width)) * 200
    return np.floor(centres[draw.integers(0, groups, n)] + draw.normal(size=(n, width)) * 3).astype(np.int64)


@pytest.mark.parametrize("kind", ["clustered", "uniform", "ties", "one vector"])
def test_equals_all_products(kind):
    draw = np.random.default_rng(4)
    rows = {"clustered": lambda: clustered(draw, 3000), "uniform": lambda: draw.integers(-64, 64, (3000, 16)),
            "ties": lambda: draw.integers(-1, 2, (3000, 4)), "one vector": lambda: np.ones((700, 5), dtype=np.int64)}[kind]()
    ids = draw.permutation(len(rows)) * 3 + 1
    tree = tree_of(ids, rows)
    qs = rows[::10]
    got = searched(tree, qs, 21)
    for i, q in enumerate(qs):
        assert got[i] == wanted(ids, rows, q, 21), (kind, i)
    least = np.array([wanted(ids, rows, q, 21)[-1][1] for q in qs], dtype=float)
    assert searched(tree, qs, 21, least) == {i: [x for x in r if x[1] >= least[i]] for i, r in got.items()}


def test_bounds_avoid_most_products_on_clustered_vectors():
    draw = np.random.default_rng(5)
    rows = clustered(draw, 8000)
    tree = tree_of(np.arange(len(rows)), rows)
    qs = rows[::20]
    searched(tree, qs, 21)
    assert tree.computed < 0.35 * len(qs) * len(rows), tree.computed / (len(qs) * len(rows))


def test_no_queries_and_small_trees():
    draw = np.random.default_rng(6)
    rows = draw.integers(-9, 9, (300, 4))
    assert searched(tree_of(np.arange(300), rows), rows[:0], 5) == {}
    few = searched(tree_of(np.arange(3), rows[:3]), rows[:1], 5)
    assert few[0] == wanted(np.arange(3), rows[:3], rows[0], 5)
