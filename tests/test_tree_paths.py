import time
from itertools import combinations
from math import factorial

import numpy as np
import pytest

from creditweave.operators import tree_paths

NODES = "tree int, weight double, id int, value double, rows double, left int, right int, feature int, cut double, categories int"
WIDTH = 12


def grown(tree, depth, rng, width=WIDTH):
    """A random tree in preorder; features repeat on paths, and some columns hold 0 or 1."""
    nodes = []

    def grow(level, rows):
        at = len(nodes)
        nodes.append(None)
        if level == depth or rows < 2 or (level and rng.random() < 0.1):
            nodes[at] = (tree, 0.1 + tree % 3, at, float(rng.normal()), float(rows), -1, -1, -1, None, -1)
            return at
        feature = int(rng.integers(0, width))
        category = feature >= width - 2
        cut = float(rng.integers(0, 2)) if category else float(rng.normal())
        share = int(rng.integers(1, rows))
        left = grow(level + 1, share)
        right = grow(level + 1, rows - share)
        nodes[at] = (tree, 0.1 + tree % 3, at, 0.0, float(rows), left, right, feature, cut, 2 if category else -1)
        return at

    grow(0, 1000)
    return nodes


def goes_left(node, row):
    return row[node[7]] == node[8] if node[9] >= 0 else row[node[7]] <= node[8]


def expected(nodes, at, row, known):
    node = nodes[at]
    if node[5] < 0:
        return node[3] * node[1]
    if node[7] in known:
        return expected(nodes, node[5] if goes_left(node, row) else node[6], row, known)
    parts = [expected(nodes, c, row, known) * nodes[c][4] for c in node[5:7]]
    return sum(parts) / node[4]


def brute(nodes, row):
    names = sorted({n[7] for n in nodes if n[5] >= 0})
    out = np.zeros(WIDTH)
    for f in names:
        rest = [g for g in names if g != f]
        for k in range(len(rest) + 1):
            for s in combinations(rest, k):
                w = factorial(k) * factorial(len(names) - k - 1) / factorial(len(names))
                out[f] += w * (expected(nodes, 0, row, {*s, f}) - expected(nodes, 0, row, set(s)))
    return out


def rows_of(rng, n):
    x = rng.normal(size=(n, WIDTH))
    x[:, -2:] = rng.integers(0, 2, (n, 2))
    return x


def test_equal_the_definition(spark):
    rng = np.random.default_rng(1)
    trees = [grown(i, d, rng) for i, d in enumerate((3, 3, 4, 2, 0))]
    paths = tree_paths.collected(tree_paths.leaf_paths(spark.createDataFrame(sum(trees, []), NODES)))
    x = rows_of(rng, 5)
    want = np.array([sum(brute(t, row) for t in trees) for row in x])
    assert paths.contributions(x) == pytest.approx(want)
    assert paths.base == pytest.approx(sum(expected(t, 0, x[0], set()) for t in trees))


def test_many_deep_trees_add_up_and_cost_the_driver_little(spark):
    rng = np.random.default_rng(2)
    trees = [grown(i, 6, rng) for i in range(650)]
    steps = tree_paths.leaf_paths(spark.createDataFrame(sum(trees, []), NODES)).cache()
    steps.count()
    start = time.process_time()
    paths = tree_paths.collected(steps)
    assert time.process_time() - start < 5
    x = rows_of(rng, 40)
    every = set(range(WIDTH))
    want = [sum(expected(t, 0, row, every) for t in trees) for row in x]
    assert paths.base + paths.contributions(x).sum(1) == pytest.approx(want, abs=1e-8)


def test_long_paths(spark):
    """Twelve features on a path: a table of coalitions would have 4096 rows for each leaf."""
    rng = np.random.default_rng(3)
    tree = grown(0, 14, rng)
    paths = tree_paths.collected(tree_paths.leaf_paths(spark.createDataFrame(tree, NODES)))
    x = rows_of(rng, 20)
    want = [expected(tree, 0, row, set(range(WIDTH))) for row in x]
    assert paths.base + paths.contributions(x).sum(1) == pytest.approx(want)


def test_rows_keep_their_keys(spark):
    rng = np.random.default_rng(4)
    paths = tree_paths.collected(tree_paths.leaf_paths(spark.createDataFrame(grown(0, 3, rng), NODES)))
    x = rows_of(rng, 600)
    frame = spark.createDataFrame([(i, f"k{i}", row.tolist()) for i, row in enumerate(x)], "id long, `a key` string, features array<double>")
    got = {r["id"]: r for r in tree_paths.explained(frame, "features", ["id", "a key"], paths).collect()}
    assert sorted(got) == list(range(600)) and got[7]["a key"] == "k7"
    want = paths.contributions(x)
    assert all(got[i]["contributions"] == pytest.approx(want[i]) for i in range(600))
    assert tree_paths.explained(frame.limit(0), "features", ["id"], paths).count() == 0


def test_more_than_two_categories_are_refused(spark):
    nodes = [(0, 1.0, 0, 0.0, 9.0, 1, 2, 0, 1.0, 3), (0, 1.0, 1, 1.0, 4.0, -1, -1, -1, None, -1), (0, 1.0, 2, 2.0, 5.0, -1, -1, -1, None, -1)]
    with pytest.raises(Exception, match="3 categories"):
        tree_paths.leaf_paths(spark.createDataFrame(nodes, NODES)).collect()
