import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from creditweave.llm import negatives, queries
from creditweave.llm.negatives import Lists, Mining, best_rows, hard_negatives

SCHEMA = "vec_id bigint, embedding array<double>, label int, anchor string, vector string, rank int"


def held(score):
    return min(max(score, -(2**63)), 2**63 - 1)


def brute(rows, is_anchor, mining=Mining()):
    usable = {}
    for key, vector, label in rows:
        if key is None or label is None or vector is None:
            continue
        if all(x is not None and np.isfinite(x) for x in vector):
            usable[key, label, tuple(int(np.floor(mining.scale * x)) for x in vector)] = None

    def best(found, k):
        return sorted(found, key=lambda x: (-x[0], x[1]))[:k]

    out = []
    for key, label, v in usable:
        if not is_anchor(key):
            continue
        score = [(held(sum(a * b for a, b in zip(v, w, strict=False))), k, m == label) for k, m, w in usable if k != key]
        for top, positive, _ in best([s for s in score if s[2]], mining.positives):
            near = [s for s in score if not s[2] and mining.least * top <= 100 * s[0] <= mining.most * top]
            out += [(key, positive, i, k, top, s) for i, (s, k, _) in enumerate(best(near, mining.negatives), 1)]
    return sorted(out)


def mined(spark, rows, mining=Mining()):
    frame = spark.createDataFrame([(*r, "a", "b", 7) for r in rows], SCHEMA).repartition(3)
    found = hard_negatives(frame, F.col("key") % 5 == 0, mining=mining)
    assert found.columns == ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]
    return sorted(tuple(r) for r in found.collect())


def cloud(n, dims, seed, coarse=4):
    """Vectors on a coarse grid, so that many scores tie."""
    rng = np.random.default_rng(seed)
    return [(i, (np.round(rng.normal(0.3, 1, dims) * coarse) / coarse).tolist(), int(rng.integers(0, 3))) for i in range(n)]


@pytest.mark.parametrize("dims, coarse", [(1, 2), (3, 2), (16, 100)])
def test_equals_brute_force(spark, dims, coarse):
    rows = cloud(240, dims, dims, coarse)
    got = mined(spark, rows)
    assert got == brute(rows, lambda k: k % 5 == 0) and len(got) > 50


def test_blocks_of_few_components_change_nothing(spark, monkeypatch):
    rows = cloud(150, 4, 9)
    monkeypatch.setattr(negatives, "BLOCK_COMPONENTS", 64)
    assert mined(spark, rows) == brute(rows, lambda k: k % 5 == 0)


def test_awkward_rows(spark):
    nan, inf = float("nan"), float("inf")
    rows = cloud(60, 3, 5)
    rows += [
        (100, None, 1), (105, [1.0, None, 2.0], 1), (110, [1.0, nan, 0.0], 1), (115, [inf, 1.0, 0.0], 2),
        (120, [1.0, 1.0, 1.0], None), (None, [9.0, 9.0, 9.0], 1), (125, [], 1), (130, [0.0, 0.0, 0.0], 2),
        (135, [5.0], 1), (140, [1.0, 2.0, 3.0, 4.0], 0), (-5, [1.0, 1.0, 0.5], 1),
    ]
    # Repeated rows, and one key with two vectors and two labels.
    rows += [(20, [2.0, 2.0, 2.0], 1), (20, [2.0, 2.0, 2.0], 1), (20, [0.5, 2.0, 1.0], 2), rows[3], rows[5]]
    # A third of all rows is one vector.
    rows += [(200 + i, [1.0, 0.75, 0.5], i % 2) for i in range(40)]
    assert mined(spark, rows) == brute(rows, lambda k: k % 5 == 0)


def test_empty_table(spark):
    assert mined(spark, []) == [] and mined(spark, [(0, None, 1), (5, [1.0], 1)]) == []


def test_scores_beyond_floats_are_exact(spark):
    rng = random.Random(4)
    big = [(i, [rng.uniform(1, 2) * 2e6 + rng.random() for _ in range(3)], i % 2) for i in range(40)]
    assert mined(spark, big) == brute(big, lambda k: k % 5 == 0)
    # Products beyond 64 bits count as the largest long.
    huge = [(i, [3e5 * (i + 1) * (-1) ** i, 3e5 * i * i], i % 3) for i in range(40)]
    want = brute(huge, lambda k: k % 5 == 0)
    assert mined(spark, huge) == want and want


def test_search_stops_before_the_end_of_the_lists():
    rng = np.random.default_rng(1)
    x = np.floor(rng.normal(0, 100, (5000, 2)))
    lists = Lists(np.arange(5000), np.zeros(5000, np.int64), x)
    anchor = np.array([90.0, -40.0])
    read = []

    def usable(rows):
        read.append(len(rows))
        return np.ones(len(rows), bool)

    ((places, scores),) = best_rows(lists, anchor, usable, [(-np.inf, np.inf)], 5)
    every = x @ anchor
    assert list(places) == sorted(range(5000), key=lambda i: (-every[i], i))[:5]
    assert (scores == every[places]).all() and sum(read) < 1000


def test_query_moves_labels_of_every_seventh_row(spark, tmp_path):
    rows = [(i, v, label) for i, v, label in cloud(120, 4, 12)]
    spark.createDataFrame(rows, "vec_id bigint, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    moved = [(i, v, (label + 1) % 10 if i % 7 == 0 else label) for i, v, label in rows]
    got = sorted(tuple(r) for r in queries.hard_negatives(spark, str(tmp_path)).collect())
    assert got == brute(moved, lambda k: k % 50 == 0) and got
