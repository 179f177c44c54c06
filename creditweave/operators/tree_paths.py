"""Contributions of boosted trees, from the paths of their leaves.

A leaf is reached by a row if the row lies inside the leaf's interval for every feature on its path.
A feature the row's coalition doesn't know lets the share of training rows through that went
the leaf's way. The Shapley value of feature i for a leaf of value v is therefore

    v * (inside_i - share_i) * sum over k of k! (d-1-k)! / d! * c_k,

where c_k are the coefficients of the path's polynomial, the product over the other features
of (share_j + inside_j * y). As k! (d-1-k)! / d! is the integral of t^k (1-t)^(d-1-k) from 0 to 1, the sum is the
integral of the product of share_j * (1-t) + inside_j * t. Its degree is below d, so Gauss-Legendre points,
half as many as the path has features, give it exactly: the path is extended by multiplying
its factors at each point and unwound by dividing by one of them. No table of coalitions is needed, and work
and memory grow with the path's length, not with two to its power.

The saved model's node table is read as a frame; paths are made per tree in tasks. They are as large as
the model (trees x leaves x depth, all parameters of the fit), and that is all the driver sees.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

# Rows that are explained at once, so that a tree's arrays stay in the cache.
CHUNK = 256

_STEPS = pa.schema(
    [
        ("tree", pa.int32()),
        ("leaf", pa.int32()),
        ("value", pa.float64()),
        ("feature", pa.int32()),
        ("low", pa.float64()),
        ("high", pa.float64()),
        ("share", pa.float64()),
    ]
)
_STEPS_DDL = "tree int, leaf int, value double, feature int, low double, high double, share double"


def saved_nodes(spark, path: str) -> DataFrame:
    """(tree, weight, id, value, rows, left, right, feature, cut, categories) of a saved tree ensemble."""
    weights = spark.read.parquet(f"{path}/treesMetadata").toDF("treeID", "metadata", "weight").drop("metadata")
    nodes = spark.read.parquet(f"{path}/data").select("treeID", "nodeData.*")
    return nodes.join(F.broadcast(weights), "treeID").select(
        F.col("treeID").alias("tree"),
        "weight",
        "id",
        F.col("prediction").alias("value"),
        F.col("impurityStats")[0].alias("rows"),
        F.col("leftChild").alias("left"),
        F.col("rightChild").alias("right"),
        F.col("split.featureIndex").alias("feature"),
        F.get("split.leftCategoriesOrThreshold", F.lit(0)).alias("cut"),
        F.col("split.numCategories").alias("categories"),
    )


def _paths_of_tree(table: pa.Table) -> pa.Table:
    """A row for each leaf and feature on its path: the interval and the share of rows let through.

    A tree of a single leaf has one row without a feature.
    """
    nodes = {n["id"]: n for n in table.to_pylist()}
    out: list[dict] = []
    waiting: list[tuple[int, dict[int, tuple[float, float, float]]]] = [(min(nodes), {})]
    while waiting:
        at, path = waiting.pop()
        node = nodes[at]
        if node["left"] < 0:
            head = {"tree": node["tree"], "leaf": at, "value": node["value"] * node["weight"]}
            steps = path.items() or [(-1, (-math.inf, math.inf, 1.0))]
            out += [head | {"feature": f, "low": low, "high": high, "share": share} for f, (low, high, share) in steps]
            continue
        feature, cut, swapped = node["feature"], node["cut"], False
        if node["categories"] > 2:
            raise ValueError(f"Feature {feature} is split by {node['categories']} categories; encoded columns hold 0 or 1")
        if node["categories"] >= 0:  # the left side holds either 0 or 1
            cut, swapped = 0.5, cut == 1.0
        for child, above in ((node["left"], swapped), (node["right"], not swapped)):
            low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
            share *= nodes[child]["rows"] / node["rows"]
            step = (max(low, cut), high, share) if above else (low, min(high, cut), share)
            waiting.append((child, path | {feature: step}))
    return pa.Table.from_pylist(out, schema=_STEPS)


def leaf_paths(nodes: DataFrame) -> DataFrame:
    """The steps of all leaves' paths, made tree by tree in tasks."""
    return nodes.groupBy("tree").applyInArrow(_paths_of_tree, _STEPS_DDL)


@dataclass(frozen=True)
class _Tree:
    """Leaves by features, padded with steps that let everything through."""

    features: np.ndarray
    low: np.ndarray
    high: np.ndarray
    share: np.ndarray
    value: np.ndarray
    order: np.ndarray  # of all steps by feature
    starts: np.ndarray
    columns: np.ndarray


@dataclass(frozen=True)
class Paths:
    trees: tuple[_Tree, ...]
    base: float  # what the ensemble gives when no feature is known
    points: np.ndarray
    weights: np.ndarray

    def contributions(self, x: np.ndarray) -> np.ndarray:
        """(rows, features) Shapley values of encoded rows."""
        total = np.zeros(x.shape)
        for start in range(0, len(x), CHUNK):
            part = x[start : start + CHUNK]
            for tree in self.trees:
                value = part[:, tree.features]
                inside = (value > tree.low) & (value <= tree.high)
                found = np.zeros(inside.shape)
                for t, weight in zip(self.points, self.weights, strict=True):
                    passed = tree.share * (1 - t)
                    factors = np.where(inside, passed + t, passed)
                    found += (weight * factors.prod(2))[:, :, None] / factors
                found *= (inside - tree.share) * tree.value[:, None]
                flat = found.reshape(len(part), -1)[:, tree.order]
                total[start : start + len(part), tree.columns] += np.add.reduceat(flat, tree.starts, axis=1)
        return total


def collected(steps: DataFrame) -> Paths:
    """Arrays of all trees; as many numbers as the model has leaves times their depth."""
    table = steps.toPandas().sort_values(["tree", "leaf", "feature"], kind="stable")
    trees, base, deepest = [], 0.0, 1
    for _, rows in table.groupby("tree", sort=True):
        shares = rows.groupby("leaf", sort=True)["share"].prod().to_numpy()
        values = rows.groupby("leaf", sort=True)["value"].first().to_numpy()
        base += float((shares * values).sum())
        if (rows["feature"] < 0).all():
            continue
        leaf = np.unique(rows["leaf"].to_numpy(), return_inverse=True)[1]
        place = rows.groupby("leaf").cumcount().to_numpy()
        shape = (leaf.max() + 1, place.max() + 1)
        deepest = max(deepest, shape[1])

        def spread(name: str, rest: float, shape=shape, leaf=leaf, place=place, rows=rows) -> np.ndarray:
            out = np.full(shape, rest)
            out[leaf, place] = rows[name].to_numpy()
            return out

        features = spread("feature", 0).astype(np.int64)
        order = np.argsort(features.ravel(), kind="stable")
        columns, starts = np.unique(features.ravel()[order], return_index=True)
        share = spread("share", 1.0)
        trees.append(_Tree(features, spread("low", -math.inf), spread("high", math.inf), share, values, order, starts, columns))
    # n points are exact up to degree 2n - 1; a path of d features has degree d - 1.
    points, weights = np.polynomial.legendre.leggauss(max(1, -(-deepest // 2)))
    return Paths(tuple(trees), base, (points + 1) / 2, weights / 2)


def explained(rows: DataFrame, features: str, keys: list[str], paths: Paths) -> DataFrame:
    """(keys, contributions) for rows whose array column `features` is encoded."""
    shared = rows.sparkSession.sparkContext.broadcast(paths)

    def explain(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            if len(batch):
                found = shared.value.contributions(np.stack(batch[features].to_numpy()))
                yield batch[keys].assign(contributions=list(found))

    fields = ", ".join(f"`{name}` {kind}" for name, kind in rows.select(*keys).dtypes)
    return rows.select(*keys, features).mapInPandas(explain, f"{fields}, contributions array<double>")
