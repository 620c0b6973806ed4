"""Tree SHAP (M11): what each feature adds to a tree ensemble's score, row by row.

A leaf's path asks one interval of each feature on it.  With the other
features unknown, a row reaches the leaf with the share of training rows that
took the same turns, so a leaf's game has as many players as its path has
features.  The sum over subsets of players is the integral over t from 0 to 1 of
a product with one factor for each player: met * t + share * (1 - t).  That is a
polynomial in t, which Gauss-Legendre nodes integrate exactly, so n players take
about n * n / 2 steps and not 2^n.  The leaf table of an ensemble is bounded by
its size (trees x 2^depth) and travels with the function; rows are scored in
batches without a shuffle."""

from __future__ import annotations

import math
import sys
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import cloudpickle
from pyspark.sql import DataFrame

# Tasks get these functions by value: executors need not have the package.
cloudpickle.register_pickle_by_value(sys.modules[__name__])


@dataclass
class Leaf:
    """``value`` for rows with low < x <= high in every feature of ``path``; ``share`` of the parent's rows kept by that feature's turns."""

    value: float
    path: dict[int, tuple[float, float, float]]  # feature -> (low, high, share)


def leaves_of(model) -> list[Leaf]:
    """Leaf table of an MLlib tree ensemble: class-1 probabilities of a forest, margins or values of boosted trees."""
    weights = list(model.treeWeights)
    total = sum(weights) if "RandomForest" in type(model).__name__ else 1.0
    by_class = "RandomForestClassification" in type(model).__name__
    out: list[Leaf] = []

    def walk(node, weight, path):
        if node.getClass().getSimpleName() == "LeafNode":
            if by_class:
                stats = list(node.impurityStats().stats())
                value = stats[1] / sum(stats) if sum(stats) else 0.0
            else:
                value = node.prediction()
            out.append(Leaf(value * weight, dict(path)))
            return
        split, cover = node.split(), node.impurityStats().count()
        feature, at = split.featureIndex(), split.threshold()
        low, high, share = path.get(feature, (-math.inf, math.inf, 1.0))
        for child, bounds in ((node.leftChild(), (low, min(high, at))), (node.rightChild(), (max(low, at), high))):
            kept = share * child.impurityStats().count() / cover
            walk(child, weight, {**path, feature: (*bounds, kept)})

    for tree, weight in zip(model.trees, weights):
        walk(tree._call_java("rootNode"), weight / total, {})
    return out


def base_value(leaves: list[Leaf]) -> float:
    """The score with every feature unknown."""
    return sum(leaf.value * math.prod(share for _, _, share in leaf.path.values()) for leaf in leaves)


def contributions(leaves: list[Leaf], x: np.ndarray) -> np.ndarray:
    """Shapley values (rows x features) of the ensemble's score."""
    out = np.zeros(x.shape)
    nodes = {n: np.polynomial.legendre.leggauss(-(-n // 2)) for n in {len(leaf.path) for leaf in leaves} if n}
    for leaf in leaves:
        if not leaf.path:
            continue
        at, weight = nodes[len(leaf.path)]
        t = (at + 1) / 2
        met = [(x[:, f] > low) & (x[:, f] <= high) for f, (low, high, _) in leaf.path.items()]
        shares = [share for _, _, share in leaf.path.values()]
        factors = [np.where(m[:, None], t, 0.0) + share * (1 - t) for m, share in zip(met, shares)]
        # the product of all factors but one, from those before it and those after it
        after = [np.ones((len(x), len(t)))]
        for factor in reversed(factors[1:]):
            after.append(after[-1] * factor)
        before = np.ones((len(x), len(t)))
        for f, m, share, factor, rest in zip(leaf.path, met, shares, factors, reversed(after)):
            out[:, f] += leaf.value * (m - share) * ((before * rest) @ (weight / 2))
            before = before * factor
    return out


def shap_values(model, table: DataFrame, cols: list[str], keys: tuple[str, ...] = ("entity", "period")) -> DataFrame:
    """(keys, base, one column per feature, score): base plus the features' values is the ensemble's score."""
    leaves = leaves_of(model)
    base = base_value(leaves)
    kinds = dict(table.dtypes)
    schema = ", ".join([*(f"{k} {kinds[k]}" for k in keys), "base double", *(f"{c} double" for c in cols), "score double"])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            values = contributions(leaves, b[list(cols)].to_numpy(float))
            out = b[list(keys)].copy()
            out["base"] = base
            out[list(cols)] = values
            out["score"] = base + values.sum(axis=1)
            yield out

    return table.select(*keys, *cols).mapInPandas(run, schema)
