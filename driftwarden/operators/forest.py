"""Isolation forest (Liu, Ting, Zhou 2008): trees grown in parallel, scored in Arrow batches."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark import Broadcast
from pyspark.sql import DataFrame, Window, functions as F, types as T

from .. import fixed_values as fv
from ..session import hash_spread

TREE = ("tree int, sample_size int, feature array<int>, threshold array<double>, "
        "left array<int>, right array<int>, path array<double>")
EULER = 0.5772156649015329


def expected_path(n) -> np.ndarray:
    """Mean path length of an unsuccessful search among n points."""
    n = np.asarray(n, dtype=float)
    big = np.maximum(n, 3.0)
    full = 2.0 * (np.log(big - 1.0) + EULER) - 2.0 * (big - 1.0) / big
    return np.where(n <= 1, 0.0, np.where(n <= 2, 1.0, full))


def tree_samples(rows: DataFrame, keys: list[str], trees: int, size: int, seed: int) -> DataFrame:
    """`size` rows per tree without replacement, drawn by every tree from all rows.

    A row's draw for a tree is a hash of its keys and the tree.  A row goes only to the trees whose draw is
    below three times the share a tree takes (a tree then gets 3 x size rows on average), and
    the smallest `size` draws of a tree stay.
    """
    span = 1 << 30
    total = rows.agg(F.count(F.lit(1))).scalar()
    narrow = rows.withColumn("_key", F.xxhash64(*keys, F.lit(seed + 1))).withColumn("_most", F.lit(3.0 * size * span) / total)

    def draw(tree):
        return F.pmod(F.xxhash64("_key", tree), F.lit(span))

    trees_of = F.filter(F.sequence(F.lit(0), F.lit(trees - 1)), lambda t: draw(t) < F.col("_most"))
    drawn = narrow.withColumn("tree", F.explode(trees_of)).withColumn("_h", draw(F.col("tree")))
    rank = F.row_number().over(Window.partitionBy("tree").orderBy("_h", *keys))
    return drawn.withColumn("_rank", rank).filter(F.col("_rank") <= size).drop("_h", "_rank", "_key", "_most")


def grow(x: np.ndarray, rng: np.random.Generator, max_depth: int) -> dict[str, list]:
    tree = {"feature": [], "threshold": [], "left": [], "right": [], "path": []}
    todo = [(np.arange(len(x)), 0, -1, "")]
    while todo:
        rows, depth, parent, side = todo.pop()
        node = len(tree["feature"])
        if parent >= 0:
            tree[side][parent] = node
        lo, hi = x[rows].min(axis=0), x[rows].max(axis=0)
        usable = np.flatnonzero(hi > lo)
        leaf = depth >= max_depth or len(rows) <= 1 or len(usable) == 0
        f = -1 if leaf else int(rng.choice(usable))
        cut = 0.0 if leaf else float(rng.uniform(lo[f], hi[f]))
        for name, value in (("feature", f), ("threshold", cut), ("left", node), ("right", node),
                            ("path", depth + float(expected_path(len(rows))))):
            tree[name].append(value)
        if not leaf:
            below = x[rows, f] <= cut
            todo += [(rows[below], depth + 1, node, "left"), (rows[~below], depth + 1, node, "right")]
    return tree


def fit_forest(rows: DataFrame, features: list[str], keys: list[str], trees: int = fv.FOREST_TREES,
               size: int = fv.FOREST_SAMPLE, seed: int = 42) -> DataFrame:
    """One row of node arrays per tree; each tree is grown in its own task group of at most
    `size` rows."""
    def build(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = pdf.sort_values(keys)[features].to_numpy(float)
        depth = math.ceil(math.log2(max(len(x), 2)))
        tree = grow(x, np.random.default_rng([seed, int(key[0])]), depth)
        return pd.DataFrame([{"tree": key[0], "sample_size": len(x), **tree}])

    samples = tree_samples(rows.select(*keys, *features), keys, trees, size, seed)
    return hash_spread(samples, "tree", most=trees).groupBy("tree").applyInPandas(build, TREE)


class Forest:
    """Node arrays of all trees, padded to one matrix per field."""

    def __init__(self, trees: list):
        width = max(len(t["feature"]) for t in trees)

        def pad(name, kind):
            return np.stack([np.pad(np.asarray(t[name], dtype=kind), (0, width - len(t[name]))) for t in trees])

        first = np.arange(len(trees))[:, None] * width          # nodes of all trees in one row; a tree's root
        self.feature, self.threshold = pad("feature", np.int64), pad("threshold", float)
        self.feature = np.maximum(self.feature, 0).ravel()
        self.threshold, self.path = self.threshold.ravel(), pad("path", float).ravel()
        # a node's right and left child, side by side
        self.child = np.stack([pad("right", np.int64) + first, pad("left", np.int64) + first], axis=2).ravel()
        self.roots = first[:, 0]
        sizes = [t["sample_size"] for t in trees]
        self.normal = float(expected_path(max(sizes)))
        self.depth = math.ceil(math.log2(max(max(sizes), 2)))

    def score(self, x: np.ndarray, block: int = 256) -> np.ndarray:
        out = np.empty(len(x))
        for lo in range(0, len(x), block):
            rows = np.ascontiguousarray(x[lo:lo + block])
            base = (np.arange(len(rows)) * x.shape[1])[:, None]
            flat = rows.ravel()
            node = np.broadcast_to(self.roots, (len(rows), len(self.roots)))
            for _ in range(self.depth):              # a leaf points to itself
                value = np.take(flat, np.take(self.feature, node, mode="clip") + base, mode="clip")
                below = value <= np.take(self.threshold, node, mode="clip")
                node = np.take(self.child, 2 * node + below, mode="clip")
            out[lo:lo + block] = 2.0 ** (-np.take(self.path, node, mode="clip").mean(axis=1) / self.normal)
        return out


def shared_forest(forest: DataFrame) -> Broadcast:
    """The forest on every executor: trees x (2 x sample size) nodes whatever the data size, so it is collected and broadcast."""
    return forest.sparkSession.sparkContext.broadcast(Forest([r.asDict() for r in forest.orderBy("tree").collect()]))


def forest_score(df: DataFrame, forest: DataFrame | Broadcast, features: list[str], name: str = "raw_if") -> DataFrame:
    """Adds the anomaly score (higher = easier to isolate); `forest` is its table, or what `shared_forest` made of it."""
    shared = forest if isinstance(forest, Broadcast) else shared_forest(forest)

    @F.pandas_udf(T.DoubleType())
    def score(*cols: pd.Series) -> pd.Series:
        return pd.Series(shared.value.score(np.column_stack([c.to_numpy(float) for c in cols])))

    return df.withColumn(name, score(*[F.col(c) for c in features]))
