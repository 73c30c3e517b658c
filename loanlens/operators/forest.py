"""Random forests over binned blocks.

Every tree has its own bootstrap (Poisson counts from a hash of record and
tree) and tries ceil(sqrt(features)) features at a node, drawn by a hash of
the node's path; splits lower the class-weighted Gini impurity. Trees grow as
:mod:`loanlens.operators.grow` describes: large nodes by passes over all
records, small ones each in one task.

Nothing in a tree depends on the number of trees, and a depth limit only cuts
it, so one fit of 300 trees and depth 20 also gives the forests of its first
100 and 200 trees and of depth 10 and 15, exactly as separate fits would.
"""

from __future__ import annotations

import math
import uuid
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame, SparkSession

from loanlens.operators.boosting import tree_of
from loanlens.operators.grow import Nodes, Rule, grow
from loanlens.operators.pieces import PiecesModel, keep, share
from loanlens.operators.trees import MAX_BINS, Binned, Block, TreesModel, mixed, salted
from loanlens.session import scratch_path


HELD = 1 << 27          # records times trees, up to which the driver holds a forest's trees

# Poisson(1): chance of at most 0, 1, 2, ... copies of a record in a bootstrap.
_COPIES = np.cumsum([math.exp(-1) / math.factorial(k) for k in range(12)])
# Copies by the first 12 bits of a hash; 255 where more bits decide.
_EDGES = np.stack([np.searchsorted(_COPIES, np.arange(4096) / 4096 + d, side="right") for d in (0.0, 1 / 4096)])
_BY_BITS = np.where(_EDGES[0] == _EDGES[1], _EDGES[0], 255).astype(np.uint8)


def copies_of(mixed_key: np.ndarray, salt: int) -> np.ndarray:
    """Copies of records in a bootstrap: ``searchsorted(_COPIES, uniform(key, salt), "right")``."""
    h = salted(mixed_key, salt)
    out = _BY_BITS[h >> np.uint64(52)]
    at = np.flatnonzero(out == 255)
    out[at] = np.searchsorted(_COPIES, (h[at] >> np.uint64(11)) * 2.0 ** -53, side="right")
    return out


@dataclass(frozen=True)
class Forest:
    """One fit. ``fold``: the fold held out; ``balanced``: classes weigh alike."""
    trees: int = 100
    max_depth: int = 30
    min_leaf: int = 1
    fold: int | None = None
    balanced: bool = True
    seed: int = 42

    def weights(self, binned: Binned) -> np.ndarray:
        neg, pos = binned.class_counts(self.fold)
        if not self.balanced or not neg or not pos:
            return np.ones(2)
        return np.array([(neg + pos) / (2 * neg), (neg + pos) / (2 * pos)])

    def grow(self, blocks, binned: Binned) -> "Grown":
        """Grow the forest's trees over an RDD of blocks."""
        nodes = self._grown(blocks, binned)
        value = share(nodes.a, nodes.b, self.weights(binned))
        nodes.a = nodes.b = None
        return Grown(self, nodes, value)

    def keep(self, blocks, binned: Binned) -> PiecesModel:
        """Grow the forest's trees into the shared folder."""
        return keep(binned.spark, lambda kept: self._grown(blocks, binned, kept=kept), self.weights(binned), self.trees, binned.edges)

    def importances(self, blocks, binned: Binned) -> np.ndarray:
        """Share of the gain of each feature; every tree counts alike. The trees stay in their tasks."""
        return shares(self._grown(blocks, binned, only_gains=True))

    def _grown(self, blocks, binned: Binned, only_gains: bool = False, kept=None):
        held_out, seed = -2 if self.fold is None else self.fold, self.seed

        def evidence(block: Block, trees: np.ndarray):
            if (key := block.__dict__.get("mixed_key")) is None:
                key = block.mixed_key = mixed(block.key)
            copies = np.stack([copies_of(key, (seed << 20) + t) for t in trees.tolist()])
            used = (block.fold != held_out) & (copies > 0)
            one = (block.y == 1).astype(np.uint8)
            return used, copies * (1 - one), copies * one
        n, dim, every = self.trees, len(binned.edges), np.ones(self.trees)
        w = self.weights(binned)
        key = mixed(np.arange(n, dtype=np.uint64) + np.uint64(seed << 20))
        rule = Rule("gini", (every * self.max_depth).astype(np.int64), every * self.min_leaf, every, np.tile(w, (n, 1)), key,
                    max(1, math.ceil(math.sqrt(dim))))
        return grow(blocks, binned, n, evidence, rule, np.full(n, sum(binned.class_counts(self.fold))), only_gains=only_gains,
                    kept=kept)


def shares(gains: np.ndarray) -> np.ndarray:
    """Share of the gain of each feature out of (trees, features) sums; every tree counts alike."""
    all_ = gains.sum(axis=1, keepdims=True)
    one = np.divide(gains, all_, out=np.zeros(gains.shape), where=all_ > 0).sum(axis=0)
    return one / one.sum() if one.sum() else one


@dataclass
class Grown:
    """The trees of one fit; ``value`` is the share of class 1 at every node."""
    forest: Forest
    nodes: Nodes
    value: np.ndarray

    def model(self, binned: Binned) -> TreesModel:
        trees = [tree_of(self.nodes, t, self.value, binned.edges) for t in range(self.forest.trees)]
        return TreesModel(trees, len(binned.edges), "mean")

    def importances(self, dim: int) -> np.ndarray:
        """Share of the gain of each feature; every tree counts alike."""
        n, at = self.forest.trees, self.nodes.feature >= 0
        one = np.bincount(self.nodes.root[at] * dim + self.nodes.feature[at], self.nodes.gain[at], n * dim).reshape(n, dim)
        return shares(one)

    def held_out_counts(self, blocks, depths: list[int], sizes: list[int]) -> dict[tuple[int, int], tuple[int, int, int, int]]:
        """(tp, fp, tn, fn) on the held-out fold at one half, for each (depth, number of trees)."""
        nodes, value, fold, n = self.nodes, self.value, self.forest.fold, self.forest.trees
        slim = Nodes(None, None, None, None, nodes.feature, nodes.cut, nodes.left, None)

        def count(part):
            total = np.zeros((len(depths), len(sizes), 4), np.int64)
            for b in part:
                at = np.flatnonzero(b.fold == fold)
                y = b.y[at] == 1
                for i, d in enumerate(depths):
                    p = np.cumsum(value[slim.walk(b.x[:, at], np.arange(n), d)], axis=0)
                    for j, size in enumerate(sizes):
                        hit = p[size - 1] >= 0.5 * size
                        total[i, j] += [(hit & y).sum(), (hit & ~y).sum(), (~hit & ~y).sum(), (~hit & y).sum()]
            yield total
        got = blocks.mapPartitions(count).treeReduce(lambda a, b: a + b)
        return {(d, s): tuple(got[i, j].tolist()) for i, d in enumerate(depths) for j, s in enumerate(sizes)}


    def held_out_scores(self, spark: SparkSession, blocks) -> DataFrame:
        """(label, score) of the held-out fold, written."""
        nodes, value, fold, n = self.nodes, self.value, self.forest.fold, self.forest.trees
        slim = Nodes(None, None, None, None, nodes.feature, nodes.cut, nodes.left, None)

        def rows(b: Block):
            at = np.flatnonzero(b.fold == fold)
            p = value[slim.walk(b.x[:, at], np.arange(n))].mean(axis=0)
            return zip(b.y[at].tolist(), p.tolist(), strict=True)
        path = scratch_path(spark, f"forest-scores-{uuid.uuid4().hex[:12]}")
        spark.createDataFrame(blocks.flatMap(rows), "label int, score double").write.parquet(path)
        return spark.read.parquet(path)


def grow_forest(df: DataFrame, forest: Forest, label: str = "label", features: str = "features", key: str | None = None,
                max_bins: int = MAX_BINS) -> tuple[Grown, Binned]:
    """Grow one forest on all records; the written blocks are deleted."""
    binned = Binned.write(df, label, features, None, key, max_bins, forest.trees)
    blocks = binned.blocks().persist()
    grown = forest.grow(blocks, binned)
    blocks.unpersist()
    binned.delete()
    return grown, binned


def forest_importances(df: DataFrame, forest: Forest, label: str = "label", features: str = "features", key: str | None = None,
                       max_bins: int = MAX_BINS) -> np.ndarray:
    """Importances of one forest grown on all records, without its trees."""
    binned = Binned.write(df, label, features, None, key, max_bins, forest.trees)
    blocks = binned.blocks().persist()
    out = forest.importances(blocks, binned)
    blocks.unpersist()
    binned.delete()
    return out


def fit_forest(df: DataFrame, forest: Forest, label: str = "label", features: str = "features", key: str | None = None,
               max_bins: int = MAX_BINS) -> "TreesModel | PiecesModel":
    """Fit one forest on all records; the trees of a large one (``HELD``) stay in the shared folder."""
    binned = Binned.write(df, label, features, None, key, max_bins, forest.trees)
    blocks = binned.blocks().persist()
    large = sum(binned.counts.values()) * forest.trees > HELD
    model = forest.keep(blocks, binned) if large else forest.grow(blocks, binned).model(binned)
    blocks.unpersist()
    binned.delete()
    return model
