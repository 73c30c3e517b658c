"""Newton boosting of depth-limited trees, many fits in step.

The objective is the weighted logistic loss with an L2 term on leaf weights;
a leaf's weight is -G / (H + l2) and a split's gain the usual difference of
G^2 / (H + l2), from sums of first and second derivatives. Several fits, one
a setting and fold, grow together: a round is the same few jobs for all of
them (see :mod:`loanlens.operators.grow`).

* The table is written once as blocks of records: bin numbers (at most
  ``max_bins`` quantile bins a feature), label, fold and a hash. A block also
  carries the margins of every fit, and a round's trees are added to them at
  the next round's first pass. Held-out records of a fold are not summed but
  have margins too, so a fit of 300 rounds is scored at 100 and 200 rounds
  from its own prefix of trees, without another fit.
* Derivatives are rounded to multiples of 2^-20, so that their sums are exact
  in doubles (up to 2^31 records a node) and do not depend on how the records
  are dealt over tasks: reruns, joint fits and separate fits agree.
* Margins are kept by ``persist`` and every ``CUT`` rounds by ``checkpoint``
  in the shared folder, so a lost executor repeats at most that many rounds.
  This is the one place with RDD code: iterative per-partition numpy state,
  hundreds of short passes (a DataFrame pass takes 2 to 3 times as long to
  plan and start).

Subsampling takes a record in a round if a hash of (record, round) lies under
the rate: the same records for every fit with the rate.
"""

from __future__ import annotations

import uuid
from dataclasses import dataclass, field

import numpy as np
from pyspark.sql import DataFrame

from loanlens.operators.grow import Nodes, Rule, grow
from loanlens.operators.trees import MAX_BINS, PART, Binned, Block, Tree, TreesModel, uniform
from loanlens.session import scratch_path

UNIT = float(1 << 20)   # derivatives are whole multiples of 1 / UNIT
CUT = 25                # rounds between checkpoints
WIDE = 1 << 18          # margins of a task, where there are more tasks than cores: starting a task costs as much as 2 ** 17 or so
PASSES = 4              # a fit's many passes over the blocks are worth more tasks than one pass


@dataclass(frozen=True)
class Setting:
    """One fit. ``fold``: the fold held out, None to fit on all records."""
    max_depth: int = 6
    eta: float = 0.3
    subsample: float = 1.0
    fold: int | None = None
    l2: float = 1.0
    min_child: float = 1.0


@dataclass
class Scored(Block):
    """A block with a row of margins a fit."""
    margin: np.ndarray


def derivatives(margin: np.ndarray, y: np.ndarray, weight: float) -> tuple[np.ndarray, np.ndarray]:
    """First and second derivative of the weighted logistic loss, in units of 1 / UNIT."""
    p = 1.0 / (1.0 + np.exp(-margin.astype(np.float64)))
    w = np.where(y, weight, 1.0) * UNIT
    whole = np.int32 if weight < 1024 else np.int64
    return np.rint(w * (p - y)).astype(whole), np.maximum(np.rint(w * p * (1.0 - p)), 1.0).astype(whole)


def _added(block: Scored, nodes: Nodes, value: np.ndarray) -> Scored:
    """The block with a round's trees added to its margins."""
    margin = block.margin + value[nodes.walk(block.x, np.arange(len(block.margin)))]
    return Scored(block.y, block.fold, block.key, block.x, margin)


@dataclass
class Training:
    """The state of fits that grow together; :meth:`run` adds rounds."""
    binned: Binned
    settings: list[Setting]
    rule: Rule
    weight: float               # of positive records
    seed: int
    blocks: object = None
    rounds: int = 0
    trees: dict[int, list[Tree]] = field(default_factory=dict)
    _files: list[str] = field(default_factory=list)
    _before: list = field(default_factory=list)

    @classmethod
    def start(cls, df: DataFrame, settings: list[Setting], label: str = "label", features: str = "features",
              fold: str | None = None, key: str | None = None, max_bins: int = MAX_BINS, seed: int = 42) -> "Training":
        """Bin and write the table. Trees are kept for the fits without a held-out fold; positives
        weigh negatives / positives of the whole table. Labels other than 1 count as negative."""
        fits = len(settings)
        binned = Binned.write(df, label, features, fold, key, max_bins, fits * PASSES, max(PART, WIDE // fits))
        neg, pos = binned.class_counts(None)
        of = lambda name: np.array([getattr(s, name) for s in settings], np.float64)
        rule = Rule("newton", of("max_depth").astype(np.int64), of("min_child"), of("l2"), np.ones((fits, 2)),
                    np.arange(fits, dtype=np.uint64), 0, UNIT)
        out = cls(binned, list(settings), rule, neg / pos if pos else 1.0, seed)
        out.blocks = binned.blocks().map(
            lambda b: Scored(b.y, b.fold, b.key, b.x, np.zeros((fits, len(b.y)), np.float32))).persist()
        out.trees = {i: [] for i, s in enumerate(settings) if s.fold is None}
        return out

    @property
    def held_out(self) -> np.ndarray:
        """Fold held out by each fit; records without a fold are marked -1 and held out by none."""
        return np.array([-2 if s.fold is None else s.fold for s in self.settings])

    def run(self, until: int) -> "Training":
        """Grow all fits to ``until`` rounds."""
        while self.rounds < until:
            self._round()
        return self

    def _round(self) -> None:
        s, salt, weight, held_out = self.settings, self.seed + self.rounds, self.weight, self.held_out
        rate = np.array([x.subsample for x in s])

        def evidence(block: Scored, fits: np.ndarray):
            used = block.fold != held_out[fits][:, None]
            if (rate[fits] < 1).any():
                used &= uniform(block.key, salt) < rate[fits][:, None]
            g, h = derivatives(block.margin[fits], block.y, weight)
            return used, g, h
        records = np.array([sum(self.binned.class_counts(x.fold)) for x in s])
        nodes = grow(self.blocks, self.binned, len(s), evidence, self.rule, records, self._computed)
        eta, l2 = (np.array([getattr(x, f) for x in s]) for f in ("eta", "l2"))
        value = (-eta[nodes.root] * nodes.a / (nodes.b + l2[nodes.root] * UNIT)).astype(np.float32)
        for i, kept in self.trees.items():
            kept.append(tree_of(nodes, i, value, self.binned.edges))
        self._before.append(self.blocks)
        self.blocks = self.blocks.map(lambda b: _added(b, nodes, value)).persist()
        self.rounds += 1
        if self.rounds % CUT == 0:
            self.blocks.checkpoint()

    def _computed(self) -> None:
        """Called when a pass over ``blocks`` is done: what they came from goes."""
        for old in self._before:
            old.unpersist()
        if self._before and self.rounds % CUT == 0 and (path := self.blocks.getCheckpointFile()):
            for old in self._files:
                self.binned.delete(old)
            self._files = [path]
        self._before.clear()

    # -------------------------------------------------------------- results
    def held_out_counts(self) -> list[tuple[int, int, int, int]]:
        """(tp, fp, tn, fn) of each fit on its held-out fold at a probability of one half, now."""
        fold = self.held_out

        def count(blocks):
            total = np.zeros((len(fold), 4), np.int64)
            for b in blocks:
                out, hit, y = b.fold == fold[:, None], b.margin >= 0, b.y == 1
                total += np.stack([(out & hit & y).sum(1), (out & hit & ~y).sum(1), (out & ~hit & ~y).sum(1), (out & ~hit & y).sum(1)], 1)
            yield total
        return [tuple(r) for r in self.blocks.mapPartitions(count).treeReduce(lambda a, b: a + b).tolist()]

    def held_out_scores(self) -> DataFrame:
        """(fit, label, score) of every fit's held-out records, now."""
        fold = self.held_out

        def rows(b: Scored):
            for i, f in enumerate(fold.tolist()):
                at = np.flatnonzero(b.fold == f)
                p = 1.0 / (1.0 + np.exp(-b.margin[i, at].astype(np.float64)))
                yield from ((i, int(y), float(s)) for y, s in zip(b.y[at], p, strict=True))
        spark = self.binned.spark
        path = scratch_path(spark, f"boost-scores-{uuid.uuid4().hex[:12]}")
        spark.createDataFrame(self.blocks.flatMap(rows), "fit int, label int, score double").write.parquet(path)
        return spark.read.parquet(path)

    def model(self, fit: int = 0, rounds: int | None = None) -> TreesModel:
        """The fit's model, or that of its first ``rounds`` rounds."""
        return TreesModel(self.trees[fit][:rounds], len(self.binned.edges), "sum")

    def close(self) -> None:
        """Give up the kept blocks and delete the written ones."""
        self.blocks.unpersist()
        for path in [*self._files, self.binned.path]:
            self.binned.delete(path)


def tree_of(nodes: Nodes, root: int, value: np.ndarray, edges: list[list[float]]) -> Tree:
    """One tree out of ``nodes``, with thresholds in the features' own values."""
    at = np.flatnonzero(nodes.root == root)
    place = np.zeros(len(nodes.root), np.int64)
    place[at] = np.arange(len(at))
    feature = nodes.feature[at]
    threshold = np.array([edges[f][c] if f >= 0 else 0.0 for f, c in zip(feature.tolist(), nodes.cut[at].tolist(), strict=True)])
    left = np.where(feature >= 0, place[nodes.left[at]], 0)
    return Tree(feature, threshold, left, nodes.gain[at], value[at])
